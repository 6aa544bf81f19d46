"""Hybrid search: ranked lists from vectors, full text and the graph, fused, reranked and turned into contexts.

Rerankers and mappers are plugged in as plain functions over a bounded list of candidates; when one fails, the fused
order or the plain summaries stay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.functions.vector import cosine_raw, cosine_unit
from cinegraph.operators.retrieval import bm25, ranked, rrf, top

#: Texts in, scores out.
Reranker = Callable[[list[str]], list[float]]
#: Rows of a batch in, the answer's JSON out: [{"community": place in the batch, "points": [{"text", "score"}]}].
Mapper = Callable[[list[dict]], str]

#: Least similarity of each kind of vector, points that count, and the batch of a mapper.
NAME_AT, DESCRIPTION_AT, RELATION_AT, SEGMENT_AT, COMMUNITY_AT, MEDIA_AT = 0.5, 0.6, 0.5, 0.4, 0.3, 0.4
MIN_POINTS, MAX_POINTS, MAP_BATCH = 50, 15, 5


def overlap(terms: list[str]) -> Reranker:
    """A reranker without a model: the share of the terms in the text."""
    return lambda texts: [sum(t in x.lower() for t in terms) / len(terms) for x in texts]


def vector_list(rows: DataFrame, key: str, vector: str, q: DataFrame, at: float, k: int) -> DataFrame:
    """key, rank (from 0), score of the k rows most like the query vector (q: one row, column q) that reach `at`."""
    s = rows.where(F.col(vector).isNotNull()).select(key, vector).join(F.broadcast(q)).select(key, cosine_unit(F.col(vector), F.col("q")).alias("score"))
    best = top(s.where(F.col("score") >= at), k, "score", key)
    return ranked(best, [F.desc("score"), key])


def text_list(rows: DataFrame, key: str, text: str, terms: list[str], k: int, where: str | None = None) -> DataFrame:
    """key, rank, score by BM25 over all rows; `where` filters what the index gives."""
    found = bm25(rows, key, text, terms)
    if where:
        found = found.join(rows.where(where).select(key), key, "left_semi")
    return ranked(top(found, k, "score", key), [F.desc("score"), key])


def fuse(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """key, rank of the first k of the fused lists; ties go by first appearance."""
    best = rrf([x.select(key, "rank") for x in lists], key).orderBy(F.desc("score"), "first").limit(k)
    return ranked(best, [F.desc("score"), "first"]).select(key, "rank")


def rerank(candidates: DataFrame, text: str, k: int, model: Reranker | None = None) -> DataFrame:
    """The first k of candidates (with their fused rank) by the model's scores, or in fused order without one or when it fails.

    Candidates are a bounded list, which one task scores as a whole.
    """
    if model is None:
        return candidates.where(F.col("rank") < k)
    names = [c for c in candidates.columns if c != "rank"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values("rank", ignore_index=True)
        try:
            scores = [float(x) for x in model(rows[text].fillna("").tolist())]
            if len(scores) == len(rows):
                rows = rows.assign(_s=scores).sort_values("_s", ascending=False, kind="stable", ignore_index=True).drop(columns="_s")
        except Exception:  # a failed model is an answer of its own: the fused order
            pass
        yield rows.head(k).assign(rank=range(min(k, len(rows))))[[*names, "rank"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields if f.name != "rank")
    return candidates.select(*names, "rank").coalesce(1).mapInPandas(run, f"{schema}, rank int")


def map_reduce(rows: DataFrame, mapper: Mapper, least: int = MIN_POINTS, most: int = MAX_POINTS) -> DataFrame:
    """community, text, score: points of the mapper's answers, MAP_BATCH rows (by rank) a call, the best first.

    What is no JSON, names no row of the batch, or has no whole-number score is left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part = part.sort_values("rank", ignore_index=True)
            out: list[tuple] = []
            for at in range(0, len(part), MAP_BATCH):
                own = part.iloc[at : at + MAP_BATCH].to_dict("records")
                try:
                    answer = json.loads(mapper(own))
                except Exception:  # a failed call has no points
                    continue
                for item in answer if isinstance(answer, list) else []:
                    try:
                        place = int(item.get("community", -1))
                        points = item.get("points") or []
                    except (TypeError, ValueError, AttributeError):
                        continue
                    for n, p in enumerate(points if 0 <= place < len(own) and isinstance(points, list) else []):
                        try:
                            score, text = int(p.get("score", 0)), str(p.get("text", "")).strip()
                        except (TypeError, ValueError, AttributeError):
                            continue
                        if text and score >= least:
                            out.append((own[place]["community"], int(own[place]["rank"]), n, text, score))
            yield pd.DataFrame(out, columns=["community", "rank", "place", "text", "score"])

    kind = dict(rows.dtypes)["community"]
    found = rows.coalesce(1).mapInPandas(run, f"community {kind}, rank int, place int, text string, score int")
    return found.orderBy(F.desc("score"), "rank", "place").limit(most)


def chunk_scores(chunks: DataFrame, q: DataFrame, stored: DataFrame, keywords: list[str], visual: list[str]) -> DataFrame:
    """chunks (media_id, chunk, vector, spoken, seen) with score and from_store; the store's score counts where it has one."""
    from cinegraph.functions.text import term_score
    from cinegraph.operators.ranking import chunk_score

    words = lambda terms: F.array(*[F.lit(x) for x in terms])
    x = chunks.join(stored.select("media_id", "chunk", F.col("score").alias("_stored")), ["media_id", "chunk"], "left").join(F.broadcast(q))
    semantic = F.coalesce("_stored", cosine_raw(F.col("vector"), F.col("q")))
    score = chunk_score(semantic, term_score(words(keywords), F.col("spoken")), term_score(words(visual), F.col("seen")))
    return x.select("media_id", "chunk", F.col("_stored").isNotNull().alias("from_store"), semantic.alias("semantic"), score.alias("score"))


def store_search(chunks: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """media_id, chunk, score of each item's k chunks most like the query, as the vector store answers."""
    s = chunks.join(F.broadcast(q)).select("media_id", "chunk", cosine_raw(F.col("vector"), F.col("q")).alias("score"))
    w = Window.partitionBy("media_id").orderBy(F.desc("score"), "chunk")
    return s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def rank_segments(segments: DataFrame, chunks: DataFrame, keywords: list[str], visual: list[str], k: int = 3) -> DataFrame:
    """Segments (media_id, chunk, segment_index, start_ms, transcript, screen) of each item's k best chunks with score and pos."""
    from cinegraph.functions.text import term_score
    from cinegraph.operators.ranking import segment_score

    w = Window.partitionBy("media_id").orderBy(F.desc("score"), "chunk")
    best = chunks.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("media_id", "chunk", F.col("score").alias("_chunk"))
    words = lambda terms: F.array(*[F.lit(x) for x in terms])
    score: Column = F.round(segment_score(F.col("_chunk"), term_score(words(keywords), F.col("transcript")), term_score(words(visual), F.col("screen"))), 9)
    rows = segments.join(best, ["media_id", "chunk"]).withColumn("score", score).drop("_chunk")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("score"), "start_ms")))

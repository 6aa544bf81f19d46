"""Retrieval: BM25, exact vector search in blocks, rank fusion and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60
BLOCK = 2048


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, score of the documents that hold a term; statistics cover all documents, filters come after."""
    rows = docs.select(key, tokens(F.col(text)).alias("w"))
    n, avg = (F.count("*").alias("n"), F.avg(F.size("w")).alias("avg"))
    total = rows.agg(n, avg)
    hits = rows.select(key, F.size("w").alias("len"), F.explode("w").alias("term")).where(F.col("term").isin(terms)).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as terms
    x = hits.join(F.broadcast(df), "term").join(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return x.groupBy(key).agg(F.sum(one).alias("score"))


def top(df: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(k)


#: Bytes of query vectors that one pass over the base takes.
PASS_BYTES = 64 << 20


def knn(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, threshold: float = -1.0) -> DataFrame:
    """q, key, score: the k nearest of base (raw cosine, not itself) for each query; ties by key.

    A pass over base takes all queries up to PASS_BYTES, which go to the workers by broadcast; more queries are dealt
    to several passes by a hash. Each batch hands on its own k best, so what is shuffled is bounded by queries, k
    and batches.
    """
    rows = queries.select(key, vector).where(F.col(vector).isNotNull())
    n, size = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    passes = -(-n * (size or 0) * 8 // PASS_BYTES)
    out = None
    for i in range(passes):
        part = rows if passes == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(passes)) == i)
        found = base.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(_nearest(part, key, k, threshold), f"q long, {key} long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.select(F.col(key).alias("q"), key, F.lit(0.0).alias("score")).limit(0)
    w = Window.partitionBy("q").orderBy(F.desc("score"), key)
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _nearest(queries: DataFrame, key: str, k: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    own = sorted((r[0], r[1]) for r in queries.collect())
    m = np.array([v for _, v in own], np.float64)
    sent = queries.sparkSession.sparkContext.broadcast((np.array([i for i, _ in own]), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ids, all_m = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            other = b.column(0).to_numpy()
            v = np.array(b.column(1).to_pylist(), np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            for at in range(0, len(all_ids), BLOCK):
                ids = all_ids[at : at + BLOCK]
                s = np.round(all_m[at : at + BLOCK] @ v.T, 12)
                s[ids[:, None] == other[None, :]] = -2
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                q = np.repeat(ids, best.shape[1])
                score = np.take_along_axis(s, best, axis=1).ravel()
                ok = (score >= threshold) & (score > -2)
                yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(other[best.ravel()][ok]), pa.array(score[ok])], names=["q", key, "score"])

    return run


def rrf(lists: list[DataFrame], key: str, by: list[str] | None = None) -> DataFrame:
    """Sum of 1 / (rank + 60) with ranks from 0; ties go by the first list and rank. Each list has key and rank."""
    by = by or []
    all_ = None
    for i, x in enumerate(lists):
        x = x.select(*by, key, F.col("rank"), F.lit(i).alias("list"))
        all_ = x if all_ is None else all_.unionByName(x)
    return all_.groupBy(*by, key).agg(F.sum(1 / (F.col("rank") + RRF_K)).alias("score"), F.min(F.struct("list", "rank")).alias("first"))


def ranked(df: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """Adds rank from 0. Without `by` the list must be a top-k already, or it would be sorted by one task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)) - 1)


def evaluate(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """q, hit, rank (from 1), precision, recall, f1 and pollution of each question's first k results.

    results: q, rank (from 0), rel (whether it is expected); expected: q, expected (how many are).
    """
    rows = results.where(F.col("rank") < k).groupBy("q").agg(F.count("*").alias("n"), F.count_if("rel").alias("good"), F.min(F.when(F.col("rel"), F.col("rank") + 1)).alias("rank"))
    all_ = expected.join(rows, "q", "left")
    p, r = F.coalesce(F.col("good") / F.col("n"), F.lit(0.0)), F.coalesce(F.col("good") / F.col("expected"), F.lit(0.0))
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return all_.select("q", F.col("rank").isNotNull().alias("hit"), "rank", p.alias("precision"), r.alias("recall"), f1.alias("f1"), (1 - p).alias("pollution"))

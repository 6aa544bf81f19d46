"""Quality classifier from weak labels (operator 6).

Two questions, is a text junk and is it toxic, each with several overlapping heuristic labellers that vote bad or
not at all, and good where none of them votes bad. The counts of all vote patterns over all documents (a bounded
table) go through expectation-maximisation, which estimates how often each labeller is right in either class, and so
the posterior of each pattern. A hashed linear scorer is trained on posteriors and then judges every document by its
words, word beginnings and shape alone; the verdict is the scorer's.

The lexicon labellers hold a short fixed list, and words and word beginnings that labelled toxic documents use
and others don't. Documents that share their least shingle hash, copies for the most part, count once there and
in the scorer's sample, or the rare words of a copied text would pass for signs.

Bounds: LABELLED labelled rows for the lexicons, whose words bound the lexicons in turn, and SCORED documents or
SCORED_BYTES of them to train the scorer (by one task), both chosen by a hash of the id; votes, pattern counts and verdicts cover all documents.

Edge cases: a null or empty text has no words, gets no vote but good ones, and is kept; without labels there are
no learned lexicons; without documents nothing is trained; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.llm.common import LOWER, flagged, from_text, lists, mix, passes, piece_hash, prefix_hash, scratch, tune, words
from cinegraph.llm.neardup import shingle_sets
from cinegraph.llm.quality import SYMBOL, measure

LABELLED, SCORED = 20_000, 20_000
#: Bytes of text of the documents that train the scorer.
SCORED_BYTES = 200 << 20
BITS = 18
BEGINNING = 5
STEM = 4
MIN_DOCS, MIN_SHARE = 3, 0.95
#: A word must stand in such a part of the toxic documents, or chance would pick rare words.
MIN_OF_TOXIC = 0.005
#: Shares of shorter texts say little; those of lines need more words.
MIN_WORDS, MIN_WORDS_IN_LINES = 5, 30
EPOCHS, BATCH, RATE, DECAY = 6, 256, 0.2, 5e-4
#: Common insults.
INSULTS = "clown disgusting dumb fool garbage idiot idiots jerk loser losers moron morons pathetic scum stupid trash worthless".split()

BAD, GOOD = 2, 1
JUNK = ["symbols", "repeats", "dup_lines", "upper", "long_words", "separators", "stutters"]
TOXIC = ["insults", "words", "beginnings", "stems"]

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _trimmed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hashes of each word, its beginning and its stem: in lower case, without outer punctuation."""
    low = LOWER[data]
    starts, ends, counts = words(low, off)
    row = np.repeat(np.arange(len(counts)), counts)
    if len(starts):
        place = np.arange(len(low))
        plain = ~_PUNCT[low]
        after = np.minimum.accumulate(np.where(plain, place, len(low))[::-1])[::-1]  # the next byte that is no punctuation
        before = np.maximum.accumulate(np.where(plain, place, -1))
        starts, ends = np.minimum(after[starts], ends), np.maximum(before[ends - 1] + 1, starts)
    ok = ends > starts
    starts, ends, row = starts[ok], ends[ok], row[ok]
    s = prefix_hash(low)
    begin, stem = (piece_hash(s, starts, np.minimum(ends, starts + k)) ^ np.uint64(0x5555 * k) for k in (BEGINNING, STEM))
    return row, piece_hash(s, starts, ends), begin, stem


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def insult_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(INSULTS).encode(), np.uint8)
    return np.sort(_trimmed(raw, np.array([0, len(raw)]))[1])


def shapes(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Shares in per cent of each row."""
    m = measure(data, off, [5])
    total = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[off])
    n = np.maximum(m["n_words"], 1)
    bar = np.zeros(256, bool)
    bar[0x7C] = True
    starts, ends, counts = words(data, off)
    w, row = piece_hash(prefix_hash(data), starts, ends), np.repeat(np.arange(len(counts)), counts)
    again = np.flatnonzero((w[1:] == w[:-1]) & (row[1:] == row[:-1]))
    return {
        "n_words": m["n_words"],
        "symbols": 100 * total(SYMBOL) // n,
        "repeats": 100 * m["chars_5"] // np.maximum(m["word_chars"], 1),
        "dup_lines": 100 * m["n_dup_lines"] // np.maximum(m["n_lines"], 1),
        "upper": 100 * total(_UPPER) // np.maximum(total(_LETTER), 1),
        "long_words": 10 * m["word_chars"] // n,
        "separators": 100 * total(bar) // n,
        "stutters": 100 * np.bincount(row[again], minlength=len(off) - 1) // n,
    }


@dataclass(frozen=True)
class Texts:
    """What votes and features are made of, computed once for a pass."""

    n: int
    shape: dict[str, np.ndarray]
    row: np.ndarray
    hashes: list[np.ndarray]


def read(data: np.ndarray, off: np.ndarray) -> Texts:
    row, *hashes = _trimmed(data, off)
    return Texts(len(off) - 1, shapes(data, off), row, hashes)


def votes(x: Texts, lexicons: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Vote of each labeller (BAD, GOOD or 0) on each row, for junk and for toxic."""
    s = x.shape
    limit = {"symbols": 10, "repeats": 30, "dup_lines": 30, "upper": 30, "long_words": 80, "separators": 5, "stutters": 10}
    some = {k: s["n_words"] >= (MIN_WORDS_IN_LINES if k in ("dup_lines", "long_words") else MIN_WORDS) for k in JUNK}
    junk = np.stack([np.where((s[k] > limit[k]) & some[k], BAD, 0) for k in JUNK], axis=1)
    hashes = [x.hashes[0], *x.hashes]
    toxic = np.zeros((x.n, len(TOXIC)), np.int64)
    for k, known in enumerate(lexicons):
        hits = np.bincount(x.row, weights=_within(hashes[k], known), minlength=x.n)
        toxic[hits > 0, k] = BAD
    for v in (junk, toxic):
        v[~(v == BAD).any(axis=1)] = GOOD
    return junk, toxic


def codes(v: np.ndarray) -> np.ndarray:
    """A number for each vote pattern."""
    return v @ (3 ** np.arange(v.shape[1]))


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior of the bad class for each vote pattern, and the votes' probabilities by class and labeller."""
    keys = sorted(patterns)
    if not keys:
        return {}, np.zeros((2, 0, 3))
    v, n = np.array(keys), np.array([patterns[k] for k in keys], float)
    post = ((v == BAD).sum(1) + 0.1) / ((v > 0).sum(1) + 0.3)
    probs = np.zeros((2, v.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        for c in (0, 1):
            cast = weight[c] @ (v > 0)  # no vote says nothing about the class
            for x in (GOOD, BAD):
                probs[c, :, x] = (weight[c] @ (v == x) + 0.5) / (cast + 1)
            probs[c, :, 0] = 1
        # a labeller is better than chance: a bad vote is likelier on bad texts
        probs[1, :, BAD] = np.maximum(probs[1, :, BAD], probs[0, :, BAD])
        like = np.stack([np.log(prior[c]) + sum(np.log(probs[c, k, v[:, k]]) for k in range(v.shape[1])) for c in (0, 1)])
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return dict(zip(keys, post.tolist(), strict=True)), probs


def features(x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed index of each row's distinct words, beginnings and shape classes."""
    size = np.uint64((1 << BITS) - 1)
    own_row, own = [], []
    for k, name in enumerate(JUNK):
        step = np.searchsorted([2, 5, 10, 15, 20, 25, 30, 40, 50, 60, 65, 70, 75, 80, 90, 100], x.shape[name], "left")
        own.append(mix((step + 1000 * (k + 1)).astype(np.uint64)))
        own_row.append(np.arange(x.n))
    kind = np.uint32 if x.n < 1 << (32 - BITS) else np.int64  # narrow keys sort faster
    rows = np.concatenate([x.row, x.row, x.row, *own_row]).astype(kind)
    key = np.sort(rows << kind(BITS) | (np.concatenate([*x.hashes, *own]) & size).astype(kind))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> kind(BITS)).astype(np.int64), (key & kind(size)).astype(np.int64)


def train(rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer on binary features, by Adagrad with shrinkage."""
    size = 1 << BITS
    df = np.bincount(np.concatenate(rows), minlength=size) if rows else np.zeros(size)
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-6)
    weight = np.where(target > 0.5, 2.0, 1.0)
    rng = np.random.default_rng(7)
    count = np.array([len(r) for r in rows])
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            index = np.concatenate([rows[i] for i in own])
            where = np.repeat(np.arange(len(own)), count[own])
            z = np.bincount(where, weights=w[index], minlength=len(own)) + w[size]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[own]) * weight[own]
            grad = np.bincount(index, weights=g[where], minlength=size) / len(own)
            used = np.flatnonzero(grad)
            seen[used] += grad[used] ** 2
            w[used] -= RATE * grad[used] / np.sqrt(seen[used])
            w[used] = np.sign(w[used]) * np.maximum(0, np.abs(w[used]) - DECAY)
            b = g.mean()
            seen[size] += b * b
            w[size] -= RATE * b / np.sqrt(seen[size])
    w[:size][df < MIN_DOCS] = 0
    return w


def _share(df: DataFrame, column: str, n: int, text: str | None = None) -> DataFrame:
    """About n of the rows, fewer where they hold more than SCORED_BYTES of text, by a hash of the id."""
    total, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)).first()
    if size:
        n = max(1, min(n, int(SCORED_BYTES * total / size)))
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(column, F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * n / total))


def _unlike(df: DataFrame) -> DataFrame:
    """One of the rows whose texts share their least shingle hash. Column text is the first."""
    schema = T.StructType([*df.schema.fields, T.StructField("_least", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in passes(batches, "text"):
            least = [int(x[0].astype(np.int64)) if len(x) else 0 for x in shingle_sets(data, off)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], names=[*b.schema.names, "_least"])

    out = df.mapInArrow(run, schema)
    first = F.min(F.struct("doc_id", *[c for c in df.columns if c != "doc_id"])).alias("x")
    return out.groupBy("_least").agg(first).select("x.*").select(df.columns)


def learn_lexicons(docs: DataFrame, labels: DataFrame) -> list[np.ndarray]:
    """The fixed list, and of each half of the labelled rows the words and beginnings of toxic documents."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = scratch(_share(known, "doc_id", LABELLED), "wl-labels")
    texts = flagged(docs.select("doc_id", "text"), known, "doc_id").where("flag").join(known, "doc_id").select("text", "toxic", "doc_id")
    texts = scratch(_unlike(texts), "wl-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in passes(batches, "text"):
            row, *hashes = _trimmed(data, off)
            toxic = b.column(1).to_numpy()
            for kind, h in enumerate(hashes):
                key = np.lexsort((h, row))
                r, x = row[key], h[key]
                new = np.ones(len(x), bool)
                new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
                r, x = r[new], x[new]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind), pa.int32()), pa.array(x.view(np.int64)), pa.array(toxic[r] == 1).cast(pa.int32())], names=["kind", "h", "bad"])

    counts = texts.mapInArrow(count, "kind int, h long, bad int").groupBy("kind", "h").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    counts = scratch(counts, "wl-words")
    least = max(MIN_DOCS, MIN_OF_TOXIC * texts.agg(F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()[0])
    rows = counts.where((F.col("bad") >= least) & (F.col("bad") >= MIN_SHARE * F.col("n"))).collect()  # some words of LABELLED rows
    out = [insult_hashes()]
    for kind in range(3):
        out.append(np.sort(np.array([r.h for r in rows if r.kind == kind], np.int64).view(np.uint64)))
    return out


def classify(docs: DataFrame, labels: DataFrame, weak: bool = False) -> DataFrame:
    """docs with p_junk, p_toxic (the scorer's) and kept added; weak: also weak_junk, weak_toxic (the label model's)."""
    spark = tune(docs.sparkSession)
    added = ["p_junk", "p_toxic", *(["weak_junk", "weak_toxic"] if weak else []), "kept"]
    base = docs.drop("p_junk", "p_toxic", "weak_junk", "weak_toxic", "kept")
    lexicons = spark.sparkContext.broadcast(learn_lexicons(docs, labels))

    def vote(data: np.ndarray, off: np.ndarray) -> pa.Array:
        both = votes(read(data, off), lexicons.value)
        return pa.StructArray.from_arrays([pa.array(codes(v), pa.int32()) for v in both], ["junk", "toxic"])

    voted = docs.select(from_text(vote, "struct<junk:int,toxic:int>")(F.col("text")).alias("v")).select("v.*")
    counts = voted.groupBy("junk", "toxic").agg(F.count("*").alias("n")).collect()  # at most 2^(labellers) rows
    models = []
    for k, n in (("junk", len(JUNK)), ("toxic", len(TOXIC))):
        patterns: dict[tuple[int, ...], int] = {}
        for r in counts:
            p = tuple(r[k] // 3**i % 3 for i in range(n))
            patterns[p] = patterns.get(p, 0) + r.n
        post, _ = estimate(patterns)
        models.append({sum(x * 3**i for i, x in enumerate(p)): v for p, v in post.items()})
    weights = spark.sparkContext.broadcast(_fit(docs, lexicons, models))

    def judge(data: np.ndarray, off: np.ndarray) -> pa.Array:
        w = [np.frombuffer(x, np.float32) for x in weights.value]
        x = read(data, off)
        row, index = features(x)
        z = [np.bincount(row, weights=v[index], minlength=x.n) + v[-1] for v in w] if w else [np.full(x.n, -30.0)] * 2
        p = [1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in z]
        by_votes = [np.array([m[c] for c in codes(v).tolist()], float) for m, v in zip(models, votes(x, lexicons.value), strict=True)] if weak else []
        kept = (p[0] < 0.5) & (p[1] < 0.5)
        kept[np.diff(off) == 0] = True
        return pa.StructArray.from_arrays([*(pa.array(v, pa.float64()) for v in (*p, *by_votes)), pa.array(kept)], added)

    own = from_text(judge, "struct<" + ",".join(f"{n}:{'boolean' if n == 'kept' else 'double'}" for n in added) + ">")(F.col("text"))
    at = "_" + max(base.columns, key=len)  # no column of the input has this name
    return base.withColumn(at, own).select(*base.columns, f"{at}.*")


def _fit(docs: DataFrame, lexicons, models: list[dict[int, float]]) -> list[bytes]:
    """The two weight vectors, trained by one task on the bounded sample."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in passes(batches, "text"):
            x = read(data, off)
            row, index = features(x)
            post = [np.array([m[c] for c in codes(v).tolist()], float) for m, v in zip(models, votes(x, lexicons.value), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), lists(index.astype(np.int32), np.bincount(row, minlength=b.num_rows), pa.int32()), *(pa.array(p) for p in post)], names=["doc_id", "index", "junk", "toxic"])

    sample = _unlike(_share(docs.select("text", "doc_id"), "doc_id", SCORED, "text")).select("doc_id", "text").mapInArrow(rows, "doc_id long, index array<int>, junk double, toxic double")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "junk", "toxic"])
        own = [np.asarray(x, np.int64) for x in part["index"]]
        return pd.DataFrame({"w": [train(own, part[k].to_numpy()).astype(np.float32).tobytes() for k in ("junk", "toxic")], "k": [0, 1]})

    found = sample.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, "w binary, k int").collect()
    return [bytes(r.w) for r in sorted(found, key=lambda r: r.k)]


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "text"), labels).drop("text")

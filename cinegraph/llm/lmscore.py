"""LM scoring with a log-bilinear model trained by noise-contrastive estimation (operator 9).

Counts of all tokens of all training documents are the unigram base. In the neural model a token's probability is
that of its class given the tokens before, times its smoothed share of the class. The classes follow the counted
vocabulary: with V tokens the sqrt(V) most frequent have a class each, all others fall into sqrt(V) classes by a
hash of their last bytes, which tells endings and so languages apart. Classes are dealt to about sqrt(classes)
groups, and a class is predicted by its group and then within it, so exact normalisation costs two short matrix
products for a token.

The prediction is log-bilinear: the vectors of the two classes before, and the mean of the FAR ones before those, each
scaled by its place, add up to a vector whose products with the vectors of groups and classes plus biases are the
scores. Training is noise-contrastive on both levels: noise is drawn from the unigram frequencies of groups, and
of the classes within a group, and shared by a batch, so a step is a few matrix products.

Training documents are dealt to shards by a hash, as many as the tokens ask for, and sorted within; in each of
ROUNDS rounds every shard runs over its next part from the same start, and the parameters and step sizes are
averaged by tokens, so all tokens are learned from once. So the model depends on the documents alone, not on how the table is partitioned (but for the
order in which floating-point sums are taken).

The LOOKUP most frequent counts go to all workers (a bounded table, within which every class of its own lies until
V exceeds LOOKUP squared); counts of rarer tokens are joined by a 64-bit hash, a row for each document and rare token.

Edge cases: a null or empty text is its end alone; a null id counts as the empty text and so as training;
without training documents all counts are zero; repeated rows are scored each and count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import LOWER, drop_scratch, lists, mix, passes, piece_hash, prefix_hash, scratch, tune, words

DIM, NOISE, RATE = 16, 16, 0.1
ROUNDS = 2
#: Places whose vectors count alone, and those whose mean counts.
NEAR, FAR = 2, 16
LEAD = NEAR + FAR
#: A step takes SEGMENTS stretches of SEGMENT places.
SEGMENT, SEGMENTS = 128, 32
SHARD_TOKENS = 4_000_000
LOOKUP = 150_000
#: Distinct tokens that a task holds before it hands on their counts.
HELD = 1_000_000
CHUNK = 2048
#: Places of one block of scores.
BLOCK = 8192
SUFFIX = 3
END = mix(np.array([0xE0D], np.uint64))[0]
_ENDING = 0x7FFFFFFF


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens and of their last bytes, each row closed by END, and how many each row has."""
    low = LOWER[data]
    starts, ends, counts = words(low, off)
    s = prefix_hash(low)
    at = np.cumsum(counts)
    ending = (piece_hash(s, np.maximum(starts, ends - SUFFIX), ends) & np.uint64(_ENDING)).astype(np.int64)
    return np.insert(piece_hash(s, starts, ends), at, END), np.insert(ending, at, int(END) & _ENDING), counts + 1


def count_tokens(docs: DataFrame) -> DataFrame:
    """h, x, c of all tokens: the hash, that of the last bytes, the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names, kinds = ["h", "x", "c"], [pa.int64(), pa.int32(), pa.int64()]

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, first, at = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            return h, np.concatenate([x[1] for x in held])[first], np.bincount(at, weights=np.concatenate([x[2] for x in held])).astype(np.int64)

        def batch(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((found[0].view(np.int64), *found[1:]), kinds, strict=True)], names=names)

        for _, data, off in passes(batches, "text"):
            w, x, _ = tokens(data, off)
            h, first, c = np.unique(w, return_index=True, return_counts=True)
            held.append((h, x[first], c))
            if sum(len(x[0]) for x in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield batch(held[0])
                    held = []
        if held:
            yield batch(merged())

    return docs.select("text").mapInArrow(run, "h long, x int, c long").groupBy("h").agg(F.min("x").alias("x"), F.sum("c").alias("c"))


def _frequent(vocab: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and counts, most frequent first, of those above the least count that at most n tokens reach.

    The bound comes from a histogram of count classes (some thousand rows at most), so nothing is sorted.
    """
    steps = {r.k: r.n for r in vocab.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    least, held = max(steps, default=0) + 1, 0
    for k in sorted(steps, reverse=True):
        held += steps[k]
        if held > n:
            break
        least = k
    rows = vocab.where(F.floor(F.log2("c") * 16).cast("int") >= least).toArrow()
    h, c = rows["h"].to_numpy().astype(np.int64), rows["c"].to_numpy().astype(np.int64)
    order = np.lexsort((h, -c))
    return h[order].view(np.uint64), c[order]


@dataclass
class Shape:
    """k tokens with a class of their own, `hashed` classes by ending; a class's place is group * width + member."""

    k: int
    hashed: int

    @cached_property
    def groups(self) -> int:
        return int(np.ceil(np.sqrt(self.k + self.hashed)))

    @cached_property
    def width(self) -> int:
        return -(-(self.k + self.hashed) // self.groups)

    @cached_property
    def pad(self) -> int:
        """The class of the places before a text."""
        return self.groups * self.width

    def place(self, rank: np.ndarray) -> np.ndarray:
        return rank % self.groups * self.width + rank // self.groups


class Model:
    """r: vectors of context classes, s: scales of the places, u, a: vectors and biases of groups, t, b: of classes."""

    def __init__(self, p: np.ndarray, shape: Shape):
        self.p, self.shape = p, shape
        self.n = n = shape.pad
        g, at = shape.groups, 0
        for name, dims in (("r", (n + 1, DIM)), ("s", (3, DIM)), ("u", (g, DIM)), ("a", (g,)), ("t", (n, DIM)), ("b", (n,))):
            size = int(np.prod(dims))
            setattr(self, name, p[at : at + size].reshape(dims))
            at += size

    @staticmethod
    def start(counts: np.ndarray, shape: Shape) -> np.ndarray:
        """Predicts the unigram classes; counts by place, -1 where there is no class."""
        rng = np.random.default_rng(11)
        p = Model.noise(counts, shape)
        group, within = (np.log(np.maximum(x, 1e-13)) for x in p)
        vectors = [rng.normal(0, 0.1, n * DIM) for n in (shape.pad + 1, shape.groups, shape.pad)]
        return np.concatenate([vectors[0], np.ones(2 * DIM), np.full(DIM, 4.0), vectors[1], group, vectors[2], within]).astype(np.float32)

    @staticmethod
    def noise(counts: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """Unigram frequencies of groups, and of classes within their group."""
        c = np.where(counts < 0, 0.0, counts + 0.5).reshape(shape.groups, shape.width)
        total = c.sum(axis=1)
        return total / total.sum(), (c / np.maximum(total, 1e-9)[:, None]).ravel()

    def contexts(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """For rows of places, of which the first LEAD are context only: vectors of one before, two before, and the mean of the others."""
        e = self.r[x]
        total = np.zeros((e.shape[0], e.shape[1] + 1, DIM))
        np.cumsum(e, axis=1, out=total[:, 1:])
        n = x.shape[1] - LEAD
        return e[:, LEAD - 1 : LEAD - 1 + n], e[:, LEAD - 2 : LEAD - 2 + n], ((total[:, FAR : FAR + n] - total[:, :n]) / FAR).astype(np.float32)

    def log_prob(self, x: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of the class at each place of a stream but the first LEAD (0 at pads)."""
        out = np.zeros(max(len(x) - LEAD, 0), np.float64)
        width = self.shape.width
        for at in range(0, len(out), BLOCK):
            part = x[at : at + BLOCK + LEAD]
            one, two, far = self.contexts(part[None])
            q = (one * self.s[0] + two * self.s[1] + far * self.s[2])[0]
            y = part[LEAD:]
            order = np.argsort(y, kind="stable")
            order = order[: np.searchsorted(y[order], self.n)]  # pads are last
            if not len(order):
                continue
            q, y = q[order], y[order]
            g = y // width
            lp = _pick_log_softmax(q @ self.u.T + self.a, g)
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            for i, j in zip(cut.tolist(), np.append(cut[1:], len(g)).tolist(), strict=True):
                base = int(g[i]) * width
                lp[i:j] += _pick_log_softmax(q[i:j] @ self.t[base : base + width].T + self.b[base : base + width], y[i:j] - base)
            out[at + order] = lp
        return out


def _pick_log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = z[np.arange(len(z)), at]
    if np.abs(own).max() > 60 or z.max() > 60:  # else no sum of exponentials is out of range
        top = z.max(axis=1)
        z, own = z - top[:, None], own - top
    np.exp(z, out=z)
    return own - np.log(z.sum(axis=1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        return np.reciprocal(z, out=z)


class Trainer:
    def __init__(self, start: np.ndarray, counts: np.ndarray, shape: Shape, squares: np.ndarray | None = None):
        self.m = Model(start.copy(), shape)
        group, within = Model.noise(counts, shape)
        self.cum = np.cumsum(group)
        self.cum_in = np.cumsum(within.reshape(shape.groups, shape.width), axis=1)
        with np.errstate(divide="ignore"):
            self.shift, self.shift_in = (np.maximum(np.log(NOISE * x), -40).astype(np.float32) for x in (group, within))
        self.squares = np.ones(len(start), np.float32) if squares is None else squares.copy()
        self.grad = Model(np.zeros(len(start), np.float32), shape)
        self.rng = np.random.default_rng(3)

    def step(self, x: np.ndarray) -> None:
        """x: stretches of places, of which the first LEAD are context only."""
        m, d, shape = self.m, self.grad, self.m.shape
        d.p[:] = 0
        one, two, far = m.contexts(x)
        n = one.shape[1]
        q = one * m.s[0] + two * m.s[1] + far * m.s[2]
        y = x[:, LEAD:].ravel()
        order = np.argsort(y, kind="stable")
        order = order[: np.searchsorted(y[order], m.n)]
        if not len(order):
            return
        y = y[order]
        g, v = y // shape.width, q.reshape(-1, DIM)[order]

        u = m.u[g]
        yes = _sigmoid((v * u).sum(axis=1) + m.a[g] - self.shift[g]) - 1
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), shape.groups - 1)
        no = _sigmoid(v @ m.u[noise].T + m.a[noise] - self.shift[noise])
        dv = yes[:, None] * u + no @ m.u[noise]
        cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        d.u[g[cut]] = np.add.reduceat(yes[:, None] * v, cut)
        d.a[g[cut]] = np.add.reduceat(yes, cut)
        np.add.at(d.u, noise, no.T @ v)
        np.add.at(d.a, noise, no.sum(axis=0))

        t = m.t[y]
        yes = _sigmoid((v * t).sum(axis=1) + m.b[y] - self.shift_in[y]) - 1
        dv += yes[:, None] * t
        own = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
        d.t[y[own]] = np.add.reduceat(yes[:, None] * v, own)
        d.b[y[own]] = np.add.reduceat(yes, own)
        drawn = (self.rng.random((len(cut), NOISE, 1)) > self.cum_in[g[cut], None, :-1]).sum(axis=2) + g[cut, None] * shape.width
        bias = m.b[drawn] - self.shift_in[drawn]
        t = m.t[drawn]
        dt, db = np.empty(t.shape, np.float32), np.empty(bias.shape, np.float32)
        for k, (i, j) in enumerate(zip(cut.tolist(), np.append(cut[1:], len(g)).tolist(), strict=True)):
            own = v[i:j]
            no = own @ t[k].T
            no += bias[k]
            no = _sigmoid(no)
            dv[i:j] += no @ t[k]
            np.matmul(no.T, own, out=dt[k])
            no.sum(axis=0, out=db[k])
        np.add.at(d.t, drawn.ravel(), dt.reshape(-1, DIM))
        np.add.at(d.b, drawn.ravel(), db.ravel())

        dq = np.zeros((q.size // DIM, DIM), np.float32)
        dq[order] = dv
        dq = dq.reshape(q.shape)
        d.s[0], d.s[1], d.s[2] = ((dq * c).sum(axis=(0, 1)) for c in (one, two, far))
        de = np.zeros((x.shape[0], x.shape[1], DIM), np.float32)
        de[:, LEAD - 1 : LEAD - 1 + n] += dq * m.s[0]
        de[:, LEAD - 2 : LEAD - 2 + n] += dq * m.s[1]
        total = np.zeros((x.shape[0], n + 1, DIM), np.float32)
        np.cumsum(dq * (m.s[2] / FAR), axis=1, out=total[:, 1:])
        j = np.arange(n + FAR - 1)  # place j is far context of the targets j - FAR + 1 .. j, counted from LEAD
        de[:, : n + FAR - 1] += total[:, np.minimum(j, n - 1) + 1] - total[:, np.maximum(j - FAR + 1, 0)]
        flat, de = x.ravel(), de.reshape(-1, DIM)
        for i in range(DIM):
            d.r[:, i] = np.bincount(flat, weights=de[:, i], minlength=m.n + 1)
        self.squares += d.p * d.p
        m.p -= RATE * d.p / np.sqrt(self.squares)

    def run(self, x: np.ndarray, part: int = 0, parts: int = 1) -> None:
        """A part of a pass over a stream (texts with LEAD pads before each), stretch by stretch in a shuffled order."""
        x = np.concatenate([x, np.full(LEAD + -(len(x) - LEAD) % SEGMENT, self.m.n, x.dtype)]) if (len(x) - LEAD) % SEGMENT else x
        rows = np.lib.stride_tricks.sliding_window_view(x, SEGMENT + LEAD)[::SEGMENT]
        order = np.random.default_rng(5).permutation(len(rows))[part::parts]
        for at in range(0, len(order), SEGMENTS):
            self.step(rows[np.sort(order[at : at + SEGMENTS])])


def _lookup(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the sorted array, and whether the value is there."""
    at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
    return at, known[at] == values if len(known) else np.zeros(len(values), bool)


def stream(classes: np.ndarray, sizes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row with LEAD pads before each, and the places of their tokens."""
    at = np.arange(len(classes)) + LEAD * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    out = np.full(len(classes) + LEAD * len(sizes), pad, np.int64)
    out[at] = classes
    return out, at


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = tune(docs.sparkSession)
    base = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    vocab = scratch(count_tokens(base.where("not held_out")), "lm-counts")
    v, n = vocab.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    h, c = _frequent(vocab, LOOKUP)
    side = max(int(np.ceil(np.sqrt(v))), 1)
    shape = Shape(min(side, len(h)), side)
    rest_n, rest_v = _hashed_counts(vocab, h[: shape.k], shape.hashed)
    spelled = np.log(rest_n + 0.5 * (rest_v + 1))
    counts = np.full(shape.pad, -1.0)
    counts[shape.place(np.arange(shape.k + shape.hashed))] = np.concatenate([c[: shape.k], rest_n])
    order = np.argsort(h)
    table = spark.sparkContext.broadcast((h[order], c[order], np.where(order < shape.k, order, -1).astype(np.int64), spelled))
    kind = "<u2" if shape.pad < 1 << 16 else "<u4"
    schema = "doc_id long, held_out boolean, n_tokens long, known long, counted double, spelled double, rare array<long>, times array<int>, classes binary, digest long"

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_c, known_k, spell = table.value
        for b, data, off in passes(batches, "text"):
            w, x, size = tokens(data, off)
            row = np.repeat(np.arange(len(size)), size)
            at, there = _lookup(w, known)
            own = np.where(there & (known_k[at] >= 0), known_k[at], -1) if len(known) else np.full(len(w), -1)
            ending = x % shape.hashed
            cls = shape.place(np.where(own >= 0, own, shape.k + ending)).astype(kind)
            lc = np.where(there, np.log10(known_c[at] + 0.5), 0.0) if len(known) else np.zeros(len(w))
            sums = lambda x: np.bincount(row, weights=x, minlength=len(size))
            key = np.lexsort((w[~there], row[~there]))
            r, z = row[~there][key], w[~there][key]
            new = np.ones(len(z), bool)
            new[1:] = (r[1:] != r[:-1]) | (z[1:] != z[:-1])
            cut = np.flatnonzero(new)
            times = np.diff(np.append(cut, len(z)))
            per = np.bincount(r[cut], minlength=len(size))
            end = np.cumsum(size)
            s = prefix_hash(cls.view(np.uint8))
            wide = cls.itemsize
            raw = cls.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array(size),
                    pa.array(sums(there).astype(np.int64)),
                    pa.array(sums(lc)),
                    # a rare token's share of its class; the count above it is in `counted` or joined later
                    pa.array(sums(np.where(own >= 0, -lc, -spell[ending] / np.log(10)))),
                    lists(z[cut].view(np.int64), per, pa.int64()),
                    lists(times.astype(np.int32), per, pa.int32()),
                    pa.array([raw[(e - k) * wide : e * wide] for e, k in zip(end.tolist(), size.tolist(), strict=True)], pa.binary()),
                    pa.array(piece_hash(s, (end - size) * wide, end * wide).view(np.int64)),
                ],
                names=[s.split()[0] for s in schema.split(", ")],
            )

    found = scratch(base.mapInArrow(ids, schema).withColumn("key", F.monotonically_increasing_id()), "lm-ids")
    params = spark.sparkContext.broadcast(_train(found.where("not held_out"), counts, shape, kind, n))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(params.value, shape)
        for b, data, off in passes(batches, "classes"):
            size = np.diff(off) // np.dtype(kind).itemsize
            x, at = stream(data.view(kind).astype(np.int64), size, shape.pad)
            lp = m.log_prob(x)[at - LEAD] / np.log(10)
            total = np.bincount(np.repeat(np.arange(len(size)), size), weights=lp, minlength=len(size))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(total)], names=[*b.schema.names[:-1], "lm"])

    carried = "key long, doc_id long, held_out boolean, n_tokens long, known long, counted double, spelled double"
    names = [x.split()[0] for x in carried.split(", ")]
    judged = found.select(*names, "classes").mapInArrow(judge, f"{carried}, lm double")
    rare = found.select("key", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("key", F.col("z.rare").alias("h"), F.col("z.times").alias("n"))
    logc = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rare = rare.join(vocab.select("h", "c"), "h", "left").groupBy("key").agg(F.sum(F.col("n") * logc).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    out = judged.join(rare, "key", "left")
    counted = F.col("counted") + F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        (F.col("lm") + F.col("spelled") + counted).alias("score"),
    )


def _hashed_counts(vocab: DataFrame, own: np.ndarray, hashed: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and different tokens of each class by ending, without the tokens that have a class of their own."""
    spark = vocab.sparkSession
    mine = spark.createDataFrame(pd.DataFrame({"h": own.view(np.int64)}), "h long")
    rest = vocab.join(F.broadcast(mine), "h", "left_anti")  # as many rows as classes
    rows = rest.groupBy((F.col("x") % hashed).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    at = rows["k"].to_numpy().astype(np.int64)
    return tuple(np.bincount(at, weights=rows[k].to_numpy(), minlength=hashed) for k in ("n", "v"))


def _train(learn: DataFrame, counts: np.ndarray, shape: Shape, kind: str, n: int) -> np.ndarray:
    """In each round every shard trains on its next part from the same start; the mean by tokens, in two levels."""
    spark, start = learn.sparkSession, Model.start(counts, shape)
    state = np.concatenate([start, np.ones(len(start), np.float32)])
    shards = max(1, -(-n // SHARD_TOKENS))
    shard = F.pmod(F.xxhash64("digest", "doc_id"), F.lit(shards)).cast("int")
    rows = learn.select(shard.alias("shard"), F.xxhash64("doc_id", "digest").alias("place"), "classes")
    rows = scratch(rows.repartition(shards, "shard").sortWithinPartitions("shard", "place", F.octet_length("classes")), "lm-shards") if shards > 1 else rows

    def add(own: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in own["p"])
        return pd.DataFrame({"part": [own["part"].iloc[0]], "n": [own["n"].sum()], "p": [total.tobytes()]})

    for part in range(ROUNDS):
        sent = spark.sparkContext.broadcast(state)

        def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(["place"], kind="stable")
            sizes = np.array([len(x) // np.dtype(kind).itemsize for x in own["classes"]])
            x, _ = stream(np.frombuffer(b"".join(own["classes"]), kind).astype(np.int64), sizes, shape.pad)
            trainer = Trainer(sent.value[: len(start)], counts, shape, sent.value[len(start) :])
            trainer.run(x, part, ROUNDS)
            seen = float(sizes.sum())
            new = np.concatenate([trainer.m.p, trainer.squares])
            pieces = [(new[i : i + CHUNK].astype(np.float64) * seen).tobytes() for i in range(0, len(new), CHUNK)]
            return pd.DataFrame({"part": np.arange(len(pieces), dtype=np.int32), "some": np.full(len(pieces), int(key[0]) % 64, np.int32), "n": [seen] * len(pieces), "p": pieces})

        found = rows.groupBy("shard").applyInPandas(run, "part int, some int, n double, p binary")
        found = found.groupBy("part", "some").applyInPandas(add, "part int, n double, p binary")
        found = found.groupBy("part").applyInPandas(add, "part int, n double, p binary").orderBy("part").collect()  # one model's size, twice
        if not found:
            break
        state = np.concatenate([np.frombuffer(r.p) / r.n for r in found]).astype(np.float32)
    if shards > 1:
        drop_scratch(rows)
    return state[: len(start)]

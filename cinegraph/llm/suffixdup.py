"""Suffix-array dedup by threshold-bounded interval expansion (operator 1).

A byte is removed if a string of L bytes that covers it also starts anywhere else in the corpus.

Dealing. Every L-byte window has an anchor: the least hash among its GRAM-byte grams. Equal windows have equal
anchors, so what repeats meets under its anchor's hash. A piece is a stretch of text whose windows share one anchor
hash; a run of a short period is one piece, cut after MOST_WINDOWS windows. An anchor of a single piece is dropped
unless it stands in the piece more than once. Where all pieces of an anchor are equal (by the anchor's rolling hash
and another hash over all bytes), all their windows repeat; only anchors with different pieces, one copy of each
piece, go on. So the repeated stretches of copies are shipped once, whatever the number of copies.

Expansion. A task joins whole anchor groups to a text of some MB, sorts its suffixes by their first L bytes at
least, and derives the common prefixes of neighbours from the Burrows-Wheeler transform by increasing value:
breadth-first, the interval of each string w is extended backward to those of cw, and an interval that ends at a
boundary without a value gives it the value |w|. After L levels the boundaries without a value are those with L
common bytes or more, and the suffixes beside them are the windows that repeat. Each boundary is given its value
once, so the work is in proportion to the text, and nothing past L is expanded.

An anchor with more than MOST_PIECES different pieces or MOST_BYTES of them (the edge of a passage in very many
documents) would make a group without bound: there each window is counted by its hash and its anchor's hash, with
partial aggregation.

Edge cases: a null text is empty; a text under L bytes keeps all; every row is a document of its own, so rows with
equal id and text lose all of their L-byte strings; ids may be null, and may stand on rows with different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import drop_scratch, flagged, gram_hash, passes, piece_hash, prefix_hash, scratch, tune

L = 200
GRAM = 64
MOST_PIECES, MOST_BYTES = 2000, 4 << 20
MOST_WINDOWS = 1 << 17
#: Bytes of one task's expansion.
TEXT_BYTES = 1 << 20
_POS = 28


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and anchor hash of each piece of a pass, and whether its anchor stands in it at several places."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none > 0
    w = length - gram + 1
    g = gram_hash(prefix_hash(data), gram)
    key = (g >> np.uint64(_POS) << np.uint64(_POS)) | np.arange(len(g), dtype=np.uint64)
    m = -(-len(key) // w) * w
    pad = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(key)] = key
    pad = pad.reshape(-1, w)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    k = min(n, len(key) - w + 1)
    least = np.minimum(right[:k], left[w - 1 : w - 1 + k])
    at = (least & np.uint64((1 << _POS) - 1)).astype(np.int64)
    size = np.diff(off)
    ok = np.zeros(k + 1, np.int64)
    rows = np.flatnonzero(size >= length)
    first, last = off[:-1][rows], off[1:][rows] - length + 1
    np.add.at(ok, first, 1)
    np.subtract.at(ok, np.minimum(last, k), 1)
    valid = np.cumsum(ok[:-1]) > 0
    begin = valid.copy()
    hash_of = least >> np.uint64(_POS)
    begin[1:] &= ~valid[:-1] | (hash_of[1:] != hash_of[:-1])
    begin[first] = True
    p1 = np.flatnonzero(begin)
    stop = valid.copy()
    stop[:-1] &= begin[1:] | ~valid[1:]
    p2 = np.flatnonzero(stop)
    if len(p1) and (p2 - p1).max() >= MOST_WINDOWS:
        parts = (p2 - p1) // MOST_WINDOWS + 1
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        p1, last_of = np.repeat(p1, parts) + nth * MOST_WINDOWS, np.repeat(p2, parts)
        p2 = np.minimum(p1 + MOST_WINDOWS - 1, last_of)
    return np.searchsorted(off, p1, "right") - 1, p1, p2 + length, hash_of[p1], at[p1] != at[p2]


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the pieces in order of their first `depth` symbols; text has 0 at `ends`, symbols from 1.

    A piece's end is less than any symbol, and ends are told apart by their place.
    """
    n = len(text)
    piece = np.searchsorted(ends, np.arange(n))
    end = ends[piece]
    key = np.zeros(n, np.int64)
    wide = np.concatenate([text.astype(np.int64), np.zeros(8, np.int64)])
    for i in range(7):
        key = (key << 9) | np.where(np.arange(n) + i < end, wide[i : i + n], 0)
    key[ends] = np.arange(len(ends)) - len(ends)
    h = 0
    while True:
        order = np.argsort(key)
        s = key[order]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(s[1:], s[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if h >= depth or new.all():
            return order
        if h:
            key = rank * (n + 1) + rank[np.minimum(np.arange(n) + h, end)]
        else:  # of suffixes that end within seven symbols, the place of the end decides
            key = rank * (n + 1) + np.where(np.arange(n) + 7 > end, piece + 1, 0)
        h = 2 * h or 7


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, the starts of its windows that also start elsewhere in the pieces."""
    sizes = np.array([len(p) for p in pieces])
    n = int(sizes.sum()) + len(pieces)
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(n, np.int16)
    body = np.ones(n, bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int16) + 1
    order = suffix_order(text, ends, length)
    bwt = text[order - 1]  # a piece's first suffix has an end before it: 0
    bwt[order == 0] = 0
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    unset[1 : len(ends) + 1] = False  # ends have nothing in common with each other
    # level 0: the string of no symbols has all suffixes; each end is a string of its own
    lo, hi = np.array([0]), np.array([n])
    alone = np.arange(len(ends))
    for level in range(length):
        one = hi - lo == 1
        p = lo[one]
        p = p[bwt[p] > 0]
        new_lo, new_hi = [lf[p]], [lf[p] + 1]
        a, b = lo[~one], hi[~one]
        if len(a):
            width = b - a
            flat = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(a, width)
            c = bwt[flat].astype(np.int64)
            key = np.repeat(np.arange(len(a)), width) * 512 + c
            # in runs of one symbol only the first and the last place matter
            d = key[1:] != key[:-1]
            edge = np.append(d, True)
            edge[1:] |= d
            edge[0] = True
            keep = edge & (c > 0)
            flat, key = flat[keep], key[keep]
            o = np.argsort(key, kind="stable")
            flat, key = flat[o], key[o]
            if len(key):
                cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                last = np.append(cut[1:], len(key)) - 1
                new_lo.append(lf[flat[cut]])
                new_hi.append(lf[flat[last]] + 1)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = unset[hi]
        lo, hi = lo[fresh], hi[fresh]
        unset[hi] = False
        if level == 0:
            lo, hi = np.concatenate([lo, alone]), np.concatenate([hi, alone + 1])
        if not len(lo):
            break
    long = unset[:n]
    again = long.copy()
    again[:-1] |= long[1:]
    hit = np.zeros(n, bool)
    hit[order[again]] = True
    start = ends - sizes
    return [np.flatnonzero(hit[s:e]) for s, e in zip(start.tolist(), ends.tolist(), strict=True)]


def _ranges(starts: np.ndarray, length: int) -> list[dict[str, int]]:
    """Maximal covered stretches of windows at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    a, b = starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)] + length
    return [{"s": x, "e": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]


_RANGES = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _expand(pieces: DataFrame, length: int) -> DataFrame:
    """ah, ph, ranges: what repeats in the pieces of an anchor, by place in the piece."""
    n = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = pieces.select("ah", "ph", "piece").repartition(n, "ah").sortWithinPartitions("ah")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = repeated([x[2] for x in held], length) if held else []
            out = [(a, p, _ranges(s, length)) for (a, p, _), s in zip(held, found, strict=True) if len(s)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], _RANGES)], names=["ah", "ph", "ranges"])

        for b in batches:
            for a, p, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if size > TEXT_BYTES and held[-1][0] != a:
                    yield flush()
                    size = 0
                held.append((a, p, t))
                size += len(t)
        yield flush()

    return rows.mapInArrow(run, "ah long, ph long, ranges array<struct<s:long,e:long>>")


def _windows(pieces: DataFrame, length: int) -> DataFrame:
    """ah, ph, ranges for anchors with very many pieces: windows are counted by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in passes(batches, "piece"):
            s = prefix_hash(data)
            n = np.diff(off) - length + 1
            first = np.repeat(off[:-1], n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = piece_hash(s, first + at, first + at + length).view(np.int64)
            back = pa.array(np.repeat(np.arange(b.num_rows), n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(back), b.column(1).take(back), pa.array(at), pa.array(h)], names=["ah", "ph", "at", "h"])

    seen = scratch(pieces.select("ah", "ph", "piece").mapInArrow(run, "ah long, ph long, at long, h long"), "sa-windows")
    twice = scratch(seen.groupBy("ah", "h").agg(F.count("*").alias("n")).where("n > 1").select("ah", "h"), "sa-twice")
    found = seen.join(twice, ["ah", "h"]).groupBy("ah", "ph").agg(F.array_sort(F.collect_list("at")).alias("starts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_ranges(np.asarray(x), length) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, _RANGES)], names=["ah", "ph", "ranges"])

    return found.mapInArrow(merge, "ah long, ph long, ranges array<struct<s:long,e:long>>")


def _keyed(text: Column, doc_id: Column) -> list[Column]:
    """k, h: what tells documents apart. Rows that agree in both are equal in id and text."""
    return [F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")).alias("k"), F.xxhash64(text, doc_id.isNull()).alias("h")]


def spans(docs: DataFrame, length: int = L, gram: int = GRAM) -> DataFrame:
    """k, h, ranges: for each document (k, h, text) with repeated strings, the stretches that they cover (unmerged)."""
    import xxhash

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in passes(batches, "text"):
            row, p1, p2, h, multi = anchors(data, off, length, gram)
            raw = memoryview(data)
            ph = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(p1.tolist(), p2.tolist(), strict=True)), np.uint64, len(p1))
            back = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(back), b.column(1).take(back), pa.array(p1 - off[row], pa.int32()), pa.array(p2 - p1, pa.int32()), pa.array(h.view(np.int64)), pa.array(ph.view(np.int64)), pa.array(multi)],
                names=["k", "h", "start", "size", "ah", "ph", "multi"],
            )

    rows = docs.select("k", "h", "text").where(F.octet_length("text") >= length)
    found = scratch(rows.mapInArrow(find, "k long, h long, start int, size int, ah long, ph long, multi boolean"), "sa-anchors")
    groups = found.groupBy("ah").agg(F.count("*").alias("n"), F.min("ph").alias("p"), F.max("ph").alias("q"), F.max("multi").alias("multi"))
    groups = scratch(groups.where("n > 1 or multi").select("ah", F.expr("n = 1 or p <> q").alias("mixed")), "sa-groups", found.count())
    hits = scratch(found.drop("multi").join(groups, "ah"), "sa-hits")
    drop_scratch(found, groups)
    n = hits.count()
    whole = hits.where("not mixed").select("k", "h", F.col("start").cast("long").alias("s"), (F.col("start") + F.col("size")).cast("long").alias("e"))

    mixed = hits.where("mixed")
    kinds = mixed.groupBy("ah", "ph").agg(F.count("*").alias("m"), F.min(F.struct("k", "h", "start", "size")).alias("x"))
    kinds = scratch(kinds.select("ah", "ph", "m", "x.*"), "sa-kinds", n)
    wanted = kinds.groupBy("k", "h").agg(F.collect_list(F.struct("ah", "ph", "start", "size")).alias("own"))
    texts = flagged(docs.select("k", "h", "text"), kinds, "h").where("flag").select("k", "h", F.encode("text", "UTF-8").alias("text"))
    cut = texts.join(wanted, ["k", "h"]).dropDuplicates(["k", "h"]).select("text", F.explode("own").alias("w"))
    pieces = scratch(cut.select("w.ah", "w.ph", F.expr("substring(text, w.start + 1, w.size)").alias("piece")), "sa-pieces")
    many = kinds.groupBy("ah").agg(F.count("*").alias("n"), F.sum("size").alias("b")).where((F.col("n") > MOST_PIECES) | ((F.col("n") > 1) & (F.col("b") > MOST_BYTES)))
    many = scratch(many.select("ah"), "sa-many", n // MOST_PIECES)
    parts = _expand(pieces.join(many, "ah", "left_anti"), length)
    if not many.isEmpty():
        parts = parts.unionByName(_windows(pieces.join(many, "ah", "left_semi"), length))
    parts = scratch(parts, "sa-parts")
    ranges = parts.select("ah", "ph", F.explode("ranges").alias("r")).select("ah", "ph", "r.s", "r.e")
    twice = kinds.where("m > 1").select("ah", "ph", F.lit(0).cast("long").alias("s"), F.col("size").cast("long").alias("e"))
    ranges = scratch(ranges.join(twice.select("ah", "ph"), ["ah", "ph"], "left_anti").unionByName(twice), "sa-ranges")
    partly = mixed.select("k", "h", "start", "ah", "ph").join(ranges, ["ah", "ph"]).select("k", "h", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
    out = whole.unionByName(partly).groupBy("k", "h").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    out = scratch(out, "sa-spans", n)
    drop_scratch(hits, kinds, pieces, parts, ranges)
    return out


def _cut(as_text: bool):
    """n_removed, n_spans and what is left of a text without its ranges; as text, parts of characters go as well."""
    kind = pa.string() if as_text else pa.binary()

    @F.arrow_udf(f"struct<n_removed:long,n_spans:long,kept:{'string' if as_text else 'binary'}>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            gone, runs, kept = [], [], []
            for t, r in zip(texts, ranges, strict=True):
                raw, own = (t.as_py() or "").encode(), r.as_py() or []
                d = np.zeros(len(raw) + 1, np.int64)
                np.add.at(d, [x["s"] for x in own], 1)
                np.subtract.at(d, [x["e"] for x in own], 1)
                inside = np.cumsum(d[:-1]) > 0
                gone.append(int(inside.sum()))
                runs.append(int(np.count_nonzero(np.diff(np.concatenate([[0], inside.astype(np.int8)])) == 1)))
                left = np.frombuffer(raw, np.uint8)[~inside].tobytes()
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            yield pa.StructArray.from_arrays([pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, kind)], ["n_removed", "n_spans", "kept"])

    return cut.asNondeterministic()


def remove(docs: DataFrame, length: int = L, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept added: the bytes that stay (binary), or as_text their text."""
    tune(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    text = F.coalesce("text", F.lit(""))
    found = spans(docs.select(*_keyed(text, F.col("doc_id")), text.alias("text")), length, gram)
    marked = flagged(docs.select(*_keyed(text, F.col("doc_id")), F.struct(*names).alias("r")), found, "h")
    zero, own = F.lit(0).cast("long"), F.coalesce("r.text", F.lit(""))
    size = F.octet_length(own).cast("long").alias("n_bytes")
    same = marked.where("not flag").select("r.*", size, zero.alias("n_removed"), zero.alias("n_spans"), (own if as_text else F.encode(own, "UTF-8")).alias("kept"))
    hit = marked.where("flag").join(found, ["k", "h"], "left").select("r", size, _cut(as_text)(F.col("r.text"), F.col("ranges")).alias("c"))
    return hit.select("r.*", "n_bytes", "c.n_removed", "c.n_spans", "c.kept").unionByName(same)


def digests(docs: DataFrame) -> DataFrame:
    return remove(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

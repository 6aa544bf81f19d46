"""MinHash near-dedup with bottom-k sketches of one hash function (operator 4).

Texts with equal shingle sets are one class from the start (a 128-bit fingerprint of the set). A class keeps the
SKETCH smallest hash values of its set; the KEYS smallest of them make the inverted lists. Two sets with a
Jaccard similarity of 0.8 share three of their sixteen keys at least but for a chance of 1e-8, so a pair is
found by two shared short lists, or by a shared pair of long ones:

* lists of up to SHORT classes give pairs; two shared lists make a candidate;
* the keys with longer lists (a common passage, or a large group of near copies) are dealt to KEY_CLASSES by their
  value, and each set emits all pairs within a class, so that four shared keys share a pair for certain; the lists
  of such pairs are short again for common passages, and give candidates;
* where even those are long, the classes are near copies or share a common passage: they join one cluster by a
  star, without any pair.

A candidate pair stays if the similarity estimated on the union sketch comes near the threshold. The candidates'
connected components are clusters: each class belongs to one. A cluster of more than one block, which a passage that
is common in the whole corpus can hold together, is divided first: sets that are alike share one of the rarest fifth
(and one more) of their shingles, so the lists of those join what belongs together, and lose no link. All pairs of a
cluster are then verified exactly, in blocks of bounded bytes: a hashed count matrix bounds the intersections
from above, pairs that pass are intersected, and pairs that are connected already are skipped, so what leaves a
task is a star for each component, never the pairs. The components of those links are the result.

Edge cases: a null or empty text, or one without words, has an empty set and stays alone; fewer words than a
shingle make one shingle. Every row is a document: rows without an id, or with an id that occurs again, are judged
by their texts like all others. component_id is the least id in the component, null if none of its rows has one;
there one of the rows counts as kept. keep_one keeps exactly one row of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.llm.common import LOWER, drop_scratch, flagged, from_text, mix, passes, piece_hash, prefix_hash, scratch, tune, window_hash, words
from cinegraph.operators.components import components

SHINGLE = 4
THRESHOLD = 80  # per cent
KEYS, SKETCH = 16, 64
#: A set's keys with long lists make pairs within so many classes of keys. Four shared keys always share a pair, so
#: similar sets share none with a chance of 6e-8 at most.
KEY_CLASSES = 3
SHORT = 32
#: Shared values among the SKETCH smallest of the union: 0.8 lies five standard deviations above.
LEAST_SHARE = 0.55
BLOCK_BYTES = 4 << 20
DIMS = 2048


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data = LOWER[data]
    starts, ends, counts = words(data, off)
    w = piece_hash(prefix_hash(data), starts, ends)
    full = window_hash(w, k)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(full[at : at + n - k + 1]))
        elif n:
            out.append(mix(window_hash(w[at : at + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h & (1 << 64) - 1) - (1 << 63), (h >> 64) - (1 << 63)


def _features(docs: DataFrame, shingle: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, sketch array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in passes(batches, "text"):
            sets = shingle_sets(data, off, shingle)
            f = [fingerprint(s) for s in sets]
            keys = [s[:KEYS].view(np.int64) for s in sets]
            sketch = [(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in f], pa.int64()) for i in (0, 1)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "f1", "f2", "keys", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _long_lists(postings: DataFrame, key: str, rows: int) -> DataFrame:
    """postings (at most `rows`) with the length of their list, for lists of two or more."""
    counts = scratch(postings.groupBy(key).agg(F.count("*").alias("len")).where("len > 1"), "nd-counts", rows)
    return postings.join(counts, key)


def _pairs(postings: DataFrame, key: str) -> DataFrame:
    """a < b of each short list, for sizes that allow the threshold."""
    left = postings.select(key, F.col("rep").alias("a"), F.col("n").alias("na"))
    right = postings.select(key, F.col("rep").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb"))
    return left.join(right, key).where(fits).select("a", "b")


def _candidates(sets: DataFrame, n_sets: int) -> DataFrame:
    """a, b: pairs that may be near duplicates, and stars over long lists of key pairs."""
    postings = sets.select("rep", "n", F.explode("keys").alias("key"))
    lists = scratch(_long_lists(postings, "key", KEYS * n_sets), "nd-lists", KEYS * n_sets)
    short = _pairs(lists.where(F.col("len") <= SHORT), "key").groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b")

    hot = lists.where(F.col("len") > SHORT).groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("key")).alias("k"))
    hot = scratch(hot, "nd-hot", n_sets)
    two = F.expr(f"flatten(transform(k, (x, i) -> transform(filter(slice(k, i + 2, size(k)), y -> pmod(y, {KEY_CLASSES}) = pmod(x, {KEY_CLASSES})), y -> xxhash64(x, y))))")
    n_hot = KEYS * (KEYS - 1) // 2 * hot.count()
    second = scratch(_long_lists(hot.select("rep", "n", F.explode(two).alias("key")), "key", n_hot), "nd-lists", n_hot)
    pairs = short.unionByName(_pairs(second.where(F.col("len") <= SHORT), "key")).distinct()

    sketch = sets.select("rep", "sketch")
    both = pairs.join(sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    unsigned = lambda c: F.transform(c, lambda x: F.when(x < 0, x.cast("long") + (1 << 32)).otherwise(x.cast("long")))
    both = both.select("a", "b", unsigned(F.col("sa")).alias("sa"), unsigned(F.col("sb")).alias("sb"))
    union = F.expr(f"slice(array_sort(array_union(sa, sb)), 1, {SKETCH})")
    share = F.size(F.array_intersect(F.array_intersect(F.col("sa"), F.col("sb")), union))
    pairs = both.where(share >= LEAST_SHARE * F.size(union)).select("a", "b")

    long = second.where(F.col("len") > SHORT)
    star = long.groupBy("key").agg(F.min("rep").alias("b"))
    star = long.select("key", F.col("rep").alias("a")).join(scratch(star, "nd-stars", n_hot), "key").select("a", "b")
    return pairs.unionByName(star).where("a <> b")


class _Links:
    """Components within one task."""

    def __init__(self, ids: list[int]):
        self.ids = ids
        self.root = list(range(len(ids)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if self.ids[j] < self.ids[i]:
            i, j = j, i
        self.root[j] = i

    def star(self) -> list[tuple[int, int]]:
        return [(self.ids[i], self.ids[r]) for i in range(len(self.ids)) if (r := self.find(i)) != i]


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= THRESHOLD * (len(both) - inter)


def verify(ids: list[int], sets: list[np.ndarray], first: list[bool], within: bool) -> list[tuple[int, int]]:
    """Stars over the links of a block pair. first: of the first block; within: both are one block."""
    links, m = _Links(ids), len(ids)
    if m <= 24:
        for i in range(m):
            for j in range(i):
                if (within or first[i] != first[j]) and links.find(i) != links.find(j) and _linked(sets[i], sets[j]):
                    links.join(i, j)
        return links.star()
    size = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(m), size)
    dims = (np.concatenate(sets) % np.uint64(DIMS)).astype(np.int64)
    left = [i for i in range(m) if within or first[i]]
    right = np.array([i for i in range(m) if within or not first[i]])
    counts = lambda own: np.bincount(np.searchsorted(own, rows[k := np.isin(rows, own)]) * DIMS + dims[k], minlength=len(own) * DIMS).reshape(len(own), DIMS).astype(np.float32)
    other = counts(right)
    for at in range(0, len(left), 256):
        own = np.array(left[at : at + 256])
        most = np.minimum(counts(own) @ other.T, np.minimum.outer(size[own], size[right]))
        may = 100 * most >= THRESHOLD * (size[own][:, None] + size[right][None, :] - most)
        for p, i in enumerate(own.tolist()):
            for j in right[may[p]].tolist():
                if (not within or j < i) and links.find(i) != links.find(j) and _linked(sets[i], sets[j]):
                    links.join(i, j)
    return links.star()


def _odd(feats: DataFrame, rows: int) -> DataFrame | None:
    """The ids that do not tell rows apart (null, if there is one, among them), or None."""
    odd = scratch(feats.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "nd-odd", rows)
    return None if odd.isEmpty() else odd


def _with_sets(docs: DataFrame, members: DataFrame, shingle: int, odd: DataFrame | None) -> DataFrame:
    """members (rep, doc_id, f1, f2 and more) with the full set of each, as the bytes of its sorted hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in passes(batches, "text"):
            own = shingle_sets(data, off, shingle)
            f = [fingerprint(s) for s in own]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[i] for x in f], pa.int64()) for i in (0, 1)), pa.array([s.tobytes() for s in own], pa.binary())], names=["doc_id", "f1", "f2", "set"])

    own = flagged(docs.select("doc_id", "text"), members.select("doc_id"), "doc_id").where("flag").select("doc_id", "text").mapInArrow(sets, "doc_id long, f1 long, f2 long, set binary")
    key = ["doc_id", "f1", "f2"]
    if odd is not None:
        marked = scratch(flagged(own, odd, "doc_id"), "nd-sets")
        own = marked.where("not flag").drop("flag").unionByName(marked.where("flag").groupBy(*key).agg(F.first("set").alias("set")))
    placed = members.withColumnsRenamed({c: f"c_{c}" for c in key})
    same = (own.f1 == placed.c_f1) & (own.f2 == placed.c_f2) & own.doc_id.eqNullSafe(placed.c_doc_id)
    return own.join(placed, same).drop(*(f"c_{c}" for c in key))


def _split(docs: DataFrame, clusters: DataFrame, shingle: int, odd: DataFrame | None, n_sets: int) -> DataFrame:
    """clusters, where those of more than one block are divided by the rarest shingles of their sets."""
    big = scratch(clusters.groupBy("cluster").agg(F.sum("n").alias("n")).where(F.col("n") * 8 > BLOCK_BYTES).select("cluster"), "nd-big", n_sets)
    if big.isEmpty():
        return clusters
    members = clusters.join(big, "cluster", "left_semi")
    own = scratch(_with_sets(docs, members, shingle, odd).select("rep", "cluster", "n", "set"), "nd-own")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(3).to_pylist()
            k = [len(x) // 8 for x in held]
            ids = [pa.array(np.repeat(b.column(c).to_numpy(), k)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.frombuffer(b"".join(held), np.int64))], names=["rep", "cluster", "n", "g"])

    e = own.mapInArrow(elements, "rep long, cluster long, n long, g long")
    # a shingle of one set makes no list, but counts as rarer than all others
    e = e.join(e.groupBy("cluster", "g").agg(F.count("*").alias("c")).where("c > 1"), ["cluster", "g"])
    of = Window.partitionBy("rep")
    e = e.withColumn("r", F.row_number().over(of.orderBy("c", "g")) + F.col("n") - F.count("*").over(of))
    e = scratch(e.where(F.col("r") <= F.floor(F.col("n") * (100 - THRESHOLD) / 100) + 1).select("cluster", "g", "rep"), "nd-rarest")
    star = e.join(e.groupBy("cluster", "g").agg(F.min("rep").alias("a")), ["cluster", "g"]).select("a", F.col("rep").alias("b"))
    parts = components(star.where("a <> b")).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    drop_scratch(own, e)
    return scratch(clusters.join(big, "cluster", "left_anti").unionByName(members.drop("cluster").join(parts, "rep")), "nd-clusters", n_sets)


def _links(docs: DataFrame, clusters: DataFrame, shingle: int, odd: DataFrame | None, n_sets: int) -> DataFrame:
    """a, b: verified links that connect what is linked in each cluster."""
    total = scratch(clusters.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") * 8) / BLOCK_BYTES).cast("int").alias("nb")), "nd-blocks", n_sets)
    placed = clusters.join(total, "cluster").select("rep", "doc_id", "f1", "f2", "cluster", "nb", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int").alias("block"))
    rows = _with_sets(docs, placed, shingle, odd)
    task = F.explode(F.expr("transform(sequence(0, nb - 1), o -> struct(least(o, block) as i, greatest(o, block) as j))"))
    rows = rows.select("rep", "set", "cluster", "block", task.alias("t")).select("rep", "set", "cluster", "block", "t.i", "t.j")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: dict[int, tuple[np.ndarray, bool]] = {}
        a: list[int] = []
        z: list[int] = []

        def flush() -> None:
            if key is not None and len(held) > 1:
                ids = list(held)
                for x, y in verify(ids, [held[i][0] for i in ids], [held[i][1] for i in ids], key[1] == key[2]):
                    a.append(x)
                    z.append(y)
            held.clear()

        for b in batches:
            rep, sets_, cluster, block, i, j = (b.column(k).to_pylist() for k in range(6))
            for r in range(b.num_rows):
                now = (cluster[r], i[r], j[r])
                if now != key:
                    flush()
                    key = now
                held[rep[r]] = (np.frombuffer(sets_[r], np.uint64), block[r] == i[r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])
            a, z = [], []
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _judged(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame | None]:
    """row, doc_id, n_shingles, f1, f2, component_id and one (the component's single row that stays) of every row; odd ids."""
    tune(docs.sparkSession)
    feats = scratch(_features(docs, shingle), "nd-features")
    n_rows = feats.count()
    odd = _odd(feats, n_rows)
    some = feats.where("n_shingles > 0")
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = some.groupBy("f1", "f2").agg(F.min(best).alias("best"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    sets = scratch(classes.select(F.col("best.row").alias("rep"), F.col("best.doc_id").alias("doc_id"), "*"), "nd-classes", n_rows)
    n_sets = sets.count()
    groups = components(_candidates(sets, n_sets))
    clusters = scratch(groups.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(sets.select("rep", "doc_id", "f1", "f2", "n"), "rep"), "nd-clusters", n_sets)
    clusters = _split(docs, clusters, shingle, odd, n_sets)
    found = components(_links(docs, clusters, shingle, odd, n_sets)).withColumnRenamed("node", "rep")
    label = scratch(sets.select("f1", "f2", "rep", "best").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "nd-components", n_sets)
    least = label.groupBy("component").agg(F.min("best").alias("of"))
    label = scratch(label.join(least, "component").select("f1", "f2", F.col("of.doc_id").alias("component_id"), F.col("of.row").alias("stays")), "nd-labels", n_sets)
    drop_scratch(sets)
    out = some.select("row", "doc_id", "n_shingles", "f1", "f2").join(label, ["f1", "f2"])
    out = out.select("row", "doc_id", "n_shingles", "f1", "f2", "component_id", (F.col("row") == F.col("stays")).alias("one"))
    alone = feats.where("n_shingles = 0").select("row", "doc_id", "n_shingles", "f1", "f2", F.col("doc_id").alias("component_id"), F.lit(True).alias("one"))
    return out.unionByName(alone), odd


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    found, _ = _judged(docs, shingle)
    kept = F.when(F.col("component_id").isNull(), F.col("one")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows that stay: one of each component, and all without words."""
    found, odd = _judged(docs, shingle)
    kept = found.where("one").select("doc_id", "n_shingles", "f1", "f2")
    if odd is None:
        return docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    kept = scratch(kept, "nd-kept")
    names = docs.columns
    marked = flagged(docs.select(F.struct(*names).alias("r"), "doc_id", "text"), odd, "doc_id")
    plain = marked.where("not flag").join(kept.select("doc_id"), "doc_id", "left_semi").select("r.*")

    def of_text(data: np.ndarray, off: np.ndarray) -> pa.Array:
        sets = shingle_sets(data, off, shingle)
        f = [fingerprint(s) for s in sets]
        return pa.StructArray.from_arrays([pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in f], pa.int64()) for i in (0, 1))], ["n", "f1", "f2"])

    # rows whose ids tell nothing: by their sets, one of those that are alike in both
    rows = marked.where("flag").select("r", "doc_id", from_text(of_text, "struct<n:long,f1:long,f2:long>")(F.col("text")).alias("_f"))
    rows = scratch(rows.select("r", "doc_id", "_f.n", "_f.f1", "_f.f2"), "nd-rows")
    wins = kept.where("n_shingles > 0").select(F.col("doc_id").alias("k_id"), F.col("f1").alias("k1"), F.col("f2").alias("k2")).distinct()
    of = rows.where("n > 0").join(wins, rows.doc_id.eqNullSafe(wins.k_id) & (F.col("f1") == F.col("k1")) & (F.col("f2") == F.col("k2")), "left_semi")
    single = of.groupBy("doc_id", "f1", "f2").agg(F.first("r").alias("r")).select("r.*")
    return plain.unionByName(single).unionByName(rows.where("n = 0").select("r.*"))

"""Entity resolution: merging mentions of a media item, matching a graph, judging candidates, closing chains.

Models are plugged in as functions over batches; the defaults are deterministic and need no network: a judge accepts
a score of 0.9, a summariser keeps the first characters.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegraph.functions.sequence import sequence_ratio
from cinegraph.functions.text import entropy, jaccard, normalize_exact, normalize_fuzzy, shingles3
from cinegraph.functions.vector import cosine_raw
from cinegraph.operators.components import components
from cinegraph.operators.retrieval import knn
from cinegraph.operators.similarity import contained_pairs, near_pairs, sequence_pairs
from cinegraph.plans.shared import drop_scratch, scratch

Judge = Callable[[list[dict]], list[dict]]
MERGE_AT = 0.9


BORDERLINE_AT = 0.5
#: Names of an item whose pairs are all compared in place.
FEW = 200


def passes_gate(name: F.Column) -> F.Column:
    """Names long or varied enough to be compared fuzzily: six characters or two words, and an entropy of 1.5 bits."""
    short = (F.length(name) < 6) & (F.size(F.split(name, " ")) < 2)
    return ~short & (entropy(name) >= 1.5)


def _alike(names: DataFrame, key: str) -> DataFrame:
    """key, a < b, inside, j: pairs of an item's gated names of at least BORDERLINE_AT, or of which one holds the other without spaces."""
    s = names.where(passes_gate(F.col("fuzzy"))).select(key, "name", F.regexp_replace("fuzzy", " ", "").alias("flat"), shingles3(F.col("fuzzy")).alias("s"))
    s = scratch(s, "er-gated")
    near = near_pairs(s.where(F.size("s") > 0), [key], BORDERLINE_AT).withColumn("inside", F.lit(False))
    held = contained_pairs(s, [key]).withColumn("inside", F.lit(True)).withColumn("j", F.lit(None).cast("double"))
    return near.unionByName(held).groupBy(key, "a", "b").agg(F.max("inside").alias("inside"), F.max("j").alias("j"))


def _by_lists(names: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """merge_mentions for items of many names (key, name, fuzzy), by inverted lists."""
    names = scratch(names.withColumn("k", F.monotonically_increasing_id()), "er-names")
    pairs = scratch(_alike(names, key).where(F.col("inside") | (F.col("j") >= BORDERLINE_AT)), "er-pairs")
    node = lambda n: names.select(key, F.col("name").alias(n), F.col("k").alias(f"k{n}"))
    ids = pairs.join(node("a"), [key, "a"]).join(node("b"), [key, "b"])
    found = components(ids.where(F.col("inside") | (F.col("j") >= MERGE_AT)).select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    label = names.join(found.withColumnRenamed("node", "k"), "k", "left").withColumn("c", F.coalesce("component", "k"))
    least = label.groupBy("c").agg(F.min("name").alias("group"))
    groups = scratch(label.join(least, "c").select(key, "name", "group"), "er-groups")
    side = lambda n: groups.select(key, F.col("name").alias(n), F.col("group").alias(f"g{n}"))
    edge = pairs.where(~F.col("inside") & (F.col("j") < MERGE_AT)).join(side("a"), [key, "a"]).join(side("b"), [key, "b"])
    return groups, edge.where("ga <> gb").select(key, "a", "b", "j")


@functools.lru_cache(1 << 16)
def _form(fuzzy: str) -> tuple[str, frozenset[str]] | None:
    """A gated name without spaces, and its shingles; None for a name that is not compared (as passes_gate says)."""
    flat = fuzzy.replace(" ", "")
    n = len(flat)
    bits = 0.0
    for x in dict.fromkeys(flat):
        share = flat.count(x) / n
        bits -= share * (math.log(share) / math.log(2))
    return None if (len(fuzzy) < 6 and " " not in fuzzy) or bits < 1.5 else (flat, _shingles(fuzzy))


def _shingles(x: str) -> frozenset[str]:
    return frozenset(x[i : i + 3] for i in range(len(x) - 2)) if len(x) != 1 else frozenset((x,))


@functools.lru_cache(1 << 18)
def _likeness(a: str, b: str) -> float:
    """2 if one of two gated names holds the other, else the Jaccard similarity of their shingles."""
    (x, s), (y, t) = _form(a), _form(b)
    if len(x) >= 3 and len(y) >= 3 and (x in y or y in x):
        return 2.0
    return len(s & t) / len(s | t) if s and t else 0.0


def _one_item(names: list[str], fuzzy: list[str]) -> tuple[list[str], list[tuple[str, str, float]]]:
    """The group of each of an item's sorted names, and its borderline pairs."""
    at = [i for i, f in enumerate(fuzzy) if _form(f)]
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    near = []
    for k, i in enumerate(at):
        for l in at[k + 1 :]:  # noqa: E741
            j = _likeness(fuzzy[i], fuzzy[l])
            if j >= MERGE_AT:
                x, y = find(i), find(l)
                root[max(x, y)] = min(x, y)
            elif j >= BORDERLINE_AT:
                near.append((i, l, j))
    group = [find(i) for i in range(len(names))]
    return [names[g] for g in group], [(names[i], names[l], j) for i, l, j in near if group[i] != group[l]]


def merge_mentions(mentions: DataFrame, key: str = "media_id") -> tuple[DataFrame, DataFrame]:
    """Groups of the names of each item, and its borderline pairs.

    mentions: key, name, type, description, segment_index. Equal normalised names are one; groups join where gated
    names contain each other or reach MERGE_AT, closed transitively. The first result has the normalised name and its
    group (the least name in it); the second the pairs of different groups between BORDERLINE_AT and MERGE_AT.

    Mentions are dealt by item once. All pairs of an item of up to FEW names are compared in place; items of more
    names go through inverted lists.
    """
    by_item(mentions.sparkSession)
    exact = mentions.select(key, "name").repartition(key).withColumn("norm", normalize_exact(F.col("name"))).groupBy(key, "norm").agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("rep"))
    items = exact.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("norm", normalize_fuzzy(F.col("rep")).alias("fuzzy")))).alias("l")).select(key, "l.norm", "l.fuzzy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: list[int] = []
            name: list[str] = []
            group: list[str | None] = []
            other: list[str | None] = []
            j: list[float | None] = []
            for i, (names, fuzzy) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                few = len(names) <= FEW
                groups, near = _one_item(names, fuzzy) if few else ([None] * len(names), [])
                name += names + [x[0] for x in near]
                group += groups + [None] * len(near)
                other += ([None] * len(names) if few else fuzzy) + [x[1] for x in near]
                j += [None] * len(names) + [x[2] for x in near]
                own += [i] * (len(names) + len(near))
            text = [pa.array(x, pa.string()) for x in (name, group, other)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int32())), *text, pa.array(j, pa.float64())], names=[key, "name", "group", "other", "j"])

    found = scratch(items.mapInArrow(run, f"`{key}` {dict(mentions.dtypes)[key]}, name string, `group` string, other string, j double"), "er-items")
    groups = found.where("`group` is not null").select(key, "name", "group")
    border = found.where("j is not null").select(key, F.col("name").alias("a"), F.col("other").alias("b"), "j")
    many = found.where("`group` is null and j is null").select(key, "name", F.col("other").alias("fuzzy"))
    if many.isEmpty():
        return groups, border
    more, rest = _by_lists(many, key)
    return groups.unionByName(more), border.unionByName(rest)


def by_item(spark: SparkSession) -> None:
    """Lets rows that are dealt by item be joined and grouped by item and name as they lie, without another shuffle."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def group_rollup(mentions: DataFrame, groups: DataFrame, key: str = "media_id") -> DataFrame:
    """Each group's longest name, commonest type, surface forms, segments and number of mentions; the least on ties."""
    by_item(mentions.sparkSession)
    m = mentions.select(key, "name", "type", "segment_index", "description").repartition(key).withColumn("_norm", normalize_exact(F.col("name")))
    m = m.join(groups.select(key, F.col("name").alias("_norm"), "group").repartition(key), [key, "_norm"])
    longest = lambda name: F.min_by(name, F.struct(-F.length(name), name)).alias("name")
    sets = {"name": "surface_forms", "segment_index": "sources", "description": "descriptions"}
    types = m.groupBy(key, "group", "type").agg(longest("name"), *(F.collect_set(x).alias(y) for x, y in sets.items()), F.count("*").alias("n"))
    return types.groupBy(key, "group").agg(
        longest("name"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(y)))).alias(y) for y in sets.values()),
        F.sum("n").alias("mentions"),
        F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"),
    )


def map_relations(relations: DataFrame, groups: DataFrame, key: str = "media_id") -> tuple[DataFrame, DataFrame]:
    """Relations with their ends mapped to groups by any surface form, and the number dropped for each item."""
    by_item(relations.sparkSession)
    forms = lambda n, g: groups.select(key, F.col("name").alias(n), F.col("group").alias(g)).repartition(key)
    r = relations.withColumn("_s", normalize_exact(F.col("src"))).withColumn("_d", normalize_exact(F.col("dst")))
    r = r.join(forms("_s", "s"), [key, "_s"], "left").join(forms("_d", "t"), [key, "_d"], "left").drop("_s", "_d")
    lost = F.col("s").isNull() | F.col("t").isNull()
    return r.where(~lost), r.where(lost).groupBy(key).agg(F.count("*").alias("dropped"))


def _leaders(texts: list[str], at: float) -> list[int]:
    """The cluster of each text in order: the first whose first member is at least as like it, else a new one."""
    place: dict[str, int] = {}  # a text again falls where it fell first: the clusters before have not changed
    sizes: list[int] = []
    lists: dict[str, list[int]] = {}
    empty = -1
    for x in texts:
        if x in place:
            continue
        s = _shingles(x)
        common: dict[int, int] = {}
        for g in s:
            for c in lists.get(g, ()):
                common[c] = common.get(c, 0) + 1
        if s:
            k = min((c for c, i in common.items() if i / (len(s) + sizes[c] - i) >= at), default=-1)
        else:
            k = empty  # two empty sets are equal
        if k < 0:
            k = len(sizes)
            sizes.append(len(s))
            for g in s:
                lists.setdefault(g, []).append(k)
            empty = k if not s else empty
        place[x] = k
    return [place[x] for x in texts]


def cluster_relations(rows: DataFrame, keys: list[str], at: float = 0.8) -> DataFrame:
    """Greedy clusters of the descriptions of each pair of ends: one joins the first cluster whose first member is as like it.

    rows: keys, pos, description, strength, segment_index. A pair of ends is folded in order, each different description
    once, through lists of the shingles of first members; single rows need no fold.
    """
    fields = ["pos", "description", "strength", "segment_index"]
    l = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_l"))  # noqa: E741

    @F.arrow_udf("array<int>")
    def fold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if x is None else _leaders(x, at) for x in b.to_pylist()], pa.list_(pa.int32()))

    texts = F.when(F.size("_l") > 1, F.transform("_l", lambda x: normalize_fuzzy(x["description"])))
    x = l.withColumn("_c", F.coalesce(fold(texts), F.array(F.lit(0))))
    x = x.select(*keys, F.explode(F.arrays_zip("_l", "_c")).alias("x")).select(*keys, "x._c", *(F.col(f"x._l.{f}").alias(f) for f in fields))
    out = x.groupBy(*keys, "_c").agg(
        F.array_sort(F.collect_list(F.struct("pos", "description"))).alias("d"),
        F.max(F.col("strength").cast("long")).alias("strength"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_set(F.col("segment_index").cast("long"))).alias("sources"),
    )
    return out.select(*keys, F.col("d.description").alias("descriptions"), "strength", "n", "sources")


def _fuzzy(x: str | None) -> str:
    """As normalize_fuzzy."""
    return re.sub(" +", " ", re.sub(r"[^a-z0-9'\u4e00-\u9fff ]", " ", (x or "").lower())).strip(" ")


@functools.lru_cache(1 << 18)
def _linked(a: str, b: str) -> bool:
    """Whether two normalised names of an item are one: both gated, and one holds the other or they reach MERGE_AT."""
    a, b = _fuzzy(a), _fuzzy(b)
    return bool(_form(a) and _form(b)) and _likeness(a, b) >= MERGE_AT


def _links_by_lists(names: list[str]) -> Iterator[tuple[int, int]]:
    """Links that close to the same groups as all pairs that are _linked, through lists of the rarest windows and shingles."""
    flats: dict[str, int] = {}
    sets: dict[str, tuple[int, frozenset[str]]] = {}
    for i, f in enumerate(map(_fuzzy, names)):
        if form := _form(f):
            yield flats.setdefault(form[0], i), i
            sets.setdefault(f, (i, form[1]))
    windows: dict[str, list[str]] = {}
    for x in flats:
        for g in _shingles(x):
            windows.setdefault(g, []).append(x)
    for y, i in flats.items():
        for x in min((windows[g] for g in _shingles(y)), key=len, default=()):
            if len(x) > len(y) and y in x:
                yield flats[x], i
    count: dict[str, int] = {}
    for _, s in sets.values():
        for g in s:
            count[g] = count.get(g, 0) + 1
    lists: dict[str, list[tuple[int, frozenset[str]]]] = {}
    for i, s in sets.values():
        # two sets that reach MERGE_AT share one of so many of their rarest shingles
        rare = sorted(s, key=lambda g: (count[g], g))[: len(s) - math.ceil(MERGE_AT * len(s) - 1e-9) + 1]
        for g in rare:
            own = lists.setdefault(g, [])
            for k, t in own:
                if len(s & t) / len(s | t) >= MERGE_AT:
                    yield k, i
            own.append((i, s))


def _groups(names: set[str]) -> dict[str, str]:
    """The group of each of an item's normalised names, as merge_mentions says: the least name in it."""
    order = sorted(names)
    root = list(range(len(order)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    few = len(order) <= FEW
    links = [(i, k) for k, b in enumerate(order) for i in range(k) if _linked(order[i], b)] if few else _links_by_lists(order)
    if few and not links:
        return dict(zip(order, order, strict=True))
    for i, k in links:
        x, y = find(i), find(k)
        root[max(x, y)] = min(x, y)
    return {x: order[find(i)] for i, x in enumerate(order)}


def premerge(rows: DataFrame, key: str = "media_id", at: float = 0.8) -> DataFrame:
    """key, src, dst, descriptions, strength, n, sources: what cluster_relations makes of map_relations over merge_mentions, in one deal by item.

    rows: key, name (of a mention, or null), src, dst, description, strength, segment_index (of a relation, or dst null).
    A relation is dropped if an end is null or no mention's name. Nothing is written in between. A window leaves an item's
    rows together, and shuffles only what is not dealt by item already; an item is the work of one task. Up to FEW
    names of an item are compared in all pairs, more through lists.
    """
    norm = lambda x: F.when(F.col(x).isNotNull(), normalize_exact(F.col(x)))
    r = rows.select(key, norm("name").alias("_m"), norm("src").alias("_s"), norm("dst").alias("_t"), "src", "dst", "description", F.col("strength").cast("long"), F.col("segment_index").cast("long"))
    r = r.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col(key).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(10)]  # rows of an item whose rest is still to come
        for b in batches:
            for x, y in zip(held, b.columns, strict=True):
                # by numpy many times faster; whole numbers with nulls would come as floats
                fast = pa.types.is_string(y.type) or (pa.types.is_integer(y.type) and not y.null_count)
                x += y.to_numpy(zero_copy_only=False).tolist() if fast else y.to_pylist()
            own, names, s, t, src, dst, text, strength, segment, size = held
            first: list[str] = []
            second: list[str] = []
            found: list[list[int]] = []
            begin = 0
            while begin < len(own) and begin + size[begin] <= len(own):
                end = begin + size[begin]
                named = set(names[begin:end])
                named.discard(None)
                kept = [i for i in range(begin, end) if t[i] in named and s[i] in named]
                begin = end
                if not kept:
                    continue
                group = _groups(named)
                ends: dict[tuple[str, str], list[int]] = {}
                for i in kept:
                    ends.setdefault((group[s[i]], group[t[i]]), []).append(i)
                for (x, y), l in ends.items():  # noqa: E741
                    clusters = {0: l}
                    if len(l) > 1:
                        l.sort(key=lambda i: [(v[i] is not None, v[i]) for v in (segment, src, dst, text)])
                        clusters = {}
                        for i, c in zip(l, _leaders([_fuzzy(text[i]) for i in l], at), strict=True):
                            clusters.setdefault(c, []).append(i)
                    for c in clusters.values():
                        first.append(x)
                        second.append(y)
                        found.append(c)
            out = {
                key: pa.array([own[l[0]] for l in found], b.schema.field(0).type),
                "src": pa.array(first, pa.string()),
                "dst": pa.array(second, pa.string()),
                "descriptions": pa.array([[text[i] for i in l] for l in found], pa.list_(pa.string())),
                "strength": pa.array([strength[l[0]] if len(l) == 1 else max((strength[i] for i in l if strength[i] is not None), default=None) for l in found], pa.int64()),
                "n": pa.array([len(l) for l in found], pa.int64()),
                "sources": pa.array([sorted({segment[i] for i in l if segment[i] is not None}) for l in found], pa.list_(pa.int64())),
            }
            if begin:
                held = [x[begin:] for x in held]
            yield pa.RecordBatch.from_pydict(out)

    return r.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, src string, dst string, descriptions array<string>, strength long, n long, sources array<long>")


def match_forms(groups: DataFrame, graph: DataFrame, key: str, at: float = MERGE_AT) -> DataFrame:
    """key, target, via: L1 where a surface form equals a graph name or alias, else L2 the graph entity most like any form.

    groups: key, name, forms (array). graph: id, names (array: the name and its aliases). Only gated names go to L2.
    """
    form = groups.select(key, "name", F.explode("forms").alias("form"))
    known = graph.select("id", F.explode("names").alias("form"))
    norm = lambda df: df.withColumn("form", normalize_exact(F.col("form")))
    l1 = norm(form).join(norm(known), "form").groupBy(key).agg(F.min("id").alias("target")).withColumn("via", F.lit("graph_l1"))
    rest = form.join(l1.select(key), key, "left_anti").where(passes_gate(normalize_fuzzy(F.col("name"))))
    sh = lambda df, own, k: df.select(*own, F.col("form").alias(f"form_{k}"), shingles3(normalize_fuzzy(F.col("form"))).alias("s")).distinct().select(*own, f"form_{k}", F.explode("s").alias("g"), F.size("s").alias(k))
    both = sh(rest, [key], "ka").join(sh(known, ["id"], "kb"), "g").groupBy(key, "id", "form_ka", "form_kb", "ka", "kb").agg(F.count("*").alias("i"))
    j = F.col("i") / (F.col("ka") + F.col("kb") - F.col("i"))
    l2 = both.withColumn("j", j).where(F.col("j") >= at).groupBy(key).agg(F.min_by("id", F.struct(-F.col("j"), "id")).alias("target")).withColumn("via", F.lit("graph_l2"))
    return l1.unionByName(l2)


def cascade(mentions: DataFrame, group: str, judge_one: Callable[[str, list[str]], int] | None = None, at: float = 0.85) -> DataFrame:
    """The sequential cascade of each tenant: equal name or alias, sequence ratio, candidates by vector and a judge, else new.

    mentions: group, pos, name, vector. One row for each, in order: name, target, via. A name seen before needs no
    comparison, so the work is in the different names; a tenant's names are its unit of work.
    """
    import difflib

    import numpy as np

    decide = judge_one or (lambda name, names: -1)

    def gate(x: str) -> bool:
        return not (len(x) < 6 and len(x.split()) < 2)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        target: dict[str, str] = {}
        names: list[str] = []
        placed: list[str] = []  # names with a vector
        vectors: list[np.ndarray] = []
        out = []
        for r in part.sort_values("pos").itertuples(index=False):
            norm = " ".join(r.name.lower().split())
            flat = "".join(c for c in norm if c.isalnum())
            via = "exact" if norm in target else ""
            if not via and gate(norm):
                best = max(((difflib.SequenceMatcher(None, flat, "".join(c for c in n if c.isalnum())).ratio(), -i) for i, n in enumerate(names) if gate(n)), default=(0.0, 0))
                if best[0] >= at:
                    target[norm], via = names[-best[1]], "similar"
            if not via and vectors and r.vector is not None:
                m = np.array(vectors)
                v = np.asarray(r.vector, float)
                score = m @ v / np.maximum(np.linalg.norm(m, axis=1) * np.linalg.norm(v), 1e-300)
                order = [i for i in np.argsort(-score, kind="stable")[:5] if score[i] > 0.5]
                pick = decide(norm, [placed[i] for i in order]) if order else -1
                if 0 <= pick < len(order):
                    target[norm], via = placed[order[pick]], "judged"
            if not via:
                target[norm], via = norm, "create"
                names.append(norm)
                if r.vector is not None:
                    placed.append(norm)
                    vectors.append(np.asarray(r.vector, float))
            out.append((getattr(r, group), r.pos, norm, target[norm], via))
        return pd.DataFrame(out, columns=[group, "pos", "name", "target", "via"])

    kinds = dict(mentions.dtypes)
    return mentions.select(group, "pos", "name", "vector").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, pos long, name string, target string, via string")


def graph_match(variants: DataFrame, graph: DataFrame, threshold: float = MERGE_AT) -> DataFrame:
    """name, target, via: the equal graph name, or else the most similar one above the threshold."""
    exact = variants.join(graph.select(F.col("name"), F.col("name").alias("target")), "name").select("name", "target", F.lit("L1").alias("via"))
    rest = variants.join(exact.select("name"), "name", "left_anti")
    s = lambda df, n: df.select(F.col("name").alias(n), F.explode(shingles3(F.col("name"))).alias("g"), F.size(shingles3(F.col("name"))).alias(f"k{n}"))
    pairs = s(rest, "a").join(s(graph, "b"), "g").groupBy("a", "b", "ka", "kb").agg(F.count("*").alias("i"))
    best = pairs.withColumn("j", F.col("i") / (F.col("ka") + F.col("kb") - F.col("i"))).where(F.col("j") >= threshold).groupBy("a").agg(F.min_by("b", F.struct(-F.col("j"), "b")).alias("target"))
    return exact.unionByName(best.select(F.col("a").alias("name"), "target", F.lit("L2").alias("via")))


JUDGE_BATCH = 20


def default_judge(batch: list[dict]) -> list[dict]:
    """Answers {"id": place in the batch, "candidate": place among its candidates or -1}: the first with MERGE_AT or more."""
    return [{"id": i, "candidate": next((k for k, v in enumerate(r["scores"]) if v >= MERGE_AT), -1)} for i, r in enumerate(batch)]


def judge(candidates: DataFrame, model: Judge = default_judge, key: str = "batch") -> DataFrame:
    """name, action, target of rows (batch, pos, name, candidates, scores), JUDGE_BATCH rows of a batch key to a call.

    An answer out of range, one that repeats an id, a missing one and a failed call all create.
    """

    def answer(own: list[dict]) -> list[tuple]:
        picked: dict[int, str] = {}
        seen: set[int] = set()
        try:
            for item in model(own):
                i, k = item.get("id", -1), item.get("candidate", -1)
                if not (isinstance(i, int) and 0 <= i < len(own)) or i in seen:
                    continue
                seen.add(i)
                if isinstance(k, int) and 0 <= k < len(own[i]["candidates"]):
                    picked[i] = own[i]["candidates"][k]
        except Exception:  # a model's failure is an answer of its own here: create
            picked = {}
        return [(r["name"], "merge" if i in picked else "create", picked.get(i)) for i, r in enumerate(own)]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["name", "action", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        for b in batches:
            out = []
            for first, r in zip(b.column(b.num_columns - 1).to_pylist(), b.drop_columns("_first").to_pylist(), strict=True):
                if first and own:
                    out += answer(own)
                    own = []
                own.append(r)
            yield table(out)
        if own:
            yield table(answer(own))

    # a window leaves the rows of a key together and in order, and shuffles only what is not dealt by the key already
    at = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    rows = candidates.select(key, "pos", "name", "candidates", "scores").withColumn("_first", at % JUDGE_BATCH == 1)
    return rows.mapInArrow(run, "name string, action string, target string")


def close_chains(pointers: DataFrame, rounds: int = 20) -> DataFrame:
    """id, target: follows pointers to their end by doubling; an id on a cycle, or behind one, points to itself."""
    to = scratch(pointers.select("id", F.coalesce("target", "id").alias("target")), "er-chain")
    for _ in range(rounds):
        hop = to.select(F.col("id").alias("target"), F.col("target").alias("next"))
        new = scratch(to.join(hop, "target", "left").select("id", F.coalesce("next", "target").alias("target"), (F.coalesce("next", "target") != F.col("target")).alias("moved")), "er-chain")
        done = new.where("moved").isEmpty()
        drop_scratch(to)
        to = new.drop("moved")
        if done:
            break
    roots = pointers.where("target is null or target = id").select(F.col("id").alias("target"))
    outside = to.join(pointers.select(F.col("id").alias("target")), "target", "left_anti").select("target")
    ends = roots.union(outside).distinct().withColumn("_end", F.lit(True))
    return to.join(ends, "target", "left").select("id", F.when(F.col("_end"), F.col("target")).otherwise(F.col("id")).alias("target"))


KNOWN_AT, LONG, SHORT_TO = 0.88, 800, 400


def description_gate(rows: DataFrame, key: str, order: str, text: str, vector: str, stored: str, limit: int = LONG, shrink: int = SHORT_TO, shorten: Callable[[str], str] | None = None) -> DataFrame:
    """key, description, changed: each new text is appended unless the text so far holds it or its vector is like the stored one.

    rows: key, order, text, vector, stored (the vector of the description so far). A result over `limit` is shortened,
    which counts only if it gets shorter. Later rows see earlier appends, so it is a fold of each key's few rows.
    """
    import numpy as np

    cut = shorten or (lambda x: x[:shrink])

    def like(a, b) -> bool:
        if a is None or b is None:
            return False
        a, b = np.asarray(a, float), np.asarray(b, float)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return bool(n) and float(a @ b) / n >= KNOWN_AT

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        out, added = "", 0
        for r in part.sort_values(order).to_dict("records"):
            if r[text] and r[text] not in out and not like(r[vector], r[stored]):
                out, added = f"{out}\n{r[text]}" if out else r[text], added + 1
        if len(out) > limit:
            short = cut(out)
            out = short if len(short) < len(out) else out
        return pd.DataFrame({key: [part[key].iloc[0]], "description": [out], "added": [added]})

    return rows.select(key, order, text, vector, stored).groupBy(key).applyInPandas(fold, f"{key} {dict(rows.dtypes)[key]}, description string, added int")


def variants(names: DataFrame, column: str, at: float = 0.93) -> DataFrame:
    """a < b, ratio of all pairs with a sequence ratio of `at` and two or more differing characters.

    Names of one length differ in the places that are unequal, others by their lengths.
    """
    p = sequence_pairs(names, column, at - 1e-6)  # the ratio is rounded
    unequal = F.size(F.expr("filter(zip_with(split(a, ''), split(b, ''), (x, y) -> x <> y), x -> x)"))
    apart = F.when(F.length("a") == F.length("b"), unequal).otherwise(F.abs(F.length("a") - F.length("b")))
    return p.where(apart >= 2).select("a", "b", F.round(sequence_ratio(F.col("a"), F.col("b")), 6).alias("ratio")).where(F.col("ratio") >= at)


def candidates(names: DataFrame, graph: DataFrame, key: str, k: int = 5, graph_at: float = 0.5, item_at: float = 0.5, borderline_at: float = BORDERLINE_AT) -> DataFrame:
    """key, name, candidate, origin: a name's k nearest in the graph, its item's names that are near by vector, and borderline ones.

    names: key, name, vector (distinct); graph: name, vector. Different names go to the graph once, in blocks.
    """
    asked = scratch(names.select("name", "vector").dropDuplicates(["name"]).withColumn("id", F.monotonically_increasing_id()), "er-asked")
    base = scratch(graph.select("name", "vector").orderBy("name").withColumn("id", F.monotonically_increasing_id()), "er-graph")
    # a name is no candidate of itself: ids differ between the tables, so one more is asked for and the equal name left out
    near = knn(asked.select(F.col("id").alias("id"), "vector"), base.select((F.col("id") + (1 << 60)).alias("id"), "vector"), "id", "vector", k + 1)
    near = near.join(asked.select(F.col("id").alias("q"), "name"), "q").join(base.select((F.col("id") + (1 << 60)).alias("id"), F.col("name").alias("candidate")), "id")
    near = near.where((F.col("name") != F.col("candidate")) & ((1 + F.col("score")) / 2 >= graph_at))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "candidate")
    near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("name", "candidate")
    first = names.select(key, "name").join(near, "name").select(key, "name", "candidate", F.lit("graph").alias("origin"))
    side = names.select(key, F.col("name").alias("candidate"), F.col("vector").alias("_v"))
    both = names.join(side, key).where("name <> candidate").withColumn("raw", cosine_raw(F.col("vector"), F.col("_v")))
    j = jaccard(shingles3(F.col("name")), shingles3(F.col("candidate")))
    own = both.withColumn("j", j).select(key, "name", "candidate", F.when(F.col("raw") >= item_at, "video").when((F.col("j") >= borderline_at) & (F.col("j") < MERGE_AT), "borderline").alias("origin")).where("origin is not null")
    return first.unionByName(own)


def phantoms(created: DataFrame, now: DataFrame, at: float = MERGE_AT) -> DataFrame:
    """group_id, name, action, target, via of entities about to be created, against those that exist by now (group_id, id, vector)."""
    by_id = created.join(now.select("id"), "id", "left_semi").select("group_id", "name", F.col("id").alias("target"), F.lit("id").alias("via"))
    rest = created.join(now.select("id"), "id", "left_anti")
    delta = now.select("group_id", F.col("id").alias("target"), F.col("vector").alias("_v"))  # what came since the snapshot
    near = rest.join(delta, "group_id").where(cosine_raw(F.col("vector"), F.col("_v")) >= at).groupBy("group_id", "name").agg(F.min("target").alias("target")).withColumn("via", F.lit("vector"))
    found = by_id.unionByName(near)
    out = created.select("group_id", "name").join(found, ["group_id", "name"], "left")
    return out.select("group_id", "name", F.when(F.col("target").isNull(), "create").otherwise("merge").alias("action"), "target", "via")

"""Communities: votes of neighbours, statistics, label propagation, modularity moves and their summaries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.plans.shared import drop_scratch, scratch


def both_ways(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("x"), F.col(b).alias("y"), *rest).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"), *rest))


def neighbour_votes(edges: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """The community that most neighbours belong to, with two votes or more; the least on ties."""
    votes = both_ways(edges).join(members.withColumnRenamed("name", "y"), ["group_id", "y"]).groupBy("group_id", F.col("x").alias("name"), "community").agg(F.count("*").alias("votes")).where(F.col("votes") >= least)
    return votes.groupBy("group_id", "name").agg(F.min_by(F.struct("community", "votes"), F.struct(-F.col("votes"), "community")).alias("b")).select("group_id", "name", "b.community", "b.votes")


def stats(members: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Members, relations inside and source segments of each community."""
    m = members.groupBy("group_id", "community").agg(F.count("*").alias("members"))
    side = lambda n: members.select("group_id", F.col("name").alias(n), F.col("community").alias(f"_{n}"))
    inside = edges.join(side("src"), ["group_id", "src"]).join(side("dst"), ["group_id", "dst"]).where("_src = _dst").groupBy("group_id", F.col("_src").alias("community")).agg(F.count("*").alias("relations"))
    places = mentions.join(members, ["group_id", "name"]).groupBy("group_id", "community").agg(F.countDistinct("media_id", "segment_index").alias("segments"))
    return m.join(inside, ["group_id", "community"], "left").join(places, ["group_id", "community"]).select("group_id", "community", "members", F.coalesce("relations", F.lit(0)).alias("relations"), "segments")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Synchronous label propagation: the label with the largest weight around, the least on ties."""
    links = scratch(both_ways(edges.select("group_id", "src", "dst", "n")), "lp-links")
    labels = scratch(links.select("group_id", "x", F.col("x").alias("label")).distinct(), "lp-labels")
    for _ in range(rounds):
        near = links.join(labels.select("group_id", F.col("x").alias("y"), "label"), ["group_id", "y"]).groupBy("group_id", "x", "label").agg(F.sum("n").alias("w"))
        new = scratch(near.groupBy("group_id", "x").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label")), "lp-labels")
        same = new.join(labels.withColumnRenamed("label", "before"), ["group_id", "x"]).where("label <> before").isEmpty()
        drop_scratch(labels)
        labels = new
        if same:
            break
    return labels.withColumnRenamed("x", "name")


#: Communities above this size are divided again, down to this many levels; weights are 1 at least.
DIVIDE_ABOVE, LEVELS = 10, 2


def _moves(near: list[dict[int, float]], own: list[int], gamma: float) -> bool:
    """Moves nodes to the neighbouring community of the largest gain in a fixed order until none moves; true if any did."""
    degree = [sum(x.values()) for x in near]
    total = sum(degree) or 1.0
    weight: dict[int, float] = {}
    for v, c in enumerate(own):
        weight[c] = weight.get(c, 0.0) + degree[v]
    moved, queue = False, list(range(len(near)))
    waiting = set(queue)
    while queue:
        later: list[int] = []
        for v in queue:
            waiting.discard(v)
            weight[own[v]] -= degree[v]
            gain = {own[v]: 0.0}
            for u, w in near[v].items():
                if u != v:
                    gain[own[u]] = gain.get(own[u], 0.0) + w
            best = max(gain, key=lambda k: (round(gain[k] - gamma * degree[v] * weight.get(k, 0.0) / total, 9), k == own[v], -k))
            weight[best] = weight.get(best, 0.0) + degree[v]
            if best != own[v]:
                own[v], moved = best, True
                for u in near[v]:
                    if own[u] != best and u not in waiting:
                        waiting.add(u)
                        later.append(u)
        queue = sorted(later)
    return moved


def _connected(near: list[dict[int, float]], own: list[int]) -> list[int]:
    """Communities split into their connected parts, each named by its least node."""
    out = [-1] * len(near)
    for v in range(len(near)):
        stack = [v] if out[v] < 0 else []
        while stack:
            x = stack.pop()
            if out[x] < 0:
                out[x] = v
                stack += [u for u in near[x] if own[u] == own[v] and out[u] < 0]
    return out


def leiden(near: list[dict[int, float]], gamma: float = 1.0) -> list[int]:
    """The community of each node: moves, a refinement within communities, and the same on the graph of the refined parts."""
    n = len(near)
    at = list(range(n))  # node -> node of the present graph
    own = list(range(n))
    while True:
        before = len(near)
        _moves(near, own, gamma)
        parts = list(range(len(near)))  # refinement: moves from single nodes along edges inside a community
        inner = [{u: w for u, w in x.items() if own[u] == own[v] or u == v} for v, x in enumerate(near)]
        _moves(inner, parts, gamma)
        parts = _connected(inner, parts)
        names = {c: i for i, c in enumerate(sorted(set(parts)))}
        if len(names) == before:
            break
        sums: list[dict[int, float]] = [{} for _ in names]
        for v, x in enumerate(near):
            for u, w in x.items():
                a, b = names[parts[v]], names[parts[u]]
                sums[a][b] = sums[a].get(b, 0.0) + w
        new_own = [0] * len(names)
        for v in range(before):
            new_own[names[parts[v]]] = own[v]
        first: dict[int, int] = {}
        own = [first.setdefault(c, i) for i, c in enumerate(new_own)]
        at = [names[parts[v]] for v in at]
        near = sums
    return [own[v] for v in at]


def hierarchy(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0) -> DataFrame:
    """group_id, name, level, community, parent: communities by modularity, those above DIVIDE_ABOVE divided again.

    nodes: group_id, name; edges: group_id, src, dst, strength. A tenant's graph is the unit of work, one task each;
    isolated nodes are communities of their own. Ids number a tenant's communities in the order of a descent.
    """

    def run(key: tuple, own_nodes: pd.DataFrame, own_edges: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(own_nodes["name"]))
        weights: dict[tuple[str, str], float] = {}
        for a, b, w in zip(own_edges["src"], own_edges["dst"], own_edges["strength"], strict=True):
            if a != b:
                k = (min(a, b), max(a, b))
                weights[k] = weights.get(k, 0.0) + max(w, 1)
        out: list[tuple] = []
        count = 0

        def divide(members: list[str], level: int, parent: int | None) -> None:
            nonlocal count
            place = {x: i for i, x in enumerate(members)}
            near: list[dict[int, float]] = [{} for _ in members]
            for (a, b), w in weights.items():
                if a in place and b in place:
                    near[place[a]][place[b]] = near[place[b]][place[a]] = w
            label = leiden(near, gamma)
            groups: dict[int, list[str]] = {}
            for x, c in zip(members, label, strict=True):
                groups.setdefault(c, []).append(x)
            for own in sorted(groups.values()):
                me, count = count, count + 1
                out.extend((key[0], x, level, me, parent) for x in own)
                if len(own) > DIVIDE_ABOVE and level < LEVELS:
                    divide(own, level + 1, me)

        divide(names, 0, None)
        return pd.DataFrame(out, columns=["group_id", "name", "level", "community", "parent"])

    n = nodes.select("group_id", "name").groupBy("group_id")
    e = edges.select("group_id", "src", "dst", "strength").groupBy("group_id")
    return n.cogroup(e).applyInPandas(run, "group_id string, name string, level int, community int, parent int")


def assign(entities: DataFrame, given: DataFrame, edges: DataFrame, vectors: DataFrame, centres: DataFrame, rounds: int = 2, k: int = 3, at: float = 0.3, accept: float = 0.6) -> DataFrame:
    """group_id, name, community, via: those with a community keep it; then neighbours vote in rounds, then the likest communities are judged, else alone.

    vectors: group_id, name, vector; centres: group_id, community, centre. The judge takes the likest of the k nearest
    that reach `at` if it reaches `accept`. Communities of a tenant are few; entities meet only their tenant's.
    """
    from cinegraph.functions.vector import cosine_unit

    done = given.select("group_id", "name", "community").withColumn("via", F.lit("given"))
    rest = entities.select("group_id", "name").join(done, ["group_id", "name"], "left_anti")
    for i in range(rounds):
        votes = neighbour_votes(edges, done.select("group_id", "name", "community")).select("group_id", "name", "community")
        new = scratch(rest.join(votes, ["group_id", "name"]).withColumn("via", F.lit(f"vote{i + 1}")), "cm-votes")
        done = done.unionByName(new.select(done.columns))
        rest = scratch(rest.join(new, ["group_id", "name"], "left_anti"), "cm-rest")
    scored = rest.join(vectors, ["group_id", "name"]).join(centres, "group_id").select("group_id", "name", "community", cosine_unit(F.col("vector"), F.col("centre")).alias("s")).where(F.col("s") >= at)
    best = scored.groupBy("group_id", "name").agg(F.min_by(F.struct("community", "s"), F.struct(-F.col("s"), "community")).alias("b")).where(F.col("b.s") >= accept).select("group_id", "name", "b.community")
    judged = rest.join(best, ["group_id", "name"], "left")
    last = judged.select("group_id", "name", F.coalesce("community", F.lit(-1)).alias("community"), F.when(F.col("community").isNull(), "single").otherwise("judged").alias("via"))
    return done.unionByName(last)


def summarise(communities: DataFrame, summariser: Callable[[list[str]], str] | None = None) -> DataFrame:
    """community, summary of rows (community, names, descriptions, relations): a template for one entity without relations, else the summariser, else counts."""
    tell = summariser or (lambda names: ", ".join(names)[:120])

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                names = list(r.names)
                if len(names) == 1 and r.relations == 0:
                    out.append(f"{names[0]}: {r.descriptions[0]}")
                    continue
                try:
                    out.append(tell(names))
                except Exception:  # a failed model leaves the counts
                    out.append(f"{len(names)} entities, {r.relations} relations")
            yield pd.DataFrame({"community": b["community"], "summary": out})

    return communities.mapInPandas(run, f"community {dict(communities.dtypes)['community']}, summary string")

"""Graphs and communities of tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.operators import communities as C
from cinegraph.operators.components import components
from cinegraph.operators.traversal import k_hop, one_hop
from cinegraph.plans.catalog import entity, mention, query, relation, t, vec

c = F.col


#: Least labels for eight rounds, which reach every node of these dense graphs.
_CC = "ed AS (SELECT DISTINCT o_custkey AS a, -l_suppkey - 1 AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey), lk AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), l0 AS (SELECT c_custkey AS n, c_custkey AS m FROM customer UNION ALL SELECT -s_suppkey - 1, -s_suppkey - 1 FROM supplier)" + "".join(
    f", l{i} AS (SELECT p.n, least(p.m, coalesce(min(q.m), p.m)) AS m FROM l{i - 1} p LEFT JOIN lk ON lk.a = p.n LEFT JOIN l{i - 1} q ON q.n = lk.b GROUP BY p.n, p.m)" for i in range(1, 9)
)


@query(f"WITH {_CC} SELECT n AS node, m AS component, count(*) OVER (PARTITION BY m) AS size FROM l8")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers linked by all lines of orders; who has none stays alone. The largest come first."""
    lines = t(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), (-c("l_suppkey") - 1).alias("b"))
    edges = t(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("a")).join(lines, "o_orderkey").select("a", "b").distinct()
    nodes = t(spark, d, "customer").select(c("c_custkey").alias("node")).unionByName(t(spark, d, "supplier").select((-c("s_suppkey") - 1).alias("node")))
    own = nodes.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    size = own.groupBy("component").agg(F.count("*").alias("size"))
    return own.join(size, "component").orderBy(F.desc("size"), "component", "node").select("node", "component", "size")


_BFS = "l AS (SELECT group_id, src AS x, dst AS y FROM relation UNION SELECT group_id, dst, src FROM relation), o AS (SELECT group_id, min(x) AS name FROM l GROUP BY group_id)"


@query("[relation] WITH RECURSIVE " + _BFS + ", r(group_id, name, k) AS (SELECT group_id, name, 0 FROM o UNION SELECT r.group_id, l.y, k + 1 FROM r JOIN l ON l.group_id = r.group_id AND l.x = r.name WHERE k < 3) SELECT group_id, name, min(k) AS distance, round(1 / min(k), 6) AS score FROM r GROUP BY group_id, name HAVING min(k) > 0")
def bfs_k_hop(spark: SparkSession, d: str) -> DataFrame:
    """All that is within three steps of each tenant's first entity, over all relations."""
    e = relation(spark, d).select(F.concat_ws("/", "group_id", "src").alias("src"), F.concat_ws("/", "group_id", "dst").alias("dst"))
    first = C.both_ways(relation(spark, d).select("group_id", "src", "dst")).groupBy("group_id").agg(F.min("x").alias("name"))
    found = k_hop(e, first.select(F.concat_ws("/", "group_id", "name").alias("name")), 3)
    part = F.split("name", "/", 2)
    return found.select(part[0].alias("group_id"), part[1].alias("name"), "distance", F.round(1 / F.greatest("distance", F.lit(1)), 6).alias("score"))


@query("[relation] WITH f AS (SELECT group_id, min(src) AS name FROM relation GROUP BY group_id) SELECT r.group_id, dst AS other, 'out' AS direction FROM relation r JOIN f ON f.group_id = r.group_id AND f.name = r.src UNION ALL SELECT r.group_id, src, 'in' FROM relation r JOIN f ON f.group_id = r.group_id AND f.name = r.dst")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of each tenant's first entity with the direction of the edge."""
    key = lambda n: F.concat_ws("/", "group_id", n).alias(n)
    e = relation(spark, d).select(key("src"), key("dst"), "strength", "n")
    first = relation(spark, d).groupBy("group_id").agg(F.min("src").alias("name")).select(key("name"))
    part = F.split("other", "/", 2)
    return one_hop(e, first).select(part[0].alias("group_id"), part[1].alias("other"), "direction")


@query()
def leiden_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    """Communities of each tenant on three levels, numbered in the order of a descent."""
    return C.hierarchy(entity(spark, d).select("group_id", "name"), relation(spark, d))


@query("[entity relation] WITH m AS (SELECT group_id, ascii(name) % 23 AS community, list_sort(list(name)) AS names, list_sort(list(description)) AS ds FROM entity GROUP BY ALL), r AS (SELECT group_id, ascii(src) % 23 AS community, count(*) AS relations FROM relation WHERE ascii(src) % 23 = ascii(dst) % 23 GROUP BY ALL), x AS (SELECT m.*, coalesce(relations, 0) AS relations FROM m LEFT JOIN r USING (group_id, community)) SELECT group_id || '/' || community AS community, CASE WHEN len(names) = 1 AND relations = 0 THEN names[1] || ': ' || ds[1] WHEN len(names) % 5 = 3 THEN len(names) || ' entities, ' || relations || ' relations' ELSE left(array_to_string(names, ', '), 120) END AS summary FROM x")
def community_summary_rule(spark: SparkSession, d: str) -> DataFrame:
    """Summaries by rule, by a summariser, and by counts where that fails (here for some sizes)."""
    e = entity(spark, d).withColumn("community", F.ascii("name") % 23)
    m = e.groupBy("group_id", "community").agg(F.array_sort(F.collect_list("name")).alias("names"), F.array_sort(F.collect_list("description")).alias("descriptions"))
    r = relation(spark, d).where(F.ascii("src") % 23 == F.ascii("dst") % 23).groupBy("group_id", (F.ascii("src") % 23).alias("community")).agg(F.count("*").alias("relations"))
    rows = m.join(r, ["group_id", "community"], "left").select(F.concat_ws("/", "group_id", "community").alias("community"), "names", "descriptions", F.coalesce("relations", F.lit(0)).alias("relations"))

    def tell(names: list[str]) -> str:
        if len(names) % 5 == 3:
            raise RuntimeError("no model")
        return ", ".join(names)[:120]

    return C.summarise(rows, tell)


_NV = "(ascii(name) * 31 + length(name) * 7 + ascii(right(name, 1)) * 13) % 500"
_WEAK = "(SELECT * FROM relation WHERE (ascii(src) + ascii(dst) + length(src)) % 7 = 0 AND n <= 60)"
_VOTE = "SELECT b.group_id, x AS name, community, count(*) AS k FROM (SELECT r.group_id, r.src AS x, r.dst AS y FROM re r UNION ALL SELECT group_id, dst, src FROM re) b JOIN {0} g ON g.group_id = b.group_id AND g.name = b.y WHERE NOT EXISTS (SELECT 1 FROM {0} h WHERE h.group_id = b.group_id AND h.name = b.x) GROUP BY b.group_id, x, community HAVING count(*) >= 2"
_ASSIGN = f"""re AS {_WEAK}, e AS (SELECT group_id, name FROM entity), g0 AS (SELECT group_id, name, ascii(name) % 5 AS community, 'given' AS via FROM e WHERE length(name) = 8),
v1 AS ({_VOTE.format('g0')}), g1 AS (SELECT * FROM g0 UNION ALL SELECT group_id, name, arg_min(community, (-k, community)), 'vote1' FROM v1 GROUP BY group_id, name),
v2 AS ({_VOTE.format('g1')}), g2 AS (SELECT * FROM g1 UNION ALL SELECT group_id, name, arg_min(community, (-k, community)), 'vote2' FROM v2 GROUP BY group_id, name),
rs AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM g2 WHERE g2.group_id = e.group_id AND g2.name = e.name)), cs AS (SELECT DISTINCT group_id, community FROM g0),
sc AS (SELECT rs.group_id, rs.name, cs.community, (1 + list_cosine_similarity(a.v, b.v)) / 2 AS s FROM rs JOIN cs USING (group_id) JOIN vec a ON a.vec_id = {_NV} JOIN vec b ON b.vec_id = 100 + cs.community * 7 + ascii(right(cs.group_id, 1))),
jd AS (SELECT group_id, name, arg_min(community, (-s, community)) AS community FROM sc WHERE s >= 0.3 GROUP BY ALL HAVING max(s) >= 0.55),
asg AS (SELECT group_id, name, community::BIGINT AS community, via FROM g2 UNION ALL SELECT rs.group_id, rs.name, coalesce(jd.community, -1), CASE WHEN jd.community IS NULL THEN 'single' ELSE 'judged' END FROM rs LEFT JOIN jd USING (group_id, name))"""


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    e = entity(spark, d).select("group_id", "name")
    given = e.where(F.length("name") == 8).withColumn("community", F.ascii("name") % 5)
    edges = relation(spark, d).where("(ascii(src) + ascii(dst) + length(src)) % 7 = 0 and n <= 60")
    v = vec(spark, d)
    at = ((F.ascii("name") * 31 + F.length("name") * 7 + F.ascii(F.right("name", F.lit(1))) * 13) % 500).cast("long")
    vectors = e.withColumn("_at", at).join(F.broadcast(v.select(c("vec_id").alias("_at"), c("v").alias("vector"))), "_at").drop("_at")
    place = (100 + c("community") * 7 + F.ascii(F.right("group_id", F.lit(1)))).cast("long")
    centres = given.select("group_id", "community").distinct().withColumn("_at", place).join(F.broadcast(v.select(c("vec_id").alias("_at"), c("v").alias("centre"))), "_at").drop("_at")
    return C.assign(e, given, edges, vectors, centres, accept=0.55)


@query(f"[entity relation vec] WITH {_ASSIGN} SELECT group_id, name, community, via FROM asg")
def assign_communities(spark: SparkSession, d: str) -> DataFrame:
    """Entities without a community take their neighbours' in two rounds of votes, then a judged one by vector, else their own."""
    return _assigned(spark, d).withColumn("community", c("community").cast("long"))


@query(f"[entity relation vec mentioned] WITH {_ASSIGN}, old AS (SELECT group_id, community, count(*) AS n FROM asg WHERE via = 'given' GROUP BY ALL), nw AS (SELECT group_id, community, count(*) AS joined, string_agg(name, ', ' ORDER BY name) AS names FROM asg WHERE via NOT IN ('given', 'single') GROUP BY ALL), pv AS (SELECT asg.group_id, community, count(DISTINCT (media_id, segment_index)) AS segments FROM asg JOIN mentioned m ON m.group_id = asg.group_id AND m.entity_id = 'entity_' || asg.group_id || '_' || asg.name WHERE via <> 'single' GROUP BY ALL) SELECT group_id, community, n + coalesce(joined, 0) AS entity_count, left('community ' || community || coalesce('; ' || names, ''), 100) AS summary, segments FROM old LEFT JOIN nw USING (group_id, community) JOIN pv USING (group_id, community)")
def join_community(spark: SparkSession, d: str) -> DataFrame:
    """Communities after the joins: counts, merged summaries and source segments."""
    a = _assigned(spark, d).where("via <> 'single'").withColumn("community", c("community").cast("long"))
    given = c("via") == "given"
    names = F.array_join(F.array_sort(F.collect_list(F.when(~given, c("name")))), ", ")
    com = a.groupBy("group_id", "community").agg(F.count("*").alias("entity_count"), F.count_if(given).alias("old"), names.alias("names")).where("old > 0")
    cited = mention(spark, d).select("group_id", "name", "media_id", "segment_index").join(a, ["group_id", "name"]).groupBy("group_id", "community").agg(F.countDistinct("media_id", "segment_index").alias("segments"))
    head = F.concat(F.lit("community "), "community", F.when(c("names") != "", F.concat(F.lit("; "), "names")).otherwise(F.lit("")))
    return com.join(cited, ["group_id", "community"]).select("group_id", "community", "entity_count", F.left(head, F.lit(100)).alias("summary"), "segments")



def _due(spark: SparkSession, d: str) -> DataFrame:
    e = entity(spark, d)
    mean = e.agg(F.avg("source_count").alias("mean"))
    return e.join(F.broadcast(mean)).groupBy("group_id").agg(F.avg((c("source_count") <= c("mean")).cast("int")).alias("ratio"))


@query("[entity] WITH du AS (SELECT group_id, avg((source_count <= (SELECT avg(source_count) FROM entity))::INT) AS ratio FROM entity GROUP BY group_id) SELECT group_id, round(ratio, 6) AS ratio, ratio >= 0.5 AS due FROM du")
def nightly_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Which tenants the nightly job works on: those of whose communities half or more are weak."""
    return _due(spark, d).select("group_id", F.round("ratio", 6).alias("ratio"), (c("ratio") >= 0.5).alias("due"))


@query()
def rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the tenants that are due are computed anew and replace theirs in the table; others keep what they had."""
    from cinegraph.sources.tables import replace_partitions

    e = entity(spark, d).select("group_id", "name")
    old = e.select("group_id", F.concat(F.lit("old_"), F.ascii("name") % 5).alias("id"), "name")
    path = replace_partitions(old, "group_id")
    due = _due(spark, d).where("ratio >= 0.5").select("group_id")
    new = C.hierarchy(e.join(due, "group_id", "left_semi"), relation(spark, d).join(due, "group_id", "left_semi")).where("level = 0")
    replace_partitions(new.select("group_id", F.concat_ws("_", "group_id", F.lit("leiden"), "community").alias("id"), "name"), "group_id", path)
    return spark.read.parquet(path).select(c("group_id").cast("string").alias("group_id"), "id", "name")


@query("[entity relation] WITH n AS (SELECT *, ascii(name) % 5 AS community FROM entity WHERE group_id = 'user_0' ORDER BY coalesce(source_count, 1) DESC, id LIMIT 40), e AS (SELECT * FROM relation WHERE group_id = 'user_0' ORDER BY strength DESC, n DESC, src, dst LIMIT 1500) SELECT 'node' AS kind, name, '' AS other, source_count AS weight, community, (SELECT count(*) FROM n) >= 40 AS truncated FROM n UNION ALL SELECT 'edge', src, dst, strength, NULL, (SELECT count(*) FROM n) >= 40 FROM e WHERE src IN (SELECT name FROM n) AND dst IN (SELECT name FROM n)")
def graph_view(spark: SparkSession, d: str) -> DataFrame:
    """What a tenant's view shows: the most mentioned nodes with their first community, and of the strongest edges those between them."""
    n = entity(spark, d).where("group_id = 'user_0'").orderBy(F.desc(F.coalesce("source_count", F.lit(1))), "id").limit(40).select("name", "source_count", (F.ascii("name") % 5).alias("community"))
    e = relation(spark, d).where("group_id = 'user_0'").orderBy(F.desc("strength"), F.desc("n"), "src", "dst").limit(1500)
    e = e.join(F.broadcast(n.select(c("name").alias("src"))), "src", "left_semi").join(F.broadcast(n.select(c("name").alias("dst"))), "dst", "left_semi")
    cut = n.agg((F.count("*") >= 40).alias("truncated"))
    node = n.select(F.lit("node").alias("kind"), "name", F.lit("").alias("other"), c("source_count").cast("long").alias("weight"), "community")
    edge = e.select(F.lit("edge").alias("kind"), c("src").alias("name"), c("dst").alias("other"), c("strength").cast("long").alias("weight"), F.lit(None).cast("int").alias("community"))
    return node.unionByName(edge).join(F.broadcast(cut))


@query("WITH m AS (SELECT label, vec_id % 2 AS half FROM embeddings), c AS (SELECT 0 AS level, label::BIGINT AS community, count(*) AS n FROM m GROUP BY label UNION ALL SELECT 1, label * 2 + half, count(*) FROM m GROUP BY label, half) SELECT level, count(*) AS communities, round(avg(n), 6) AS mean_size FROM c GROUP BY level")
def level_counts(spark: SparkSession, d: str) -> DataFrame:
    """Communities of each level and their mean size; the second level divides the first."""
    m = t(spark, d, "embeddings").select("label", (c("vec_id") % 2).alias("half"))
    top = m.groupBy(c("label").cast("long").alias("community")).agg(F.count("*").alias("n")).withColumn("level", F.lit(0))
    low = m.groupBy((c("label") * 2 + c("half")).alias("community")).agg(F.count("*").alias("n")).withColumn("level", F.lit(1))
    return top.unionByName(low).groupBy("level").agg(F.count("*").alias("communities"), F.round(F.avg("n"), 6).alias("mean_size"))

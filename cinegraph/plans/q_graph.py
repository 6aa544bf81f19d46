"""Graphs, communities and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.operators import communities as C
from cinegraph.operators import resolution as R
from cinegraph.operators import store as S
from cinegraph.plans.catalog import entity, entity_id, mention, mentioned, query, relation, t

c = F.col
_SH = "CASE WHEN length({0}) < 3 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, (length({0}) - 1)::BIGINT), lambda i: substr({0}, i::BIGINT, 3))) END"


@query("[entity mentioned relation] SELECT e.id, count(DISTINCT m.media_id * 100 + m.segment_index) AS segments FROM entity e LEFT JOIN mentioned m ON m.entity_id = e.id GROUP BY e.id")
def load_graph(spark: SparkSession, d: str) -> DataFrame:
    m = mentioned(spark, d).groupBy(c("entity_id").alias("id")).agg(F.countDistinct(c("media_id") * 100 + c("segment_index")).alias("segments"))
    return entity(spark, d).select("id").join(m, "id", "left").select("id", F.coalesce("segments", F.lit(0)).alias("segments"))


@query("[relation] WITH u AS (SELECT group_id, src AS name, dst AS other, 'out' AS direction, strength, n FROM relation UNION ALL SELECT group_id, dst, src, 'in', strength, n FROM relation) SELECT group_id, name, other, direction, strength FROM u QUALIFY row_number() OVER (PARTITION BY group_id, name ORDER BY strength DESC, n DESC, other, direction) <= 3")
def one_hop_expand(spark: SparkSession, d: str) -> DataFrame:
    e = relation(spark, d)
    g = e.select("group_id", "src", "dst", "strength", "n")
    out = g.select("group_id", c("src").alias("name"), c("dst").alias("other"), F.lit("out").alias("direction"), "strength", "n")
    back = g.select("group_id", c("dst").alias("name"), c("src").alias("other"), F.lit("in").alias("direction"), "strength", "n")
    return S.latest(out.unionByName(back), ["group_id", "name"], [F.desc("strength"), F.desc("n"), "other", "direction"], 3).drop("n")


_LP = "lk AS (SELECT group_id, src AS x, dst AS y, n FROM relation UNION ALL SELECT group_id, dst, src, n FROM relation), l0 AS (SELECT DISTINCT group_id, x, x AS label FROM lk)" + "".join(
    f", w{i} AS (SELECT lk.group_id, lk.x, label, sum(n) AS w FROM lk JOIN l{i - 1} p ON p.group_id = lk.group_id AND p.x = lk.y GROUP BY lk.group_id, lk.x, label), l{i} AS (SELECT group_id, x, arg_min(label, (-w, label)) AS label FROM w{i} GROUP BY group_id, x)" for i in range(1, 6)
)


@query(f"[relation] WITH {_LP} SELECT group_id, x AS name, label FROM l5")
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return C.label_propagation(relation(spark, d))


@query("[entity] SELECT 'community_' || left(md5(id), 10) AS id, 0 AS level, 1 AS entity_count, name || ' (' || type || ')' AS summary FROM entity WHERE source_count <= 1")
def create_singletons(spark: SparkSession, d: str) -> DataFrame:
    return entity(spark, d).where("source_count <= 1").select(F.concat(F.lit("community_"), F.left(F.md5("id"), F.lit(10))).alias("id"), F.lit(0).alias("level"), F.lit(1).alias("entity_count"), F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("summary"))


@query(f"WITH n AS (SELECT DISTINCT p_name || 's' AS name FROM part), g AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT name, unnest({_SH.format('name')}) AS s, len({_SH.format('name')}) AS k FROM n), b AS (SELECT name, unnest({_SH.format('name')}) AS s, len({_SH.format('name')}) AS k FROM g), j AS (SELECT a.name, b.name AS target, count(*) / (any_value(a.k) + any_value(b.k) - count(*)) AS j FROM a JOIN b USING (s) GROUP BY a.name, b.name HAVING j >= 0.6) SELECT name, target, 'L2' AS via FROM j QUALIFY row_number() OVER (PARTITION BY name ORDER BY j DESC, target) = 1")
def graph_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    names = t(spark, d, "part").select(c("p_name").alias("name")).distinct()
    return R.graph_match(names.select(F.concat("name", F.lit("s")).alias("name")), names, 0.6)


@query("WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey - 1 END AS target FROM part), r(id, e, k) AS (SELECT id, id, 0 FROM p UNION ALL SELECT r.id, p.target, k + 1 FROM r JOIN p ON p.id = r.e WHERE p.target IS NOT NULL) SELECT id, arg_max(e, k) AS target FROM r GROUP BY id")
def close_chains(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select(c("p_partkey").alias("id"), F.when(c("p_partkey") % 5 != 0, c("p_partkey") - 1).alias("target"))
    return R.close_chains(p)


@query("SELECT p_brand AS src, p_type AS dst, min_by(p_name, (-length(p_name), p_partkey)) AS description, 'rel_' || p_brand || '_' || p_type AS id FROM part GROUP BY p_brand, p_type")
def relation_anchor(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "part").groupBy(c("p_brand").alias("src"), c("p_type").alias("dst")).agg(F.min_by("p_name", F.struct(-F.length("p_name"), "p_partkey")).alias("description"))
    return g.select("src", "dst", "description", F.concat_ws("_", F.lit("rel"), "src", "dst").alias("id"))


@query("[mention] SELECT DISTINCT 'entity_' || group_id || '_' || name AS entity_id, media_id FROM mention WHERE segment_index = 1")
def entity_first_segments(spark: SparkSession, d: str) -> DataFrame:
    return mention(spark, d).where("segment_index = 1").select(entity_id().alias("entity_id"), "media_id").distinct()

"""Sinks, joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegraph.operators import intervals as I
from cinegraph.operators import rollup as R
from cinegraph.operators import store as S
from cinegraph.plans.catalog import entity, entity_id, event, media, mention, mentioned, query, relation, segment, t

c = F.col


# --- sinks ---


@query("[entity] SELECT id, coalesce(o.description, 'new') AS description, coalesce(o.source_count, 0) + CASE WHEN n.id IS NOT NULL THEN 1 ELSE 0 END AS source_count, CASE WHEN o.id IS NOT NULL THEN 1 ELSE 2 END AS created_at FROM (SELECT * FROM entity WHERE group_id <> 'user_3') o FULL JOIN (SELECT * FROM entity WHERE group_id <> 'user_0') n USING (id)".replace("coalesce(o.description, 'new')", "coalesce(n.description, o.description)").replace("coalesce(o.source_count, 0) + CASE WHEN n.id IS NOT NULL THEN 1 ELSE 0 END", "CASE WHEN n.id IS NOT NULL THEN n.source_count + 1 ELSE o.source_count END"))
def upsert_entities(spark: SparkSession, d: str) -> DataFrame:
    e = entity(spark, d)
    old = e.where("group_id <> 'user_3'").select("id", "description", "source_count", F.lit(1).alias("created_at"))
    new = e.where("group_id <> 'user_0'").select("id", "description", (c("source_count") + 1).alias("source_count"), F.lit(2).alias("created_at"))
    return S.upsert(old, new, ["id"], first_write_wins=("created_at",))


@query("[relation entity] SELECT r.group_id, src, dst, strength FROM relation r JOIN entity a ON a.group_id = r.group_id AND a.name = r.src AND a.source_count > 2 JOIN entity b ON b.group_id = r.group_id AND b.name = r.dst AND b.source_count > 2")
def upsert_relations(spark: SparkSession, d: str) -> DataFrame:
    e = entity(spark, d).where("source_count > 2").select("group_id", "name")
    r = relation(spark, d)
    return r.join(e.withColumnRenamed("name", "src"), ["group_id", "src"], "left_semi").join(e.withColumnRenamed("name", "dst"), ["group_id", "dst"], "left_semi").select("group_id", "src", "dst", "strength")


@query("[mention] SELECT group_id, name, media_id, max(segment_index) AS segment_index, count(*) AS n FROM mention GROUP BY group_id, name, media_id")
def upsert_mentions(spark: SparkSession, d: str) -> DataFrame:
    return mention(spark, d).groupBy("group_id", "name", "media_id").agg(F.max("segment_index").alias("segment_index"), F.count("*").alias("n"))


@query("SELECT group_id, 'user_' || group_id || '_leiden_' || label AS id, n FROM (SELECT vec_id % 4 AS group_id, label, count(*) AS n FROM embeddings GROUP BY ALL)")
def replace_communities(spark: SparkSession, d: str) -> DataFrame:
    """The communities of each group are written by partition overwrite, so a second run replaces the first."""
    from cinegraph.sources.tables import replace_partitions

    rows = t(spark, d, "embeddings").groupBy((c("vec_id") % 4).alias("group_id"), "label").agg(F.count("*").alias("n"))
    rows = rows.select("group_id", F.concat(F.lit("user_"), "group_id", F.lit("_leiden_"), "label").alias("id"), "n")
    path = replace_partitions(rows.withColumn("n", -c("n")), "group_id")
    replace_partitions(rows, "group_id", path)
    return spark.read.parquet(path).select(c("group_id").cast("long").alias("group_id"), "id", "n")


@query("SELECT p_brand AS id, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS sources, count(DISTINCT p_type) AS source_count FROM part GROUP BY p_brand")
def merge_relation_sources(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    half = lambda k: p.where(c("p_partkey") % 2 == k).groupBy(c("p_brand").alias("id")).agg(F.collect_set("p_type").alias(f"s{k}"))
    union = F.array_sort(F.array_union(F.coalesce("s0", F.array().cast("array<string>")), F.coalesce("s1", F.array().cast("array<string>"))))
    return half(0).join(half(1), "id", "full_outer").select("id", F.array_join(union, ",").alias("sources"), F.size(union).cast("long").alias("source_count"))


@query("[segment] SELECT segment_id FROM segment WHERE NOT starts_with(segment_id, 'media_1')")
def delete_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return segment(spark, d).where(~F.startswith("segment_id", F.lit("media_1"))).select("segment_id")


_LATEST = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


@query(_LATEST)
def upsert_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(t(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query(_LATEST)
def latest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(last).select("user_id", "event_type", "x.event_id", "x.value")


# --- joins ---


@query("[mentioned] SELECT DISTINCT entity_id FROM mentioned WHERE media_id % 10 = 3")
def exists_mention_scope(spark: SparkSession, d: str) -> DataFrame:
    scope = t(spark, d, "orders").where("o_orderkey % 10 = 3").select(c("o_orderkey").alias("media_id"))
    hit = mentioned(spark, d).join(scope, "media_id", "left_semi").select("entity_id")
    return entity(spark, d).select(c("id").alias("entity_id")).join(hit, "entity_id", "left_semi")


@query("SELECT conv_id, bool_or(turn = 0) AND count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0 AS valid FROM conversations GROUP BY conv_id")
def structured_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or(c("turn") == 0).alias("t"), F.count_if(c("role") == "user").alias("u"), F.count_if(c("role") == "assistant").alias("a"))
    return rows.select("conv_id", (c("t") & (c("u") > 0) & (c("a") > 0)).alias("valid"))


@query("[mention entity] SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, e.id FROM lineitem l JOIN part p ON l_partkey = p_partkey LEFT JOIN entity e ON e.group_id = 'user_' || (l_orderkey % 4) AND e.name = p.p_name AND e.source_count > 1".replace("[mention entity]", "[entity]"))
def join_alias_map(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").join(t(spark, d, "part").select("p_partkey", c("p_name").alias("name")), c("l_partkey") == c("p_partkey"))
    known = entity(spark, d).where("source_count > 1").select("group_id", "name", "id")
    return lines.withColumn("group_id", F.concat(F.lit("user_"), c("l_orderkey") % 4)).join(known, ["group_id", "name"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "id")


@query("[relation entity] SELECT a.id AS source, b.id AS target, r.strength FROM relation r JOIN entity a ON a.group_id = r.group_id AND a.name = r.src JOIN entity b ON b.group_id = r.group_id AND b.name = r.dst WHERE a.type <> b.type")
def join_resolution_anchor(spark: SparkSession, d: str) -> DataFrame:
    e = entity(spark, d).select("group_id", "name", "id", "type")
    a = e.select("group_id", c("name").alias("src"), c("id").alias("source"), c("type").alias("ta"))
    b = e.select("group_id", c("name").alias("dst"), c("id").alias("target"), c("type").alias("tb"))
    return relation(spark, d).join(a, ["group_id", "src"]).join(b, ["group_id", "dst"]).where("ta <> tb and source <> target").select("source", "target", "strength")


@query("[segment] WITH p AS (SELECT event_id, user_id AS media_id, event_id * 37 % 600000 AS ts FROM events), l AS (SELECT media_id, max_by(segment_index, end_ms) AS last_index, max(end_ms) AS last_end FROM segment GROUP BY media_id) SELECT p.event_id, coalesce(s.segment_index, CASE WHEN p.ts >= l.last_end THEN l.last_index END) AS segment_index FROM p JOIN l USING (media_id) LEFT JOIN segment s ON s.media_id = p.media_id AND p.ts >= s.start_ms AND p.ts < s.end_ms")
def interval_point_join(spark: SparkSession, d: str) -> DataFrame:
    points = t(spark, d, "events").select("event_id", c("user_id").alias("media_id"), (c("event_id") * 37 % 600000).alias("ts"))
    return I.owner(points, segment(spark, d), "media_id", "event_id").select("event_id", "segment_index")


@query("[segment] WITH p AS (SELECT event_id, user_id AS media_id, event_id * 37 % 600000 AS ts FROM events) SELECT s.segment_id, min_by(p.event_id, (abs(p.ts - (s.start_ms + s.end_ms) // 2), p.event_id)) AS event_id FROM segment s JOIN p USING (media_id) GROUP BY s.segment_id")
def nearest_asof_join(spark: SparkSession, d: str) -> DataFrame:
    points = t(spark, d, "events").select("event_id", c("user_id").alias("media_id"), (c("event_id") * 37 % 600000).alias("ts"))
    return I.nearest(segment(spark, d).withColumn("at", F.expr("(start_ms + end_ms) div 2")), points, "media_id", "segment_id", "event_id")


@query("[segment] WITH o AS (SELECT media_id, segment_index AS old_index, start_ms + 20000 AS s, end_ms + 20000 AS e FROM segment), x AS (SELECT o.media_id, o.old_index, n.segment_index, greatest(0, least(o.e, n.end_ms) - greatest(o.s, n.start_ms)) AS v FROM o JOIN segment n ON n.media_id = o.media_id AND n.start_ms < o.e AND n.end_ms > o.s) SELECT media_id, old_index, arg_max(segment_index, (v, -segment_index)) AS new_index, round(max(v) / 60000.0, 6) AS ratio FROM x GROUP BY media_id, old_index")
def interval_overlap_argmax(spark: SparkSession, d: str) -> DataFrame:
    s = segment(spark, d)
    old = s.select("media_id", c("segment_index").alias("old_index"), (c("start_ms") + 20000).alias("s"), (c("end_ms") + 20000).alias("e"))
    return I.best_overlap(old, s, "media_id", "old_index")


@query("[segment] WITH p AS (SELECT event_id, user_id AS media_id, event_id * 37 % 600000 AS ts FROM events), x AS (SELECT p.event_id, s.segment_index, CASE WHEN p.ts BETWEEN s.start_ms AND s.end_ms THEN 0 ELSE 1 END AS k, abs(p.ts - s.start_ms) AS far FROM p JOIN segment s USING (media_id)) SELECT event_id, segment_index, k = 0 AS inside FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY k, far, segment_index) = 1")
def citation_timepoint_join(spark: SparkSession, d: str) -> DataFrame:
    points = t(spark, d, "events").select("event_id", c("user_id").alias("media_id"), (c("event_id") * 37 % 600000).alias("ts"))
    return I.cite(points, segment(spark, d), "media_id", "event_id")


@query("[segment] WITH p AS (SELECT event_id, user_id AS media_id, event_id * 37 % 600000 AS ts FROM events) SELECT s.segment_id, count(*) AS n FROM segment s JOIN p ON p.media_id = s.media_id AND p.ts >= greatest(0, s.start_ms - 60000) AND p.ts < s.end_ms + 60000 GROUP BY s.segment_id")
def near_segment_join(spark: SparkSession, d: str) -> DataFrame:
    points = t(spark, d, "events").select("event_id", c("user_id").alias("media_id"), (c("event_id") * 37 % 600000).alias("ts"))
    wide = segment(spark, d).withColumn("start_ms", F.greatest(F.lit(0), c("start_ms") - 60000)).withColumn("end_ms", c("end_ms") + 60000)
    return I.points_in_intervals(points, wide, "media_id").groupBy("segment_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def anti_join_orphans(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").join(lines, "o_orderkey", "left_anti").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_join_no_mention(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").join(t(spark, d, "lineitem").where("l_quantity > 45").select(c("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("[relation entity] SELECT r.group_id, r.src, r.dst FROM relation r WHERE EXISTS (SELECT 1 FROM entity e WHERE e.group_id = r.group_id AND e.name = r.src AND e.type LIKE 'S%') AND EXISTS (SELECT 1 FROM entity e WHERE e.group_id = r.group_id AND e.name = r.dst AND e.type LIKE 'S%')")
def semi_join_edges_in_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = entity(spark, d).where("type like 'S%'").select("group_id", "name")
    return relation(spark, d).join(n.withColumnRenamed("name", "src"), ["group_id", "src"], "left_semi").join(n.withColumnRenamed("name", "dst"), ["group_id", "dst"], "left_semi").select("group_id", "src", "dst")


@query("[relation mention] SELECT r.src, r.dst FROM relation r WHERE r.group_id = 'user_1' AND r.src IN (SELECT name FROM mention WHERE media_id = (SELECT min(o_orderkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 4 = 1)) AND r.dst IN (SELECT name FROM mention WHERE media_id = (SELECT min(o_orderkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 4 = 1))")
def double_exists_subgraph(spark: SparkSession, d: str) -> DataFrame:
    m = mention(spark, d).where("group_id = 'user_1'")
    first = m.agg(F.min("media_id").alias("media_id"))
    names = m.join(F.broadcast(first), "media_id", "left_semi").select("name").distinct()
    r = relation(spark, d).where("group_id = 'user_1'")
    return r.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst")


@query("WITH q AS (SELECT DISTINCT left(p_name, 4) AS q FROM part UNION SELECT DISTINCT p_name FROM part), n AS (SELECT DISTINCT p_name AS name FROM part) SELECT q, coalesce((SELECT name FROM n WHERE name = q), (SELECT min(name) FROM n WHERE starts_with(name, q))) AS name FROM q")
def prefix_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.operators.lookup import by_prefix

    n = t(spark, d, "part").select(c("p_name").alias("name")).distinct()
    q = n.select(F.left("name", F.lit(4)).alias("q")).union(n).distinct()
    return by_prefix(q, n)


@query("SELECT doc_id, coalesce(l.quality, -1) AS quality, d.source FROM documents d JOIN labels l USING (doc_id)")
def dataset_answer_merge(spark: SparkSession, d: str) -> DataFrame:
    left = t(spark, d, "documents").select("doc_id", "source", F.lit(-1).alias("quality"))
    right = t(spark, d, "labels").select("doc_id", c("quality").alias("answer"))
    return left.join(right, "doc_id").select("doc_id", F.coalesce("answer", "quality").alias("quality"), "source")


# --- aggregations ---


@query("[mention] SELECT group_id, lower(name) AS norm, count(*) AS n FROM mention GROUP BY ALL")
def l1_exact_group(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.functions.text import normalize_exact

    return mention(spark, d).groupBy("group_id", normalize_exact(c("name")).alias("norm")).agg(F.count("*").alias("n"))


@query("""[mention] WITH y AS (SELECT group_id, name, type, count(*) AS k FROM mention GROUP BY group_id, name, type QUALIFY row_number() OVER (PARTITION BY group_id, name ORDER BY count(*) DESC, type) = 1)
SELECT m.group_id, m.name, any_value(y.type) AS type, string_agg(DISTINCT m.description, '|' ORDER BY m.description) AS descriptions, count(DISTINCT m.media_id) AS media, count(*) AS mention_count FROM mention m JOIN y ON y.group_id = m.group_id AND y.name = m.name GROUP BY m.group_id, m.name""")
def entity_group_rollup(spark: SparkSession, d: str) -> DataFrame:
    return R.entity_groups(mention(spark, d))


@query()
def relation_dedup_legacy(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").select(c("p_brand").alias("src"), c("p_type").alias("dst"), c("p_name").alias("description"), (1 + c("p_size") % 10).alias("strength"), c("p_partkey").alias("pos"))
    return R.relation_clusters(rows, 0.8)


@query("[relation] WITH v AS (SELECT r.group_id, x.name AS name, ascii(y.name) % 5 AS community FROM relation r, LATERAL (SELECT r.src AS name UNION ALL SELECT r.dst) x, LATERAL (SELECT r.src AS name UNION ALL SELECT r.dst) y WHERE x.name <> y.name), n AS (SELECT group_id, name, community, count(*) AS votes FROM v GROUP BY ALL HAVING count(*) >= 2) SELECT group_id, name, community, votes FROM n QUALIFY row_number() OVER (PARTITION BY group_id, name ORDER BY votes DESC, community) = 1")
def neighbor_vote(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.operators.communities import neighbour_votes

    r = relation(spark, d)
    return neighbour_votes(r, r.select("group_id", c("src").alias("name")).union(r.select("group_id", c("dst").alias("name"))).distinct().withColumn("community", F.ascii("name") % 5))


@query("SELECT round(avg(CASE WHEN coalesce(n, 0) <= 1 THEN 1 ELSE 0 END), 6) AS ratio FROM (SELECT p_brand FROM part GROUP BY p_brand) b LEFT JOIN (SELECT p_brand, count(*) AS n FROM part WHERE p_size = 7 GROUP BY p_brand) m USING (p_brand)")
def singleton_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    return R.singleton_ratio(p.select("p_brand").distinct(), p.where("p_size = 7"), "p_brand")


@query("[relation mention] WITH e AS (SELECT DISTINCT group_id, name, ascii(name) % 5 AS community FROM mention), m AS (SELECT group_id, community, count(*) AS members FROM e GROUP BY ALL), i AS (SELECT group_id, ascii(src) % 5 AS community, count(*) AS relations FROM relation WHERE ascii(src) % 5 = ascii(dst) % 5 GROUP BY ALL), s AS (SELECT group_id, ascii(name) % 5 AS community, count(DISTINCT (media_id, segment_index)) AS segments FROM mention GROUP BY ALL) SELECT group_id, community, members, coalesce(relations, 0) AS relations, segments FROM m LEFT JOIN i USING (group_id, community) JOIN s USING (group_id, community)")
def community_stats(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.operators.communities import stats

    m = mention(spark, d)
    return stats(m.select("group_id", "name").distinct().withColumn("community", F.ascii("name") % 5), relation(spark, d), m)


@query("SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 48 GROUP BY p_partkey")
def recount_sources(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "lineitem").where("l_quantity > 48").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t(spark, d, "part").select("p_partkey").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderpriority AS k, round(CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = 0 THEN 0 ELSE count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus <> 'P') END, 6) AS ratio FROM orders GROUP BY 1")
def ratio_metrics(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy(c("o_orderpriority").alias("k")).agg(F.round(R.ratio(c("o_orderstatus") == "F", c("o_orderstatus") != "P"), 6).alias("ratio"))


@query("SELECT user_id, event_type, round(sum(value), 4) AS total, count(*) AS n, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY ALL")
def telemetry_rollup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


@query("SELECT lang, count(*) AS total, count(quality) AS covered FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("total"), F.count("quality").alias("covered"))


@query("[segment] SELECT DISTINCT group_id FROM segment WHERE group_id IS NOT NULL")
def distinct_groups(spark: SparkSession, d: str) -> DataFrame:
    return segment(spark, d).where("group_id is not null").select("group_id").distinct()


@query("SELECT p_name AS name, min(p_brand) AS community FROM part GROUP BY p_name")
def first_community(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").groupBy(c("p_name").alias("name")).agg(F.min("p_brand").alias("community"))


@query("SELECT conv_id, string_agg('[' || lpad(turn::VARCHAR, 2, '0') || ':00] ' || text, chr(10) || chr(10) ORDER BY turn) AS script FROM conversations GROUP BY conv_id")
def transcript_concat(spark: SparkSession, d: str) -> DataFrame:
    return R.transcript(segment(spark, d)).select(c("media_id").alias("conv_id"), "script")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def citations_dedup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("[mention] SELECT name, count(DISTINCT media_id) AS media FROM mention GROUP BY name HAVING count(DISTINCT media_id) > 1")
def cross_media_communities(spark: SparkSession, d: str) -> DataFrame:
    return mention(spark, d).groupBy("name").agg(F.countDistinct("media_id").alias("media")).where("media > 1")


# --- windows, limits, sets ---


@query("[relation] SELECT group_id, src, dst, strength FROM relation QUALIFY row_number() OVER (PARTITION BY group_id, src ORDER BY strength DESC, n DESC, dst) <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(relation(spark, d), ["group_id", "src"], [F.desc("strength"), F.desc("n"), "dst"], 3).select("group_id", "src", "dst", "strength")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5 AND role IN ('user', 'assistant')")
def history_last_n(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(t(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 5).where("role in ('user', 'assistant')").select("conv_id", "turn", "role")


@query("SELECT conv_id, CASE WHEN length(x) > 30 THEN left(x, 30) || '…' ELSE x END AS title FROM (SELECT conv_id, arg_min(text, turn) AS x FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def session_title(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("x"))
    return x.select("conv_id", F.when(F.length("x") > 30, F.concat(F.left("x", F.lit(30)), F.lit("…"))).otherwise(c("x")).alias("title"))


@query("SELECT user_id, min(r) AS rank FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE event_type = 'purchase' GROUP BY user_id")
def first_hit_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").withColumn("r", F.row_number().over(w)).where("event_type = 'purchase'").groupBy("user_id").agg(F.min("r").cast("long").alias("rank"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 200")
def trim_feedback(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(t(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 200).select("user_id", "event_id")


@query("[entity relation] WITH n AS (SELECT * FROM entity WHERE group_id = 'user_0' ORDER BY source_count DESC, id LIMIT 20), e AS (SELECT * FROM relation WHERE group_id = 'user_0' ORDER BY strength DESC, n DESC, src, dst LIMIT 300) SELECT src, dst, strength FROM e WHERE src IN (SELECT name FROM n) AND dst IN (SELECT name FROM n)")
def graph_view_topk(spark: SparkSession, d: str) -> DataFrame:
    n = entity(spark, d).where("group_id = 'user_0'").orderBy(F.desc("source_count"), "id").limit(20).select("name")
    e = relation(spark, d).where("group_id = 'user_0'").orderBy(F.desc("strength"), F.desc("n"), "src", "dst").limit(300)
    return e.join(n.withColumnRenamed("name", "src"), "src", "left_semi").join(n.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst", "strength")


@query("SELECT label, count(*) AS n FROM embeddings WHERE label % 2 = 0 GROUP BY label ORDER BY n DESC, label")
def communities_by_size(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").where("label % 2 = 0").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@query("SELECT event_id, value FROM events WHERE value >= 50 ORDER BY value DESC, event_id LIMIT 15")
def map_points_topk(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").where("value >= 50").orderBy(F.desc("value"), "event_id").limit(15).select("event_id", "value")


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100")
def latest_failed(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("event_id")).limit(100).select("event_id")


@query("SELECT p_brand, string_agg(DISTINCT p_name, '|' ORDER BY p_name) FILTER (p_name <> m) AS aliases FROM (SELECT *, min(p_name) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY p_brand")
def alias_union(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("s"), F.min("p_name").alias("m")).select("p_brand", F.array_join(F.array_sort(F.array_except("s", F.array("m"))), "|").alias("aliases"))


@query("SELECT string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS ids FROM part")
def write_set(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), "|").alias("ids"))


@query("SELECT DISTINCT lower(trim(p_name)) AS name FROM part WHERE p_size > 40 AND lower(trim(p_name)) NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_size <= 2)")
def gleaning_new_only(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "part").select(F.lower(F.trim("p_name")).alias("name"), "p_size")
    return n.where("p_size > 40").join(n.where("p_size <= 2"), "name", "left_anti").select("name").distinct()


@query("WITH u AS (SELECT 1 AS pri, user_id, event_type, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL UNION ALL SELECT 2, user_id, event_type, max(value) FROM events WHERE event_id % 2 = 1 GROUP BY ALL), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY pri) = 1) SELECT user_id, event_type, v FROM k WHERE v > 0.5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) <= 5")
def candidate_union_prefer_memory(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    side = lambda k, p: e.where(c("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.max("value").alias("v")).withColumn("pri", F.lit(p))
    one = side(0, 1).unionByName(side(1, 2)).groupBy("user_id", "event_type").agg(F.min_by("v", "pri").alias("v")).where("v > 0.5")
    return S.latest(one, ["user_id"], [F.desc("v"), "event_type"], 5)


@query("SELECT conv_id, turn, min(pri) AS pri FROM (SELECT conv_id, turn, 1 AS pri FROM conversations WHERE role = 'system' UNION ALL SELECT conv_id, turn, 2 FROM conversations WHERE turn < 2 UNION ALL SELECT conv_id, turn, 3 FROM conversations) GROUP BY ALL")
def segments_union_priority(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "conversations").select("conv_id", "turn", "role")
    u = s.where("role = 'system'").withColumn("pri", F.lit(1)).unionByName(s.where("turn < 2").withColumn("pri", F.lit(2))).unionByName(s.withColumn("pri", F.lit(3)))
    return u.groupBy("conv_id", "turn").agg(F.min("pri").alias("pri"))


# --- remaining small operators ---


@query("[media] SELECT regexp_replace(id, '^media_', '')::BIGINT AS media_id, summary FROM media WHERE summary IS NOT NULL")
def media_summaries(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).where("summary is not null").select(F.regexp_replace("id", "^media_", "").cast("long").alias("media_id"), "summary")


@query("[media] SELECT media_id, title FROM media WHERE group_id = 'user_2' ORDER BY media_id DESC")
def list_media_by_user(spark: SparkSession, d: str) -> DataFrame:
    return S.scope(media(spark, d), group_id="user_2").orderBy(F.desc("media_id")).select("media_id", "title")


@query("SELECT user_id, max(ts) AS updated_at FROM events GROUP BY user_id ORDER BY updated_at DESC, user_id")
def list_sessions(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at")).orderBy(F.desc("updated_at"), "user_id")


@query("WITH h AS (SELECT doc_id, source, md5(text) AS h FROM documents) SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY source, h) < doc_id THEN 'INSTANT' WHEN doc_id % 10 = 0 THEN 'RESUME' WHEN doc_id % 10 = 1 THEN 'CONFLICT' ELSE 'NEW' END AS decision FROM h")
def upload_decision(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.operators.tasks import upload_decision as f

    docs = t(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("hash"), F.floor(c("n_chars") / 1000).alias("chunks"))
    tasks = docs.where("doc_id % 10 < 2").select("doc_id", (c("chunks") + c("doc_id") % 10).alias("task_chunks"))
    return f(docs, tasks)


@query("SELECT l_orderkey AS upload_id, count(*) >= 3 AND round(sum(l_quantity), 2) >= 100 AS complete FROM lineitem GROUP BY l_orderkey")
def upload_complete_check(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy(c("l_orderkey").alias("upload_id")).agg(((F.count("*") >= 3) & (F.round(F.sum("l_quantity"), 2) >= 100)).alias("complete"))


@query("SELECT e.event_id FROM events e WHERE e.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.user_id = e.user_id AND a.event_type = 'purchase' AND a.ts > e.ts)")
def latest_failed_replay_guard(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    done = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("done"))
    return e.where("event_type = 'error'").join(done, "user_id", "left").where("done is null or done <= ts").select("event_id")


@query("[event] SELECT event_id FROM event WHERE (k = 7 OR k = 8) AND event_type = 'click'")
def feedback_filter(spark: SparkSession, d: str) -> DataFrame:
    return event(spark, d).where("(k = 7 or k = 8) and event_type = 'click'").select("event_id")


@query("SELECT conv_id, '# ' || arg_min(text, turn) || chr(10) || string_agg('- [' || lpad(turn::VARCHAR, 2, '0') || ':00] ' || role || '：' || text, chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def result_markdown(spark: SparkSession, d: str) -> DataFrame:
    return R.markdown(segment(spark, d)).select(c("media_id").alias("conv_id"), "markdown")


@query("SELECT doc_id, left(text, 4000) AS prompt FROM documents")
def follow_up_prompt(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.left("text", F.lit(4000)).alias("prompt"))


@query("[segment] SELECT segment_id, 'Time: ' || (start_ms // 1000) || ':' || lpad((start_ms % 1000 // 10)::VARCHAR, 2, '0') || chr(10) || 'Speech: ' || transcript AS input FROM segment")
def extraction_input_text(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("Time: "), F.floor(c("start_ms") / 1000), F.lit(":"), F.lpad(F.floor(c("start_ms") % 1000 / 10).cast("string"), 2, "0"))
    return segment(spark, d).select("segment_id", F.concat_ws("\n", head, F.concat(F.lit("Speech: "), "transcript")).alias("input"))


@query("SELECT doc_id, coalesce(quality, 9) AS value FROM documents LEFT JOIN labels USING (doc_id)")
def layered_config(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(9)).alias("value"))


@query("[entity] SELECT id, 20 + 5 * source_count AS size, left(name, 20) AS label, ascii(name) % 10 AS colour FROM entity")
def graph_export_rows(spark: SparkSession, d: str) -> DataFrame:
    return entity(spark, d).select("id", (20 + 5 * c("source_count")).alias("size"), F.left("name", F.lit(20)).alias("label"), (F.ascii("name") % 10).alias("colour"))


@query("[mentioned] SELECT entity_id, count(DISTINCT media_id) AS media, min(media_id * 100 + segment_index) AS first_segment FROM mentioned GROUP BY entity_id")
def entity_detail_export(spark: SparkSession, d: str) -> DataFrame:
    return mentioned(spark, d).groupBy("entity_id").agg(F.countDistinct("media_id").alias("media"), F.min(c("media_id") * 100 + c("segment_index")).alias("first_segment"))


@query("[mentioned] SELECT DISTINCT entity_id, media_id FROM mentioned")
def segment_relation_stamp(spark: SparkSession, d: str) -> DataFrame:
    return mention(spark, d).select(entity_id().alias("entity_id"), "media_id").distinct()

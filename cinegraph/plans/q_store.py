"""Sinks: upserts, cascades, reports and vector points; folds of ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.functions import text as X
from cinegraph.operators import folds as D
from cinegraph.operators import store as S
from cinegraph.plans.catalog import event, media, mention, mentioned, query, segment, t, vec

c = F.col


@query("[media] SELECT media_id, CASE WHEN media_id % 2 = 0 THEN 1 ELSE 2 END AS uploaded_at, title FROM media")
def upsert_media_first_write_wins(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d)
    old = m.where("media_id % 2 = 0").select("media_id", F.lit(1).alias("uploaded_at"), F.lit("old").alias("title"))
    return S.upsert(old, m.select("media_id", F.lit(2).alias("uploaded_at"), "title"), ["media_id"], ("uploaded_at",))


@query("WITH n AS (SELECT label AS id, count(*) AS entity_count FROM embeddings GROUP BY label) SELECT id, CASE WHEN id % 3 <> 1 THEN entity_count ELSE 1 END AS entity_count, CASE WHEN id % 3 = 1 THEN 'old finding' WHEN id % 4 = 0 THEN 'found ' || id ELSE '' END AS findings FROM n UNION ALL SELECT 1000 + label, 1, 'old finding' FROM embeddings GROUP BY label")
def upsert_communities(spark: SparkSession, d: str) -> DataFrame:
    """New communities overwrite old ones of the same id, with no findings where they bring none; others stay."""
    n = t(spark, d, "embeddings").groupBy(c("label").alias("id")).agg(F.count("*").alias("entity_count"))
    said = F.array(F.lit("old finding"))
    old = n.select("id", F.lit(1).cast("long").alias("entity_count"), said.alias("findings")).unionByName(n.select((c("id") + 1000).alias("id"), F.lit(1).cast("long").alias("entity_count"), said.alias("findings")))
    new = n.where("id % 3 <> 1").withColumn("findings", F.when(c("id") % 4 == 0, F.array(F.concat(F.lit("found "), "id"))))
    out = S.upsert(old, new.withColumn("findings", F.coalesce("findings", F.array().cast("array<string>"))), ["id"])
    return out.select("id", "entity_count", F.array_join("findings", ",").alias("findings"))


_GONE = "media_id % 7 = 0"


@query(f"""[mention] WITH src AS (SELECT DISTINCT a.group_id, a.name AS src, b.name AS dst, 'media_' || a.media_id || '_segment_' || a.segment_index AS sid, a.media_id FROM mention a JOIN mention b ON a.group_id = b.group_id AND a.media_id = b.media_id AND a.name < b.name),
rel AS (SELECT group_id, src, dst, count(*) FILTER (NOT ({_GONE})) AS left_ FROM src GROUP BY ALL HAVING left_ > 0), ent AS (SELECT group_id, name, count(DISTINCT (media_id, segment_index)) AS n FROM mention WHERE NOT ({_GONE}) GROUP BY ALL), com AS (SELECT group_id, ascii(name) % 5 AS community, count(*) AS n FROM ent GROUP BY ALL)
SELECT 'relation' AS kind, group_id, src || '|' || dst AS id, left_ AS n FROM rel UNION ALL SELECT 'entity', group_id, name, n FROM ent UNION ALL SELECT 'community', group_id, community::VARCHAR, n FROM com""")
def delete_media_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Media go; their segments leave the source lists of relations; what has no source, mention or member left goes, and counts are taken anew."""
    m = mention(spark, d)
    gone = t(spark, d, "orders").where("o_orderkey % 7 = 0").select(c("o_orderkey").alias("media_id"))
    sid = F.concat(F.lit("media_"), c("a.media_id"), F.lit("_segment_"), c("a.segment_index"))
    same = (c("a.group_id") == c("b.group_id")) & (c("a.media_id") == c("b.media_id")) & (c("a.name") < c("b.name"))
    rel = m.alias("a").join(m.alias("b"), same).groupBy(c("a.group_id").alias("group_id"), c("a.name").alias("src"), c("b.name").alias("dst")).agg(F.collect_set(sid).alias("sources"))
    rel, ent, com = S.delete_media(rel, m.select("group_id", "name", "media_id", "segment_index").distinct(), m.select("group_id", "name").distinct().withColumn("community", F.ascii("name") % 5), gone)
    row = lambda df, kind, key, n: df.select(F.lit(kind).alias("kind"), "group_id", key.cast("string").alias("id"), c(n).cast("long").alias("n"))
    return row(rel, "relation", F.concat_ws("|", "src", "dst"), "source_count").unionByName(row(ent, "entity", c("name"), "source_count")).unionByName(row(com, "community", c("community"), "entity_count"))


@query("SELECT doc_id, left(coalesce(nullif(source, ''), 'unknown'), 3) AS action, left(regexp_replace(regexp_replace(regexp_replace('token=' || doc_id || ' ' || text, 'bearer\\s+[A-Za-z0-9._-]+', 'Bearer ***', 'gi'), '(api[_-]?key|token|password|secret)\\s*[=:]\\s*[^\\s,;]+', '\\1=***', 'gi'), 'sk-[A-Za-z0-9]{8,}', 'sk-***', 'g'), 255) AS error FROM documents")
def dead_letter_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Rows cut to the width of their columns, with placeholders, and without secrets."""
    action = F.left(F.coalesce(F.nullif(c("source"), F.lit("")), F.lit("unknown")), F.lit(3))
    return t(spark, d, "documents").select("doc_id", action.alias("action"), X.mask_secrets(F.concat(F.lit("token="), "doc_id", F.lit(" "), "text"), 255).alias("error"))


_REPORT = "WITH q AS (SELECT conv_id AS id, CASE WHEN conv_id % 5 = 0 THEN 'oos' ELSE 'local' END AS type, count(*) FILTER (role = 'assistant') > 0 AS hit, count(*) AS n FROM conversations GROUP BY conv_id)"


def _report(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = t(spark, d, "conversations").groupBy(c("conv_id").alias("id")).agg(F.bool_or(c("role") == "assistant").alias("hit"), F.count("*").alias("n"))
    q = q.select("id", F.when(c("id") % 5 == 0, "oos").otherwise("local").alias("type"), "hit", "n")
    return q.groupBy("type").agg(F.count("*").alias("count"), F.round(F.avg(c("hit").cast("int")), 6).alias("hit_rate")), q


@query(_REPORT + " SELECT type, count(*) AS count, round(avg(hit::INT), 6) AS hit_rate FROM q GROUP BY type")
def write_report(spark: SparkSession, d: str) -> DataFrame:
    """A report of a summary and details, written as JSON; the summary is read back."""
    from cinegraph.sources.tables import read_report
    from cinegraph.sources.tables import write_report as write

    summary, details = _report(spark, d)
    return read_report(spark, write(summary, details), "summary", summary.schema)


@query(_REPORT + " SELECT id, type, hit, n FROM q")
def read_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The details of a written report, read with their schema."""
    from cinegraph.sources.tables import read_report
    from cinegraph.sources.tables import write_report as write

    summary, details = _report(spark, d)
    return read_report(spark, write(summary, details), "details", details.schema)


_UUID = "left(m, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(m, 17, 1))::INT % 4), 1) || substr(m, 18, 3) || '-' || substr(m, 21)"


@query(f"[segment vec] WITH s AS (SELECT media_id, start_ms, end_ms, CASE WHEN (media_id + segment_index) % 6 = 0 THEN []::DOUBLE[] WHEN (media_id + segment_index) % 6 = 1 THEN NULL ELSE v END AS v, md5(media_id || ':' || start_ms || ':' || end_ms) AS m FROM segment JOIN vec ON vec_id = (media_id * 8 + segment_index) % 500) SELECT {_UUID} AS point_id, media_id, start_ms, end_ms, len(v) AS dimension FROM s WHERE v IS NOT NULL AND len(v) > 0")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Points of a vector store: an id by name, the payload and the vector; a second upsert replaces, and empty vectors are left out."""
    from cinegraph.sources.tables import name_uuid

    k = (c("media_id") + c("segment_index")) % 6
    v = vec(spark, d).select(c("vec_id").alias("_at"), "v")
    s = segment(spark, d).withColumn("_at", ((c("media_id") * 8 + c("segment_index")) % 500).cast("long")).join(F.broadcast(v), "_at")
    s = s.withColumn("v", F.when(k == 0, F.array().cast("array<double>")).when(k != 1, c("v")))
    points = s.where("v is not null and size(v) > 0").select(name_uuid(F.concat_ws(":", "media_id", "start_ms", "end_ms")).alias("point_id"), "media_id", "start_ms", "end_ms", "v")
    stored = S.upsert(points.withColumn("end_ms", -c("end_ms")), points, ["point_id"])
    return stored.select("point_id", "media_id", "start_ms", "end_ms", F.size("v").cast("long").alias("dimension"))


@query("[mentioned] WITH m AS (SELECT DISTINCT group_id, ascii(replace(entity_id, 'entity_' || group_id || '_', '')) % 5 AS community, media_id, segment_index FROM mentioned), r AS (SELECT *, count(*) OVER w AS communities FROM m WINDOW w AS (PARTITION BY group_id, media_id, segment_index)) SELECT group_id, community, media_id, segment_index, communities FROM r")
def two_hop_provenance(spark: SparkSession, d: str) -> DataFrame:
    """From communities over their members to the segments that mention them, ordered by media and place, and how many communities each segment serves."""
    m = mention(spark, d).select("group_id", (F.ascii("name") % 5).alias("community"), "media_id", "segment_index").distinct()
    served = m.groupBy("group_id", "media_id", "segment_index").agg(F.count("*").alias("communities"))
    return m.join(served, ["group_id", "media_id", "segment_index"]).orderBy("group_id", "community", "media_id", "segment_index").select("group_id", "community", "media_id", "segment_index", "communities")


@query("[event] WITH l AS (SELECT user_id, k, event_id, ts FROM event QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, k, event_id FROM l ORDER BY ts DESC, event_id DESC LIMIT 500")
def trace_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest trace of each task and goal; above 500 the oldest are evicted."""
    last = event(spark, d).groupBy("user_id", "k").agg(F.max(F.struct("ts", "event_id")).alias("x"))
    return last.orderBy(F.desc("x")).limit(500).select("user_id", "k", "x.event_id")


# --- folds: each step depends on what was kept before ---


@query("""WITH RECURSIVE h AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, list_sum(list_transform(range(16), lambda j: CASE WHEN embedding[j + 1 + j // 4] > embedding[j + 2 + j // 4] THEN 1 << j ELSE 0 END))::BIGINT AS hash FROM embeddings),
r AS (SELECT label, i, vec_id, hash AS kept, true AS keep FROM h WHERE i = 1 UNION ALL SELECT h.label, h.i, h.vec_id, CASE WHEN bit_count(xor(h.hash, r.kept)) > 5 THEN h.hash ELSE r.kept END, bit_count(xor(h.hash, r.kept)) > 5 FROM r JOIN h ON h.label = r.label AND h.i = r.i + 1)
SELECT label, vec_id FROM r WHERE keep""")
def frame_dedup_chain(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a label in order; one stays if its difference hash is more than five bits from the last that was kept."""
    bits = F.expr("transform(sequence(0, 15), j -> if(embedding[j + j div 4] > embedding[j + 1 + j div 4], shiftleft(1L, j), 0L))")
    h = t(spark, d, "embeddings").select("label", "vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a + x).alias("hash"))
    return D.dedup_chain(h, "label", "vec_id", "hash", 5)


@query("WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), r AS (SELECT conv_id, i, turn, true AS taken, n AS used FROM s WHERE i = 1 UNION ALL SELECT s.conv_id, s.i, s.turn, r.used + s.n <= 1200, r.used + CASE WHEN r.used + s.n <= 1200 THEN s.n ELSE 0 END FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1) SELECT conv_id, turn FROM r WHERE taken")
def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    return D.budget_pack(t(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size")), "conv_id", "turn", "size", 1200)


@query("WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), r AS (SELECT conv_id, i, turn, 0 AS chunk, n AS used FROM s WHERE i = 1 UNION ALL SELECT s.conv_id, s.i, s.turn, CASE WHEN r.used > 0 AND r.used + s.n > 1000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used > 0 AND r.used + s.n > 1000 THEN s.n ELSE r.used + s.n END FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1) SELECT conv_id, turn, chunk FROM r")
def text_chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return D.chunk_pack(t(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size")), "conv_id", "turn", "size", 1000)


@query("[segment] WITH RECURSIVE s AS (SELECT media_id, segment_index, length(transcript) + 9 AS n, row_number() OVER (PARTITION BY media_id ORDER BY start_ms) AS i FROM segment), r AS (SELECT media_id, i, 0 AS chunk, n AS used FROM s WHERE i = 1 UNION ALL SELECT s.media_id, s.i, CASE WHEN r.used + s.n > 600 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used + s.n > 600 THEN s.n ELSE r.used + s.n END FROM r JOIN s ON s.media_id = r.media_id AND s.i = r.i + 1), z AS (SELECT media_id, sum(n) - 1 AS chars FROM s GROUP BY media_id) SELECT media_id, chars::BIGINT AS chars, chars <= 2000 AS single, CASE WHEN chars <= 2000 THEN 1 ELSE max(chunk) + 1 END AS calls FROM r JOIN z USING (media_id) GROUP BY media_id, chars")
def summary_text_layers(spark: SparkSession, d: str) -> DataFrame:
    """Timed lines of an item go to one summary call if they are short enough, else chunk by chunk and then merged."""
    from cinegraph.operators.segments import summary_layers

    return summary_layers(segment(spark, d), single=2000, chunk=600)

"""Registry of queries, and the domain tables that they derive from the driver's tables.

VIEWS states the same derivations in SQL; a query's SQL names the views that it uses in brackets at its start.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VIEWS = {
    "segment": "SELECT conv_id AS media_id, turn AS segment_index, 'media_' || conv_id || '_segment_' || turn AS segment_id, 'user_' || (conv_id % 4) AS group_id, turn * 60000 AS start_ms, turn * 60000 + 60000 AS end_ms, role, text AS transcript FROM conversations",
    "media": "SELECT doc_id AS media_id, 'media_' || doc_id AS id, 'user_' || (doc_id % 4) AS group_id, source AS title, text AS summary, n_chars * 100 AS duration_ms, lang FROM documents",
    "mention": "SELECT 'user_' || (l_orderkey % 4) AS group_id, l_orderkey AS media_id, l_linenumber AS segment_index, p_name AS name, p_type AS type, p_brand AS description FROM lineitem JOIN part ON l_partkey = p_partkey",
    "entity": "SELECT group_id, 'entity_' || group_id || '_' || name AS id, name, min(type) AS type, min(description) AS description, count(DISTINCT media_id * 100 + segment_index) AS source_count FROM mention GROUP BY group_id, name",
    "mentioned": "SELECT DISTINCT group_id, 'entity_' || group_id || '_' || name AS entity_id, media_id, segment_index FROM mention",
    "relation": "SELECT a.group_id, a.name AS src, b.name AS dst, max(1 + (a.segment_index + b.segment_index) % 10) AS strength, count(*) AS n FROM mention a JOIN mention b ON a.group_id = b.group_id AND a.media_id = b.media_id AND a.name < b.name GROUP BY a.group_id, a.name, b.name",
    "moment": "SELECT *, CASE segment_index % 3 WHEN 0 THEN [left(transcript, 24), translate(left(transcript, 12), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')] WHEN 1 THEN []::VARCHAR[] ELSE [right(transcript, 20)] END AS ocr_texts FROM segment",
    "evidence": "SELECT segment_id AS evidence_id, media_id, start_ms + (segment_index * 17 + media_id) % 80 * 1000 AS ts, (['ASR', 'OCR', 'asr+ocr', 'NOTE'])[1 + ((media_id + segment_index) % 4)::INT] AS source, left(transcript, 40) AS claim, CASE WHEN (media_id + segment_index) % 5 = 0 THEN 'unseen ' || left(transcript, 9) WHEN (media_id + segment_index) % 4 = 1 THEN translate(left(transcript, 10), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE translate(substr(transcript, 5, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS content FROM segment",
    "variant": "SELECT group_id, media_id, segment_index, CASE (media_id + segment_index) % 4 WHEN 1 THEN upper(name) WHEN 2 THEN name || 's' WHEN 3 THEN '  ' || name ELSE name END AS name, name AS plain, type, description FROM mention",
    "raw_relation": "SELECT group_id, media_id, segment_index, name AS src, CASE WHEN media_id % 11 = 0 THEN 'nobody' ELSE lead(name) OVER w END AS dst, description || ' near ' || lead(description) OVER w AS description, 1 + (media_id + segment_index) % 10 AS strength FROM (SELECT v.*, row_number() OVER (PARTITION BY media_id ORDER BY segment_index, plain, description, name) AS pos FROM variant v) WINDOW w AS (PARTITION BY media_id ORDER BY pos) QUALIFY lead(name) OVER w IS NOT NULL",
    "vec": "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 500",
    "event": "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
}
_NEEDS = {"entity": ["mention"], "mentioned": ["mention"], "relation": ["mention"], "moment": ["segment"], "evidence": ["segment"], "variant": ["mention"], "raw_relation": ["mention", "variant"]}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name; sql may start with [view view ...]."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def with_views(sql: str) -> str:
    m = re.match(r"\s*\[([\w ]+)\]\s*", sql)
    if not m:
        return sql.strip()
    names: list[str] = []
    for v in m[1].split():
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    body = sql[m.end() :].strip()
    if re.match(r"(?i)WITH\s+RECURSIVE\b", body):
        return f"WITH RECURSIVE {head}, {re.sub(r'(?i)^WITH\s+RECURSIVE', '', body)}"
    return f"WITH {head}, {body[4:]}" if body[:4].upper() == "WITH" else f"WITH {head} {body}"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segment(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return t(spark, d, "conversations").select(
        c("conv_id").alias("media_id"),
        c("turn").alias("segment_index"),
        F.concat(F.lit("media_"), c("conv_id"), F.lit("_segment_"), c("turn")).alias("segment_id"),
        F.concat(F.lit("user_"), c("conv_id") % 4).alias("group_id"),
        (c("turn") * 60000).alias("start_ms"),
        (c("turn") * 60000 + 60000).alias("end_ms"),
        "role",
        c("text").alias("transcript"),
    )


def media(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return t(spark, d, "documents").select(
        c("doc_id").alias("media_id"),
        F.concat(F.lit("media_"), c("doc_id")).alias("id"),
        F.concat(F.lit("user_"), c("doc_id") % 4).alias("group_id"),
        c("source").alias("title"),
        c("text").alias("summary"),
        (c("n_chars") * 100).alias("duration_ms"),
        "lang",
    )


def mention(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = t(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return lines.join(parts, c("l_partkey") == c("p_partkey")).select(
        F.concat(F.lit("user_"), c("l_orderkey") % 4).alias("group_id"),
        c("l_orderkey").alias("media_id"),
        c("l_linenumber").alias("segment_index"),
        c("p_name").alias("name"),
        c("p_type").alias("type"),
        c("p_brand").alias("description"),
    )


def entity_id() -> F.Column:
    return F.concat(F.lit("entity_"), F.col("group_id"), F.lit("_"), F.col("name"))


def entity(spark: SparkSession, d: str) -> DataFrame:
    rolled = mention(spark, d).groupBy("group_id", "name").agg(F.min("type").alias("type"), F.min("description").alias("description"), F.countDistinct(F.col("media_id") * 100 + F.col("segment_index")).alias("source_count"))
    return rolled.select("group_id", entity_id().alias("id"), "name", "type", "description", "source_count")


def mentioned(spark: SparkSession, d: str) -> DataFrame:
    return mention(spark, d).select("group_id", entity_id().alias("entity_id"), "media_id", "segment_index").distinct()


def relation(spark: SparkSession, d: str) -> DataFrame:
    m = mention(spark, d).select("group_id", "media_id", "segment_index", "name")
    a, b = m.alias("a"), m.alias("b")
    both = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.media_id") == F.col("b.media_id")) & (F.col("a.name") < F.col("b.name")))
    strength = F.max(1 + (F.col("a.segment_index") + F.col("b.segment_index")) % 10).alias("strength")
    return both.groupBy(F.col("a.group_id").alias("group_id"), F.col("a.name").alias("src"), F.col("b.name").alias("dst")).agg(strength, F.count("*").alias("n"))


def event(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def big(x: F.Column) -> F.Column:
    """The letters a-z in upper case."""
    return F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def moment(spark: SparkSession, d: str) -> DataFrame:
    """Segments with screen texts."""
    x = F.col("transcript")
    ocr = F.when(F.col("segment_index") % 3 == 0, F.array(F.left(x, F.lit(24)), big(F.left(x, F.lit(12))))).when(F.col("segment_index") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.right(x, F.lit(20))))
    return segment(spark, d).withColumn("ocr_texts", ocr)


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Quotes with a source label, a time and the claim that they stand for."""
    c = F.col
    k = c("media_id") + c("segment_index")
    x = c("transcript")
    content = F.when(k % 5 == 0, F.concat(F.lit("unseen "), F.left(x, F.lit(9)))).when(k % 4 == 1, big(F.left(x, F.lit(10)))).otherwise(big(F.substring(x, 5, 30)))
    source = F.element_at(F.array(*[F.lit(s) for s in ("ASR", "OCR", "asr+ocr", "NOTE")]), (1 + k % 4).cast("int"))
    return segment(spark, d).select(c("segment_id").alias("evidence_id"), "media_id", (c("start_ms") + (c("segment_index") * 17 + c("media_id")) % 80 * 1000).alias("ts"), source.alias("source"), F.left(x, F.lit(40)).alias("claim"), content.alias("content"))


def _written(mentions: DataFrame) -> DataFrame:
    c = F.col
    k = (c("media_id") + c("segment_index")) % 4
    name = F.when(k == 1, F.upper("name")).when(k == 2, F.concat("name", F.lit("s"))).when(k == 3, F.concat(F.lit("  "), "name")).otherwise(c("name"))
    return mentions.select("group_id", "media_id", "segment_index", name.alias("name"), c("name").alias("plain"), "type", "description")


def variant(spark: SparkSession, d: str) -> DataFrame:
    """Mentions whose names are written in several ways."""
    return _written(mention(spark, d))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """All mentions (src), dealt by item, each with its relation to the next one; dst is null where there is none. Some ends name nobody."""
    c = F.col
    w = Window.partitionBy("media_id").orderBy(*(c(x).asc_nulls_last() for x in ("segment_index", "plain", "description", "name")))  # nulls as in the SQL
    # names are written after the deal, which then holds each of them once
    rows = _written(mention(spark, d).repartition("media_id")).withColumn("next", F.lead("name").over(w)).withColumn("after", F.lead("description").over(w))
    dst = F.when(c("next").isNotNull(), F.when(c("media_id") % 11 == 0, F.lit("nobody")).otherwise(c("next")))
    return rows.select("group_id", "media_id", "segment_index", c("name").alias("src"), dst.alias("dst"), F.concat("description", F.lit(" near "), "after").alias("description"), (1 + (c("media_id") + c("segment_index")) % 10).alias("strength"))


def raw_relation(spark: SparkSession, d: str) -> DataFrame:
    """Relations between neighbouring mentions of a media item; some ends name nobody."""
    return neighbours(spark, d).where("dst is not null")


def vec(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 vectors by id; domain rows are given one by arithmetic on their keys."""
    return t(spark, d, "embeddings").where("vec_id < 500").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

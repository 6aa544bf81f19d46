"""Scalar functions, filters and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.functions import text as X
from cinegraph.operators import parsing as P
from cinegraph.plans.catalog import event, media, query, segment, t

_NE = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"
_NF = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9''一-鿿 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NC = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9一-鿿]', '', 'g')"
_SH = "CASE WHEN length({0}) = 0 OR length({0}) = 2 THEN []::VARCHAR[] WHEN length({0}) = 1 THEN [{0}] ELSE list_distinct(list_transform(range(1, (length({0}) - 1)::BIGINT), lambda i: substr({0}, i::BIGINT, 3))) END"
_MMSS = "(lpad(({0} // 60000)::VARCHAR, greatest(length(({0} // 60000)::VARCHAR), 2)::INT, '0') || ':' || lpad(({0} // 1000 % 60)::VARCHAR, 2, '0'))"


@query(f"SELECT p_partkey, {_NE.format('p_name')} AS norm FROM part")
def normalize_exact(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", X.normalize_exact(F.col("p_name")).alias("norm"))


@query(f"SELECT doc_id, {_NF.format('text')} AS norm FROM documents")
def normalize_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", X.normalize_fuzzy(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, {_NC.format('text')} AS norm FROM documents")
def normalize_fuzzy_legacy(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", X.normalize_compact(F.col("text")).alias("norm"))


_ENT = """WITH n AS (SELECT DISTINCT p_name AS name FROM part),
c AS (SELECT name, unnest(string_split(replace(name, ' ', ''), '')) AS ch FROM n),
g AS (SELECT name, ch, count(*) AS k, sum(count(*)) OVER (PARTITION BY name) AS n FROM c WHERE ch <> '' GROUP BY name, ch)
SELECT name, round(-sum(k / n * log2(k / n)), 6) AS entropy{0} FROM g GROUP BY name"""


@query(_ENT.format(""))
def name_entropy(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_name").alias("name")).distinct().select("name", F.round(X.entropy(F.col("name")), 6).alias("entropy"))


@query(_ENT.format(", NOT (length(name) < 6 AND len(string_split(name, ' ')) < 2) AND -sum(k / n * log2(k / n)) >= 1.5 AS passes"))
def entropy_gate(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    e = X.entropy(n)
    short = (F.length(n) < 6) & (F.size(F.split(n, " ")) < 2)
    return t(spark, d, "part").select(F.col("p_name").alias("name")).distinct().select("name", F.round(e, 6).alias("entropy"), (~short & (e >= 1.5)).alias("passes"))


@query("SELECT DISTINCT p_name AS name, NOT (length(p_name) < 6 AND len(string_split(p_name, ' ')) < 2) AS passes FROM part")
def legacy_length_gate(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return t(spark, d, "part").select(n.alias("name"), (~((F.length(n) < 6) & (F.size(F.split(n, " ")) < 2))).alias("passes")).distinct()


@query(f"SELECT DISTINCT p_name AS name, array_to_string(list_sort({_SH.format('p_name')}), '|') AS shingles FROM part")
def shingles3(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_name").alias("name"), F.array_join(F.array_sort(X.shingles3(F.col("p_name"))), "|").alias("shingles")).distinct()


_PAIRS = f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT name, {_SH.format('name')} AS s FROM n),
e AS (SELECT name, unnest(s) AS g, len(s) AS k FROM s),
p AS (SELECT a.name AS a, b.name AS b, count(*) AS inter, any_value(a.k) AS ka, any_value(b.k) AS kb FROM e a JOIN e b ON a.g = b.g AND a.name < b.name GROUP BY a.name, b.name)"""


@query(_PAIRS + " SELECT a, b, round(inter / (ka + kb - inter), 6) AS jaccard FROM p WHERE inter >= 0.2 * (ka + kb - inter)")
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.operators.similarity import shingle_pairs

    names = t(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return shingle_pairs(names, "name", 0.2).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(_PAIRS + ", c AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name < b.name AND (contains(a.name, b.name) OR contains(b.name, a.name))) SELECT DISTINCT a, b FROM (SELECT a, b FROM p WHERE inter >= 0.4 * (ka + kb - inter) UNION ALL SELECT a, b FROM c)")
def fuzzy_pair_join(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.operators.similarity import fuzzy_pairs

    return fuzzy_pairs(t(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), "name", 0.4)


@query("WITH b AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS s FROM benchmark), d AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS s FROM documents), w AS (SELECT doc_id, len(s) AS n, unnest(s) AS w FROM d), v AS (SELECT item_id, len(s) AS k, unnest(s) AS w FROM b) SELECT doc_id, item_id, count(*) AS common, (any_value(n) + any_value(k) - count(*))::BIGINT AS either FROM w JOIN v USING (w) GROUP BY doc_id, item_id")
def shingle_set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of intersection and union of the word sets of whole texts, through an inverted index of the items."""
    from cinegraph.operators.similarity import set_sizes

    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    a = t(spark, d, "documents").select("doc_id", words(F.col("text")).alias("s"))
    b = t(spark, d, "benchmark").select("item_id", words(F.col("text")).alias("s"))
    return set_sizes(a, b, "doc_id", "item_id")


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, (length(text) - a) + ceil(a / 4)) END::BIGINT AS tokens FROM (SELECT *, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS a FROM documents)")
def estimate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, CASE WHEN length(x) > 180 THEN left(x, 180) || '...' ELSE x END AS short FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations)")
def abbreviate(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", X.abbreviate(F.col("text")).alias("short"))


@query("WITH s AS (SELECT item_id, text, unnest(regexp_split_to_array(lower(text), '[\\s,.;:!?|]+')) AS w, generate_subscripts(regexp_split_to_array(lower(text), '[\\s,.;:!?|]+'), 1) AS i FROM benchmark), f AS (SELECT item_id, w, min(i) AS i FROM s WHERE length(w) >= 2 GROUP BY item_id, w), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM f) SELECT item_id, string_agg(w, ' ' ORDER BY k) AS terms FROM r WHERE k <= 8 GROUP BY item_id")
def fallback_terms(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select("item_id", F.array_join(X.fallback_terms(F.col("text")), " ").alias("terms"))


@query("SELECT conv_id, turn, (contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT + contains(lower(text), 'de ')::INT) / 3.0 AS score FROM conversations")
def term_score(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", X.term_score(F.array(F.lit("the"), F.lit("and"), F.lit("de ")), F.col("text")).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(0.6 * l_discount * 10 + 0.25 * l_tax * 10 + 0.15 * l_quantity / 50, 6) AS score, l_extendedprice FROM lineitem")
def chunk_score(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.operators.ranking import chunk_score as f

    c = F.col
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(f(c("l_discount") * 10, c("l_tax") * 10, c("l_quantity") / 50), 6).alias("score"), "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(0.55 * l_discount * 10 + 0.25 * l_tax * 10 + 0.2 * l_quantity / 50, 6) AS score, l_extendedprice FROM lineitem")
def segment_score(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.operators.ranking import segment_score as f

    c = F.col
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(f(c("l_discount") * 10, c("l_tax") * 10, c("l_quantity") / 50), 6).alias("score"), "l_extendedprice")


@query("SELECT conv_id, turn, CASE WHEN contains(text, 'the') AND contains(text, 'an') THEN 'ASR+OCR' WHEN contains(text, 'an') THEN 'OCR' WHEN contains(text, 'the') THEN 'ASR' ELSE 'none' END AS source FROM conversations")
def evidence_source_label(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.operators.ranking import source_label

    x = F.col("text")
    return t(spark, d, "conversations").select("conv_id", "turn", source_label(F.contains(x, F.lit("the")), F.contains(x, F.lit("an"))).alias("source"))


@query(f"SELECT p_partkey, 'entity_user_' || (p_partkey % 4) || '_' || {_NE.format('p_name')} AS id FROM part")
def entity_id(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", F.concat(F.lit("entity_user_"), F.col("p_partkey") % 4, F.lit("_"), X.normalize_exact(F.col("p_name"))).alias("id"))


@query(f"SELECT p_partkey, 'rel_' || p_brand || '_' || p_type || '_' || left(md5({_NE.format('p_name')}), 10) AS id, left(md5(lower(trim(p_name))), 8) AS legacy FROM part")
def relation_id(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return t(spark, d, "part").select("p_partkey", F.concat(F.lit("rel_"), "p_brand", F.lit("_"), "p_type", F.lit("_"), F.left(F.md5(X.normalize_exact(n)), F.lit(10))).alias("id"), F.left(F.md5(F.lower(F.trim(n))), F.lit(8)).alias("legacy"))


@query("SELECT p_partkey, 'community_' || left(md5(p_name), 10) AS id FROM part")
def community_id(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", F.concat(F.lit("community_"), F.left(F.md5("p_name"), F.lit(10))).alias("id"))


@query("SELECT item_id, sha256(CASE WHEN item_id % 2 = 0 THEN trim(text) ELSE 'DETAIL' || chr(9247) || trim(text) END) AS digest FROM benchmark")
def goal_digest(spark: SparkSession, d: str) -> DataFrame:
    x = F.trim("text")
    return t(spark, d, "benchmark").select("item_id", F.sha2(F.when(F.col("item_id") % 2 == 0, x).otherwise(F.concat(F.lit("DETAIL␟"), x)), 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'media-' || doc_id ELSE md5(text) END AS key FROM documents")
def normalize_content_hash(spark: SparkSession, d: str) -> DataFrame:
    h = F.when(F.col("doc_id") % 3 == 0, F.lit("none")).otherwise(F.upper(F.md5("text")))
    return t(spark, d, "documents").select("doc_id", F.when(h.rlike("^[0-9A-Fa-f]{32}$"), F.lower(h)).otherwise(F.concat(F.lit("media-"), "doc_id")).alias("key"))


@query("SELECT doc_id, sha256(text) AS quick_hash FROM documents")
def quick_hash(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("quick_hash"))


@query("SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(text, 'bearer\\s+[A-Za-z0-9._-]+', 'Bearer ***', 'gi'), '(api[_-]?key|token|password|secret)\\s*[=:]\\s*[^\\s,;]+', '\\1=***', 'gi'), 'sk-[A-Za-z0-9]{8,}', 'sk-***', 'g'), 1000) AS masked FROM documents")
def mask_secrets(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", X.mask_secrets(F.col("text")).alias("masked"))


@query(f"SELECT doc_id, {_MMSS.format('(n_chars * 100)')} AS mmss, lpad((n_chars // 36000)::VARCHAR, 2, '0') || ':' || lpad((n_chars // 600 % 60)::VARCHAR, 2, '0') || ':' || lpad((n_chars // 10 % 60)::VARCHAR, 2, '0') || ',' || lpad((n_chars * 100 % 1000)::VARCHAR, 3, '0') AS srt FROM documents")
def mmss_srt_time(spark: SparkSession, d: str) -> DataFrame:
    ms = F.col("n_chars") * 100
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    srt = F.concat(two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return t(spark, d, "documents").select("doc_id", X.mmss(ms).alias("mmss"), srt.alias("srt"))


@query("WITH c AS (SELECT conv_id, turn, '〔媒体' || conv_id || ' ' || lpad(turn::VARCHAR, 2, '0') || ':30〕' AS x FROM conversations) SELECT conv_id, turn, regexp_extract(x, '〔媒体(\\d+) ', 1)::BIGINT AS media_id, regexp_extract(x, ' (\\d+):', 1)::BIGINT * 60 + regexp_extract(x, ':(\\d+)', 1)::BIGINT AS start_s FROM c")
def parse_citation_anchor(spark: SparkSession, d: str) -> DataFrame:
    anchor = F.concat(F.lit("〔媒体"), "conv_id", F.lit(" "), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":30〕"))
    return t(spark, d, "conversations").select("conv_id", "turn", anchor.alias("x")).select("conv_id", "turn", P.citation_anchor(F.col("x")).alias("a")).select("conv_id", "turn", "a.media_id", "a.start_s")


@query(r"""SELECT page_id, regexp_replace(url, '([+\-&|!(){}\[\]^"~*?:\\/=<>@#%,;])', '\\\1', 'g') AS escaped FROM pages""")
def escape_lucene(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.regexp_replace("url", r'([+\-&|!(){}\[\]^"~*?:\\/=<>@#%,;])', r"\\$1").alias("escaped"))


@query("SELECT p_partkey, p_brand || '|' || p_type || '|' || left(p_name, 5) AS key FROM part")
def rel_key(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type", F.left("p_name", F.lit(5))).alias("key"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '([^/]*)$', 1) <> '' AND length(regexp_extract(url, '([^/]*)$', 1)) <= 255 AND regexp_extract(lower(url), '\\.([a-z0-9]+)$', 1) IN ('html', 'htm') AS valid FROM pages")
def normalize_filename(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_extract("url", r"([^/]*)$", 1)
    ext = F.regexp_extract(F.lower("url"), r"\.([a-z0-9]+)$", 1)
    return t(spark, d, "pages").select("page_id", name.alias("name"), ((name != "") & (F.length(name) <= 255) & ext.isin("html", "htm")).alias("valid"))


@query("SELECT event_id, CASE upper(trim(event_type)) WHEN 'VIEW' THEN 'VIEW' WHEN 'CLICK' THEN 'CLICK' ELSE 'GENERAL' END AS mode FROM events")
def mode_parse(spark: SparkSession, d: str) -> DataFrame:
    m = F.upper(F.trim("event_type"))
    return t(spark, d, "events").select("event_id", F.when(m.isin("VIEW", "CLICK"), m).otherwise("GENERAL").alias("mode"))


@query("SELECT page_id, regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'gis') AS rest FROM pages")
def strip_think(spark: SparkSession, d: str) -> DataFrame:
    """Hidden sections of marked-up text are cut out."""
    return t(spark, d, "pages").select("page_id", F.regexp_replace("html", r"(?is)<(script|style)>.*?</(script|style)>", "").alias("rest"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN (n_chars // 1024) || ' KB' ELSE (n_chars // 1048576) || ' MB' END AS size, CASE WHEN n_chars // 10 >= 3600 THEN (n_chars // 36000) || 'h' ELSE (n_chars // 600) || 'm' || (n_chars // 10 % 60) || 's' END AS duration FROM documents")
def format_bytes_duration(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("n_chars"), F.floor(F.col("n_chars") / 10)
    size = F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1048576, F.concat(F.floor(n / 1024), F.lit(" KB"))).otherwise(F.concat(F.floor(n / 1048576), F.lit(" MB")))
    return t(spark, d, "documents").select("doc_id", size.alias("size"), F.when(s >= 3600, F.concat(F.floor(s / 3600), F.lit("h"))).otherwise(F.concat(F.floor(s / 60), F.lit("m"), s % 60, F.lit("s"))).alias("duration"))


@query("SELECT doc_id, n_chars > 0 AND n_chars <= 2147483648 AND ceil(n_chars / 1000) = 1 + (n_chars - 1) // 1000 AS valid, ceil(n_chars / 1000)::BIGINT AS chunks FROM documents")
def upload_validate(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    chunks = F.ceil(n / 1000)
    return t(spark, d, "documents").select("doc_id", ((n > 0) & (n <= 2147483648) & (chunks == 1 + F.floor((n - 1) / 1000))).alias("valid"), chunks.alias("chunks"))


@query("SELECT DISTINCT p_name AS name, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 10)::BIGINT AS colour FROM part")
def color_hash(spark: SparkSession, d: str) -> DataFrame:
    h = F.aggregate(X.characters(F.col("p_name")), F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)) % 4294967296)
    return t(spark, d, "part").select(F.col("p_name").alias("name"), (h % 10).alias("colour")).distinct()


@query("[segment] SELECT media_id, segment_index, transcript FROM segment ORDER BY media_id, segment_index")
def scan_media_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment(spark, d).select("media_id", "segment_index", "transcript").orderBy("media_id", "segment_index")


@query("[entity] SELECT id, name, type, description, source_count FROM entity WHERE group_id = 'user_1'")
def scan_group_entities(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.plans.catalog import entity

    return entity(spark, d).where("group_id = 'user_1'").select("id", "name", "type", "description", "source_count")


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def scan_entities_after(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").where(F.col("ts").isNotNull() & (F.col("ts") > F.timestamp_seconds(F.lit(1705276800)))).select("event_id", "ts")


@query("SELECT min(p_partkey) AS p_partkey FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def lookup_entity_by_name(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    first = part.agg(F.min("p_name").alias("p_name"))
    return part.join(F.broadcast(first), "p_name").orderBy("p_partkey").limit(1).select("p_partkey")


@query("""WITH l AS (SELECT p_partkey, '("entity"<|>' || p_name || '<|>' || p_type || '<|>' || p_brand || ')##' AS x FROM part UNION ALL SELECT p_partkey, '("relationship"<|>' || p_name || '<|>' || p_brand || '<|>made by)<|>' || p_size || ')##' FROM part)
SELECT p_partkey, 'entity' AS kind, p_name AS a, p_type AS b, p_brand AS description, NULL::INT AS strength FROM part UNION ALL SELECT p_partkey, 'relationship', p_name, p_brand, 'made by)', least(p_size, 10)::INT FROM part""")
def parse_extraction_text(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    text = F.concat(F.lit('("entity"<|>'), c("p_name"), F.lit("<|>"), c("p_type"), F.lit("<|>"), c("p_brand"), F.lit(')##\n\n("relationship"<|>'), c("p_name"), F.lit("<|>"), c("p_brand"), F.lit("<|>made by)<|>"), c("p_size"), F.lit(')##\n("entity"<|>x)\n<|COMPLETE|>'))
    return P.extraction_tuples(t(spark, d, "part").select("p_partkey", text.alias("x")), "p_partkey", "x")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_llm_json(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return t(spark, d, "events").select("event_id", P.fenced_json(fenced, "k bigint").alias("j")).select("event_id", "j.k")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_outer_object(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit("Sure: "), "props", F.lit(" done"))
    return t(spark, d, "events").select("event_id", P.outer_json(noisy, "k bigint").alias("j")).select("event_id", "j.k")


@query("[event] SELECT user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start_id, event_id AS end_id FROM event WHERE event_type IN ('signup', 'purchase') QUALIFY event_type = 'purchase' AND lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'signup'")
def parse_silence_log(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a start line and the end line right after it; other ends are left out."""
    log = event(spark, d).select("user_id", "ts", "event_id", F.when(F.col("event_type") == "signup", F.concat(F.lit("silence_start: "), "event_id")).when(F.col("event_type") == "purchase", F.concat(F.lit("silence_end: "), "event_id")).alias("line")).where("line is not null")
    return P.silence_pairs(log, "user_id", ["ts", "event_id"], "line")


@query("SELECT event_id, (k * 1000 + 250)::BIGINT AS ms FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def parse_pts_time(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("frame pts_time:"), F.col("k"), F.lit(".25 fmt"))
    return event(spark, d).select("event_id", P.pts_ms(line).alias("ms"))


@query("[segment] SELECT segment_id FROM segment WHERE media_id IN (1, 2, 3)")
def filter_scope(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.operators.store import scope

    return scope(segment(spark, d), media_ids=[1, 2, 3]).select("segment_id")


@query("SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda w: starts_with(w, 'th'))) > 0 AS hit FROM conversations")
def array_any_prefix(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", F.exists(F.split("text", " "), lambda w: F.startswith(w, F.lit("th"))).alias("hit"))


@query("SELECT DISTINCT w AS word, CASE WHEN length(trim(w)) = 0 THEN false WHEN upper(w) IN ('AI', 'GPU', 'THE') THEN true WHEN length(w) < 4 THEN false WHEN regexp_matches(w, '[一-鿿]') THEN true WHEN regexp_matches(w, '(?i)[bcdfghjklmnpqrstvwxyz]{6,}') THEN false WHEN upper(w) = w AND lower(w) <> w THEN false ELSE true END AS keep FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)")
def ocr_noise_filter(spark: SparkSession, d: str) -> DataFrame:
    w = t(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return w.select("word", X.ocr_keep(F.col("word"), ["AI", "GPU", "THE"]).alias("keep"))


@query("SELECT doc_id, length(trim(regexp_replace(text, '[\\[(][^\\])]{0,8}[\\])]', '', 'g'))) >= 300 AS passes FROM documents")
def effective_text_gate(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", (F.length(F.trim(F.regexp_replace("text", r"[\[(][^\])]{0,8}[\])]", ""))) >= 300).alias("passes"))


@query("WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN NULL ELSE embedding::DOUBLE[] END AS v FROM embeddings) SELECT vec_id, round((1 + list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))) / 2, 6) AS score FROM x WHERE v IS NOT NULL AND (1 + list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))) / 2 >= 0.5")
def not_null_vector(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a vector that reach the threshold; some rows have none."""
    from cinegraph.functions.vector import cosine_unit

    e = t(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))
    rows = e.withColumn("v", F.when(F.col("vec_id") % 7 != 3, F.col("embedding"))).where("v is not null").join(q)
    return rows.select("vec_id", cosine_unit(F.col("v"), F.col("q")).alias("s")).where("s >= 0.5").select("vec_id", F.round("s", 6).alias("score"))


@query("[segment] SELECT media_id, segment_index FROM segment WHERE length(trim(transcript)) > 0")
def segment_non_empty(spark: SparkSession, d: str) -> DataFrame:
    return segment(spark, d).where(F.length(F.trim("transcript")) > 0).select("media_id", "segment_index")


@query("WITH m AS (SELECT doc_id AS media_id, CASE doc_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PROCESSING' ELSE 'FAILED' END AS status, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars * 100 END AS duration_ms, CASE WHEN doc_id % 7 <> 0 THEN 'cover_' || doc_id END AS cover, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS path FROM documents) SELECT media_id FROM m WHERE status = 'COMPLETED' AND (duration_ms IS NULL OR cover IS NULL) AND path <> ''")
def missing_visuals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    status = F.when(k % 3 == 0, "COMPLETED").when(k % 3 == 1, "PROCESSING").otherwise("FAILED")
    m = t(spark, d, "documents").select(k.alias("media_id"), status.alias("status"), F.when(k % 5 != 0, F.col("n_chars") * 100).alias("duration_ms"), F.when(k % 7 != 0, F.concat(F.lit("cover_"), k)).alias("cover"), F.when(k % 11 == 0, "").otherwise(F.col("source")).alias("path"))
    return m.where("status = 'COMPLETED' and (duration_ms is null or cover is null) and path <> ''").select("media_id")


_MESSAGES = ["HTTP 503 Service Unavailable", "Read timed out", "402 Payment Required: balance", "401 Unauthorized", "ffprobe failed", "File not found", "bad value", "corrupt stream, connection reset", "Invalid API key", "disk full"]
_KINDS = ["ValueError", "FileNotFoundError", "RuntimeError"]


def _classes() -> str:
    """The ordered rules as SQL."""
    from cinegraph.operators import ranking as K

    cases = [f"WHEN regexp_matches(m, '{'|'.join(K.TRANSIENT)}') THEN 'TRANSIENT_' || left(upper(kind), 50)"]
    cases += [f"WHEN contains(m, '{x}') THEN 'PERMANENT_AUTH_{x.upper().replace(' ', '_')}'" for x in K.AUTH]
    cases += ["WHEN kind = 'FileNotFoundError' THEN 'PERMANENT_FILENOTFOUND'"]
    cases += [f"WHEN contains(m, '{x}') THEN 'PERMANENT_{x.upper().replace(' ', '_')}'" for x in K.PERMANENT]
    return f"CASE {' '.join(cases)} ELSE left(upper(kind), 60) END"


@query(f"WITH e AS (SELECT event_id, lower(({_MESSAGES})[1 + (event_id % 10)::INT] || ' ' || event_type) AS m, ({_KINDS})[1 + (event_id // 10 % 3)::INT] AS kind FROM events), x AS (SELECT event_id, {_classes()} AS code FROM e) SELECT event_id, code, NOT starts_with(code, 'PERMANENT_') AS retryable FROM x")
def error_classify(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.operators.ranking import classify_error

    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + at).cast("int"))
    k = F.col("event_id")
    e = classify_error(F.concat_ws(" ", pick(_MESSAGES, k % 10), "event_type"), pick(_KINDS, F.floor(k / 10) % 3))
    return t(spark, d, "events").select("event_id", e.alias("e")).select("event_id", "e.code", "e.retryable")


@query("SELECT event_id, 400 + k AS status, k BETWEEN 0 AND 99 AND 400 + k NOT IN (408, 429) AS terminal FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)")
def terminal_http_status(spark: SparkSession, d: str) -> DataFrame:
    s = 400 + F.col("k")
    return event(spark, d).select("event_id", s.alias("status"), (s.between(400, 499) & ~s.isin(408, 429)).alias("terminal"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'cannot|unable|no information|sorry|nicht|no puedo') AS refusal FROM conversations")
def refusal_marker(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", F.lower("text").rlike("cannot|unable|no information|sorry|nicht|no puedo").alias("refusal"))


@query(f"[segment] SELECT segment_id, '[' || {_MMSS.format('start_ms')} || '] ' || left(transcript, 300) AS context, left(transcript, 100) AS excerpt FROM segment")
def context_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return segment(spark, d).select("segment_id", F.concat(F.lit("["), X.mmss(F.col("start_ms")), F.lit("] "), F.left("transcript", F.lit(300))).alias("context"), F.left("transcript", F.lit(100)).alias("excerpt"))

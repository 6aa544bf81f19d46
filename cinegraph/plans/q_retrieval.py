"""Vectors, ranking, segmentation and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.functions import vector as V
from cinegraph.operators import retrieval as T
from cinegraph.operators import segments as G
from cinegraph.operators import store as S
from cinegraph.plans.catalog import media, query, segment, t

c = F.col
TERMS = ["the", "and", "thing"]
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _zero(spark: SparkSession, d: str) -> F.Column:
    v = t(spark, d, "embeddings").where("vec_id = 0").first().embedding
    return F.array(*[F.lit(float(x)) for x in v])


_BM = """w AS (SELECT segment_id, regexp_extract_all(lower(transcript), '([a-z0-9]+)', 1) AS w FROM segment), n AS (SELECT count(*) AS n, avg(len(w)) AS av FROM w),
h AS (SELECT segment_id, len, term, count(*) AS tf FROM (SELECT segment_id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN ('the', 'and', 'thing') GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
bm AS (SELECT segment_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / av))) AS score FROM h JOIN f USING (term), n GROUP BY segment_id)"""


@query(f"SELECT b.vec_id, round({_COS}, 6) AS score FROM (SELECT {_Q0} AS embedding) a, embeddings b")
def cosine_raw(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select("vec_id", F.round(V.cosine_raw(c("embedding"), _zero(spark, d)), 6).alias("score"))


@query(f"SELECT b.vec_id, round((1 + {_COS}) / 2, 6) AS score FROM (SELECT {_Q0} AS embedding) a, embeddings b")
def cosine_unit(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select("vec_id", F.round(V.cosine_unit(c("embedding"), _zero(spark, d)), 6).alias("score"))


_TOP = f"SELECT b.vec_id, round((1 + {_COS}) / 2, 6) AS score FROM (SELECT {_Q0} AS embedding) a, embeddings b WHERE (1 + {_COS}) / 2 >= 0.5 ORDER BY (1 + {_COS}) / 2 DESC, b.vec_id LIMIT 10"


@query(_TOP)
def topk_vector(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings").select("vec_id", V.cosine_unit(c("embedding"), _zero(spark, d)).alias("s")).where("s >= 0.5")
    return T.top(e, 10, "s", "vec_id").select("vec_id", F.round("s", 6).alias("score"))


@query(f"SELECT b.vec_id, round((1 + {_COS}) / 2, 6) AS score FROM (SELECT {_Q0} AS embedding) a, embeddings b WHERE b.label = 3 AND (1 + {_COS}) / 2 >= 0.4")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings").where("label = 3").select("vec_id", V.cosine_unit(c("embedding"), _zero(spark, d)).alias("s"))
    return e.where("s >= 0.4").select("vec_id", F.round("s", 6).alias("score"))


@query(f"SELECT a.vec_id AS q, b.vec_id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 5")
def vector_knn_join(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    return T.knn(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).select("q", "vec_id", F.round("score", 6).alias("score"))


@query("[segment] WITH " + _BM + " SELECT segment_id, round(score, 6) AS score FROM bm")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return T.bm25(segment(spark, d), "segment_id", "transcript", TERMS).select("segment_id", F.round("score", 6).alias("score"))


@query("[segment] WITH " + _BM + ", k AS (SELECT * FROM bm ORDER BY score DESC, segment_id LIMIT 40) SELECT segment_id, round(score, 6) AS score FROM k JOIN segment USING (segment_id) WHERE group_id = 'user_1'")
def topk_fulltext(spark: SparkSession, d: str) -> DataFrame:
    """The group filter comes after the index has given its best."""
    s = segment(spark, d)
    best = T.top(T.bm25(s, "segment_id", "transcript", TERMS), 40, "score", "segment_id")
    return s.where("group_id = 'user_1'").select("segment_id").join(best, "segment_id").select("segment_id", F.round("score", 6).alias("score"))


_LISTS = f"""v AS (SELECT vec_id, row_number() OVER (ORDER BY {_COS} DESC, b.vec_id) - 1 AS rank FROM (SELECT {_Q0} AS embedding) a, embeddings b QUALIFY rank < 50), w2 AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS rank FROM embeddings QUALIFY rank < 50),
u AS (SELECT 0 AS l, * FROM v UNION ALL SELECT 1, * FROM w2), r AS (SELECT vec_id, sum(1 / (rank + 60)) AS score, min(l * 1000 + rank) AS f FROM u GROUP BY vec_id)"""


def _two_lists(spark: SparkSession, d: str) -> list[DataFrame]:
    e = t(spark, d, "embeddings")
    v = T.top(e.select("vec_id", V.cosine_raw(c("embedding"), _zero(spark, d)).alias("s")), 50, "s", "vec_id")
    return [T.ranked(v, [F.desc("s"), "vec_id"]), T.ranked(T.top(e.select("vec_id", "label"), 50, "label", "vec_id"), [F.desc("label"), "vec_id"])]


@query(f"WITH {_LISTS} SELECT vec_id, round(score, 9) AS score FROM r")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return T.rrf(_two_lists(spark, d), "vec_id").select("vec_id", F.round("score", 9).alias("score"))


_EV = "SELECT conv_id, turn, length(text) AS score, row_number() OVER (PARTITION BY conv_id // 5 ORDER BY length(text) DESC, conv_id, turn) AS r FROM conversations"


@query(f"SELECT conv_id // 5 AS chunk, conv_id, turn, score FROM ({_EV}) WHERE r <= 3")
def evidence_top_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "conversations").select(F.expr("conv_id div 5").alias("chunk"), "conv_id", "turn", F.length("text").alias("score"))
    return S.latest(s, ["chunk"], [F.desc("score"), "conv_id", "turn"], 3)


@query("SELECT conv_id, string_agg(turn || ': ' || role, '; ' ORDER BY turn) AS note FROM conversations WHERE turn < 10 GROUP BY conv_id")
def sources_note(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "conversations").where("turn < 10").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("turn", F.lit(": "), "role").alias("x")))).alias("l"))
    return s.select("conv_id", F.array_join(F.transform("l", lambda x: x["x"]), "; ").alias("note"))


_KNN = f"res AS (SELECT a.vec_id AS q, b.vec_id AS item, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) - 1 AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank < 5), tr AS (SELECT a.vec_id AS q, b.vec_id AS item FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), e AS (SELECT q, count(*) AS expected FROM tr GROUP BY q), x AS (SELECT r.q, count(*) AS n, count(t.item) AS good, min(CASE WHEN t.item IS NOT NULL THEN rank + 1 END) AS rank FROM res r LEFT JOIN tr t ON t.q = r.q AND t.item = r.item GROUP BY r.q), ev AS (SELECT q, rank IS NOT NULL AS hit, rank, coalesce(good / n, 0) AS p, coalesce(good / expected, 0) AS r FROM e LEFT JOIN x USING (q))"


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0")
    res = T.ranked(T.knn(q, e, "vec_id", "embedding", 5), [F.desc("score"), "vec_id"], ["q"]).select("q", c("vec_id").alias("item"), "rank")
    of = lambda n, label: e.select(c("vec_id").alias(n), c("label").alias(label))
    rel = res.join(of("q", "_q"), "q").join(of("item", "_i"), "item").withColumn("rel", c("_q") == c("_i"))
    size = e.groupBy("label").agg((F.count("*") - 1).alias("expected")).where("expected > 0")
    return T.evaluate(rel, q.select(c("vec_id").alias("q"), "label").join(size, "label").select("q", "expected"), 5)


@query(f"WITH {_KNN} SELECT q, hit, rank, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(1 - p, 6) AS pollution FROM ev")
def eval_question(spark: SparkSession, d: str) -> DataFrame:
    six = lambda *names: [F.round(n, 6).alias(n) for n in names]
    return _evaluated(spark, d).select("q", "hit", c("rank").cast("long").alias("rank"), *six("precision", "recall", "f1", "pollution"))


@query(f"WITH {_KNN}, s AS (SELECT q % 3 AS kind, * FROM ev) SELECT coalesce(kind, -1) AS kind, count(*) AS n, round(avg(hit::INT), 6) AS hit_rate, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM s GROUP BY GROUPING SETS ((), (kind))")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).withColumn("kind", c("q") % 3).rollup("kind").agg(F.count("*").alias("n"), F.round(F.avg(c("hit").cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / c("rank"), F.lit(0.0))), 6).alias("mrr")).withColumn("kind", F.coalesce("kind", F.lit(-1)))


@query("SELECT round(avg(m), 6) AS mean FROM (SELECT lang, avg(toxic) AS m FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)")
def claim_means(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.avg("toxic").alias("m"))
    return m.agg(F.round(F.avg("m"), 6).alias("mean"))


@query("SELECT conv_id, count(*) BETWEEN 1 AND 6 AND bool_and(length(trim(text)) > 0 AND length(text) <= 500) AS valid FROM conversations GROUP BY conv_id")
def plan_valid(spark: SparkSession, d: str) -> DataFrame:
    tasks = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("x"))
    return tasks.select("conv_id", (F.size("x").between(1, 6) & F.forall("x", lambda s: (F.length(F.trim(s)) > 0) & (F.length(s) <= 500))).alias("valid"))


@query()
def sequence_ratio(spark: SparkSession, d: str) -> DataFrame:
    from cinegraph.functions.sequence import sequence_ratio as f

    b = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    return b.select("p_brand", "p_type", F.round(f(c("a"), c("b")), 6).alias("ratio"))


@query("[media] SELECT media_id, g::INT AS segment_index, g * 60000 AS start_ms, least(g * 60000 + 60000, duration_ms) AS end_ms, greatest(0, g * 60000 - 8000) AS audio_start_ms, least(duration_ms, least(g * 60000 + 60000, duration_ms) + 8000) AS audio_end_ms FROM (SELECT media_id, duration_ms, unnest(range(0, (duration_ms - 1) // 60000 + 1)) AS g FROM media WHERE duration_ms > 0)")
def fixed_grid_plan(spark: SparkSession, d: str) -> DataFrame:
    return G.fixed_grid(media(spark, d))


_NEAR = "list_min(list_transform(list_filter(sil, lambda q: q > {0} AND q {1}), lambda q: {{'k': abs(q - {2}), 's': q}})).s"


@query(f"""[media] WITH RECURSIVE md AS (SELECT media_id, duration_ms AS d, list_transform(range(1, 13), lambda i: (media_id * 7919 + i * i * 104729) % (duration_ms + 1)) AS sil FROM media),
w AS (SELECT media_id, d, sil, 0 AS n, 0::BIGINT AS place, false AS hard FROM md UNION ALL SELECT media_id, d, sil, n + 1, coalesce(near, least(place + 60000, far)), near IS NULL FROM (SELECT *, {_NEAR.format('place + 30000', '<= far', 'place - 60000')} AS near FROM (SELECT *, least(place + 90000, d) AS far FROM w WHERE place + 30000 < d))),
z AS (SELECT *, max(n) OVER (PARTITION BY media_id) AS last FROM w), ed AS (SELECT media_id, d, sil, n, place, hard FROM z WHERE NOT (n = last AND n > 0 AND d - place < 30000) UNION ALL SELECT media_id, d, sil, n + 1, d, false FROM z WHERE n = last),
pc AS (SELECT media_id, d, sil, place AS a, hard AS x, lead(place) OVER o AS b, lead(hard) OVER o AS y FROM ed WINDOW o AS (PARTITION BY media_id ORDER BY n)), sp AS (SELECT *, a + (b - a) // 2 AS mid, {_NEAR.format('a + 30000', '< b - 30000', '(a + (b - a) // 2)')} AS near FROM pc WHERE b IS NOT NULL),
ct AS (SELECT media_id, d, a, x, b, y FROM sp WHERE b - a <= 90000 UNION ALL SELECT media_id, d, a, x, coalesce(near, greatest(a + 30000, least(mid, b - 30000))), near IS NULL FROM sp WHERE b - a > 90000 UNION ALL SELECT media_id, d, coalesce(near, greatest(a + 30000, least(mid, b - 30000))), near IS NULL, b, y FROM sp WHERE b - a > 90000)
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY a) - 1)::INT AS segment_index, a AS start_ms, b AS end_ms, x AS left_cut, y AS right_cut, CASE WHEN x THEN greatest(0, a - 8000) ELSE a END AS audio_start_ms, CASE WHEN y THEN least(d, b + 8000) ELSE b END AS audio_end_ms FROM ct""")
def plan_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each item cut at silences, which stand at places made of its id."""
    m = media(spark, d).select("media_id", "duration_ms", F.expr("transform(sequence(1L, 12L), i -> (media_id * 7919 + i * i * 104729) % (duration_ms + 1))").alias("silences"))
    return G.plan_segments(m)


@query("SELECT conv_id, turn * 60000 // 300000 * 300000 AS start_ms, turn * 60000 // 300000 * 300000 + 300000 AS end_ms, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY ALL")
def chunk_5min(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "conversations").select("conv_id", (c("turn") * 60000).alias("ts"), "text")
    return G.tumbling(rows, "conv_id", "ts", "text", 300_000)


@query("SELECT conv_id, turn * 45000 // 60000 * 60000 AS start_ms, turn * 45000 // 60000 * 60000 + 60000 AS end_ms, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY ALL")
def tumbling_60s_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "conversations").select("conv_id", (c("turn") * 45000).alias("ts"), "text")
    return G.tumbling(rows, "conv_id", "ts", "text", 60_000)


@query("SELECT conv_id, left(string_agg(text, ' ' ORDER BY turn), 500) AS summary FROM conversations GROUP BY conv_id")
def chunk_summary_fallback(spark: SparkSession, d: str) -> DataFrame:
    x = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ")
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.left(x, F.lit(500)).alias("summary"))


@query("[segment] WITH p AS (SELECT media_id, start_ms, CASE WHEN (media_id + segment_index) % 4 = 0 OR media_id % 9 = 0 THEN 'FAILED' ELSE 'DONE' END AS status, CASE WHEN segment_index % 5 = 3 THEN '  ' ELSE transcript END AS text FROM segment), x AS (SELECT media_id, bool_and(status = 'FAILED') AS lost FROM p GROUP BY media_id) SELECT media_id, start_ms, 'ok' AS outcome FROM p WHERE status <> 'FAILED' AND length(trim(text)) > 0 UNION ALL SELECT media_id, NULL, 'all failed' FROM x WHERE lost")
def asr_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Transcribed parts without the failed and blank ones; where all of an item failed, that is the outcome."""
    s = segment(spark, d)
    failed = ((c("media_id") + c("segment_index")) % 4 == 0) | (c("media_id") % 9 == 0)
    parts = s.select("media_id", "start_ms", F.when(failed, "FAILED").otherwise("DONE").alias("status"), F.when(c("segment_index") % 5 == 3, "  ").otherwise(c("transcript")).alias("text"))
    return G.asr_outcomes(parts, "media_id")


@query("[moment] SELECT segment_id, array_to_string(list_transform(ocr_texts, lambda x: 'src' || media_id || '#timestampMs=' || start_ms), ',') AS frames FROM moment")
def reuse_context(spark: SparkSession, d: str) -> DataFrame:
    """The frames of a reused context point to their source and time; a segment without frames keeps none."""
    from cinegraph.plans.catalog import moment

    frame = F.concat(F.lit("src"), "media_id", F.lit("#timestampMs="), "start_ms")
    return moment(spark, d).select("segment_id", F.array_join(F.transform("ocr_texts", lambda _: frame), ",").alias("frames"))


_WORDS = "(['AI', 'OEIAFMOOC', 'hello world', 'bcdfghj', 'screen text', 'abc'])[1 + (event_id % 6)::INT]"
_KEEP = "CASE WHEN length(trim(w)) = 0 THEN false WHEN upper(w) IN ('AI', 'GPU') THEN true WHEN length(w) < 4 THEN false WHEN regexp_matches(replace(w, ' ', ''), '(?i)[bcdfghjklmnpqrstvwxyz]{6,}') THEN false WHEN upper(w) = w AND lower(w) <> w AND NOT contains(w, ' ') THEN false ELSE true END"


@query(f"[segment] WITH f AS (SELECT event_id, user_id AS media_id, event_id * 37 % 600000 AS ts, {_WORDS} AS w FROM events WHERE event_id % 3 = 0), l AS (SELECT media_id, max_by(segment_index, end_ms) AS li, max(end_ms) AS le FROM segment GROUP BY media_id), o AS (SELECT f.*, coalesce(s.segment_index, CASE WHEN f.ts >= l.le THEN l.li END) AS si FROM f JOIN l USING (media_id) LEFT JOIN segment s ON s.media_id = f.media_id AND f.ts >= s.start_ms AND f.ts < s.end_ms), a AS (SELECT media_id, si, count(*) AS n, coalesce(string_agg(w, ' | ' ORDER BY ts, event_id) FILTER ({_KEEP}), '') AS seen FROM o WHERE si IS NOT NULL GROUP BY ALL), z AS (SELECT s.segment_id, arg_min(f.event_id, (abs(f.ts - (s.start_ms + s.end_ms) // 2), f.event_id)) AS near FROM segment s JOIN f ON f.media_id = s.media_id GROUP BY s.segment_id) SELECT s.segment_id, CASE WHEN (s.media_id + s.segment_index) % 5 = 0 THEN '' ELSE transcript END AS transcript, coalesce(a.seen, '') AS seen, coalesce(a.n, CASE WHEN z.near IS NOT NULL THEN 1 END, 0) AS frames, CASE WHEN a.n IS NULL THEN z.near END AS nearest FROM segment s LEFT JOIN a ON a.media_id = s.media_id AND a.si = s.segment_index LEFT JOIN z USING (segment_id) WHERE (s.media_id + s.segment_index) % 5 <> 0 AND length(trim(transcript)) > 0 OR coalesce(a.seen, '') <> '' OR coalesce(a.n, z.near) IS NOT NULL")
def merge_asr_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Planned segments with the speech that starts with them, the plausible screen texts of their frames, or else the nearest frame."""
    from cinegraph.functions.text import ocr_keep

    s = segment(spark, d)
    words = F.array(*[F.lit(x) for x in ("AI", "OEIAFMOOC", "hello world", "bcdfghj", "screen text", "abc")])
    frames = t(spark, d, "events").where("event_id % 3 = 0").select(c("user_id").alias("media_id"), c("event_id").alias("frame"), (c("event_id") * 37 % 600_000).alias("ts"), F.element_at(words, (1 + c("event_id") % 6).cast("int")).alias("screen"))
    speech = s.where((c("media_id") + c("segment_index")) % 5 != 0).select("media_id", "start_ms", "transcript")
    out = G.merge_channels(s.select("media_id", "segment_index", "segment_id", "start_ms", "end_ms"), speech, frames, "media_id", lambda x: ocr_keep(x, ["AI", "GPU"]))
    return out.select("segment_id", "transcript", "seen", "frames", c("_near").alias("nearest"))


@query(f"WITH p AS (SELECT vec_id, list_transform(range(72), lambda i: least(255, greatest(0, floor((embedding[1 + (i % 64)::INT] + 1) * 100)))::INT) AS px FROM embeddings), b AS (SELECT vec_id, list_transform(range(64), lambda i: px[1 + i + i // 8] > px[2 + i + i // 8]) AS bits FROM p) SELECT vec_id, CASE WHEN vec_id % 9 = 4 THEN NULL ELSE (list_sum(list_transform(range(1, 64), lambda i: CASE WHEN bits[i + 1] THEN (1::HUGEINT << (63 - i)::INT) ELSE 0::HUGEINT END)) - CASE WHEN bits[1] THEN (1::HUGEINT << 63) ELSE 0::HUGEINT END)::BIGINT::VARCHAR END AS dhash FROM b")
def dhash(spark: SparkSession, d: str) -> DataFrame:
    """Difference hashes of pictures (PGM files made of vectors, twice as large as the hash; some can't be read)."""
    from cinegraph.operators.images import hashes

    # in single precision, as the vectors are: whole numbers would make it double, which rounds some points down
    px = F.expr("transform(sequence(0, 71), i -> least(255, greatest(0, floor((embedding[i % 64] + float(1)) * float(100)))))")
    hex2 = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    e = t(spark, d, "embeddings").select("vec_id", px.alias("px"))
    row = lambda r: F.array_join(F.transform(F.slice("px", r * 9 + 1, 9), lambda x: F.concat(hex2(x), hex2(x))), "")
    body = F.concat(*[x for r in range(8) for x in (row(r), row(r))])
    head = F.hex(F.encode(F.when(F.col("vec_id") % 9 == 4, "P9 18 16 255\n").otherwise("P5 # made\n18 16\n255\n"), "UTF-8"))
    return hashes(e.select("vec_id", F.unhex(F.concat(head, body)).alias("content")), "vec_id", "content").withColumn("dhash", c("dhash").cast("string"))

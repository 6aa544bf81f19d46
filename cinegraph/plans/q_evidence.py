"""Evidence, claims and the structure of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.functions import text as X
from cinegraph.operators import evidence as E
from cinegraph.plans.catalog import big, evidence, moment, query, segment, t

c = F.col

_BARE = "regexp_replace(lower(coalesce({0}, '')), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g')"
_CHANNEL = "CASE WHEN contains(upper(e.source), 'ASR') AND contains(upper(e.source), 'OCR') THEN m.transcript || ' ' || array_to_string(m.ocr_texts, ' ') WHEN contains(upper(e.source), 'ASR') THEN m.transcript WHEN contains(upper(e.source), 'OCR') THEN array_to_string(m.ocr_texts, ' ') END"
_JUDGED = f"j AS (SELECT e.*, EXISTS (SELECT 1 FROM moment m WHERE m.media_id = e.media_id AND e.ts >= m.start_ms AND e.ts < m.end_ms AND {_BARE.format('e.content')} <> '' AND contains({_BARE.format(_CHANNEL)}, {_BARE.format('e.content')})) AS supported FROM evidence e)"
_CLAIMS = f"c AS (SELECT media_id, segment_index, translate(left(transcript, 40), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!' AS claim FROM segment), k AS (SELECT c.*, EXISTS (SELECT 1 FROM j WHERE j.supported AND j.media_id = c.media_id AND {_BARE.format('c.claim')} <> '' AND {_BARE.format('j.claim')} = {_BARE.format('c.claim')}) AS supported FROM c)"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return segment(spark, d).select("media_id", "segment_index", F.concat(big(F.left("transcript", F.lit(40))), F.lit("!")).alias("claim"))


@query(f"[moment evidence] WITH {_JUDGED} SELECT evidence_id, supported FROM j")
def evidence_supported(spark: SparkSession, d: str) -> DataFrame:
    return E.supported(evidence(spark, d), moment(spark, d)).select("evidence_id", "supported")


@query(f"[moment evidence] WITH {_JUDGED}, {_CLAIMS} SELECT media_id, segment_index, supported FROM k")
def claim_supported(spark: SparkSession, d: str) -> DataFrame:
    return E.supports_claims(_claims(spark, d), E.supported(evidence(spark, d), moment(spark, d))).select("media_id", "segment_index", "supported")


@query(f"[moment evidence] WITH {_JUDGED}, {_CLAIMS}, a AS (SELECT media_id, count(*) FILTER (NOT supported) AS invalid, coalesce(string_agg(DISTINCT ts::VARCHAR, ',' ORDER BY ts) FILTER (NOT supported), '') AS required FROM j GROUP BY media_id), b AS (SELECT media_id, count(DISTINCT claim) FILTER (NOT supported) AS unsupported FROM k GROUP BY media_id) SELECT media_id, invalid, unsupported, required, invalid = 0 AND unsupported = 0 AS passed FROM a JOIN b USING (media_id)".replace("string_agg(DISTINCT ts::VARCHAR, ',' ORDER BY ts) FILTER (NOT supported)", "array_to_string(list_sort(list(DISTINCT ts) FILTER (NOT supported)), ',')"))
def evidence_bounds(spark: SparkSession, d: str) -> DataFrame:
    """A critique fails where evidence can't be found in its channel or a conclusion has none."""
    return E.critique(_claims(spark, d), E.supported(evidence(spark, d), moment(spark, d)))


_MODE = "(['GENERAL', 'LEARNING', 'REVIEW', 'CREATION'])[1 + (conv_id % 4)::INT]"
_KEYS = "(['outline', 'fallacies', 'highlights', 'keypoints', 'omissions', 'titles', 'quiz', 'script', 'pitfalls'])[1 + ((conv_id + turn) % 9)::INT]"


@query(f"WITH s AS (SELECT conv_id, {_MODE} AS mode, list(DISTINCT {_KEYS}) FILTER (role <> 'system' AND length(trim(text)) > 0) AS have, count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY conv_id), r AS (SELECT *, list_filter(CASE mode WHEN 'LEARNING' THEN ['outline', 'keypoints', 'quiz', 'pitfalls'] WHEN 'REVIEW' THEN ['fallacies', 'exaggerations', 'omissions', 'doubtful'] WHEN 'CREATION' THEN ['highlights', 'titles', 'intro', 'script'] ELSE []::VARCHAR[] END, lambda k: NOT list_contains(coalesce(have, []), k)) AS miss FROM s) SELECT conv_id, array_to_string(miss, ', ') AS missing, len(miss) = 0 AND n > 0 AS passed FROM r")
def structure_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Sections that the mode asks for must be there and not blank, and there must be conclusions."""
    mode = F.element_at(F.array(*[F.lit(x) for x in ("GENERAL", "LEARNING", "REVIEW", "CREATION")]), (1 + c("conv_id") % 4).cast("int"))
    keys = [F.lit(x) for x in ("outline", "fallacies", "highlights", "keypoints", "omissions", "titles", "quiz", "script", "pitfalls")]
    key = F.element_at(F.array(*keys), (1 + (c("conv_id") + c("turn")) % 9).cast("int"))
    full = (c("role") != "system") & (F.length(F.trim("text")) > 0)
    s = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(full, key)).alias("have"), F.count_if(c("role") == "assistant").alias("n"))
    s = s.select("conv_id", "n", E.missing_sections(mode, c("have")).alias("miss"))
    return s.select("conv_id", F.array_join("miss", ", ").alias("missing"), ((F.size("miss") == 0) & (c("n") > 0)).alias("passed"))


@query(r"""WITH q AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id), w AS (SELECT conv_id, unnest(regexp_split_to_array(lower(q), '[\s,.;:!?|]+')) AS w, generate_subscripts(regexp_split_to_array(lower(q), '[\s,.;:!?|]+'), 1) AS i FROM q), f AS (SELECT conv_id, w, min(i) AS i FROM w WHERE length(w) >= 2 GROUP BY conv_id, w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min(i)) <= 8),
a AS (SELECT conv_id, string_agg(lower(text), chr(10) ORDER BY turn) AS answer, count(*) AS n, count(*) FILTER (length(trim(text)) > 20) AS good FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
k AS (SELECT f.conv_id, avg(contains(coalesce(a.answer, ''), f.w)::INT) AS coverage FROM f LEFT JOIN a USING (conv_id) GROUP BY f.conv_id)
SELECT conv_id, round(coverage, 6) AS coverage, coalesce(n, 0) > 0 AND good / n >= 0.8 AND coverage >= 0.8 AS passed FROM k LEFT JOIN a USING (conv_id)""")
def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of the question's words in the answers; it passes with a structured answer, sound claims and words of 0.8."""
    s = t(spark, d, "conversations")
    terms = s.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q")).select("conv_id", X.fallback_terms(c("q")).alias("terms"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.lower("text").alias("x")))), lambda x: x["x"]), "\n")
    a = s.where("role = 'assistant'").groupBy("conv_id").agg(text.alias("answer"), F.count("*").alias("n"), F.count_if(F.length(F.trim("text")) > 20).alias("good"))
    k = terms.join(a, "conv_id", "left").withColumn("coverage", X.term_score(c("terms"), F.coalesce("answer", F.lit(""))))
    passed = F.coalesce((c("n") > 0) & (c("good") / c("n") >= 0.8) & (c("coverage") >= 0.8), F.lit(False))
    return k.select("conv_id", F.round("coverage", 6).alias("coverage"), passed.alias("passed"))


@query("WITH m AS (SELECT lang, doc_id % 2 AS run, avg(quality) AS quality, avg(toxic) AS pollution FROM documents JOIN labels USING (doc_id) GROUP BY ALL), u AS (SELECT lang, run, 'quality' AS metric, quality AS v FROM m UNION ALL SELECT lang, run, 'pollution', pollution FROM m) SELECT n.lang, n.metric, round(CASE WHEN n.metric = 'pollution' THEN b.v - n.v ELSE n.v - b.v END, 6) AS gain FROM u n JOIN u b ON b.lang = n.lang AND b.metric = n.metric AND b.run = 0 WHERE n.run = 1")
def baseline_diff(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a run against those of an earlier one; less pollution is a gain."""
    m = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id").groupBy("lang", (c("doc_id") % 2).alias("run")).agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("pollution"))
    u = m.unpivot(["lang", "run"], ["quality", "pollution"], "metric", "v")
    now, base = u.where("run = 1").select("lang", "metric", "v"), u.where("run = 0").select("lang", "metric", c("v").alias("b"))
    gain = F.when(c("metric") == "pollution", c("b") - c("v")).otherwise(c("v") - c("b"))
    return now.join(base, ["lang", "metric"]).select("lang", "metric", F.round(gain, 6).alias("gain"))


_MARKERS = ["没有相关信息", "cannot", "sorry", "nicht", "no puedo", "ne sais"]


@query("WITH q AS (SELECT conv_id, conv_id % 5 = 0 AS oos, arg_max(text, turn) FILTER (role = 'assistant') AS answer, count(*) FILTER (role = 'system') AS calls, sum(length(text)) * 10 AS ms FROM conversations GROUP BY conv_id) SELECT round(coalesce(avg(regexp_matches(lower(answer), '" + "|".join(_MARKERS) + "')::INT) FILTER (oos), 0), 6) AS refusal_rate, round(avg(calls), 6) AS mean_calls, round(avg(ms), 6) AS mean_ms FROM q WHERE answer IS NOT NULL")
def behaviour_summary(spark: SparkSession, d: str) -> DataFrame:
    """Refusals among questions that are out of scope, calls of tools and time for a question."""
    answer = F.max_by(F.when(c("role") == "assistant", c("text")), F.when(c("role") == "assistant", c("turn")))
    q = t(spark, d, "conversations").groupBy("conv_id").agg(answer.alias("answer"), F.count_if(c("role") == "system").alias("calls"), (F.sum(F.length("text")) * 10).alias("ms")).where("answer is not null")
    refused = F.lower("answer").rlike("|".join(_MARKERS)).cast("int")
    return q.agg(F.round(F.coalesce(F.avg(F.when(c("conv_id") % 5 == 0, refused)), F.lit(0.0)), 6).alias("refusal_rate"), F.round(F.avg("calls"), 6).alias("mean_calls"), F.round(F.avg("ms"), 6).alias("mean_ms"))

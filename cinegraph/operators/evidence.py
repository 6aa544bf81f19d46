"""Evidence of claims: whether the source text at a time holds what is quoted, and what a critique must ask for again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegraph.operators.intervals import points_in_intervals

#: The sections that each mode of analysis must fill.
SECTIONS = {
    "LEARNING": ["outline", "keypoints", "quiz", "pitfalls"],
    "REVIEW": ["fallacies", "exaggerations", "omissions", "doubtful"],
    "CREATION": ["highlights", "titles", "intro", "script"],
}


def bare(x: Column) -> Column:
    """Lower case without punctuation, symbols and white space."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\p{P}\p{S}\s]+", "")


def channel(source: Column, transcript: Column, ocr: Column) -> Column:
    """The text that a source label points to; null for a label that names neither channel."""
    s, screen = F.upper(source), F.array_join(ocr, " ")
    asr, seen = F.contains(s, F.lit("ASR")), F.contains(s, F.lit("OCR"))
    return F.when(asr & seen, F.concat_ws(" ", transcript, screen)).when(asr, transcript).when(seen, screen)


def supported(evidence: DataFrame, segments: DataFrame, key: str = "media_id") -> DataFrame:
    """evidence (evidence_id, key, ts, source, content, ...) with supported: a segment that holds ts has the content in the named channel."""
    held = points_in_intervals(evidence.select("evidence_id", key, "ts", "source", "content"), segments.select(key, "start_ms", "end_ms", "transcript", "ocr_texts"), key)
    text, quote = bare(channel(F.col("source"), F.col("transcript"), F.col("ocr_texts"))), bare(F.col("content"))
    good = held.where((quote != "") & F.contains(text, quote)).select("evidence_id").distinct().withColumn("supported", F.lit(True))
    return evidence.join(good, "evidence_id", "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def supports_claims(claims: DataFrame, judged: DataFrame, key: str = "media_id") -> DataFrame:
    """claims with supported: some supported evidence of the same item makes the same claim, compared bare.

    Evidence is reduced to one row for each claim before the join, so equal claims never multiply.
    """
    known = judged.where("supported").select(key, bare(F.col("claim")).alias("_c")).where("_c <> ''").distinct().withColumn("supported", F.lit(True))
    return claims.withColumn("_c", bare(F.col("claim"))).join(known, [key, "_c"], "left").drop("_c").withColumn("supported", F.coalesce("supported", F.lit(False)))


def critique(claims: DataFrame, judged: DataFrame, key: str = "media_id") -> DataFrame:
    """For each item: invalid evidence, unsupported claims, the times to look at again, and whether it passes."""
    bad = judged.groupBy(key).agg(F.count_if(~F.col("supported")).alias("invalid"), F.array_join(F.transform(F.array_sort(F.collect_set(F.when(~F.col("supported"), F.col("ts")))), lambda x: x.cast("string")), ",").alias("required"))
    lost = supports_claims(claims, judged, key).groupBy(key).agg(F.countDistinct(F.when(~F.col("supported"), F.col("claim"))).alias("unsupported"))
    both = bad.join(lost, key, "full_outer")
    zero = F.lit(0).cast("long")
    invalid, unsupported = F.coalesce("invalid", zero), F.coalesce("unsupported", zero)
    return both.select(key, invalid.alias("invalid"), unsupported.alias("unsupported"), F.coalesce("required", F.lit("")).alias("required"), ((invalid == 0) & (unsupported == 0)).alias("passed"))


def missing_sections(mode: Column, present: Column) -> Column:
    """Sections that the mode asks for and that are not among those present, in the mode's order."""
    need = F.array().cast("array<string>")
    for name, keys in SECTIONS.items():
        need = F.when(mode == name, F.array(*[F.lit(k) for k in keys])).otherwise(need)
    return F.filter(need, lambda k: ~F.array_contains(present, k))

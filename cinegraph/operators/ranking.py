"""Scores and labels of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_score(semantic: Column, keywords: Column, visual: Column) -> Column:
    return 0.6 * semantic + 0.25 * keywords + 0.15 * visual


def segment_score(chunk: Column, transcript: Column, visual: Column) -> Column:
    return 0.55 * chunk + 0.25 * transcript + 0.2 * visual


def source_label(speech: Column, screen: Column) -> Column:
    return F.when(speech & screen, "ASR+OCR").when(screen, "OCR").when(speech, "ASR").otherwise("none")


#: Markers of errors in the order in which they decide.
TRANSIENT = ["429", "502", "503", "504", "timeout", "timed out", "transient", "限流", "重试", "connection", "temporarily"]
AUTH = ["402", "payment required", "insufficient", "balance", "401", "unauthorized", "invalid api key", "incorrect api key", "403", "forbidden", "authentication"]
PERMANENT = ["no such", "not found", "不存在", "ffprobe", "无法解析为有效视频", "视频内容校验失败", "corrupt"]


def classify_error(message: Column, kind: Column) -> Column:
    """struct(code, retryable) of an error's text and type: passing troubles first, then denied access, a missing file, lasting faults."""
    text = F.lower(F.coalesce(message, F.lit("")))
    kind = F.upper(kind)
    code, again = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for prefix, markers in (("PERMANENT_", PERMANENT), ("PERMANENT_AUTH_", AUTH)):
        for m in reversed(markers):
            code = F.when(F.contains(text, F.lit(m)), F.lit(prefix + m.upper().replace(" ", "_"))).otherwise(code)
        if prefix == "PERMANENT_":
            code = F.when(kind == "FILENOTFOUNDERROR", F.lit("PERMANENT_FILENOTFOUND")).otherwise(code)
    passing = F.exists(F.array(*[F.lit(m) for m in TRANSIENT]), lambda m: F.contains(text, m))
    again = passing | code.isNull()
    return F.struct(F.when(passing, F.concat(F.lit("TRANSIENT_"), F.left(kind, F.lit(50)))).otherwise(F.coalesce(code, F.left(kind, F.lit(60)))).alias("code"), again.alias("retryable"))

"""Parsers of model output, tool logs and citations, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extraction_tuples(df: DataFrame, key: str, text: str) -> DataFrame:
    """Entities and relations of tuple lines ("kind"<|>a<|>b<|>description[<|>strength]); too short lines go."""
    line = F.explode(F.split(text, "\n")).alias("line")
    rows = df.select(key, line).select(key, F.regexp_replace(F.trim("line"), r"##$", "").alias("line"))
    rows = rows.where((F.col("line") != "") & (F.col("line") != "##") & ~F.contains("line", F.lit("COMPLETE")))
    p = F.split(F.regexp_replace("line", r"^\(", ""), r"<\|>")
    rows = rows.select(key, p.alias("p"), F.regexp_replace(F.element_at(p, 1), '"', "").alias("kind"))
    digits = F.regexp_extract(F.get("p", F.lit(4)), r"(\d+)", 1)
    strength = F.when(F.col("kind") == "relationship", F.least(digits.try_cast("int"), F.lit(10)))
    rows = rows.where(((F.col("kind") == "entity") & (F.size("p") >= 4)) | ((F.col("kind") == "relationship") & (F.size("p") >= 5) & (digits != "")))
    description = F.when(F.col("kind") == "entity", F.regexp_replace(F.get("p", F.lit(3)), r"\)+$", "")).otherwise(F.get("p", F.lit(3)))
    return rows.select(key, "kind", F.get("p", F.lit(1)).alias("a"), F.get("p", F.lit(2)).alias("b"), description.alias("description"), strength.alias("strength"))


def fenced_json(x: Column, schema: str) -> Column:
    """The value inside a code fence, or the whole; malformed text gives nulls."""
    return F.from_json(F.regexp_replace(F.regexp_replace(F.trim(x), r"^```\w*\s*", ""), r"\s*```$", ""), schema)


def outer_json(x: Column, schema: str) -> Column:
    """From the first opening brace to the last closing one."""
    return F.from_json(F.regexp_extract(x, r"(?s)(\{.*\})", 1), schema)


def silence_pairs(log: DataFrame, key: str, order: list[str], line: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    start = F.regexp_extract(line, r"silence_start: (\d+)", 1)
    end = F.regexp_extract(line, r"silence_end: (\d+)", 1)
    rows = log.select(key, *order, start.alias("s"), end.alias("e")).withColumn("before", F.lag("s").over(w))
    return rows.where((F.col("e") != "") & (F.col("before") != "")).select(key, F.col("before").cast("long").alias("start_id"), F.col("e").cast("long").alias("end_id"))


def pts_ms(x: Column) -> Column:
    return F.floor(F.regexp_extract(x, r"pts_time:([0-9.]+)", 1).cast("double") * 1000).cast("long")


def citation_anchor(x: Column) -> Column:
    part = lambda k: F.regexp_extract(x, r"〔媒体(\d+) (\d+):(\d{2})(?:-\d+:\d{2})?〕", k).cast("long")
    return F.struct(part(1).alias("media_id"), (part(2) * 60 + part(3)).alias("start_s"))

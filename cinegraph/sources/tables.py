"""Tables written and read back: partition overwrite, JSON reports, name-based ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.plans.shared import shared_dir


def replace_partitions(rows: DataFrame, column: str, path: str | None = None) -> str:
    """Overwrites just the partitions that the rows belong to."""
    path = path or f"{shared_dir(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    return path


def write_report(summary: DataFrame, details: DataFrame) -> str:
    """Writes a report's summary and details as JSON in folders of one name, which is returned."""
    path = f"{shared_dir(summary.sparkSession)}/report-{uuid.uuid4().hex}"
    summary.write.json(f"{path}/summary")
    details.write.json(f"{path}/details")
    return path


def read_report(spark: SparkSession, path: str, part: str, schema: T.StructType) -> DataFrame:
    """A part of a report; malformed lines give nulls."""
    return spark.read.schema(schema).json(f"{path}/{part}")


def name_uuid(name: Column) -> Column:
    """Version-3 layout over the MD5 of the name."""
    h = F.md5(name)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))

"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session on one machine may do without: there a folder of its own serves."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="cinegraph-"))
    return _OWN_DIR[0]


#: Rows of a file of a small scratch table.
ROWS_IN_FILE = 100_000


def scratch(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    rows: a bound of its rows, where one is known. A small table that comes out of a shuffle is then written by as
    few tasks as its rows ask for, not by one for each shuffle partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        files = -(-rows // ROWS_IN_FILE) or 1
        if files < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(files)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*frames: DataFrame) -> None:
    """Deletes scratch tables that no later step reads."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

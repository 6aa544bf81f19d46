"""Upserts, deletes and scoped reads of graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scope(df: DataFrame, media_id: int | None = None, media_ids: list[int] | None = None, group_id: str | None = None) -> DataFrame:
    """Only the filters that are given."""
    if group_id is not None:
        df = df.where(F.col("group_id") == group_id)
    if media_id is not None:
        df = df.where(F.col("media_id") == media_id)
    if media_ids is not None:
        df = df.where(F.col("media_id").isin(media_ids))
    return df


def upsert(old: DataFrame, new: DataFrame, keys: list[str], first_write_wins: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both; new values win, but for the columns whose first value stays."""
    rest = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(new.select(*keys, *rest, F.lit(True).alias("_new")).alias("n"), keys, "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in first_write_wins else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*keys, *(pick(c).alias(c) for c in rest))


def latest(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def delete_media(relations: DataFrame, mentions: DataFrame, members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relations, entities and communities that are left without the media in `gone`, with their counts.

    relations: group_id, src, dst, sources (segment ids); mentions: group_id, name, media_id, segment_index (distinct);
    members: group_id, name, community. Source lists are taken apart, so they meet the deleted media in an equi-join.
    """
    own = relations.select("group_id", "src", "dst", F.explode("sources").alias("_sid"))
    own = own.withColumn("media_id", F.regexp_extract("_sid", r"^media_(\d+)_segment_", 1).cast("long")).join(gone, "media_id", "left_anti")
    rel = own.groupBy("group_id", "src", "dst").agg(F.count("*").alias("source_count"))
    ent = mentions.join(gone, "media_id", "left_anti").groupBy("group_id", "name").agg(F.count("*").alias("source_count"))
    com = members.join(ent, ["group_id", "name"], "left_semi").groupBy("group_id", "community").agg(F.count("*").alias("entity_count"))
    return rel, ent, com

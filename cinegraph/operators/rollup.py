"""Roll-ups of mentions, relations and transcripts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_groups(mentions: DataFrame) -> DataFrame:
    """For each group and name: commonest type (the least on ties), descriptions, number of media and mentions.

    Media are counted over distinct rows, not gathered: an entity may be in very many.
    """
    by_type = mentions.groupBy("group_id", "name", "type").agg(F.count("*").alias("k"), F.collect_set("description").alias("d"))
    # one shuffle more, over rows that are counted already
    out = by_type.groupBy("group_id", "name").agg(F.min_by("type", F.struct(-F.col("k"), "type")).alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("d")))).alias("d"), F.sum("k").alias("mention_count"))
    media = mentions.select("group_id", "name", "media_id").distinct().groupBy("group_id", "name").agg(F.count("*").alias("media"))
    return out.join(media, ["group_id", "name"]).select("group_id", "name", "type", F.array_join("d", "|").alias("descriptions"), "media", "mention_count")


def relation_clusters(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Greedy clusters of each (src, dst): a description joins the first cluster whose first member has that sequence ratio to it."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in part.sort_values("pos").itertuples():
            for k in out:
                if difflib.SequenceMatcher(None, k[2].lower(), r.description.lower()).ratio() >= threshold:
                    k[3] = max(k[3], r.strength)
                    k[4] += 1
                    break
            else:
                out.append([r.src, r.dst, r.description, r.strength, 1])
        return pd.DataFrame(out, columns=["src", "dst", "description", "strength", "n"])

    return rows.groupBy("src", "dst").applyInPandas(fold, "src string, dst string, description string, strength int, n long")


def singleton_ratio(communities: DataFrame, members: DataFrame, key: str) -> DataFrame:
    n = members.groupBy(key).agg(F.count("*").alias("n"))
    return communities.join(n, key, "left").agg(F.round(F.avg((F.coalesce("n", F.lit(0)) <= 1).cast("int")), 6).alias("ratio"))


def ratio(part: Column, whole: Column) -> Column:
    """Share of counts; 0 if there is nothing."""
    return F.when(F.count_if(whole) == 0, F.lit(0.0)).otherwise(F.count_if(part) / F.count_if(whole))


def _ordered(line: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", line.alias("x")))), lambda s: s["x"]), sep)


def _stamp() -> Column:
    from cinegraph.functions.text import mmss

    return F.concat(F.lit("["), mmss(F.col("start_ms")), F.lit("] "))


def transcript(segments: DataFrame) -> DataFrame:
    return segments.groupBy("media_id").agg(_ordered(F.concat(_stamp(), "transcript"), "\n\n").alias("script"))


def markdown(segments: DataFrame) -> DataFrame:
    out = segments.groupBy("media_id").agg(F.min_by("transcript", "segment_index").alias("title"), _ordered(F.concat(F.lit("- "), _stamp(), "role", F.lit("："), "transcript"), "\n").alias("lines"))
    return out.select("media_id", F.concat(F.lit("# "), "title", F.lit("\n"), "lines").alias("markdown"))

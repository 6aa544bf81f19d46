"""Interval, nearest and overlap joins within a media item.

Points and intervals of an item meet in time bins, so a join is an equi-join on (item, bin) with an exact
predicate after it, never all points against all intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN_MS = 60_000


def _bins(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each bin that [start, end) touches."""
    last = F.greatest(F.floor((F.col(end) - 1) / BIN_MS), F.floor(F.col(start) / BIN_MS))
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN_MS), last)))


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Each point (ts) with the intervals [start_ms, end_ms) of its key that hold it."""
    p = points.withColumn("_bin", F.floor(F.col("ts") / BIN_MS))
    return p.join(_bins(intervals, "start_ms", "end_ms"), [key, "_bin"]).where("ts >= start_ms and ts < end_ms").drop("_bin")


def owner(points: DataFrame, intervals: DataFrame, key: str, point: str) -> DataFrame:
    """The interval that holds each point; points after the last end belong to the last interval."""
    last = intervals.groupBy(key).agg(F.max_by("segment_index", "end_ms").alias("_last"), F.max("end_ms").alias("_end"))
    held = points_in_intervals(points, intervals, key).select(point, "segment_index")
    all_ = points.join(last, key).join(held, point, "left")
    return all_.select(point, key, "ts", F.coalesce("segment_index", F.when(F.col("ts") >= F.col("_end"), F.col("_last"))).alias("segment_index"))


def nearest(rows: DataFrame, points: DataFrame, key: str, row: str, point: str) -> DataFrame:
    """For each row (at), the point of its key with the least distance, the smaller id on ties.

    Only the last point before and the first after can be it. Within a time bin two ordered windows find them; across
    bins, windows over one row a bin, so that a key with very many rows is dealt over its bins.
    """
    kind = dict(rows.dtypes)[row]
    r = rows.select(key, F.col("at").cast("long").alias("t"), F.col(row).alias("_r"), F.lit(None).cast("long").alias("_p"))
    both = r.unionByName(points.select(key, F.col("ts").cast("long").alias("t"), F.lit(None).cast(kind).alias("_r"), F.col(point).cast("long").alias("_p"))).withColumn("_bin", F.floor(F.col("t") / BIN_MS))
    here = F.when(F.col("_p").isNotNull(), F.struct("t", "_p"))
    back = Window.partitionBy(key, "_bin").orderBy(F.col("t"), F.col("_p").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key, "_bin").orderBy(F.col("t"), F.col("_p").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    own = both.withColumn("_b", F.last(here, ignorenulls=True).over(back)).withColumn("_a", F.first(here, ignorenulls=True).over(ahead)).where("_r is not null")
    some = F.col("_p").isNotNull()
    bins = both.groupBy(key, "_bin").agg(F.min(F.when(some, F.struct("t", "_p"))).alias("_first"), F.max(F.when(some, F.struct(F.col("t"), (-F.col("_p")).alias("m")))).alias("_last"))
    w = Window.partitionBy(key).orderBy("_bin")
    before = F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(key, "_bin", before.alias("_l"), F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_n"))
    bins = bins.select(key, "_bin", F.when(F.col("_l").isNotNull(), F.struct(F.col("_l.t").alias("t"), (-F.col("_l.m")).alias("_p"))).alias("_l"), "_n")
    out = own.join(bins, [key, "_bin"])
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("t")).alias("far"), F.col(f"{c}._p").alias("p")))
    return out.withColumn("_best", F.array_min(F.array_compact(F.array(*[far(c) for c in ("_b", "_a", "_l", "_n")])))).where("_best is not null").select(F.col("_r").alias(row), F.col("_best.p").alias(point))


def best_overlap(old: DataFrame, new: DataFrame, key: str, row: str) -> DataFrame:
    """For each old cell [s, e), the new segment that covers most of it, the earlier on ties, and the share."""
    a = _bins(old, "s", "e")
    b = _bins(new.select(key, "segment_index", "start_ms", "end_ms"), "start_ms", "end_ms")
    v = F.greatest(F.lit(0), F.least("e", "end_ms") - F.greatest("s", "start_ms"))
    pairs = a.join(b, [key, "_bin"]).where("start_ms < e and end_ms > s").select(key, row, "segment_index", v.alias("v"), (F.col("e") - F.col("s")).alias("size"))
    return pairs.groupBy(key, row).agg(F.max_by("segment_index", F.struct("v", -F.col("segment_index"))).alias("new_index"), F.round(F.max(F.col("v") / F.col("size")), 6).alias("ratio"))


def cite(points: DataFrame, segments: DataFrame, key: str, point: str) -> DataFrame:
    """The segment that holds the time (both ends) with the nearest start, or else that with the nearest start; the earlier on ties."""
    s = segments.select(key, "segment_index", "start_ms", (F.col("end_ms") + 1).alias("end_ms"))  # both ends belong
    held = points_in_intervals(points.select(point, key, "ts"), s, key)
    held = held.groupBy(point).agg(F.min_by("segment_index", F.struct(F.col("ts") - F.col("start_ms"), "segment_index")).alias("segment_index")).withColumn("inside", F.lit(True))
    rest = points.select(point, key, "ts").join(held.select(point), point, "left_anti").select(F.col(point).cast("string").alias("_p"), key, F.col("ts").alias("at"))
    near = nearest(rest, segments.select(key, "segment_index", F.col("start_ms").alias("ts")), key, "_p", "segment_index")
    kind, index = dict(points.dtypes)[point], dict(segments.dtypes)["segment_index"]
    near = near.select(F.col("_p").cast(kind).alias(point), F.col("segment_index").cast(index).alias("segment_index"), F.lit(False).alias("inside"))
    return held.unionByName(near)

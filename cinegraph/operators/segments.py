"""Segmentation plans and chunks over media time in milliseconds."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, TARGET, MOST, PAD = 30_000, 60_000, 90_000, 8_000


def plan(duration: int, silences: list[int]) -> list[tuple[int, int, bool, bool, int, int]]:
    """(start, end, left cut, right cut, audio start, audio end): pieces of LEAST to MOST, cut at silences near the TARGET, else hard."""
    quiet = sorted(silences)
    edges: list[tuple[int, bool]] = [(0, False)]  # a place and whether it is a hard cut
    while edges[-1][0] + LEAST < duration:
        at = edges[-1][0]
        far = min(at + MOST, duration)
        near = [s for s in quiet if at + LEAST < s <= far]
        cut = min(near, key=lambda s: abs(s - at - TARGET)) if near else min(at + TARGET, far)
        edges.append((cut, not near))
        if duration - cut < LEAST:
            break
    edges.append((duration, False))

    kept = [edges[0]]  # a piece that is too short joins the one before, and hands on its right edge
    for i, e in enumerate(edges[1:]):
        if i and e[0] - kept[-1][0] < LEAST and len(kept) > 1:
            kept[-1] = e
        else:
            kept.append(e)

    out = [kept[0]]
    for e in kept[1:]:
        while e[0] - out[-1][0] > MOST:  # a piece that is too long is cut near its middle, LEAST from either end
            a, b = out[-1][0], e[0]
            mid = a + (b - a) // 2
            near = [s for s in quiet if a + LEAST < s < b - LEAST]
            out.append((min(near, key=lambda s: abs(s - mid)), False) if near else (max(a + LEAST, min(mid, b - LEAST)), True))
        out.append(e)
    return [(a, b, x, y, max(0, a - PAD * x), min(duration, b + PAD * y)) for (a, x), (b, y) in zip(out, out[1:], strict=False)]


def plan_segments(media: DataFrame) -> DataFrame:
    """media: media_id, duration_ms, silences (array). One task row for each media item; nothing is gathered."""

    def run(batches):
        for pdf in batches:
            rows = [(m, i, *p) for m, n, s in zip(pdf["media_id"], pdf["duration_ms"], pdf["silences"], strict=True) for i, p in enumerate(plan(int(n), [int(x) for x in s]))]
            yield pd.DataFrame(rows, columns=["media_id", "segment_index", "start_ms", "end_ms", "left_cut", "right_cut", "audio_start_ms", "audio_end_ms"])

    return media.select("media_id", "duration_ms", "silences").mapInPandas(run, "media_id long, segment_index int, start_ms long, end_ms long, left_cut boolean, right_cut boolean, audio_start_ms long, audio_end_ms long")


def fixed_grid(media: DataFrame, width: int = TARGET, pad: int = PAD) -> DataFrame:
    """Cells of equal width, the audio overlapping on inner sides."""
    cells = media.where("duration_ms > 0").select("media_id", "duration_ms", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, F.lit(width).cast("long"))).alias("segment_index", "start_ms"))
    end = F.least(F.col("start_ms") + width, "duration_ms")
    return cells.select("media_id", "segment_index", "start_ms", end.alias("end_ms"), F.greatest(F.lit(0), F.col("start_ms") - pad).alias("audio_start_ms"), F.least(F.col("duration_ms"), end + pad).alias("audio_end_ms"))


def tumbling(rows: DataFrame, key: str, ts: str, text: str, width: int) -> DataFrame:
    """Texts of each window joined in order of time; empty windows are left out."""
    w = (F.floor(F.col(ts) / width) * width).alias("start_ms")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(ts, text))), lambda s: s[text])
    return rows.groupBy(key, w).agg(F.array_join(lines, "\n").alias("text"), F.count("*").alias("n")).select(key, "start_ms", (F.col("start_ms") + width).alias("end_ms"), "text", "n")


def summary_layers(segments: DataFrame, single: int = 20_000, chunk: int = 6_000) -> DataFrame:
    """media_id, chars, single, calls: whether an item's timed lines fit one summary call, else the number of chunk calls."""
    from cinegraph.operators.folds import chunk_pack

    lines = segments.select("media_id", "start_ms", (F.length("transcript") + 9).alias("size"))
    total = lines.groupBy("media_id").agg((F.sum("size") - 1).cast("long").alias("chars"))
    packed = chunk_pack(lines, "media_id", "start_ms", "size", chunk).groupBy("media_id").agg((F.max("chunk") + 1).alias("n"))
    return total.join(packed, "media_id").select("media_id", "chars", (F.col("chars") <= single).alias("single"), F.when(F.col("chars") <= single, 1).otherwise(F.col("n")).alias("calls"))


def asr_outcomes(parts: DataFrame, key: str) -> DataFrame:
    """Parts of items (key, start_ms, status, text) that succeeded with text, in order; an item all of whose parts failed is an error row."""
    bad = (F.col("status") == "FAILED") | (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0)
    good = parts.where(~bad).select(key, "start_ms", F.lit("ok").alias("outcome"))
    lost = parts.groupBy(key).agg(F.bool_and(F.col("status") == "FAILED").alias("_all")).where("_all").select(key, F.lit(None).cast("long").alias("start_ms"), F.lit("all failed").alias("outcome"))
    return good.unionByName(lost).orderBy(key, "start_ms")


def merge_channels(plan: DataFrame, speech: DataFrame, frames: DataFrame, key: str, keep: Callable[[Column], Column]) -> DataFrame:
    """Planned segments with their speech and screen texts; a segment without a frame takes the nearest; empty ones go.

    plan: key, segment_index, segment_id, start_ms, end_ms; speech: key, start_ms, transcript; frames: key, frame, ts, screen.
    """
    from cinegraph.operators.intervals import nearest, owner

    held = owner(frames.select(key, "frame", "ts"), plan, key, "frame").join(frames.select("frame", "screen"), "frame")
    texts = F.array_sort(F.collect_list(F.when(keep(F.col("screen")), F.struct("ts", "frame", "screen"))))
    own = held.groupBy(key, "segment_index").agg(F.count("*").alias("frames"), F.array_join(F.transform(texts, lambda x: x["screen"]), " | ").alias("seen"))
    s = plan.join(speech, [key, "start_ms"], "left").join(own, [key, "segment_index"], "left")
    bare = s.where("frames is null").select(key, "segment_id", F.expr("(start_ms + end_ms) div 2").alias("at"))
    near = nearest(bare, frames.select(key, "frame", "ts"), key, "segment_id", "frame").withColumnRenamed("frame", "_near")
    out = s.join(near, "segment_id", "left").withColumn("frames", F.coalesce("frames", F.when(F.col("_near").isNotNull(), 1), F.lit(0)))
    some = (F.length(F.trim(F.coalesce("transcript", F.lit("")))) > 0) | (F.coalesce("seen", F.lit("")) != "") | (F.col("frames") > 0)
    return out.where(some).select(key, "segment_id", "segment_index", F.coalesce("transcript", F.lit("")).alias("transcript"), F.coalesce("seen", F.lit("")).alias("seen"), "frames", "_near")

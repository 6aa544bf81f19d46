"""Ordered folds within a key: each step depends on what was kept before, so no running sum can say it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def _fold(df: DataFrame, key: str, order: str, value: str, run: Callable[[list], list], out: str, kind: str) -> DataFrame:
    kinds = dict(df.dtypes)

    def apply(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        return pd.DataFrame({key: part[key], order: part[order], out: run(part[value].tolist())})

    return df.select(key, order, value).groupBy(key).applyInPandas(apply, f"{key} {kinds[key]}, {order} {kinds[order]}, {out} {kind}")


def dedup_chain(df: DataFrame, key: str, order: str, hash_column: str, distance: int) -> DataFrame:
    """Rows whose hash differs in more than `distance` bits from the last row that was kept."""

    def run(values: list[int]) -> list[bool]:
        out, last = [], None
        for v in values:
            keep = last is None or ((v ^ last) & (1 << 64) - 1).bit_count() > distance
            last = v if keep else last
            out.append(keep)
        return out

    return _fold(df, key, order, hash_column, run, "kept", "boolean").where("kept").drop("kept")


def budget_pack(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Takes the first row always, then each that still fits; rows that don't fit are skipped, later ones tried."""

    def run(values: list[int]) -> list[bool]:
        used, out = 0, []
        for i, v in enumerate(values):
            take = i == 0 or used + v <= budget
            used += v * take
            out.append(take)
        return out

    return _fold(df, key, order, size, run, "taken", "boolean").where("taken").drop("taken")


def chunk_pack(df: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Number of the chunk of each row; a chunk is closed when it has rows and the next would pass the limit."""

    def run(values: list[int]) -> list[int]:
        chunk, used, out = 0, 0, []
        for i, v in enumerate(values):
            if i and used and used + v > limit:
                chunk, used = chunk + 1, 0
            used += v
            out.append(chunk)
        return out

    return _fold(df, key, order, size, run, "chunk", "int")

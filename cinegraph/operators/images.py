"""Difference hashes of grey images: a picture is shrunk to 9 by 8 and neighbours in a row are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WIDE, HIGH = 9, 8


def read_pnm(raw: bytes) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM picture; None if it is none."""
    head: list[bytes] = []
    at = 0
    while len(head) < 4:
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.find(b"\n", at) + 1 or len(raw)
            continue
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        if end == at:
            return None
        head.append(raw[at:end])
        at = end
    if head[0] not in (b"P5", b"P6") or not all(x.isdigit() for x in head[1:]):
        return None
    w, h, most = map(int, head[1:])
    n = 3 if head[0] == b"P6" else 1
    body = np.frombuffer(raw, np.uint8, offset=at + 1) if at + 1 <= len(raw) else np.zeros(0, np.uint8)
    if not (w and h and 0 < most < 256) or len(body) < w * h * n:
        return None
    px = body[: w * h * n].reshape(h, w, n).astype(float)
    return px @ np.array([0.299, 0.587, 0.114]) if n == 3 else px[:, :, 0]


def shrink(px: np.ndarray, high: int = HIGH, wide: int = WIDE) -> np.ndarray:
    """Means over the areas that the smaller picture's points cover."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        left, right = np.arange(n), np.arange(1, n + 1)
        cover = np.clip(np.minimum(edge[1:, None], right) - np.maximum(edge[:-1, None], left), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return weights(px.shape[0], high) @ px @ weights(px.shape[1], wide).T


def dhash(raw: bytes | None) -> int | None:
    """64 bits, the first comparison as the highest, as a signed number."""
    px = read_pnm(bytes(raw)) if raw is not None else None
    if px is None:
        return None
    small = np.round(shrink(px), 6)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def hashes(images: DataFrame, key: str, content: str) -> DataFrame:
    """key, dhash of each picture (null where it can't be read)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "dhash": pd.array([dhash(x) for x in b[content]], "Int64")})

    return images.select(key, content).mapInPandas(run, f"{key} {dict(images.dtypes)[key]}, dhash long")

"""Shared pieces: table access, scratch tables in the shared folder, byte-level text kernels in numpy.

The kernels work on the raw UTF-8 buffers of Arrow columns, so no Python object is made per document.
Words are maximal runs of characters other than space and U+0009..U+000D; those separators are ASCII,
so they can be told apart on bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.plans.shared import drop_scratch, scratch, shared_dir

__all__ = ["drop_scratch", "scratch", "shared_dir"]

#: Bytes of text that one numpy pass handles at a time; a longer document is a pass of its own.
PASS_BYTES = 3 << 19
#: Session settings that bound what a task holds at once: some documents are a hundred times the usual length.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "parquet.block.size": str(16 << 20),
}

U = np.uint64


def tune(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, read batches and the row groups that a Parquet writer keeps until they are full."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    bufs = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(col: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of stretches of rows with at most `limit` bytes each (one row at least)."""
    if len(col):
        data, off = utf8(col)
        at = 0
        while at < len(col):
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield at, data[off[at] : off[end]], off[at : end + 1] - off[at]
            at = end


def from_text(run: Callable[[np.ndarray, np.ndarray], pa.Array], kind: str) -> Callable[[Column], Column]:
    """A column function: `run` gets bytes and offsets of a stretch of rows and returns a value for each row.

    Only these values come back from the worker; the other columns stay in the JVM.
    """

    @F.arrow_udf(kind)
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            found = [run(data, off) for _, data, off in slices(col)]
            yield pa.concat_arrays(found) if found else run(np.zeros(0, np.uint8), np.zeros(1, np.int64))

    return column.asNondeterministic()


def passes(batches: Iterator[pa.RecordBatch], column: str, limit: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with at most `limit` bytes of text each (one row at least)."""
    for b in batches:
        for at, data, off in slices(b.column(b.schema.get_field_index(column)), limit):
            yield b.slice(at, len(off) - 1), data, off


SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) + U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = _table(0x9E3779B9)
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, U)
        x[0] = 1
        _POW[base] = have = np.cumprod(x, dtype=U)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of BYTE[data[j]] * base^j over j < i, modulo 2^64."""
    s = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * _powers(_BASE, len(data)), out=s[1:])
    return s


def piece_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings data[start:end], by the prefix sums of prefix_hash."""
    return mix((s[end] - s[start]) * _powers(_INV, len(s))[start] + (end - start).astype(U))


def gram_hash(s: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings."""
    n = len(s) - k  # s has one element more than the data
    return mix((s[k:] - s[:n]) * _powers(_INV, n)) if n > 0 else np.zeros(0, U)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words each row has; no word crosses rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off) - 1, np.int64)
    word = ~SEP[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = off[(off > 0) & (off < len(data))]
    first[cut] |= word[cut]
    last[cut - 1] |= word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(starts, off)
    return starts, ends, np.diff(at)


_MULT = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def window_hash(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k word hashes (also those that cross rows: the caller leaves them out)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for i in range(k):
        h = (h ^ w[i : i + n]) * _MULT[i % 4] + U(i + 1)
        h ^= h >> U(29)
    return mix(h)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the count of each row."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=kind))


ID_BITS = 24


def flagged(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Adds flag: false if the row's id is surely not in ids, so that few other rows need a shuffle.

    The ids are hashed to a bit map of 2^ID_BITS bits, some 270,000 rows of 62 bits whatever the input, which is
    broadcast; with many more ids than bits all rows are flagged, which only costs the shuffle.
    """
    slot = lambda: F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << ID_BITS))
    bits = ids.select(slot().alias("_s")).groupBy(F.expr("_s div 62").alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_s % 62 as int)))").alias("_m"))
    out = df.withColumn("_s", slot()).withColumn("_w", F.expr("_s div 62")).join(F.broadcast(bits), "_w", "left")
    flag = F.expr("coalesce(shiftright(_m, cast(_s % 62 as int)) & 1, 0) = 1")
    return out.withColumn("flag", flag).select(*df.columns, "flag")

"""Benchmark decontamination by pigeonhole edit matching (operator 8).

An item of m characters may differ by e = rate * m edits. Cut into e + 1 pieces, at least one piece stands
unchanged in any text that holds the item within e edits, so an Aho-Corasick automaton over all pieces finds
every candidate place in one scan, and Myers' bit-parallel distance verifies the window around it. Texts and
items are compared with letters lower-cased. An item under min_chars would match by chance with edits: it counts
only where it stands unchanged, and where no letter or digit of a script that separates words adjoins its own.

Items are collected in blocks whose size is checked and handed to the workers by broadcast; the documents are not
shuffled. A benchmark of one block is one scan; of many, CHAINED blocks share a scan and a worker each.

Edge cases: a null or empty text or item, or an item of white space, matches nothing; an item without an id counts
like others and is reported with a null id; equal items are reported each under its own id; repeated rows stay.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.llm.common import scratch, tune

ERROR_RATE = 0.08
MIN_CHARS = 20
CHAINED = 4
#: Bytes of item text in one automaton.
BLOCK_BYTES = 2 << 20
Q = 4

HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_HIT = pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def lower(s: str) -> str:
    """Lower case with unchanged positions."""
    t = s.lower()
    return t if len(t) == len(s) else "".join(x if len(x := c.lower()) == 1 else c for c in s)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length with their places."""
    n = errors + 1
    at = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False) if a < b]


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """Least distance of the pattern to any substring of the text, and the first end where it occurs (Myers)."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        peq[ch] |= 1 << i
    plus, minus, score, best = mask, 0, m, (m, 0)
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & mask
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        plus = mh | ~(xv | ph) & mask
        minus = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def may_hold(pattern: str, text: str, errors: int) -> bool:
    """An edit destroys Q substrings of length Q at most: false only if too many of the pattern's are missing."""
    left = Q * errors
    for i in range(len(pattern) - Q + 1):
        if pattern[i : i + Q] not in text:
            left -= 1
            if left < 0:
                return False
    return True


def _stands_alone(item: str, text: str, begin: int, end: int) -> bool:
    """No letter or digit next to one of the item's own; scripts from U+2E80 on do not separate words."""
    joined = lambda a, b: a.isalnum() and b.isalnum() and ord(a) < 0x2E80 and ord(b) < 0x2E80
    return not (begin > 0 and joined(text[begin - 1], item[0])) and not (end < len(text) and joined(item[-1], text[end]))


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items = [(i, lower(t), int(rate * len(t)) if len(t) >= min_chars else -1) for i, t in items]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, errors) in enumerate(self.items):
            for a, piece in pieces(text, max(errors, 0)):
                at[piece].append((k, a))
        self.auto = ahocorasick.Automaton()
        for piece, own in at.items():
            self.auto.add_word(piece, (len(piece), own))
        self.auto.make_automaton()

    def hits(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, start, end) of each item that the text holds, at its best place."""
        text = lower(text)
        found: dict[int, tuple[int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        for end, (size, own) in self.auto.iter(text):
            for k, a in own:
                _, item, errors = self.items[k]
                begin = end + 1 - size - a
                if k in found and found[k][0] == 0 or errors >= 0 and (k, begin) in done:
                    continue
                if errors < 0:
                    if _stands_alone(item, text, begin, end + 1):
                        found[k] = (0, begin, end + 1)
                    continue
                done.add((k, begin))
                if text.startswith(item, max(begin, 0)) and begin >= 0:
                    found[k] = min(found.get(k, (errors + 1, 0, 0)), (0, begin, begin + len(item)))
                    continue
                low = max(0, begin - errors)
                window = text[low : begin + len(item) + errors]
                if len(window) < len(item) - errors or not may_hold(item, window, errors):
                    continue
                distance, stop = best_end(item, window)
                if distance <= errors and (k not in found or distance < found[k][0]):
                    _, back = best_end(item[::-1], window[:stop][::-1])
                    found[k] = (distance, low + stop - back, low + stop)
        return [(self.items[k][0], *v) for k, v in sorted(found.items())]


_MATCHERS: dict[str, Matcher] = {}


def _blocks(items: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    own = items.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")).where(F.trim("t") != "")
    total = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        if rows := [(r.i, r.t) for r in part.collect() if r.t.strip()]:
            yield sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _found(sent, key: str, rate: float, min_chars: int):
    """A column function: the hits of a block of items."""

    @F.arrow_udf(T.ArrayType(HIT))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(sent.value, rate, min_chars)
        m = _MATCHERS[key]
        for col in batches:
            yield pa.array([[dict(zip(("item_id", "distance", "start", "end"), h, strict=True)) for h in m.hits(t or "")] for t in col.to_pylist()], pa.list_(_HIT))

    return found.asNondeterministic()


def match(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, text: str = "text", column: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds an array of (item_id, distance, start, end): the items that the text holds, each at its best place."""
    spark = tune(docs.sparkSession)
    out = docs.drop(column).withColumn(column, F.array().cast(T.ArrayType(HIT)))
    for n, own in enumerate(_blocks(items, "item_id", "text", block_bytes)):
        if n and n % CHAINED == 0:
            out = scratch(out, "bench-hits")
        found = _found(spark.sparkContext.broadcast(own), uuid.uuid4().hex, rate, min_chars)
        out = out.withColumn(column, F.concat(column, found(F.col(text))))
    return out


def leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, distance, start, end, contaminated (true)."""
    out = match(docs.select("doc_id", "text"), items, rate).select("doc_id", F.explode("hits").alias("h"))
    return out.select("doc_id", "h.*", F.lit(True).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no item."""
    held = "_" + max(docs.columns, key=len)  # no column of the input has this name
    return match(docs, items, rate, column=held).where(F.size(held) == 0).drop(held)

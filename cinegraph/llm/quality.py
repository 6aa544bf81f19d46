"""Quality rules by repetition coverage (operator 5).

Word and line hashes come from one polynomial prefix sum over the bytes of a pass of documents; n-gram hashes
from them. A word is covered by length n if it lies in an n-word window found twice or more in its text, so the
covered characters follow from a difference array, without any loop over words. A window of more than three
words can only repeat where its three-word windows do, so the longer lengths sort few positions.

Edge cases: a null or empty text has no words and fails the base rule; a line without a word is no line here;
repeated rows give repeated rows; clashing columns of the input are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import from_text, mix, piece_hash, prefix_hash, tune, window_hash, words

BASE_N = 3


@dataclass(frozen=True)
class Rules:
    """Percentages: a text is rejected when a share is above its limit."""

    min_words: int = 50
    max_repeat_words: int = 50
    #: Word characters inside repeated windows of n words.
    grams: dict[int, int] = field(default_factory=lambda: {5: 30, 8: 25, 13: 20})
    max_dup_lines: int = 30
    max_dup_line_chars: int = 20
    #: Symbols for each hundred words.
    max_symbols: int = 25


RULES = Rules()
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "line_chars", "dup_line_chars"]


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _seen_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it equal to an earlier one, and is it equal to any other."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    later, some = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    some[order[1:]] = same
    some[order[:-1]] |= same
    return later, some


def measure(data: np.ndarray, off: np.ndarray, lengths: list[int]) -> dict[str, np.ndarray]:
    """The counts of each row of a pass."""
    n_rows = len(off) - 1
    s = prefix_hash(data)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    starts, ends, counts = words(data, off)
    row = np.repeat(np.arange(n_rows), counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    chars = points[ends] - points[starts]
    out = {"n_words": counts, "word_chars": _sums(chars, first), "n_symbols": _sums(SYMBOL[data], off)}

    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([off[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))[: len(begin)]
    stop = stop - (data[stop - 1] == 0x0A)
    lines_row = np.searchsorted(off, begin, "right") - 1
    k = np.searchsorted(starts, begin)
    has = (k < len(starts)) & (np.append(starts, len(data) + 1)[k] < stop)
    begin, stop, lines_row = begin[has], stop[has], lines_row[has]
    later, _ = _seen_before(mix(piece_hash(s, begin, stop) ^ mix(lines_row + 1)))
    length = points[stop] - points[begin]
    of_row = lambda x: np.bincount(lines_row, weights=x, minlength=n_rows).astype(np.int64)
    out |= {"n_dup_lines": of_row(later), "n_lines": of_row(np.ones(len(begin))), "line_chars": of_row(length), "dup_line_chars": of_row(length * later)}

    hashes = piece_hash(s, starts, ends)
    salt = mix(row + 1)

    def covered(n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """at: windows that may repeat. The repeated ones, and the words inside them."""
        keys = mix(window_hash(hashes, n)[at] ^ salt[at])
        _, some = _seen_before(keys)
        at = at[some]
        d = np.zeros(len(starts) + 1, np.int64)
        np.add.at(d, at, 1)
        np.subtract.at(d, at + n, 1)
        return at, np.cumsum(d[:-1]) > 0

    m = len(starts) - BASE_N + 1
    at = np.flatnonzero(row[:m] == row[BASE_N - 1 :]) if m > 0 else np.zeros(0, np.int64)
    at, inside = covered(BASE_N, at)
    out["n_repeat_words"] = _sums(inside, first)
    again = np.zeros(len(starts) + 1, bool)
    again[at] = True
    for n in lengths:
        m = len(starts) - n + 1
        at = np.flatnonzero(again[:m] & again[n - BASE_N : n - BASE_N + m] & (row[:m] == row[n - 1 :])) if m > 0 else np.zeros(0, np.int64)
        _, inside = covered(n, at)
        out[f"chars_{n}"] = _sums(chars * inside, first)
    return out


def repetition(df: DataFrame, rules: Rules = RULES, text: str = "text") -> DataFrame:
    """Adds the counts of COLUMNS, chars_n for each n-gram length, base_failed and kept."""
    tune(df.sparkSession)
    names = [*COLUMNS, *(f"chars_{n}" for n in rules.grams)]
    kept = df.drop(*names, "base_failed", "kept", "_m")
    lengths = list(rules.grams)

    def run(data: np.ndarray, off: np.ndarray) -> pa.Array:
        found = measure(data, off, lengths)
        return pa.StructArray.from_arrays([pa.array(found[n], pa.int64()) for n in names], names)

    counts = from_text(run, "struct<" + ",".join(f"{n}:long" for n in names) + ">")
    out = kept.withColumn("_m", counts(F.col(text))).select(*kept.columns, *(F.col(f"_m.{n}").alias(n) for n in names))
    c = F.col
    failed = (c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.max_repeat_words * c("n_words"))
    good = (
        (100 * c("n_dup_lines") <= rules.max_dup_lines * c("n_lines"))
        & (100 * c("dup_line_chars") <= rules.max_dup_line_chars * c("line_chars"))
        & (100 * c("n_symbols") <= rules.max_symbols * c("n_words"))
    )
    for n, most in rules.grams.items():
        good &= 100 * c(f"chars_{n}") <= most * c("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~c("base_failed") & good)


def verdicts(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    out = repetition(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(rules: Rules = RULES) -> str:
    lengths = [BASE_N, *rules.grams]
    gram = lambda n: " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER d" for i in range(1, n))])
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
g AS (SELECT *, {", ".join(f"{gram(n)} AS g{n}" for n in lengths)} FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, length(w) AS k, {", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS r{n}" for n in lengths)} FROM g),
c AS (SELECT doc_id, k, {", ".join(f"bool_or(r{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)} FROM r),
a AS (SELECT doc_id, count(*) AS n_words, sum(k) AS word_chars, {", ".join(f"count(*) FILTER (c{n}) AS n{n}, coalesce(sum(k) FILTER (c{n}), 0) AS k{n}" for n in lengths)} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM t)),
m AS (SELECT doc_id, length(x) AS k, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) > 1 AS again FROM l WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
b AS (SELECT doc_id, count(*) AS n_lines, sum(k) AS line_chars, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(k) FILTER (again), 0) AS dup_line_chars FROM m GROUP BY doc_id),
f AS (SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n{BASE_N}, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(line_chars, 0) AS line_chars, coalesce(dup_line_chars, 0) AS dup_line_chars,
 {", ".join(f"coalesce(k{n}, 0) AS k{n}" for n in rules.grams)} FROM s LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)),
v AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_words} * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
 NOT base_failed AND 100 * n_dup_lines <= {rules.max_dup_lines} * n_lines AND 100 * dup_line_chars <= {rules.max_dup_line_chars} * line_chars AND 100 * n_symbols <= {rules.max_symbols} * n_words
 {" ".join(f"AND 100 * k{n} <= {most} * word_chars" for n, most in rules.grams.items())} AS kept
FROM v"""


VERDICTS_SQL = _sql()

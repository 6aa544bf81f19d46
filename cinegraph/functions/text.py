"""Text expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_exact(x: Column) -> Column:
    """Lower case, white space collapsed and trimmed; null gives the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+", " "))


def normalize_fuzzy(x: Column) -> Column:
    """Letters a-z, digits, apostrophes, CJK and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9'\x{4e00}-\x{9fff} ]", " "), r"\s+", " "))


def normalize_compact(x: Column) -> Column:
    """As normalize_fuzzy without apostrophes and spaces."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9\x{4e00}-\x{9fff}]", "")


def characters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def entropy(x: Column) -> Column:
    """Shannon entropy in bits over the characters but spaces; 0 for none."""
    chars = characters(F.regexp_replace(x, " ", ""))
    n = F.size(chars).cast("double")
    term = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - term(c) * F.log2(term(c))))


def shingles3(x: Column) -> Column:
    """Distinct three-character windows; one character stands alone, two give none, none gives none."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substring(x, i, F.lit(3)))
    none = F.array().cast("array<string>")
    return F.when(F.length(x) == 0, none).when(F.length(x) == 1, F.array(x)).when(F.length(x) == 2, none).otherwise(F.array_distinct(windows))


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are equal; one empty set has nothing in common."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def mmss(ms: Column) -> Column:
    """Minutes (two digits or more) and seconds."""
    s = F.floor(ms / 1000)
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), F.greatest(F.length(F.floor(s / 60).cast("string")), F.lit(2)), F.lit("0")), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def abbreviate(x: Column, n: int = 180) -> Column:
    t = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def estimate_tokens(x: Column) -> Column:
    """One for each non-ASCII character, a quarter for each ASCII one, 1 at least; 0 for none."""
    other = F.length(F.regexp_replace(x, r"[\x00-\x7F]", ""))
    return F.when(F.coalesce(F.length(x), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), other + F.ceil((F.length(x) - other) / 4))).cast("long")


def mask_secrets(x: Column, n: int = 1000) -> Column:
    x = F.regexp_replace(x, r"(?i)bearer\s+[A-Za-z0-9._-]+", "Bearer ***")
    x = F.regexp_replace(x, r"(?i)(api[_-]?key|token|password|secret)\s*[=:]\s*[^\s,;]+", "$1=***")
    return F.left(F.regexp_replace(x, r"sk-[A-Za-z0-9]{8,}", "sk-***"), F.lit(n))


def fallback_terms(x: Column) -> Column:
    """The first eight distinct terms of two characters or more, or else the text."""
    terms = F.slice(F.array_distinct(F.filter(F.split(F.lower(x), r"[\s,.;:!?|]+"), lambda t: F.length(t) >= 2)), 1, 8)
    return F.when(F.size(terms) > 0, terms).otherwise(F.array(F.lower(x)))


def term_score(terms: Column, text: Column) -> Column:
    """Share of the terms that the text contains."""
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t))) / F.size(terms))


def ocr_keep(t: Column, allowed: list[str]) -> Column:
    """Keeps plausible screen text: known short words, CJK, words with vowels and not a lone upper-case run."""
    upper = (F.upper(t) == t) & (F.lower(t) != t)
    known = F.upper(t).isin(allowed)
    return (
        F.when(F.length(F.trim(t)) == 0, False)
        .when(known, True)
        .when(F.length(t) < 4, False)
        .when(t.rlike(r"[\x{4e00}-\x{9fff}]"), True)
        .when(F.regexp_replace(t, " ", "").rlike("(?i)[bcdfghjklmnpqrstvwxyz]{6,}"), False)
        .when(upper & ~F.contains(t, F.lit(" ")), False)
        .otherwise(True)
    )

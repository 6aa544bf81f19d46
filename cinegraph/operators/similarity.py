"""Similarity joins on names through an inverted index of shingles; never all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.functions.text import shingles3
from cinegraph.plans.shared import scratch


def _by_rarity(rows: DataFrame, by: list[str], s: str) -> DataFrame:
    """A row for each element g of the set s, with its place r (from 1) and the size _k among the set's elements, the rarest first."""
    e = rows.withColumn("_k", F.size(s)).withColumn("g", F.explode(s))
    e = e.join(e.groupBy(*by, "g").agg(F.count("*").alias("_n")), [*by, "g"])
    return e.withColumn("r", F.row_number().over(Window.partitionBy(*by, "name").orderBy("_n", "g"))).drop("_n")


def near_pairs(rows: DataFrame, by: list[str], at: float) -> DataFrame:
    """by, a < b, j: pairs of the rows of one `by` (name, s: a set) with a Jaccard similarity of `at` or more.

    Two such sets share one of the rarest k - ceil(at k) + 1 elements of either, so only those are joined.
    """
    e = _by_rarity(rows.select(*by, "name", "s"), by, "s").where(F.col("r") <= F.col("_k") - F.ceil(F.col("_k") * at - 1e-9) + 1)
    side = lambda n: e.select(*by, "g", *(F.col(c).alias(f"{c}_{n}") for c in ("name", "s", "_k")))
    fits = (F.col("name_a") < F.col("name_b")) & (F.least("_k_a", "_k_b") >= at * F.greatest("_k_a", "_k_b"))
    both = side("a").join(side("b"), [*by, "g"]).where(fits).select(*by, F.col("name_a").alias("a"), F.col("name_b").alias("b"), "s_a", "s_b").dropDuplicates([*by, "a", "b"])
    j = F.size(F.array_intersect("s_a", "s_b")) / F.size(F.array_union("s_a", "s_b"))
    return both.select(*by, "a", "b", j.alias("j")).where(F.col("j") >= at)


def contained_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, a < b: pairs of the rows of one `by` (name, flat) where one text holds the other.

    The holder has all three-character windows of the held, so the held text's rarest window finds it.
    """
    e = _by_rarity(rows.where(F.length("flat") >= 3).select(*by, "name", "flat", shingles3(F.col("flat")).alias("s")), by, "s")
    inner = e.where("r = 1").select(*by, "g", F.col("name").alias("x"), F.col("flat").alias("_in"))
    both = e.select(*by, "g", F.col("name").alias("y"), F.col("flat").alias("_out")).join(inner, [*by, "g"])
    return both.where((F.col("x") != F.col("y")) & F.contains("_out", F.col("_in"))).select(*by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def shingle_pairs(names: DataFrame, column: str, threshold: float) -> DataFrame:
    """a < b, jaccard of all pairs of distinct names that reach the threshold (above 0)."""
    s = names.select(F.lit(0).alias("_all"), F.col(column).alias("name"), shingles3(F.col(column)).alias("s")).where(F.size("s") > 0)
    return near_pairs(s, ["_all"], threshold).select("a", "b", F.col("j").alias("jaccard"))


def set_sizes(rows: DataFrame, queries: DataFrame, row: str, query: str) -> DataFrame:
    """row, query, common, either: sizes of intersection and union of each row's set s with each query's, where they meet.

    A common element is in very many rows but in few queries, so the join is dealt by element over salted rows.
    """
    salts = 16
    a = rows.select(row, F.size("s").alias("n"), F.explode("s").alias("w")).withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    b = queries.select(query, F.size("s").alias("k"), F.explode("s").alias("w")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = a.join(b, ["w", "_salt"]).groupBy(row, query, "n", "k").agg(F.count("*").alias("common"))
    return both.select(row, query, "common", (F.col("n") + F.col("k") - F.col("common")).alias("either"))


def fuzzy_pairs(names: DataFrame, column: str, threshold: float) -> DataFrame:
    """Pairs above the threshold, or one containing the other (names of three characters or more)."""
    flat = names.select(F.lit(0).alias("_all"), F.col(column).alias("name"), F.col(column).alias("flat"))
    return shingle_pairs(names, column, threshold).select("a", "b").union(contained_pairs(flat, ["_all"]).select("a", "b")).distinct()


def sequence_pairs(names: DataFrame, column: str, at: float = 0.8) -> DataFrame:
    """a < b of all pairs of distinct names whose sequence ratio can be `at` or more, and some others.

    A ratio of `at` needs at / 2 of both lengths in common characters, counted with repetition, so at least at / (2 - at)
    of either name; the rarest rest of each name's numbered characters, and one more, then share one.
    """
    least = at / (2 - at)
    name = F.col(column)
    chars = F.array_sort(F.split("name", F.lit("")))
    s = names.where(name.isNotNull() & (name != "")).select(name.alias("name")).distinct()
    s = s.withColumn("s", F.transform(chars, lambda x, i: F.concat(x, F.lit(" "), (i - F.array_position(chars, x)).cast("string"))))
    s = scratch(s.withColumn("k", F.size("s")).withColumn("id", F.monotonically_increasing_id()), "sp-names")
    e = s.select("id", "k", F.explode("s").alias("g"))
    e = e.join(e.groupBy("g").agg(F.count("*").alias("n")), "g")
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("n", "g"))).where(F.col("r") <= F.floor(F.col("k") * (1 - least) + 1e-9) + 1)
    a, b = e.alias("a"), e.alias("b")
    fits = (F.col("a.g") == F.col("b.g")) & (F.col("a.id") < F.col("b.id")) & (F.least("a.k", "b.k") >= least * F.greatest("a.k", "b.k") - 1e-9)
    pairs = a.join(b, fits).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    side = lambda n: s.select(F.col("id").alias(n), F.col("name").alias(f"n{n}"), F.col("s").alias(f"s{n}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    both = both.where(2 * F.size(F.array_intersect("sx", "sy")) >= at * (F.size("sx") + F.size("sy")) - 1e-9)
    return both.select(F.least("nx", "ny").alias("a"), F.greatest("nx", "ny").alias("b"))

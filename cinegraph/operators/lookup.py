"""Name lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_prefix(queries: DataFrame, names: DataFrame, q: str = "q", name: str = "name") -> DataFrame:
    """The equal name, or else the least name that the query begins.

    Names are cut to the lengths that queries have, of which there are few, so it stays an equi-join.
    """
    asked = queries.select(q).distinct()
    lengths = asked.select(F.length(q).alias("_n")).where("_n > 0").distinct()
    cut = names.join(F.broadcast(lengths), F.length(name) >= F.col("_n")).select(name, F.left(F.col(name), F.col("_n")).alias(q))
    best = cut.join(asked, q, "left_semi").groupBy(q).agg(F.min_by(name, F.struct(F.col(name) != F.col(q), name)).alias(name))
    return queries.join(best, q, "left")

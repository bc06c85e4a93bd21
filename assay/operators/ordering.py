"""Seeded orders and running totals that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int | str, key: Column) -> Column:
    """A fixed pseudo-random order of keys, the same in any layout of the data. A null key has a place of its own."""
    return F.md5(F.concat(F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("\0null"))).cast("binary"))


def running_before(df: DataFrame, order: str, values: dict[str, Column], digits: int = 3) -> DataFrame:
    """Add, for each name, the sum of its value over the rows before a row in `order` (hex digests, none null).

    Rows of equal digests follow each other in any order, so n rows always get n different counts.
    Two levels: totals of the cells of `digits` leading digits, then sums inside a cell.
    """
    df = df.withColumns({f"_v_{n}": c for n, c in values.items()}).withColumn("_cell", F.substring(order, 1, digits))
    cells = df.groupBy("_cell").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    across = Window.orderBy("_cell")
    ahead = cells.select("_cell", *[(F.sum(f"_t_{n}").over(across) - F.col(f"_t_{n}")).alias(f"_a_{n}") for n in values])
    inside = Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inside) - F.col(f"_v_{n}") for n in values})
    out = local.join(F.broadcast(ahead), "_cell").withColumns({n: F.col(f"_a_{n}") + F.col(f"_l_{n}") for n in values})
    return out.drop("_cell", *[f"_{k}_{n}" for n in values for k in "vtla"])


def first_of_each(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group; the limit is pushed below the exchange by Spark's window group limit."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def numbered_by(df: DataFrame, by: list[str], order: str, rank: str, digits: int = 3) -> DataFrame:
    """Number the rows of each group of `by` from 1 in `order` (hex digests, none null); nulls in `by` are a group.

    Two levels, so that a group with a third of all rows is no single task: counts of the cells of `digits` leading
    digits, then numbers inside a cell.
    """
    df = df.drop(rank).withColumns({"_by": F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in by]), "_cell": F.substring(order, 1, digits)})
    cells = df.groupBy("_by", "_cell").agg(F.count(F.lit(1)).alias("_c"))
    ahead = cells.select(F.col("_by").alias("_by2"), F.col("_cell").alias("_cell2"), (F.sum("_c").over(Window.partitionBy("_by").orderBy("_cell")) - F.col("_c")).alias("_ahead"))
    inside = df.withColumn(rank, F.row_number().over(Window.partitionBy("_by", "_cell").orderBy(order)))
    met = inside.join(ahead, F.col("_by").eqNullSafe(F.col("_by2")) & (F.col("_cell") == F.col("_cell2")))
    return met.withColumn(rank, F.col(rank) + F.col("_ahead")).drop("_by", "_cell", "_by2", "_cell2", "_ahead")


def join_frequent(big: DataFrame, one: DataFrame, keys: list[str], times: str, how: str = "inner", most: int = 100_000, few: int = 10_000) -> DataFrame:
    """big joined with `one` (one row a key; `times` tells how many rows of big have it), where a few keys may hold most rows.

    Keys of at least `most` rows, and of a `few`-th of all, are joined by broadcast, so their rows stay where they are; there are
    at most `few` of them.
    """
    total = one.agg(F.sum(times)).first()[0] or 0
    many = max(most, total // few + 1)
    if total < most or one.filter(F.col(times) >= many).isEmpty():
        return big.join(one, keys, how)
    hot = F.broadcast(one.filter(F.col(times) >= many))
    rest = big.join(hot.select(*keys), keys, "left_anti").join(one.filter(F.col(times) < many), keys, how)
    return big.join(hot, keys).unionByName(rest)

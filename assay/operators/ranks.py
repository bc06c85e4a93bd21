"""Ranks of every row among all rows of its group, exactly, for groups and values of any size.

Rows are counted by value; the distinct values of a group are cut into slices of like row numbers, and running counts go
over the slices and then inside a slice. A row finds its value's place by a join: frequent values, at most LIMIT of them,
by broadcast, so that their rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.slices import LIMIT, MOST, borders, slice_of


def value_places(rows: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """rows: _g and a value without nulls -> one row a group and value: n (rows), before (rows of smaller values), smaller
    (smaller distinct values) and total (rows of the group)."""
    return places_of(rows.groupBy("_g", value).agg(F.count(F.lit(1)).alias("n")), value, most)


def places_of(counts: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """value_places of rows that are counted already: _g, value, n. Slices hold like numbers of distinct values."""
    counts = counts.withColumn("_slice", slice_of(F.col(value), borders(counts, value, most)))
    slices = counts.groupBy("_g", "_slice").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    over, whole = Window.partitionBy("_g").orderBy("_slice"), Window.partitionBy("_g")
    ahead = slices.select("_g", "_slice", (F.sum("_n").over(over) - F.col("_n")).alias("_n0"), (F.sum("_d").over(over) - F.col("_d")).alias("_d0"), F.sum("_n").over(whole).alias("total"))
    inside = Window.partitionBy("_g", "_slice").orderBy(value)
    local = counts.withColumns({"_n1": F.sum("n").over(inside) - F.col("n"), "_d1": F.row_number().over(inside) - 1})
    placed = local.join(ahead, ["_g", "_slice"])
    return placed.select("_g", value, "n", (F.col("_n0") + F.col("_n1")).alias("before"), (F.col("_d0") + F.col("_d1")).alias("smaller"), "total")


def bucket_of(number: Column, total: Column, buckets: int) -> Column:
    """The ntile of row `number` (from 0) of `total`: the first total % buckets ones hold a row more."""
    size, more = F.floor(total / buckets), total % buckets
    return F.when(number < more * (size + 1), F.floor(number / (size + 1)) + 1).otherwise(more + F.floor((number - more * (size + 1)) / size) + 1).cast("int")


def with_ranks(rows: DataFrame, value: str, tie: str, by: list[str] | None = None, buckets: int = 4, most: int | None = None) -> DataFrame:
    """rows plus rank, dense_rank, row_number (ties by the number `tie`), percent_rank, cume_dist and ntile of each row in its group.

    Rows with a null value take no part: nulls. Null groups are a group. Rows equal in value and tie swap their numbers.
    """
    most = most or MOST
    new = ["rank", "dense_rank", "row_number", "percent_rank", "cume_dist", "ntile"]
    base = rows.drop(*new).withColumn("_g", F.struct(F.lit(0).alias("_"), *[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("v")).alias(f"g{i}") for i, c in enumerate(by or [])]))
    some = base.filter(F.col(value).isNotNull())
    places = value_places(some.select("_g", F.col(value).alias("_v")), "_v", most)
    n = some.count()
    many = max(most, n // LIMIT + 1)  # so at most LIMIT values are frequent
    frequent = F.broadcast(places.filter(F.col("n") >= many))
    keyed = some.withColumn("_v", F.col(value))
    hot = keyed.join(frequent, ["_g", "_v"]).withColumn("_cell", slice_of(F.col(tie), borders(some, tie, most)))
    rest = keyed.join(frequent.select("_g", "_v"), ["_g", "_v"], "left_anti").join(places.filter(F.col("n") < many), ["_g", "_v"]).withColumn("_cell", F.lit(0))
    met = hot.unionByName(rest)
    # numbers among equal values: a frequent value's rows are cut by their ties
    cells = met.groupBy("_g", "_v", "_cell").agg(F.count(F.lit(1)).alias("_c"))
    ahead = cells.select("_g", "_v", "_cell", (F.sum("_c").over(Window.partitionBy("_g", "_v").orderBy("_cell")) - F.col("_c")).alias("_ahead"))
    own = met.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_v", "_cell").orderBy(tie)))
    number = F.col("before") + F.col("_ahead") + F.col("_r")
    ranked = own.join(ahead, ["_g", "_v", "_cell"]).withColumns({
        "rank": F.col("before") + 1, "dense_rank": F.col("smaller") + 1, "row_number": number,
        "percent_rank": F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1)).otherwise(0.0),
        "cume_dist": (F.col("before") + F.col("n")) / F.col("total"), "ntile": bucket_of(number - 1, F.col("total"), buckets),
    })
    kinds = dict(ranked.dtypes)
    none = base.filter(F.col(value).isNull()).withColumns({c: F.lit(None).cast(kinds[c]) for c in new})
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in new]
    return ranked.select(*keep, *new).unionByName(none.select(*keep, *new))

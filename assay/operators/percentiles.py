"""Exact percentiles of groups that no task has to hold.

Values are counted first; running counts go over slices of the distinct values (of like size, wherever the values lie) and
then inside a slice. Nulls do not count; a group without values gives NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.ranks import places_of
from assay.session import cut


def percentiles(rows: DataFrame, value: str, wanted: dict[str, tuple[str, float]], by: list[str] | None = None, times: str | None = None, most: int | None = None) -> DataFrame:
    """One row a group of `by`, with a column for each wanted name: ("cont", q) interpolates, ("disc", q) takes a value.

    `times` may name a column that tells for how many rows a row stands.
    """
    group = F.struct(F.lit(0).alias("_"), *[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("v")).alias(f"g{i}") for i, c in enumerate(by or [])])
    counts = cut(rows.select(group.alias("_g"), F.col(value).cast("double").alias("_v"), (F.col(times) if times else F.lit(1)).cast("long").alias("_n")).groupBy("_g", "_v").agg(F.sum("_n").alias("n")))
    placed = places_of(counts.filter("_v IS NOT NULL"), "_v", most)
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("_v")))

    def pick(kind: str, q: float) -> Column:
        if kind == "disc":
            return at(F.greatest(F.ceil(F.lit(q) * F.col("total")) - 1, F.lit(0)))
        spot = F.lit(q) * (F.col("total") - 1)
        low, high = at(F.floor(spot)), at(F.ceil(spot))
        part = F.max(spot - F.floor(spot))
        return F.when(part == 0, low).otherwise(low * (1 - part) + high * part)

    picks = [pick(*w).alias(n) for n, w in wanted.items()]
    if not by:
        return placed.agg(*picks)
    every = counts.select("_g").distinct().join(placed.groupBy("_g").agg(*picks), "_g", "left")
    return every.select(*[F.col(f"_g.g{i}.v").alias(c) for i, c in enumerate(by)], *wanted)


def with_percentiles(groups: DataFrame, rows: DataFrame, value: str, wanted: dict[str, tuple[str, float]], by: list[str] | None = None, times: str | None = None) -> DataFrame:
    """groups (one row for each value of `by`) with the percentiles of rows."""
    found = percentiles(rows, value, wanted, by, times)
    if not by:
        return groups.crossJoin(F.broadcast(found))  # one row each
    found = found.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = reduce(lambda x, y: x & y, [groups[c].eqNullSafe(found[f"_by_{c}"]) for c in by])
    return groups.join(found, same, "left").drop(*[f"_by_{c}" for c in by])

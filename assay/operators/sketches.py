"""Measures that cannot be added, kept as states that can: distinct members, quantiles, frequent items.

A state table has one row for each finest group (a day and its dimensions); its binary columns merge to any coarser group or
longer period without the rows. Distinct numbers come in two forms: HyperLogLog for any keys (`error`: about
1.04 / sqrt(2^12) = 1.6 %), and exact bitmaps for whole numbers from 0. Quantiles are KLL states (rank error below 1.4 %).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 200


def day_states(rows: DataFrame, by: list[str], member: str, value: str, at: str = "at") -> DataFrame:
    """day, by, n, members (HLL state) and values (KLL state): one row a day and group; hot groups combine before the shuffle."""
    return rows.groupBy(F.to_date(at).alias("day"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(member, LG_K).alias("members"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("values")
    )


def merged(states: DataFrame, by: list[str | Column]) -> DataFrame:
    """The states of coarser groups or longer periods."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("members", allowDifferentLgConfigK=True).alias("members"), F.kll_merge_agg_double("values", KLL_K).alias("values"))


def estimates(states: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """states with n, distinct_members and the named quantiles in place of the binary columns."""
    found = {"distinct_members": F.hll_sketch_estimate("members"), **{name: F.kll_sketch_get_quantile_double("values", F.lit(float(q))) for name, q in quantiles.items()}}
    return states.withColumns(found).drop("members", "values")


def frequent_states(rows: DataFrame, by: list[str | Column], item: str, tracked: int = 10_000) -> DataFrame:
    """by and items: a state of the most frequent items; items beyond `tracked` at once make counts upper bounds."""
    return rows.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(`{item}`, {tracked})").alias("items"))


def frequent_items(states: DataFrame, by: list[str | Column], k: int, tracked: int = 10_000) -> DataFrame:
    """by, rank, item and n of the k most frequent items of the merged states."""
    top = states.groupBy(*by).agg(F.expr(f"approx_top_k_combine(items, {tracked})").alias("items")).withColumn("items", F.expr(f"approx_top_k_estimate(items, {k})"))
    names = [c for c in top.columns if c != "items"]
    return top.select(*names, F.posexplode("items").alias("rank", "_i")).select(*names, (F.col("rank") + 1).alias("rank"), F.col("_i.item").alias("item"), F.col("_i.count").alias("n"))


def lattice(rows: DataFrame, dimensions: list[str], member: str, sums: dict[str, Column], sets: list[list[str]] | None = None) -> DataFrame:
    """The cube of exact distinct members and additive sums: one row a cell, `grouping` tells which dimensions are rolled up.

    A Spark cube copies each row 2^d times to count distinct members. Here rows are read once, into a bitmap for each finest
    cell and range of 32,768 members (whole numbers from 0; others do not count); each coarser set of dimensions merges the
    bitmaps of the set with one dimension more. Work and shuffles follow the number of cells, not of rows.
    `sets` may name the wanted sets of dimensions, a rollup for instance; None gives all.
    """
    d = len(dimensions)
    number = F.col(member).cast("long")
    kept = F.when(number >= 0, number)
    finest = rows.groupBy(*dimensions, F.bitmap_bucket_number(kept).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(kept)).alias("_bits"), F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in sums.items()]
    )
    totals = ["_n", *sums]
    levels = {tuple(dimensions): finest}
    for size in range(d - 1, -1, -1):
        for chosen in combinations(dimensions, size):
            parent = next(p for p in levels if len(p) == size + 1 and set(chosen) < set(p))
            levels[chosen] = levels[parent].groupBy(*chosen, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"), *[F.sum(c).alias(c) for c in totals])
    wanted = [tuple(x for x in dimensions if x in s) for s in sets] if sets is not None else list(levels)
    cells = []
    for chosen in wanted:
        mask = sum(1 << d - 1 - i for i, x in enumerate(dimensions) if x not in chosen)
        summed = levels[chosen].groupBy(*chosen).agg(F.sum(F.bitmap_count("_bits")).alias("distinct_members"), *[F.sum(c).alias(c) for c in totals])
        cells.append(summed.select(*[F.col(x) if x in chosen else F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in dimensions], F.lit(mask).alias("grouping"), F.col("_n").alias("n"), "distinct_members", *sums))
    return reduce(lambda a, b: a.unionByName(b), cells)

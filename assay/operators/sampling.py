"""Seeded samples and quotas: the same seed gives the same rows in any layout of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.ordering import first_of_each, running_before, seeded

# Condition -> (longest side, format, quality).
CONDITIONS = (("orig", None, "JPEG", 95), ("phone", 1440, "JPEG", 92), ("screenshot", 1080, "PNG", None), ("social", 720, "JPEG", 60), ("reencode", None, "JPEG", 40))


def balanced_sample(rows: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of each class in seeded order."""
    return first_of_each(rows, [label], [seeded(seed, F.col(key)), F.col(key)], n).drop("rn")


def cap_per_identity(rows: DataFrame, who: str, order: str, per: int, total: int) -> DataFrame:
    """At most `per` rows of a person in arrival order, then the first `total` of all."""
    return first_of_each(rows, [who], [F.col(order)], per).orderBy(order).limit(total).drop("rn")


def holdout_first(pool: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """pool plus is_holdout: n rows are carved out before any training selection."""
    order = pool.withColumn("_order", seeded(seed, F.col(key)))
    return running_before(order, "_order", {"_before": F.lit(1)}).withColumn("is_holdout", F.col("_before") < n).drop("_order", "_before")


def budget_fill(pools: list[DataFrame], key: str, budget: int, seed: int = 42) -> DataFrame:
    """Rows of ordered pools up to the budget: an earlier pool is used up before the next one starts."""
    tagged = reduce(DataFrame.unionByName, [p.withColumn("pool", F.lit(i)) for i, p in enumerate(pools)])
    order = F.concat(F.lpad(F.hex("pool"), 4, "0"), seeded(seed, F.col(key)))
    spread = running_before(tagged.withColumn("_order", order), "_order", {"_before": F.lit(1)}, 7)  # 4096 cells a pool
    return spread.filter(F.col("_before") < budget).drop("_order", "_before")


def match_count(rows: DataFrame, key: str, reference: DataFrame, seed: int = 42) -> DataFrame:
    """As many rows as reference has, in seeded order."""
    want = reference.agg(F.count(F.lit(1)).alias("_want"))
    order = running_before(rows.withColumn("_order", seeded(seed, F.col(key))), "_order", {"_before": F.lit(1)})
    return order.crossJoin(F.broadcast(want)).filter("_before < _want").drop("_order", "_before", "_want")


def withheld_family(rows: DataFrame, column: str, family: str, key: str, n: int = 2000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training rows without the family, at most n rows of it for the test)."""
    is_it = F.lower(column) == family.lower()
    test = rows.filter(is_it).orderBy(seeded(seed, F.col(key)), key).limit(n)
    return rows.filter(~F.coalesce(is_it, F.lit(False))), test


def blind_pack(rows: DataFrame, stratum: str, key: str, per: int = 6, seed: int = 42) -> DataFrame:
    """A few rows of each stratum under anonymous names in shuffled order, with the answers beside them."""
    few = first_of_each(rows, [stratum], [seeded(seed, F.col(key)), F.col(key)], per).drop("rn")
    number = F.row_number().over(Window.orderBy(seeded(f"pack{seed}", F.col(key)), F.col(key)))  # strata * per rows
    return few.withColumn("sample_name", F.format_string("sample_%02d", number))


def concat_predictions(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.withColumn("holdout", F.lit(name)) for name, p in parts.items()])


def condition_plan(images: DataFrame) -> DataFrame:
    """images: path, width, height -> one row for each condition with target size and name; never scaled up, at least 1 pixel."""
    rows = [F.struct(F.lit(n).alias("condition"), F.lit(s).cast("int").alias("side"), F.lit(f).alias("format"), F.lit(q).cast("int").alias("quality")) for n, s, f, q in CONDITIONS]
    planned = images.select("*", F.explode(F.array(*rows)).alias("c")).select(*images.columns, "c.*")
    longest = F.greatest("width", "height")
    scale = F.when(F.col("side").isNotNull() & (longest > F.col("side")), F.col("side") / longest)
    fit = lambda c: F.when(scale.isNull(), F.col(c)).otherwise(F.greatest(F.lit(1), F.bround(F.col(c) * scale, 0).cast("int")))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    name = F.concat("condition", F.lit("/"), stem, F.lit("__cond-"), "condition", F.when(F.col("format") == "PNG", ".png").otherwise(".jpg"))
    return planned.select("path", "condition", "format", "quality", fit("width").alias("target_width"), fit("height").alias("target_height"), name.alias("target"))



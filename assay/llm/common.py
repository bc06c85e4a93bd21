"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts: 0x20 and 0x09 to 0x0D.
BLANK = " \t\n\u000b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def columns(names: list[str]) -> list[Column]:
    """Columns by their names as they are, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def aliased(names: list[str]) -> tuple[list[Column], list[str]]:
    """Columns by their names under numbered names, and those: PySpark's Arrow maps cannot take names with dots."""
    plain = [f"__{i}" for i in range(len(names))]
    return [c.alias(n) for c, n in zip(columns(names), plain, strict=True)], plain


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def text_key(df: DataFrame, text: str = "text") -> list[Column]:
    """128 bits that stand for a whole text (null is its own value)."""
    t = F.col(text)
    return [F.xxhash64(t, F.lit(1)).alias("__k1"), F.xxhash64(F.lit(2), t).alias("__k2")]


def ranked(df: DataFrame, group: str, order: list[Column], rank: str, chunk: int = 2_000, per_slice: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without a whole group in one task.

    A group of n rows is dealt by the hash of `order` into ceil(n / chunk) slices; rows are numbered inside
    a slice, and the slices' running counts are added. The order inside a group is thus a fixed shuffle.
    Rows equal in all of `order` may swap their numbers. `per_slice` may add columns to the table of slices
    (__g, __slice, __ahead, __c), which reach the slices' rows without another shuffle of them.
    """
    # a key without nulls: equal joins on it keep the window's partitioning, so wide rows are shuffled once
    keyed = df.withColumn("__g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    slices = keyed.groupBy("__g").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("__slices"))
    dealt = keyed.join(F.broadcast(slices), "__g")  # one row for each group: sources or ring arcs
    dealt = dealt.withColumn("__h", F.xxhash64(F.lit(97), *order)).withColumn("__slice", F.pmod("__h", "__slices")).drop("__slices")
    counts = dealt.groupBy("__g", "__slice").agg(F.count(F.lit(1)).alias("__c"))
    ahead = counts.select(
        "__g", "__slice", (F.sum("__c").over(Window.partitionBy("__g").orderBy("__slice")) - F.col("__c")).alias("__ahead"), "__c"
    )
    ahead = per_slice(ahead) if per_slice else ahead.drop("__c")
    inside = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__g", "__slice").orderBy("__h", *order)) - 1)
    return inside.join(ahead, ["__g", "__slice"]).withColumn(rank, (F.col("__ahead") + F.col("__r")).cast("long")).drop("__g", "__slice", "__ahead", "__r", "__h")


def in_order(df: DataFrame, group: str, order: list[str], at: str) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in the given order (nulls first) without a whole group in one task.

    Rows are dealt by ranges of (group, order) and sorted; each task's rows of a group are numbered where they are, and
    the tasks' running counts are added: at most one row a task and group. group holds no nulls. Rows equal in all of
    `order` share a task and may swap their numbers.
    """
    placed = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__task", F.shiftrightunsigned("__id", 33))
    runs = placed.groupBy(group, "__task").agg(F.min("__id").alias("__low"), F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(group).orderBy("__task"))
    ahead = runs.select(group, "__task", (upto - F.col("__c") - F.col("__low")).alias("__shift"))
    return placed.join(ahead, [group, "__task"]).withColumn(at, F.col("__id") + F.col("__shift")).drop("__id", "__task", "__shift")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives the worker's freed memory back when its task ends: workers live on between tasks."""
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-made table; the JVM unpickles it, no Python runs for it on executors."""
    return spark.createDataFrame(rows, schema)


def hot_join(big: DataFrame, one: DataFrame, keys: list[str], least: int = 1_000, most: int = 1_000) -> DataFrame:
    """big joined with `one` (one row a key, no null keys) where a few keys may hold most rows of big.

    The `most` most frequent keys, if they have over `least` rows, are joined by broadcast, so their rows stay where
    they are; every other key has less than a `most`-th of all rows and is joined by shuffle. big is read three times.
    """
    hot = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > least).orderBy(F.desc("__n"), *keys).limit(most).select(*keys)
    few = one.join(F.broadcast(hot), keys, "left_semi")
    return (
        big.join(F.broadcast(few), keys)
        .unionByName(big.join(F.broadcast(hot), keys, "left_anti").join(one, keys))
    )

"""Tables laid out for later joins and filters: bucketed and sorted Parquet, sorted ORC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession


def bucketed_table(df: DataFrame, name: str, path: str, keys: list[str], buckets: int, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as the table `name` under path, in buckets of the keys' hash and sorted by them, and read it.

    One task writes a bucket, so a bucket is one file. Tables of the same keys and number of buckets join, and aggregate by
    the keys, without an exchange. The table's files outlive its name, which is the session's. Bucketed tables must not be
    united and then grouped by their keys (Spark 4.1 groups the parts of such a union apart): read the files for that.
    """
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def orc_table(df: DataFrame, path: str, sort_by: list[str], bloom: list[str] | None = None) -> DataFrame:
    """Write df as ORC, its files sorted, so that the least and largest values of stripes tell which ones a filter can leave
    out; bloom filters do so for equality on the named columns. Read it back."""
    writer = df.sortWithinPartitions(*sort_by).write.mode("overwrite")
    if bloom:
        writer = writer.option("orc.bloom.filter.columns", ",".join(bloom))
    writer.orc(path)
    return df.sparkSession.read.schema(df.schema).orc(path)


def joined_in_place(spark: SparkSession, left: str, right: str, keys: list[str], how: str = "inner", keep: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """The join of two bucketed tables by their keys, as they lie. The join is a merge of buckets, never a broadcast, so it
    holds for sides of any size."""
    a, b = spark.table(left), spark.table(right)
    if keep:
        b = b.filter(keep(b))
    return a.join(b.hint("merge"), keys, how)

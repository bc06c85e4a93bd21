"""Line de-duplication with levelled sorted runs.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys shorter than `min_chars` are
left alone. The store holds runs of (h1, h2, n_docs, top_doc, fresh) by a 128-bit key hash, bucketed by it and sorted in
each bucket. Documents arrive in batches. Each batch is reduced to its distinct keys with the number of its documents that
hold a key and the largest id among them, and merge-anti-joined with the runs: keys that no run holds are its fresh keys, the
others are counts to add to a key that an earlier batch brought. So a key is fresh in exactly one run, and most keys, which
one batch holds and no other, are never looked at again but as the other side of a merge. The runs' buckets are joined as
they lie: only the batch is shuffled. As soon as a level holds `fanout` runs they are compacted into one of the next level.

A line goes if its key is in `min_docs` documents or more and this is not the largest one. This is known only when the
last batch is in: each run's fresh keys then meet the counts, and what reaches `min_docs` joins the lines; what goes is a
list of line numbers for each document. Runs are tables in the shared folder, so a lost executor costs a re-read only.

A null or empty text is one empty line. Rows that share a doc_id are one document; null ids are one document, the
smallest. A very common line is counted with map-side partial sums and joined by broadcast, so no task sees all its holders.
A document of very many lines costs time in proportion to its lines.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import BLANK, ascii_lower
from assay.session import cut, shared_dir
from assay.sources.layout import bucketed_table

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 6, 3
HOT_LINES = 10_000
HASH = ["h1", "h2"]


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def key_hash(key: Column) -> Column:
    """128 bits, so that even a trillion keys do not collide."""
    return F.struct(F.xxhash64(key, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))


@dataclass
class Run:
    """A run as a table of buckets, for joins as it lies, and as rows. Tables of buckets must not be united and then grouped:
    Spark 4.1 takes the union to be in buckets as well and groups the parts apart (tests/llm holds a case)."""

    table: DataFrame
    rows: DataFrame


class LineRuns:
    """Levelled runs of line hashes under one folder of the shared store, in as many buckets as the session's shuffles have parts."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.tag = spark, fanout, uuid.uuid4().hex
        self.folder = folder or f"{shared_dir(spark)}/line-runs-{self.tag}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> Run:
        number, self.made = self.made, self.made + 1
        path = f"{self.folder}/run-{number}"
        table = bucketed_table(rows, f"line_runs_{self.tag}_{number}", path, HASH, self.buckets)
        return Run(table, self.spark.read.schema(rows.schema).parquet(path))

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def marked(self, keys: DataFrame) -> DataFrame:
        """keys (distinct h1, h2) plus fresh: whether no run holds it."""
        names = keys.columns
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.table.filter("fresh").select(*HASH, F.lit(True).alias(f"__run{i}")), HASH, "left")
        found = F.coalesce(*[F.col(f"__run{i}") for i in range(len(self.runs()))], F.lit(False))
        return keys.select(*names, (~found).alias("fresh"))

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, doc_id) of documents that no earlier batch held, repeats allowed."""
        counts = batch.distinct().groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))
        run = self._write(self.marked(counts))
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            together = reduce(DataFrame.unionByName, [r.rows for r in self.levels[level]])
            run = self._write(together.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"), F.bool_or("fresh").alias("fresh")))
            self.levels[level] = []
            level += 1

    def common(self, min_docs: int) -> DataFrame:
        """h1, h2, n_docs and top_doc of the keys that min_docs documents hold: each run's fresh keys with all later counts."""
        later = reduce(DataFrame.unionByName, [r.rows.filter("NOT fresh") for r in self.runs()])
        later = later.groupBy(*HASH).agg(F.sum("n_docs").alias("more"), F.max("top_doc").alias("last"))
        total = (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs")
        parts = [r.table.filter("fresh").join(later, HASH, "left").select(*HASH, total, F.greatest("top_doc", "last").alias("top_doc")) for r in self.runs()]
        return reduce(DataFrame.unionByName, parts).filter(F.col("n_docs") >= min_docs)

    def entries(self) -> DataFrame:
        """Every key with the counts of all batches."""
        return self.common(0).withColumn("fresh", F.lit(True))


def unseen(batch: DataFrame, runs: LineRuns) -> DataFrame:
    """The rows (h1, h2, ...) of a new batch whose line no run holds yet: the incremental keep-first form."""
    return runs.marked(batch).filter("fresh").drop("fresh")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs plus kept_text, n_lines and n_dropped; columns of these names are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    runs = LineRuns(spark, fanout=fanout)
    table = f"{runs.folder}/lines"
    (
        docs.select(
            F.col(key).alias("doc_id"), F.xxhash64(text).alias("t"), F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("_batch"),
            F.posexplode(lines(F.col(text))).alias("at", "_line"),
        )
        .withColumn("_key", line_key(F.col("_line")))
        .filter(F.length("_key") >= min_chars)
        .withColumn("h", key_hash(F.col("_key")))
        .select("h.h1", "h.h2", "doc_id", "t", "at", "_batch")
        .write.partitionBy("_batch").parquet(table)
    )
    id_type = docs.schema[key].dataType.simpleString()
    held = spark.read.schema(f"h1 long, h2 long, doc_id {id_type}, t long, at int, _batch int").parquet(table)
    for b in range(batches):
        runs.add(held.filter(F.col("_batch") == b).select("h1", "h2", "doc_id"))
    common = cut(runs.common(min_docs))
    # fewer than HOT_LINES keys can have this many holders, so these are broadcast and never meet in one task
    many = max(min_docs, held.count() // HOT_LINES + 1)
    hot = F.broadcast(common.filter(F.col("n_docs") >= many))
    rest = held.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(common.filter(F.col("n_docs") < many), ["h1", "h2"])
    drops = (
        held.join(hot, ["h1", "h2"])
        .unionByName(rest)
        .filter(~F.col("doc_id").eqNullSafe(F.col("top_doc")))
        .groupBy(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))  # rows of one id may have several texts
        .agg(F.collect_set("at").alias("__drop"))
    )
    marked = docs.join(drops, docs[key].eqNullSafe(drops["__id"]) & (F.xxhash64(docs[text]) == drops["__t"]), "left").drop("__id", "__t")
    every = lines(F.col(text))
    numbers = F.sequence(F.lit(0), F.size(every) - 1)
    # the lines are bound once (x), so that a text is not split again for each of them
    left = F.element_at(F.transform(F.array(every), lambda x: F.transform(F.array_except(numbers, F.col("__drop")), lambda i: F.get(x, i))), 1)
    return (
        marked.withColumn("n_lines", F.size(every).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("long"))
        .withColumn("kept_text", F.when(F.col("__drop").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(left, "\n")))
        .drop("__drop")
    )

"""Consistent-hash sharding with virtual nodes and bounded loads (DataFrame functions only).

Every shard owns `vnodes` points on a 64-bit ring; a text's hash finds the next point clockwise, so equal texts
start at the same point. A shard takes at most its capacity; what overflows continues clockwise to the next
point of a shard with room. Capacities are floor(n / shards) or one more, so shard counts end at most one apart.

Rows are counted per arc (shards * vnodes counts, whatever the input). The driver turns these counts into a
plan of (arc, from, to, shard) intervals; each row then finds its interval by its number within the arc.
A huge group of copies is one hot arc: its rows are numbered in slices, never in one task.

Null text: size 8, CRC of no bytes, placed like any text. Empty table: empty result. Repeated rows are each placed.
"""

from __future__ import annotations

import uuid

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import columns, ranked, rows_of
from assay.session import cut, shared_dir

VNODES = 64
#: Positions of a given order in one span; a shard's rows are numbered span by span.
SPAN = 4096


def ring(shards: int, vnodes: int = VNODES) -> tuple[list[int], list[int]]:
    """(shard of each arc in clockwise order, arc of each cell of the ring).

    The ring has a power of two of cells, at least 32 for each virtual node; a cell is the leading bits of a hash, so
    nodes and texts stay where they are when more shards need a finer ring. A node whose cell is taken moves on
    clockwise, so every node has its own arc.
    """
    bits = (32 * shards * vnodes - 1).bit_length()
    cells = 1 << bits
    owner: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at = xxhash.xxh64_intdigest(f"{s}/{v}") >> (64 - bits)
            while at in owner:
                at = (at + 1) % cells
            owner[at] = s
    spots = sorted(owner)
    arc_of, arc = [], 0
    for cell in range(cells):
        while arc < len(spots) and spots[arc] < cell:
            arc += 1
        arc_of.append(arc % len(spots))
    return [owner[x] for x in spots], arc_of


def spill_plan(owners: list[int], demand: dict[int, int], shards: int) -> list[tuple]:
    """(arc, lo, hi, shard, base): intervals of each arc's rows by shard. Bounded by the ring, not by the rows.

    First every shard serves its own arcs, in ring order; then two turns round the ring hand the rest on.
    """
    total = sum(demand.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    held = [0] * shards
    plan: list[tuple] = []

    def place(arc: int, start: int, n: int, shard: int) -> int:
        took = min(n, room[shard])
        if took:
            plan.append((arc, start, start + took, shard, held[shard]))
            room[shard] -= took
            held[shard] += took
        return took

    rest = []
    for arc, shard in enumerate(owners):
        n = demand.get(arc, 0)
        took = place(arc, 0, n, shard)
        if took < n:
            rest.append([arc, took, n])
    waiting: list[list[int]] = []
    starts = {arc: (arc, lo, hi) for arc, lo, hi in rest}
    for step in range(2 * len(owners)):
        at = step % len(owners)
        while waiting and room[owners[at]]:
            arc, lo, hi = waiting[0]
            waiting[0][1] += place(arc, lo, hi - lo, owners[at])
            if waiting[0][1] == hi:
                waiting.pop(0)
        if at in starts:
            waiting.append([*starts.pop(at)])
    return plan


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus size, text_crc32 and the text's ring hash __t."""
    return (
        docs.drop("size", "text_crc32")
        .withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8)
        .withColumn("text_crc32", F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
        .withColumn("__t", F.xxhash64(text))
    )


def shard_rows(docs: DataFrame, shards: int, vnodes: int = VNODES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs plus size, text_crc32, shard and slot; shard counts differ by at most one, slots run gapless from 0.

    Columns of docs named shard, slot, size or text_crc32 are replaced. The broadcast plan has at most
    shards * vnodes + shards + arcs intervals, whatever the input.
    """
    return place(measured(docs.drop("shard", "slot"), text), shards, vnodes, key).drop("__t")


def place(rows: DataFrame, shards: int, vnodes: int = VNODES, key: str = "doc_id") -> DataFrame:
    """rows with a ring hash __t, plus shard and slot."""
    spark = rows.sparkSession
    owners, arc_of = ring(shards, vnodes)
    cells = rows_of(spark, list(enumerate(arc_of)), "__cell int, __arc int")
    placed = (
        rows.withColumn("__cell", F.shiftrightunsigned("__t", 65 - len(arc_of).bit_length()).cast("int"))
        .join(F.broadcast(cells), "__cell")
        .drop("__cell")
    )
    demand = {r["__arc"]: r["n"] for r in placed.groupBy("__arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spill_plan(owners, demand, shards)
    spans = rows_of(spark, plan, "__plan_arc int, __lo long, __hi long, shard int, __base long")
    numbered = ranked(placed, "__arc", [F.col("__t"), F.col(key)], "__at")
    return (
        numbered.join(F.broadcast(spans), (F.col("__arc") == F.col("__plan_arc")) & (F.col("__at") >= F.col("__lo")) & (F.col("__at") < F.col("__hi")))
        .withColumn("slot", F.col("__base") + F.col("__at") - F.col("__lo"))
        .drop("__plan_arc", "__lo", "__hi", "__base", "__arc", "__at")
    )


def slots_by(placed: DataFrame, position: str) -> DataFrame:
    """shard_rows' result with the slots of each shard in the order of `position` (distinct numbers from 0 without large gaps).

    Rows are numbered inside spans of positions, and the spans' running counts are added.
    """
    dealt = placed.drop("slot").withColumn("__span", F.floor(F.col(position) / SPAN))
    counts = dealt.groupBy("shard", "__span").agg(F.count(F.lit(1)).alias("__c"))
    ahead = counts.select("shard", "__span", (F.sum("__c").over(Window.partitionBy("shard").orderBy("__span")) - F.col("__c")).alias("__ahead"))
    inside = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("shard", "__span").orderBy(position)) - 1)
    return inside.join(ahead, ["shard", "__span"]).withColumn("slot", (F.col("__ahead") + F.col("__r")).cast("long")).drop("__span", "__ahead", "__r")


def in_file_order(docs: DataFrame, position: str) -> DataFrame:
    """docs plus the place of each row in the order of its files: by file name, then by the row's number in the file.

    Spark rereads files in any order, but their names and rows keep the order in which a sort wrote them. docs comes
    straight from files (filters may follow). Positions are distinct and start at 0; filtered rows leave gaps.
    """
    seen = docs.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    files = seen.groupBy("__file").agg((F.max("__row") + 1).alias("__rows"))
    every = Window.orderBy(F.length("__file"), "__file")  # one row a file; part-100000 follows part-99999
    ahead = files.select("__file", (F.sum("__rows").over(every) - F.col("__rows")).alias("__ahead"))
    return seen.join(ahead, "__file").withColumn(position, F.col("__ahead") + F.col("__row")).drop("__file", "__row", "__ahead")


def shards_in_order(docs: DataFrame, shards: int, vnodes: int = VNODES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """shard_rows' result with the slots of each shard in the order of docs' files, and that order as mix_position.

    Rows that come from no files are written first. Shards and slots are found for rows of hashes; texts are shuffled
    once, to join the result by position.
    """
    spark = docs.sparkSession
    new = ["size", "text_crc32", "shard", "slot", "mix_position"]
    docs = docs.drop(*new)
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # no files below
        path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
        docs.write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    seen = in_file_order(docs, "mix_position")
    thin = measured(seen.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), "mix_position")).drop("text")
    found = slots_by(place(cut(thin), shards, vnodes), "mix_position").select(*new)
    return seen.join(found, "mix_position").select(*columns(docs.columns), *new)

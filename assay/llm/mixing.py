"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only over the rows).

Each source's rows are cut into blocks. With the exact target weight w, block k of a source may not come before its
release floor(k/w) and not after its deadline ceil((k+1)/w); of the released blocks the one with the earliest deadline
goes next. As the weights of the live sources sum to one, every block keeps to its window, so every source is, at every
slot, less than one block away from its target. Weights are whole numbers of any size, taken from the exact value of the
given ones: nothing is rounded to a grid, and nothing drifts.

No row is dropped or repeated. When a source runs out, a new phase begins with the weights of those that remain;
sources of weight 0 come after all others, alike among themselves.

The driver handles one count for each source and one slot for each block, never a row. A block is a MAX_BLOCKS-th of
the table, `block_rows` rows at least, so the plan has at most MAX_BLOCKS + sources slots, whatever the input: 32 MB as
a table of arrays. Rows find their block by their number in the source, which is counted in slices (`ranked`); each
slice receives the slots of its own blocks, so the rows are shuffled once.

Null source: a source of its own. Sources without a given weight have weight 0. Empty table: empty result. Repeated
rows are each kept; ties between equal rows may swap places. Negative, infinite or undefined weights raise ValueError.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import columns, ranked, rows_of

BLOCK_ROWS, MAX_BLOCKS = 32, 1 << 20
#: Blocks in one row of the plan's table.
CHUNK = 512


def whole_weights(weights: dict) -> dict:
    """Whole numbers in the exact ratio of the weights."""
    for s, w in weights.items():
        if not math.isfinite(w) or w < 0:
            raise ValueError(f"weight of {s!r} must be a finite number of 0 or more")
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    return {s: int(w * unit) for s, w in exact.items()}


def schedule(blocks: list[int], weights: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(source, block, phase, release, deadline) at each slot: earliest deadline first among released blocks."""
    out: list[tuple[int, int, int, int, int]] = []
    placed = [0] * len(blocks)
    phase = 0
    while True:
        live = [i for i, b in enumerate(blocks) if placed[i] < b]
        own = {i: weights[i] for i in live if weights[i]} or dict.fromkeys(live, 1)
        if not own:
            return out
        total, start, first = sum(own.values()), len(out), placed[:]
        coming = [(0, -(-total // w), i) for i, w in own.items()]
        heapq.heapify(coming)
        ready: list[tuple[int, int, int]] = []
        running = True
        while running:
            slot = len(out) - start
            while coming and coming[0][0] <= slot:
                release, deadline, i = heapq.heappop(coming)
                heapq.heappush(ready, (deadline, i, release))
            deadline, i, release = heapq.heappop(ready)
            if deadline <= slot:
                raise AssertionError("a block missed its deadline")
            out.append((i, placed[i], phase, start + release, start + deadline))
            placed[i] += 1
            k = placed[i] - first[i]
            running = placed[i] < blocks[i]
            heapq.heappush(coming, (k * total // own[i], -(-(k + 1) * total // own[i]), i))
        phase += 1


def plan_rows(counts: list[int], weights: list[int], block_rows: int) -> list[tuple]:
    """(source, first block, slots, phases, releases, deadlines, first mix positions) by chunks of a source's blocks."""
    lines: list[list[tuple]] = [[] for _ in counts]
    at = 0
    for slot, (i, k, phase, release, deadline) in enumerate(schedule([-(-n // block_rows) for n in counts], weights)):
        lines[i].append((slot, phase, release, deadline, at))
        at += min(block_rows, counts[i] - k * block_rows)
    return [
        (i, lo, *map(list, zip(*line[lo : lo + CHUNK], strict=True)))
        for i, line in enumerate(lines) for lo in range(0, len(line), CHUNK)
    ]


def mix(docs: DataFrame, weights: dict | None = None, source: str = "source", key: str = "doc_id", text: str | None = "text",
        block_rows: int = BLOCK_ROWS, power: float = 0.5, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """docs plus weight, phase, block, slot, release, deadline and mix_position (gapless from 0), every row kept.

    slot, release and deadline count blocks from the start of the whole mix; weight is the source's share of all
    weights. The weights name sources (None for the null source); the default is the sources' row counts to `power`.
    Columns of these names are replaced. `text` may name the text's xxhash64 instead: the mix is the same.
    """
    spark = docs.sparkSession
    docs = docs.drop("weight", "phase", "block", "slot", "release", "deadline", "mix_position")
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts, key=lambda s: (s is not None, s))
    block_rows = max(block_rows, -(-sum(counts.values()) // max_blocks))
    whole = whole_weights({s: counts[s] ** power for s in names} if weights is None else {s: weights.get(s, 0) for s in names})
    total = sum(whole.values()) or 1
    lines = plan_rows([counts[s] for s in names], [whole[s] for s in names], block_rows)
    table = [("" if (s := names[i]) is None else f"={s}", float(Fraction(whole[s], total)), *rest) for i, *rest in lines]
    chunks = rows_of(
        spark, table,
        "__g string, weight double, __first bigint, slot array<bigint>, phase array<int>, release array<bigint>, deadline array<bigint>, __at array<bigint>",
    )
    fields = ["slot", "phase", "release", "deadline", "__at"]
    placed = chunks.select("__g", "weight", "__first", F.posexplode(F.arrays_zip(*fields)).alias("__i", "__b")).select(
        "__g", (F.col("__first") + F.col("__i")).alias("block"), "weight", *[f"__b.{c}" for c in fields]
    )

    def blocks_of_slices(slices: DataFrame) -> DataFrame:
        """Each slice of a source's rows with the places of the blocks it touches."""
        first, last = F.floor(F.col("__ahead") / block_rows), F.floor((F.col("__ahead") + F.col("__c") - 1) / block_rows)
        touched = slices.select("__g", "__slice", "__ahead", first.alias("__low"), F.explode(F.sequence(first, last)).alias("block"))
        line = F.struct("block", "weight", *fields)
        return touched.join(placed, ["__g", "block"]).groupBy("__g", "__slice", "__ahead", "__low").agg(F.array_sort(F.collect_list(line)).alias("__blocks"))

    order = [F.col(key)]
    if text and text in docs.columns:
        order.append(F.col(text) if docs.schema[text].dataType.simpleString() == "bigint" else F.xxhash64(text))
    numbered = ranked(docs.withColumn("__source", F.col(source).cast("string")), "__source", order, "__n", per_slice=blocks_of_slices)
    own = F.element_at("__blocks", (F.floor(F.col("__n") / block_rows) - F.col("__low") + 1).cast("int"))
    return numbered.withColumn("__b", own).select(
        *columns(docs.columns), "__b.weight", "__b.phase", "__b.block", "__b.slot", "__b.release", "__b.deadline",
        (F.col("__b.__at") + F.col("__n") % block_rows).alias("mix_position"),
    )

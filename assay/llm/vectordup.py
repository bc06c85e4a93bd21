"""Near-duplicates among vectors of equal labels by cosine, found exactly with a PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the axes of the second-moment matrix of all of them (summed over the
whole table), most energy first. Equal vectors of a label are one node with a count. The nodes of a label are ordered
along a space-filling curve over the leading axes and cut into tiles of TILE; a tile knows its box, the least and largest
coordinate on each leading axis. Two tiles meet only if their boxes are near enough for the threshold.

Inside a pair of tiles the inner products are accumulated over the leading axes first. After each step the rest of a
pair's product is at most the product of the two suffix norms: pairs that cannot reach the threshold are left, and what
remains goes on as a list of pairs, or as a whole block if most of it remains. Pairs that end within SLACK of the
threshold are decided by the inner product of the vectors as given over the product of their norms.

A pair of tiles gives one row for each linked node: how many vectors it links to, and one node of its group in these two
tiles, so a dense group costs as many rows as nodes and never its pairs. Copies are linked among themselves by count.

Null labels, and vectors that are null, zero, of another length than most, or hold null or non-finite components, link
with nothing: they are classes of their own. Rows that repeat an id are vectors of their own. Null ids are left out of
the smallest ids of a class; a class of null ids alone has none and keeps nothing. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.ann import usable
from assay.llm.common import columns, hot_join, in_order, tidy
from assay.operators.graph import connected_components
from assay.session import cut, ship

THRESHOLD, TILE = 0.93, 1_024
#: Axes of the curve and of the boxes, bits of each on the curve, axes in the first steps of the sums.
CURVE_AXES, BOX_AXES, CURVE_BITS, STEPS = 4, 12, 12, (8, 8, 16)
#: Rows of a tile compared at once, share of a strip from which it goes on whole, what rounding may hide.
STRIP, DENSE, SLACK = 256, 1 / 16, 1e-9
#: Copies of a tile's row that share the search for partner tiles of a large label.
SLICES = 16


def _matrix(column: pd.Series | pa.Array, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, width))


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes (columns) of the second moments of all unit vectors, most energy first. The driver gets width squared numbers."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            if len(b):
                x = _matrix(b["v"], width)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"][:1], "row": [np.sum(rows["row"].to_list(), axis=0)]})

    sums = vectors.select("v").mapInPandas(moments, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>").orderBy("i").collect()
    if not sums:
        return np.eye(width)
    _, axes = np.linalg.eigh(np.array([r["row"] for r in sums]))
    return np.ascontiguousarray(axes[:, ::-1])


def curve(x: np.ndarray) -> np.ndarray:
    """Places along a curve that takes the bits of the leading coordinates in turn, so that near places are near points."""
    axes = min(CURVE_AXES, x.shape[1])
    level = np.clip((x[:, :axes] + 1) * (1 << CURVE_BITS - 1), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for bit in range(CURVE_BITS - 1, -1, -1):
        for a in range(axes):
            out = out << 1 | level[:, a] >> bit & 1
    return out


def join_groups(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The groups (each named by its smallest member) after joining those of a[i] and b[i]."""
    while True:
        x, y = group[a], group[b]
        apart = x != y
        if not apart.any():
            return group
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        new = group.copy()
        np.minimum.at(new, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := new[new], new):
            new = up
        group = new[group]


def linked(x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows whose cosine reaches the threshold. x, y: unit vectors in the axes; vx, vy: as given."""
    width, least = x.shape[1], threshold - SLACK
    ends = np.r_[np.cumsum([s for s in STEPS if s < width]), width]
    ends = np.unique(np.minimum(ends, width))
    tail = lambda v, at: np.sqrt((v[:, at:] ** 2).sum(axis=1))
    sums = x[:, : ends[0]] @ y[:, : ends[0]].T
    at, i, j = int(ends[0]), None, None
    for end in map(int, ends[1:]):
        if i is None:
            alive = sums + np.outer(tail(x, at), tail(y, at)) >= least
            n = int(alive.sum())
            if n > DENSE * sums.size:
                sums += x[:, at:end] @ y[:, at:end].T
            else:
                i, j = np.nonzero(alive)
                sums = sums[i, j]
        if i is not None:
            keep = sums + tail(x, at)[i] * tail(y, at)[j] >= least
            i, j, sums = i[keep], j[keep], sums[keep]
            if not len(i):
                return i, j
            sums = sums + np.einsum("ij,ij->i", x[i, at:end], y[j, at:end])
        at = end
    if i is None:
        i, j = np.nonzero(sums >= least)
        sums = sums[i, j]
    near = np.flatnonzero(np.abs(sums - threshold) <= SLACK)
    p, q = vx[i[near]], vy[j[near]]
    sums[near] = (p * q).sum(axis=1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
    keep = sums >= threshold
    return i[keep], j[keep]


def compare(a: dict, b: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, vectors it links to, a node of its group here) of the linked nodes of two tiles (or within one, b None)."""
    other = b or a
    n, shift = len(a["node"]), len(a["node"]) if b else 0
    group, counts = np.arange(n + (len(other["node"]) if b else 0)), np.zeros(n + (len(other["node"]) if b else 0), np.int64)
    for at in range(0, n, STRIP):
        start = 0 if b else at  # within a tile: each pair once
        i, j = linked(a["x"][at : at + STRIP], other["x"][start:], a["v"][at : at + STRIP], other["v"][start:], threshold)
        i, j = i + at, j + start
        if not b:
            i, j = i[i < j], j[i < j]
        np.add.at(counts, i, other["copies"][j])
        np.add.at(counts, j + shift, a["copies"][i])
        group = join_groups(group, i, j + shift)
    node = np.r_[a["node"], b["node"]] if b else a["node"]
    some = np.flatnonzero(counts)
    return node[some], counts[some], node[group[some]]


def unit_links(nodes: DataFrame, width: int, threshold: float) -> DataFrame:
    """nodes: label, node, copies, v -> (node, links, with): one row for each node linked in a pair of tiles."""
    spark = nodes.sparkSession
    axes = spark.sparkContext.broadcast(principal_axes(nodes, width))  # width squared
    boxes_of = min(BOX_AXES, width)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select(["label", "node", "copies", "v"]).append_column("place", pa.array(curve(turned(_flat(b.column("v"), width), axes.value))))

    placed = in_order(nodes.mapInArrow(tidy(turn), "label string, node long, copies long, v array<double>, place long"), "label", ["place", "node"], "at")
    tiles = placed.groupBy("label", F.floor(F.col("at") / TILE).alias("tile")).agg(F.sort_array(F.collect_list(F.struct("node", "copies", "v"))).alias("rows"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = b.column("rows")[i].values
                v = _flat(rows.field("v"), width)
                lead = turned(v, axes.value)[:, :boxes_of]
                raw = [pa.array([x.tobytes()], pa.binary()) for x in (rows.field("node").to_numpy(), rows.field("copies").to_numpy(), v)]
                yield pa.RecordBatch.from_arrays([b.column("label").slice(i, 1), b.column("tile").slice(i, 1), *raw, pa.array([lead.min(axis=0)]), pa.array([lead.max(axis=0)])], ["label", "tile", "node", "copies", "v", "low", "high"])

    tiles = cut(tiles.mapInArrow(tidy(pack), "label string, tile long, node binary, copies binary, v binary, low array<double>, high array<double>"))
    pairs = cut(near_tiles(tiles.select("label", "tile", "low", "high"), threshold))
    cargo = ["node", "copies", "v"]
    left = pairs.join(tiles.select("label", F.col("tile").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cargo]), ["label", "a"])
    both = left.join(tiles.select("label", F.col("tile").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cargo]), ["label", "b"]).drop("label")
    # a pair of tiles is work for seconds, whatever its bytes
    spread = max(1, min(pairs.count(), 64 * spark.sparkContext.defaultParallelism))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tile = lambda side: _tile(*(b.column(f"{side}_{c}")[i].as_py() for c in cargo), width, axes.value)  # noqa: B023,E731
                found = compare(tile("a"), None if b.column("a")[i].as_py() == b.column("b")[i].as_py() else tile("b"), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "links", "with"])

    return both.repartition(spread).mapInArrow(tidy(meet), "node long, links long, with long")


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def turned(v: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors in the axes; scaled by the largest component first, so that no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)) @ axes


def _tile(node: bytes, copies: bytes, v: bytes, width: int, axes: np.ndarray) -> dict:
    vectors = np.frombuffer(v, np.float64).reshape(-1, width)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return {"node": np.frombuffer(node, np.int64), "copies": np.frombuffer(copies, np.int64), "v": vectors, "x": turned(vectors, axes)}


def near_tiles(tiles: DataFrame, threshold: float) -> DataFrame:
    """label, a, b (a <= b): the tiles whose boxes hold points near enough. Unit vectors of this cosine are at most sqrt(2 - 2 cos) apart.

    A label's tiles are a TILE-th of its nodes; each is met in SLICES parts, so a large label is no single task.
    """
    left = tiles.select("label", F.col("tile").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah"), F.pmod("tile", F.lit(SLICES)).alias("part"))
    right = tiles.select("label", F.col("tile").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))).alias("part"))
    gap = F.transform(F.arrays_zip("al", "ah", "bl", "bh"), lambda s: F.greatest(s["al"] - s["bh"], s["bl"] - s["ah"], F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return left.join(right, ["label", "part"]).filter((F.col("a") <= F.col("b")) & (apart <= 2 - 2 * threshold + SLACK)).select("label", "a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row a vector: key, n_links, component_id and kept; threshold above 0."""
    spark = vectors.sparkSession
    ship(spark)
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    k, v, lab = columns([key, vector, label])
    rows = vectors.select(k.alias("id"), F.when(usable(v) & lab.isNotNull(), v.cast("array<double>")).alias("v"), lab.cast("string").alias("label"))
    usual = rows.filter("v IS NOT NULL").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = usual["n"] if usual else 1
    hashes: list[Column] = [F.xxhash64("label", "v", F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), "v", "label").alias("k2")]
    alone = F.coalesce(F.size("v") != width, F.lit(True))
    good = rows.filter(~alone).select("id", "label", "v", *hashes)
    # -0.0 and 0.0 hash apart: such vectors are two nodes with a link
    nodes = good.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"))
    nodes = cut(in_order(nodes.withColumn("one", F.lit(0)), "one", ["k1", "k2"], "node").drop("one"))
    links = cut(unit_links(nodes.select("label", "node", "copies", "v"), width, threshold))
    classes = connected_components(links.select(F.col("node").alias("a"), F.col("with").alias("b")))
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        nodes.select("k1", "k2", "node", "copies", "low").join(degree, "node", "left").join(classes, "node", "left")
        .select("k1", "k2", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("class"))
    )
    named = cut(named)
    lowest = named.groupBy("class").agg(F.min("low").alias("component_id"))
    by_node = cut(hot_join(named, lowest, ["class"]).select("k1", "k2", "n_links", "component_id"))
    found = hot_join(good.select("id", "k1", "k2"), by_node, ["k1", "k2"]).select("id", "n_links", "component_id")
    rest = rows.filter(alone).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = found.unionByName(rest)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

"""Connected components by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.session import cut, ship

MAX_ROUNDS = 60
#: Links of a node that one task may meet. Nodes with a thousandth of all links or more are few enough for a broadcast.
HUB, FEW = 100_000, 1_000

#: Links that a task looks at together, and how many times fewer of them must do to replace them.
CHUNK, GAIN = 1 << 21, 2


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reachable from each of 0 to n - 1 by the links."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])  # roots hang under smaller roots
        while (root != root[root]).any():
            root = root[root]
    return root


def _thinned(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    """A forest with the components of the links, if it has that far fewer."""
    both = pa.Table.from_batches(held)
    n = both.num_rows
    met = pa.chunked_array([*both["a"].chunks, *both["b"].chunks]).combine_chunks().dictionary_encode()
    codes, names = met.indices.to_numpy(), met.dictionary
    if len(names) * GAIN > n:
        return None
    root = _roots(codes[:n], codes[n:], len(names))
    leaf = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(leaf)), names.take(pa.array(root[leaf]))], schema=held[0].schema)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links in chunks: the forest of one is the beginning of the next. From a chunk on that stays, all pass as they are."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        batch = batch.filter(pc.not_equal(batch["a"], batch["b"]))  # nulls go too
        held.append(batch)
        n += batch.num_rows
        if n < CHUNK:
            continue
        forest = _thinned(held)
        if forest is None:
            yield from held
            yield from (b.filter(pc.not_equal(b["a"], b["b"])) for b in batches)
            return
        held, n = [forest], forest.num_rows
    if n:
        forest = _thinned(held)
        yield from held if forest is None else [forest]


def spanning_links(links: DataFrame) -> DataFrame:
    """(a, b) links of numbers or strings -> links with the same components, often as few as a small multiple of the nodes.

    Tasks thin out the links first as they lie, then those of the same `a`; a hub's links are dealt over tasks.
    """
    links = links.select("a", "b")
    if not all(isinstance(f.dataType, (T.StringType, T.IntegralType)) for f in links.schema):
        return links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    ship(links.sparkSession)
    thin = lambda df: df.mapInArrow(_forest, links.schema)
    return thin(thin(links).hint("rebalance", F.col("a")))


def _meet(links: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """links (a, b) joined with low (a, m): the links of a hub are dealt over as many tasks as they need."""
    if n <= HUB:
        return links.join(low, "a")
    hubs = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(HUB, n // FEW)).select("a", F.ceil(F.col("n") / HUB).cast("int").alias("parts"))
    hubs = F.broadcast(hubs)  # at most 2 * FEW nodes
    dealt = links.join(hubs, "a", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), "parts").cast("int"))).drop("parts")
    copies = low.join(hubs, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, ["a", "part"]).drop("part")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m"))
    return _meet(both.filter("b > a"), low, n).select(F.col("m").alias("a"), "b")  # no more links than before; the small star drops repeats


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    links = _meet(down, low, n)
    return links.select(F.col("m").alias("a"), "b").unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether each node is a centre or the leaf of one centre: then the centres, smaller than their leaves, name the components."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("centre"), F.lit(1).alias("leaf")))
    return roles.groupBy("node").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf")).filter("leaf > 1 OR centre = 1 AND leaf = 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of any orderable type -> (node, component) with the smallest node as label.

    Nulls and self links are left out. A hub's smallest neighbour is a min() with map-side combine, and its links are
    dealt over tasks. The rounds end when only stars are left. Lineage is cut each round in the shared folder.
    """
    edges = cut(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    rounds = 0
    while not _stars_only(edges):
        rounds += 1
        if rounds > MAX_ROUNDS:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        n = edges.count()
        edges = cut(_small_star(_large_star(edges, n), n))
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    centres = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return leaves.unionByName(centres)

"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner product is turned into distance: with M the largest norm, x becomes (x, sqrt(M^2 - |x|^2)) and a query
(q, 0), so the nearest extended vector has the largest inner product. Equal vectors are one entry with their k + 1
smallest ids (no other id of theirs can be among the k nearest), so copies are neither indexed nor searched twice.

The number of lists follows the number of distinct vectors: one for each LIST_TARGET of them, up to MAX_LISTS. Their
centroids come from balanced two-means splits of a sample of about SAMPLE_A_LIST vectors a list (by hash; at most
about MAX_LISTS * SAMPLE_A_LIST); they are searched through an in-memory neighbour graph by best-first walk. Every
vector is indexed: it goes to its nearest list, and boundary vectors also to further lists whose centroid is within
REPLICA_RATIO of the nearest distance, at most REPLICAS. A query probes the lists within PROBE_RATIO of its nearest
centroid's distance, MIN_PROBES at least and MAX_PROBES at most, whatever the table's size.

Inside a list the same splits make leaves of LEAF vectors, and a query looks at the LEAVES nearest of them (in lists of
up to LEAF * LEAVES vectors: at all), in double precision on the original vectors. So a query's work does not grow with
the table up to MAX_LISTS * LIST_ROWS vectors. A list larger than LIST_ROWS is dealt into parts by hash, and its queries
visit each part. Only each part's best k + 1 of a query travel on.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
rows without an id. Equal scores go to the smaller id. An id on several rows is one candidate, with the best score of
its vectors, and one query, with the best score for each candidate. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import hot_join
from assay.session import cut, ship

LIST_TARGET, MAX_LISTS, SAMPLE_A_LIST, LIST_ROWS = 100, 8_192, 24, 20_000
LEAF, LEAVES = 128, 12
REPLICAS, REPLICA_RATIO = 4, 1.10
MIN_PROBES, MAX_PROBES, PROBE_RATIO = 40, 80, 1.35
DEGREE, BEAM, ASSIGN_BEAM = 32, 128, 32


def usable(v: Column) -> Column:
    """A vector of finite components, not all zero."""
    d = v.cast("array<double>")
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(d.isNotNull() & finite & F.exists(d, lambda x: x != 0), F.lit(False))


def balanced_leaves(x: np.ndarray, leaf: int, seed: int = 3) -> list[np.ndarray]:
    """Row numbers of the leaves of repeated two-means splits at the median, so that all leaves are of like size."""
    rng = np.random.default_rng(seed)
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        part = x[rows]
        if len(rows) <= leaf or not np.ptp(part, axis=0).any():
            out.append(rows)
            continue
        a, b = part[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            side = part @ (a - b)
            order = np.argsort(side, kind="stable")
            half = len(rows) // 2
            b, a = part[order[:half]].mean(axis=0), part[order[half:]].mean(axis=0)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def balanced_centroids(x: np.ndarray, leaf: int) -> np.ndarray:
    return np.array([x[rows].mean(axis=0) for rows in balanced_leaves(x, leaf)])


@dataclass
class CentroidGraph:
    """Centroids with a neighbour graph; the size is bounded by the sample."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(centroids: np.ndarray) -> CentroidGraph:
        n = len(centroids)
        near = np.empty((n, min(DEGREE, max(n - 1, 1))), np.int64)
        square = (centroids**2).sum(axis=1)
        for at in range(0, n, 1024):
            d = square[None, :] - 2 * centroids[at : at + 1024] @ centroids.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf if n > 1 else 0.0
            near[at : at + 1024] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        # a few far-apart entry points, each the centroid farthest from those before it
        entries, far = [0], np.full(n, np.inf)
        for _ in range(min(n, 16) - 1):
            far = np.minimum(far, square - 2 * centroids @ centroids[entries[-1]] + square[entries[-1]])
            entries.append(int(np.argmax(far)))
        return CentroidGraph(centroids, near, np.array(entries))

    def search(self, q: np.ndarray, want: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the nearest found, nearest first: a best-first walk with a bounded beam."""
        beam = max(want, beam)
        seen = np.zeros(len(self.centroids), bool)
        seen[self.entries] = True
        d = np.linalg.norm(self.centroids[self.entries] - q, axis=1)
        open_ = list(zip(d.tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(open_)
        best = [(-x, i) for x, i in open_]
        heapq.heapify(best)
        while open_:
            x, i = heapq.heappop(open_)
            if len(best) >= beam and x > -best[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            if not len(new):
                continue
            seen[new] = True
            for y, j in zip(np.linalg.norm(self.centroids[new] - q, axis=1).tolist(), new.tolist(), strict=True):
                if len(best) < beam or y < -best[0][0]:
                    heapq.heappush(open_, (y, j))
                    heapq.heappush(best, (-y, j))
                    if len(best) > beam:
                        heapq.heappop(best)
        got = sorted((-x, i) for x, i in best)[:want]
        return np.array([i for _, i in got]), np.array([x for x, _ in got])


def _extend(v: np.ndarray, top: float) -> np.ndarray:
    return np.c_[v, np.sqrt(np.maximum(top**2 - (v**2).sum(axis=1), 0.0))]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


@dataclass
class Part:
    """One list, or part of one: its distinct vectors in leaves, each vector with its smallest ids."""

    vectors: np.ndarray
    ids: list[np.ndarray]

    def __post_init__(self) -> None:
        self.leaves = balanced_leaves(self.vectors, LEAF)
        self.centres = np.array([self.vectors[rows].mean(axis=0) for rows in self.leaves])

    def best(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the n best, ties to smaller ids; all vectors that tie with the last are looked at."""
        rows = np.arange(len(self.vectors))
        if len(self.leaves) > LEAVES:
            near = np.argpartition(-(self.centres @ q), LEAVES - 1)[:LEAVES]
            rows = np.concatenate([self.leaves[i] for i in near])
        s = (self.vectors[rows] * q).sum(axis=1)  # each pair summed alike, whatever its neighbours
        m = min(n, len(s))
        some = np.flatnonzero(s >= np.partition(s, len(s) - m)[len(s) - m])
        lens = [len(self.ids[i]) for i in rows[some]]
        ids, scores = np.concatenate([self.ids[i] for i in rows[some]]), np.repeat(s[some], lens)
        order = np.lexsort((ids, -scores))[:n]
        return ids[order], scores[order]


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """k1, k2, v, ids: each distinct vector with its `most` smallest ids."""
    one = rows.dropDuplicates(["k1", "k2", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    return one.withColumn("r", rank).filter(F.col("r") <= most).groupBy("k1", "k2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(base: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k nearest rows of base, its own id left out: query_id, rank, vec_id, score."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = base.sparkSession
    ship(spark)
    hashes = [F.xxhash64("v", F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2")]

    def clean(df: DataFrame, name: str) -> DataFrame:
        usual = df.filter(usable(F.col(vector)) & F.col(key).isNotNull())
        return usual.select(F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v")).select(name, "v", *hashes)

    rows = clean(base, "vec_id")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    lens = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.max(norm).alias("m")).orderBy(F.desc("c"), "n").first()
    if lens is None:
        return spark.createDataFrame([], schema)
    width, top = lens["n"], lens["m"]
    vectors = cut(distinct_vectors(rows.filter(F.size("v") == width), k + 1))
    asked = clean(queries, "query_id").filter(F.size("v") == width)
    n = vectors.count()
    lists = min(MAX_LISTS, -(-n // LIST_TARGET))
    share = min(1.0, lists * SAMPLE_A_LIST / n)
    sample = vectors.filter(F.pmod(F.xxhash64(F.lit(3), "k1", "k2"), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))).select("v").toArrow().column("v")
    known = sample.combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, width) if len(sample) else np.zeros((1, width))
    graph = spark.sparkContext.broadcast(CentroidGraph.build(balanced_centroids(_extend(known, top), -(-len(known) // lists))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            rows, lists = [], []
            for i, x in enumerate(_extend(_matrix(b["v"]), top)):
                c, d = graph.value.search(x, REPLICAS, ASSIGN_BEAM)
                chosen = c[d <= d[0] * REPLICA_RATIO]
                rows += [i] * len(chosen)
                lists += chosen.tolist()
            yield b.iloc[rows].assign(list=lists)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            rows, lists = [], []
            for i, x in enumerate(_matrix(b["v"])):
                # scaled to the extended sphere's radius: the order of inner products does not change
                c, d = graph.value.search(np.r_[x * (top / np.linalg.norm(x)), 0.0], MAX_PROBES)
                keep = (d <= d[0] * PROBE_RATIO) | (np.arange(len(d)) < MIN_PROBES)
                rows += [i] * int(keep.sum())
                lists += c[keep].tolist()
            yield b.iloc[rows].assign(list=lists)

    # narrow walks over the graph: enough tasks for them, whatever the shuffle before left
    spread = max(spark.sparkContext.defaultParallelism, -(-n // 5_000))
    postings = cut(vectors.repartition(spread, "k1", "k2").mapInPandas(assign, "k1 long, k2 long, v array<double>, ids array<long>, list long"))
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("_n")).select("list", F.ceil(F.col("_n") / LIST_ROWS).cast("int").alias("parts"))
    index = postings.join(F.broadcast(sizes), "list").withColumn("part", F.pmod("k1", "parts").cast("int")).drop("parts")
    visits = asked.dropDuplicates(["k1", "k2"]).select("k1", "k2", "v").mapInPandas(probe, "k1 long, k2 long, v array<double>, list long").join(F.broadcast(sizes), "list")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"k1": [], "k2": [], "vec_id": [], "score": []}).astype({"k1": "int64", "k2": "int64", "vec_id": "int64", "score": "float64"})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values(["k1", "k2"], kind="stable")  # so that leaves do not depend on the order of arrival
        part, out = Part(_matrix(right["v"]), right["ids"].to_list()), []
        for k1, k2, q in zip(left["k1"], left["k2"], _matrix(left["v"]), strict=True):
            ids, scores = part.best(q, k + 1)
            out.append(pd.DataFrame({"k1": np.full(len(ids), k1), "k2": np.full(len(ids), k2), "vec_id": ids, "score": scores}))
        return pd.concat(out)

    found = visits.groupBy("list", "part").cogroup(index.groupBy("list", "part")).applyInPandas(scan, "k1 long, k2 long, vec_id long, score double")
    nearest = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("k1", "k2", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k + 1)
    best = best.groupBy("k1", "k2").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    named = hot_join(asked.select("query_id", "k1", "k2").distinct(), cut(best), ["k1", "k2"]).select("query_id", F.inline("near")).filter("vec_id <> query_id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = named.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(own))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""SimHash near-duplicates found with BK-trees.

A text's fingerprint takes its word shingles, repeats included: bit b is set if more than half of the
shingles' XXH64 values have it. Fingerprints within `radius` differing bits are linked, and linked documents form
a component named by its smallest document id.

Only distinct fingerprints are compared, so copies cost nothing. By the pigeonhole principle two fingerprints
within the radius agree on one of a few sets of bit blocks; each (set, value) is a shard with its own BK-tree, whose
children are keyed by their integer Hamming distance to the parent, and a search follows only the edges within
the radius of the query's own distance. The trees travel to the tasks by a shuffle on their shard, not by a broadcast:
together they hold every fingerprint of the corpus, which must not pass through the driver.

A search does not list all pairs: what one group of links reaches leaves the tree at once and is searched from later,
against what is still there; two groups never leave a tree together, as links between them would be lost. Each shard
thus gives a spanning forest of its links, and a dense group of near copies costs about one visit each. Components of
the forests' union are found in Spark; fingerprints and components that very many rows share are joined by broadcast.

Where links must be verified (`similarity`), forests prefer close links, which seldom fail. Each text that a link
needs is written once, and travels to the texts it is compared with in bounded slices. A group in which links failed is
searched again from its smaller parts, until no candidate is left out.

Null or empty text: no shingles, fingerprint zero, linked like any other. Fewer words than a shingle: the whole
sequence is one shingle. Null ids have a fingerprint and a component, but never name one unless all ids in it are null.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import columns, hot_join, text_key, tidy
from assay.operators.graph import connected_components
from assay.session import cut, release, ship

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Comparisons in a shard that cost as much as one more copy of a fingerprint.
COPY = 64
#: Words after the fingerprint of a shingle set: a 128-bit digest of the set.
TAIL = 2
#: Candidates for each fingerprint and shard in the first search of groups that fell apart, and their growth from search to search.
MOST, MORE = 4, 1 << 16
#: Pairs verified at once: as many as there are fingerprints, and at least this many.
PAIRS = 20_000
#: Share of the radius within which links are looked for first, where they must be verified.
CLOSE = 2 / 3
#: Texts that one copy of a text is compared with.
HUB = 500
#: Pairs of query and tree node that one wave of searches may hold at once.
WAVE = 300_000
#: Copies of fingerprints that a task holds on average.
TASK_ROWS = 1_000_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of `width` words, joined by single spaces."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(tokens) - width + 1
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops[width - 1 :].tolist(), strict=True)), np.uint64, n
    )


def fingerprint(text: bytes | None, width: int = SHINGLE, wide: int = 1, as_set: bool = False) -> bytes:
    """`wide` big-endian words of 64 bits; the first takes the hashes as they are, further ones remix them.

    As a set: repeats count once, and TAIL words follow that stand for the whole set.
    """
    h = shingle_hashes(text or b"", width)
    tail = b""
    if as_set:
        h = np.unique(h)
        tail = xxhash.xxh3_128_digest(h.astype("<u8").tobytes())
    if not len(h):
        return bytes(8 * wide) + tail
    ones = np.zeros(64 * wide, np.int64)
    for at in range(0, len(h), 255 * 32):
        part = h[at : at + 255 * 32]
        words = np.zeros((-(-len(part) // 255) * 255, wide), ">u8")
        for j in range(wide):
            words[: len(part), j] = part if j == 0 else remix(part, j)
        bits = np.unpackbits(words.view(np.uint8), axis=1).reshape(-1, 255, 64 * wide)
        ones += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)  # 255 rows fit a byte
    return np.packbits(ones * 2 > len(h)).tobytes() + tail


def remix(h: np.ndarray, j: int) -> np.ndarray:
    z = h + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, wide: int = 1, as_set: bool = False) -> DataFrame:
    """docs' key and text key with the fingerprint as binary `fp`."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(x.as_py(), width, wide, as_set) for x in b.column("_t")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__k1"), b.column("__k2"), fp], ["__id", "__k1", "__k2", "fp"])

    ship(docs.sparkSession)
    source = docs.select(F.col(key).alias("__id"), *text_key(docs, text), F.col(text).cast("binary").alias("_t"))
    return source.mapInArrow(tidy(run), f"__id {id_type}, __k1 long, __k2 long, fp binary")


def exact_masks(radius: int, n: int = 0) -> list[int]:
    """Masks of every choice of blocks - radius out of some bit blocks: 64-bit fingerprints within the radius agree on all
    bits of at least one. More blocks mean more copies of a fingerprint, but far smaller shards: n fingerprints take
    the number that costs least, so that the work of each does not grow with n."""
    blocks = min(range(radius + 1, radius + 5), key=lambda b: math.comb(b, radius) * (COPY + n / 2 ** (64 * (b - radius) // b)))
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]


def similar_masks(n: int, bits: int, agree: float = 0.85, missed: float = 0.002, least: int = 12) -> list[int]:
    """Masks for fingerprints that agree on a bit with this probability: all but `missed` of such pairs share a shard.

    A mask has 12 bits, and one more each time n doubles beyond 2^18, so that the shards stay small. While the bits
    suffice masks are consecutive bands; longer ones, of which more are needed, are seeded choices of bits.
    """
    band = least + max(0, math.ceil(math.log2(max(n, 1) / 2**18)))
    count = math.ceil(math.log(missed) / math.log1p(-(agree**band)))
    if count * band <= bits:
        return [((1 << band) - 1) << lo for lo in range(0, bits - band + 1, band)]
    pick = random.Random(bits * 64 + band)
    return [sum(1 << b for b in pick.sample(range(bits), band)) for _ in range(count)]


class BKForest:
    """BK-trees of many shards, grown and searched level by level with numpy."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        """fps: rows of uint64 words, shard: int codes, both ordered by shard. The first of a shard is its root."""
        n = len(fps)
        self.fps, self.reach = fps, 64 * fps.shape[1]
        roots = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.empty(0, np.int64)
        self.root = np.repeat(roots, np.diff(np.r_[roots, n])) if n else roots
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.zeros(n, np.int64)
        waiting = np.flatnonzero(self.root != np.arange(n))
        at = self.root[waiting]
        while len(waiting):
            d = self.apart(waiting, at)
            spot = at * (self.reach + 1) + d
            _, first, inverse = np.unique(spot, return_index=True, return_inverse=True)
            child = waiting[first]
            self.parent[child], self.edge[child] = at[first], d[first]
            down = np.ones(len(waiting), bool)
            down[first] = False
            waiting, at = waiting[down], child[inverse][down]
        # children of a node lie together, ordered by edge
        order = np.lexsort((self.edge, self.parent))
        self.children = order[np.searchsorted(self.parent[order], 0) :]
        self.spots = self.parent[self.children] * (self.reach + 1) + self.edge[self.children]
        self.depth_order = self._by_depth()

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), 1 << 16):  # so that wide fingerprints are gathered a few megabytes at a time
            s = slice(i, i + (1 << 16))
            out[s] = np.bitwise_count(self.fps[a[s]] ^ self.fps[b[s]]).sum(axis=1, dtype=np.int64)
        return out

    def _by_depth(self) -> list[np.ndarray]:
        level, out = np.unique(self.root), []
        while len(level):
            out.append(level)
            lo, hi = np.searchsorted(self.spots, level * (self.reach + 1)), np.searchsorted(self.spots, (level + 1) * (self.reach + 1))
            level = self.children[_ranges(lo, hi)]
        return out

    def living(self, alive: np.ndarray) -> np.ndarray:
        """For each node, how many nodes of its subtree are alive."""
        n = alive.astype(np.int64)
        for level in reversed(self.depth_order[1:]):
            np.add.at(n, self.parent[level], n[level])
        return n

    def search(self, queries: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, bits) of the alive nodes within the radius of each query, all in the query's own tree."""
        left = self.living(alive)
        q, at, hits = queries, self.root[queries], []
        while len(q):
            d = self.apart(q, at)
            near = (d <= radius) & alive[at] & (q != at)
            hits.append((q[near], at[near], d[near]))
            base = at * (self.reach + 1)
            lo = np.searchsorted(self.spots, base + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.spots, base + np.minimum(d + radius, self.reach) + 1)
            q, at = np.repeat(q, hi - lo), self.children[_ranges(lo, hi)]
            some = left[at] > 0
            q, at = q[some], at[some]
        return _columns(hits, 3)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0]..hi[0]-1, lo[1]..hi[1]-1, ... in one array."""
    n = hi - lo
    total = int(n.sum())
    return np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(total) if len(n) else np.empty(0, np.int64)


def _columns(parts: list[tuple], n: int) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(n))


def _forest(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As few of the links as keep the same components, the closest first, and the component of each."""
    order = np.argsort(bits, kind="stable")
    a, b, bits = a[order], b[order], bits[order]
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            top[x] = y
            keep.append(i)
    a, b, bits = a[keep], b[keep], bits[keep]
    return a, b, bits, np.array([find(x) for x in a.tolist()], np.int64)


def _largest(node: np.ndarray, group: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The distinct nodes of one group a tree, the one with most of them."""
    node, first = np.unique(node, return_index=True)
    group, root = group[first], root[first]
    _, inverse, n = np.unique(group, return_inverse=True, return_counts=True)
    order = np.lexsort((-n[inverse], root))
    _, best = np.unique(root[order], return_index=True)
    return node[np.isin(group, group[order][best])]


def spanning_links(fps: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (indexes a, b, and their bits) that join all of each shard's fingerprints within the radius.

    Seeds are searched against all that is alive, each other included, and every link counts. What they reach in a
    tree leaves it as the frontier only if it is of one group: frontier nodes of a tree are joined already and need
    no comparison with each other. What other groups reach stays alive and is searched later.
    """
    tree = BKForest(fps, shard)
    n = len(fps)
    alive = np.ones(n, bool)
    size_of = np.bincount(tree.root, minlength=n)[tree.root] if n else np.empty(0, np.int64)
    frontier, out = np.empty(0, np.int64), []
    while True:
        seeding = not len(frontier)
        batch = np.flatnonzero(alive) if seeding else frontier
        if not len(batch):
            break
        batch = batch[: max(1, int(np.searchsorted(np.cumsum(size_of[batch]), WAVE)))]
        q, hit, bits = tree.search(batch, alive, radius)
        if seeding:
            alive[batch] = False
            q, hit, bits, group = _forest(q, hit, bits)
            outer = alive[hit]
            new = _largest(hit[outer], group[outer], tree.root[hit[outer]])
            out.append((q, hit, bits))
        else:
            frontier = frontier[len(batch) :]
            closest = np.lexsort((bits, hit))
            new, first = np.unique(hit[closest], return_index=True)
            out.append((q[closest][first], new, bits[closest][first]))
        alive[new] = False
        frontier = np.concatenate([frontier, new])
    return _columns(out, 3)


def close_links(fps: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning links as few as keep the components, with the closest ones of two searches before the others."""
    found = [spanning_links(fps, shard, int(radius * CLOSE)), spanning_links(fps, shard, radius)]
    return _forest(*_columns(found, 3))[:3]


def first_shared(apart: np.ndarray, mask: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether a pair (its differing bits) agrees on none of the masks before the one that it was found by: each pair counts once."""
    once = np.ones(len(apart), bool)
    for j in range(int(mask.max(initial=0))):
        words = np.flatnonzero(masks[j])
        some = np.flatnonzero(once & (mask > j))
        once[some] = (apart[np.ix_(some, words)] & masks[j, words]).any(axis=1)
    return once


def outside_candidates(fps: np.ndarray, shard: np.ndarray, group: np.ndarray, asks: np.ndarray, radius: int, most: int,
                       mask: np.ndarray | None = None, masks: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(a, b, bits, whether a has more): for each node that asks the `most` closest within the radius that are of other groups.

    With each node's mask and the masks' words, a pair is found by the first mask that it shares, and by no other."""
    tree = BKForest(fps, shard)
    n = len(fps)
    alive = np.ones(n, bool)
    work = np.cumsum(np.bincount(tree.root, minlength=n)[tree.root])
    at, out = 0, []
    while at < n:
        stop = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + WAVE)))
        q, hit, bits = tree.search(at + np.flatnonzero(asks[at:stop]), alive, radius)
        order = np.lexsort((hit, bits, q))
        order = order[group[q[order]] != group[hit[order]]]
        q, hit, bits = q[order], hit[order], bits[order]
        if masks is not None:
            once = np.concatenate([first_shared(fps[q[i : i + 65_536]] ^ fps[hit[i : i + 65_536]], mask[q[i : i + 65_536]], masks) for i in range(0, len(q), 65_536)] or [np.empty(0, bool)])
            q, hit, bits = q[once], hit[once], bits[once]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        more = np.bincount(q, minlength=n)[q] > most
        out.append(tuple(x[place < most] for x in (q, hit, bits, more)))
        at = stop
    return _columns(out, 4)


def mask_words(masks: list[int], words: int) -> np.ndarray:
    """The masks as rows of 64-bit words, leading word first."""
    return np.array([[m >> 64 * (words - 1 - w) & (1 << 64) - 1 for w in range(words)] for m in masks], np.uint64)


def shard_codes(fps: np.ndarray, masks: list[int]) -> np.ndarray:
    """A 64-bit shard code for each fingerprint and mask; a chance collision only joins two trees."""
    words = fps.shape[1]
    out = np.empty((len(fps), len(masks)), np.uint64)
    for i, m in enumerate(masks):
        code = np.full(len(fps), i, np.uint64)
        for w in range(words):
            code = remix(code ^ (fps[:, w] & np.uint64(m >> 64 * (words - 1 - w) & (1 << 64) - 1)), i + 1)
        out[:, i] = code
    return out.view(np.int64)


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, wide)


def fingerprint_links(fps: DataFrame, radius: int, masks: list[int], wide: int = 1, tail: int = 0, most: int | None = None) -> DataFrame:
    """Distinct `fp` -> links (a, b, bits) that join what is within the radius and shares a shard.

    `tail` words of an fp tell equal fingerprints apart and do not count as bits; with a tail, links name nodes by it
    and close links are preferred.
    With `most`, fps has columns g and asks: the links of each fingerprint that asks are the `most` closest ones to
    other g, and the column more tells whether there are others.
    """
    g = ["g", "asks"] if most else []
    words = wide + tail

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = shard_codes(_matrix(b.column("fp"), words)[:, :wide], masks)
                rows = pa.array(np.repeat(np.arange(b.num_rows), len(masks)))
                number = [pa.array(np.tile(np.arange(len(masks), dtype=np.int32), b.num_rows))] if most else []
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ["fp", *g]), *number, pa.array(codes.ravel())], ["fp", *g, *(["mask"] if most else []), "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        fp, shard = np.concatenate([_matrix(b.column("fp"), words) for b in parts]), np.concatenate([b.column("shard").to_numpy() for b in parts])
        order = np.lexsort((*fp.T, shard))
        fp, shard = fp[order], shard[order]
        bare = np.ascontiguousarray(fp[:, :wide])
        if most:
            group, asks, mask = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts])[order] for c in [*g, "mask"])
            a, b, bits, more = outside_candidates(bare, shard, group, asks, radius, most, mask, mask_words(masks, wide))
            extra = {"more": pa.array(more.astype(bool))}
        else:
            a, b, bits = close_links(bare, shard, radius) if tail else spanning_links(bare, shard, radius)
            extra = {}
        ends = np.ascontiguousarray(fp[:, wide:] if tail else fp).astype(">u8")  # the tail alone tells nodes apart
        raw = lambda rows: pa.array([x.tobytes() for x in ends[rows]], pa.binary())
        yield pa.RecordBatch.from_pydict({"a": raw(a), "b": raw(b), "bits": pa.array(bits, pa.int64()), **extra})

    ship(fps.sparkSession)
    dealt = fps.mapInArrow(tidy(deal), "fp binary, " + ("g long, asks boolean, mask int, " if most else "") + "shard long")
    # a task holds all rows of its shards: enough tasks that these are bounded, whatever the table
    tasks = -(-fps.count() * len(masks) // TASK_ROWS)
    dealt = dealt.repartition(tasks, "shard") if tasks > int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")) else dealt.repartition("shard")
    return dealt.mapInArrow(tidy(run), "a binary, b binary, bits long" + (", more boolean" if most else ""))


def jaccard(a: bytes | None, b: bytes | None, width: int) -> float:
    """Of the sets of word shingles."""
    return overlap(*(np.unique(shingle_hashes(x or b"", width)) for x in (a, b)))


def node_of(fp: str) -> Column:
    """The tail of a fingerprint: the name of its node in links."""
    return F.substring(fp, -8 * TAIL, 8 * TAIL)


def texts_of(links: DataFrame, docs: DataFrame, marked: DataFrame, key: str, text: str) -> DataFrame:
    """(fp, t): one text for each node of the links, under the node's name."""
    needed = links.select(F.col("a").alias("fp")).union(links.select("b")).distinct()
    rows = marked.withColumn("fp", node_of("fp")).join(needed, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct(F.xxhash64("__id").alias("k0"), "__k1", "__k2")).alias("r"))
    rows = rows.select("fp", F.col("r.k0").alias("__k0"), "r.__k1", "r.__k2")
    source = docs.select(F.xxhash64(key).alias("__k0"), *text_key(docs, text), F.col(text).cast("binary").alias("t"))
    return source.join(rows, ["__k0", "__k1", "__k2"]).dropDuplicates(["fp"]).select("fp", "t")


def pairs_of(links: DataFrame) -> DataFrame:
    """Each pair once as (a, b), with the side that most links name first as a: it tends to be the hub of many."""
    low, high = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    votes = links.select(low, high, F.when(F.col("a") <= F.col("b"), 1).otherwise(-1).alias("v")).groupBy("lo", "hi").agg(F.sum("v").alias("v"))
    return votes.select(F.when(F.col("v") >= 0, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("v") >= 0, F.col("hi")).otherwise(F.col("lo")).alias("b"))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs whose texts have the Jaccard similarity.

    A text meets the texts it is compared with in slices of about HUB, each led by one copy of it.
    """
    ship(pairs.sparkSession)
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("n"))
    dealt = pairs.join(slices, "a").select("a", "b", F.pmod(F.xxhash64("b"), "n").cast("int").alias("slice"))
    leaders = slices.join(texts, slices["a"] == texts["fp"]).select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"), F.lit(None).cast("binary").alias("b"), "t")
    rest = dealt.join(texts, dealt["b"] == texts["fp"]).select("a", "slice", "b", "t")
    met = leaders.unionByName(rest).repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for x in batches:
            ok = []
            for b, t in zip(x.column("b"), x.column("t"), strict=True):
                other = np.unique(shingle_hashes(t.as_py() or b"", width))
                if not b.is_valid:
                    mine = other
                ok.append(b.is_valid and overlap(mine, other) >= similarity)
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return met.mapInArrow(tidy(run), "a binary, b binary")


def verified_in_waves(pairs: DataFrame, texts: DataFrame, n: int, similarity: float, width: int) -> DataFrame:
    """verified() of PAIRS or n pairs at a time, whatever is more: the texts that travel are then in proportion to the table."""
    waves = -(-pairs.count() // max(PAIRS, n))
    if waves < 2:
        return cut(verified(pairs, texts, similarity, width))
    good = None
    for w in range(waves):
        some = cut(verified(pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(waves)) == w), texts, similarity, width))
        good = some if good is None else good.unionByName(some)
        release(pairs.sparkSession)
    return good


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of sorted distinct hashes; 1 for two empty sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def similar_classes(docs: DataFrame, marked: DataFrame, nodes: DataFrame, radius: int, masks: list[int], wide: int,
                    similarity: float, width: int, key: str, text: str) -> DataFrame:
    """node, component over all links within the radius whose texts have the similarity.

    The spanning links join all candidates. Where each link of a group holds, the group stands. A group with links
    that fail is searched again from all but its largest part for candidates in other parts, more of them each time,
    until none is left out.
    """
    rough = cut(fingerprint_links(nodes, radius, masks, wide, TAIL))
    texts = cut(texts_of(rough, docs, marked, key, text))
    tried = cut(pairs_of(rough))
    n = nodes.count()
    good = verified_in_waves(tried, texts, n, similarity, width)
    whole = cut(connected_components(rough.select("a", "b")).select("node", F.col("component").alias("whole")))
    most = MOST
    while True:
        classes = cut(connected_components(good))
        parts = whole.join(classes, "node", "left").select("node", "whole", F.coalesce("component", "node").alias("part"))
        sizes = parts.groupBy("whole", "part").agg(F.count(F.lit(1)).alias("n"))
        broken = sizes.groupBy("whole").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "part")).alias("top")).filter("k > 1").select("whole", F.col("top.part").alias("top"))
        asking = parts.join(broken, "whole").select("node", F.xxhash64("part").alias("g"), (F.col("part") != F.col("top")).alias("asks"))
        again = cut(nodes.withColumn("node", node_of("fp")).join(asking, "node").select("fp", "g", "asks"))
        if again.isEmpty():
            return classes
        found = cut(fingerprint_links(again, radius, masks, wide, TAIL, most))
        new = cut(pairs_of(found).join(tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti"))
        fresh = verified_in_waves(cut(new), texts, n // 2, similarity, width)
        if not fresh.isEmpty():
            good = good.unionByName(fresh)
        elif found.filter("more").isEmpty():
            return classes
        tried, most = tried.unionByName(new), most * MORE


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE,
               wide: int = 1, masks: list[int] | None = None, similarity: float | None = None) -> DataFrame:
    """One row for each document row: __id, __k1, __k2, fp, component_id, component (the class as a fingerprint).

    The search is exact for 64 bits: every pair within the radius is linked. With a similarity, texts of the same
    shingle set are one and every link is checked by the exact Jaccard similarity of their texts.
    """
    marked = cut(fingerprints(docs, key, text, width, wide, similarity is not None))
    distinct = cut(marked.groupBy("fp").agg(F.min("__id").alias("low")))
    n = distinct.count()
    if similarity is None:
        masks = masks or exact_masks(radius, n)
        classes = connected_components(fingerprint_links(distinct.select("fp"), radius, masks, wide))
    else:
        masks = masks or similar_masks(n, 64 * wide)
        classes = similar_classes(docs, marked, distinct.select("fp"), radius, masks, wide, similarity, width, key, text)
    name = F.col("fp") if similarity is None else node_of("fp")
    named = cut(distinct.withColumn("own", name).join(classes, F.col("own") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "own").alias("component")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = cut(hot_join(named.select("fp", "component"), lowest, ["component"]).select("fp", "component_id", "component"))
    return hot_join(marked, by_fp, ["fp"]).select("__id", "__k1", "__k2", "fp", "component_id", "component")


#: Near copies of a Jaccard similarity of 0.8 or more over five-word shingles: their 512-bit fingerprints differ in
#: 77.6 bits on average (an angle of 27 degrees) and in at most 96 for 99 pairs of a hundred. One of the masks (42 bands
#: of 12 bits, or more and longer ones) agrees for 99.8 % of pairs at 0.8. Every link is checked.
SIMILAR = {"width": 5, "wide": 8, "radius": 96, "similarity": 0.8}


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **opts) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (then text hash, if ids repeat)."""
    row = [F.xxhash64(key).alias("__k0"), *text_key(docs, text)]
    best = (
        components(docs, key, text, **opts)
        .groupBy("component")
        .agg(F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__k1"), F.col("__k2"))).alias("w"))
        .select(F.xxhash64("w.__id").alias("__k0"), "w.__k1", "w.__k2")
    )
    kept = docs.select("*", *row).join(best, ["__k0", "__k1", "__k2"], "left_semi")
    return kept.dropDuplicates(["__k0", "__k1", "__k2"]).select(*columns(docs.columns))

"""Merkle manifest of a dataset: a tree of SHA-256 digests whose parents keep hash states, so that one change folds cheaply.

A row is a leaf: the digest of its fields, each `-` if null, else UTF-8 byte count, `:`, value. The leaves of a group (a
language) ascend by id; every FANOUT consecutive nodes (the last run: fewer, even one) become the digest of their hex
digests until one is left, the group's subroot. The subroots, ordered by group (null first, bytewise), give the root alike.

A parent keeps a copy of the hash's state before each child's slot. A fold (replace a leaf, find the root) resumes, level
by level, the state before the slot with the replacement and the siblings to the right; what lies to the left is not read
again. States live in the task that folds: Python's hashes can be copied but not stored.

Spark holds the tree as chunks: SPAN levels of one subtree are one row, at most FANOUT ** SPAN nodes. Bottom up, chunks
are hashed to nodes of the next round; a table is written for each round. Top down, each chunk receives the siblings on the
way from its top to the root, once for all its leaves. So no task sees more than a chunk, whatever the group, texts are
read once and never shuffled, and a lost executor costs a re-read of a written table.

Null ids come first; rows that repeat an id are leaves of their own, ordered by digest. A null group is a group. A lone
leaf is its subroot; without siblings a proof is the digest of nothing. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import ascii_lower, in_order
from assay.session import cut, shared_dir, ship

FANOUT, SPAN = 8, 4
#: Bytes of a digest in hex.
HEX = 64
PATH = "array<struct<left: binary, right: binary>>"


def leaf_of(*fields: Column) -> Column:
    """The digest (32 bytes) of a row's fields."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def depth(n: int) -> int:
    """Levels above n nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // FANOUT), k + 1
    return k


class Parent:
    """A parent with its children's digests in a row (hex) and the hash's state before each of them."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: bytes):
        self.children, self.states, h = children, [], sha256()
        for at in range(0, len(children), HEX):
            self.states.append(h.copy())
            h.update(children[at : at + HEX])
        self.digest = h.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with this child in the slot."""
        h = self.states[slot].copy()
        h.update(child)
        h.update(self.children[HEX * (slot + 1) :])
        return h.hexdigest().encode()

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        return self.children[: HEX * slot], self.children[HEX * (slot + 1) :]


def grow(nodes: list[bytes], levels: int) -> list[list[Parent]]:
    """The parents of each level above a chunk's nodes (hex digests)."""
    out = []
    for _ in range(levels):
        out.append([Parent(b"".join(nodes[at : at + FANOUT])) for at in range(0, len(nodes), FANOUT)])
        nodes = [p.digest for p in out[-1]]
    return out


def _chunks(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[dict, pa.StructArray, list[bytes], list[list[Parent]]]]:
    """Each chunk of the batches: its columns, its rows, their digests, its tree."""
    for b in batches:
        for i in range(b.num_rows):
            rows = b.column("rows")[i].values
            one = {c: b.column(c)[i].as_py() for c in b.schema.names if c != "rows"}
            nodes = [x.hex().encode() for x in rows.field("digest").to_pylist()]
            yield one, rows, nodes, grow(nodes, min(span, depth(one["n"])))


def _top(nodes: list[bytes], tree: list[list[Parent]]) -> bytes:
    return tree[-1][0].digest if tree else nodes[0]


@dataclass
class Rounds:
    """The written chunks of each round of one forest; `tops`: g, digest of each tree's top."""

    tables: list[DataFrame]
    tops: DataFrame
    span: int


def _climb(nodes: DataFrame, folder: str, span: int) -> Rounds:
    """nodes: g, at, n (nodes of g), digest and columns to keep -> the trees of all g."""
    spark, chunk, tables = nodes.sparkSession, FANOUT**span, []

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(x["g"], x["chunk"], -(-x["n"] // chunk), bytes.fromhex(_top(nodes, tree).decode())) for x, _, nodes, tree in _chunks(batches, span)]
        yield pa.RecordBatch.from_pylist([dict(zip(("g", "at", "n", "digest"), m, strict=True)) for m in made],
                                         pa.schema([("g", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))

    while True:
        kept = [c for c in nodes.columns if c not in ("g", "n", "at")]
        packed = nodes.groupBy("g", F.floor(F.col("at") / chunk).alias("chunk")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", *kept))).alias("rows"))
        path = f"{folder}/{len(tables)}"
        packed.write.parquet(path)
        tables.append(spark.read.schema(packed.schema).parquet(path))
        up = tables[-1].select("g", "chunk", "n", F.transform("rows", lambda r: F.struct(r["digest"].alias("digest"))).alias("rows"))
        nodes = up.mapInArrow(roots, "g string, at long, n long, digest binary")
        if (tables[-1].agg(F.max("n")).first()[0] or 0) <= chunk:
            return Rounds(tables, nodes.select("g", "digest"), span)


@dataclass
class Manifest:
    """The dataset's tree: rounds of the groups' leaves, and rounds of their subroots."""

    leaves: Rounds
    groups: Rounds
    keys: list[str]

    def root(self) -> str | None:
        """The root in hex; None for an empty dataset."""
        top = self.groups.tops.first()
        return top["digest"].hex() if top else None


def build(rows: DataFrame, group: str = "lang", key: str = "doc_id", keep: tuple[str, ...] = (), span: int = SPAN) -> Manifest:
    """rows: group, key, digest (of leaf_of) and columns to keep at the leaves. The tree is written into the shared folder."""
    spark: SparkSession = rows.sparkSession
    ship(spark)
    folder = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    # a group's name keeps its place: the null group is empty, others begin with a sign
    own = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(key).alias("id"), "digest", *keep)
    sizes = own.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    leaves = _climb(in_order(own, "g", ["id", "digest"], "at").join(sizes, "g"), f"{folder}/leaves", span)
    tops = cut(leaves.tops.select(F.lit("").alias("g"), F.col("g").alias("id"), "digest"))
    listed = in_order(tops, "g", ["id"], "at")
    groups = _climb(listed.withColumn("n", F.lit(tops.count())), f"{folder}/groups", span)
    return Manifest(leaves, groups, list(keep))


def _descend(rounds: Rounds, paths: DataFrame, constant: list[str]) -> DataFrame:
    """paths: g, at (chunk of the last round), path from its top to the root, constants -> the same for the first round's chunks."""
    span = rounds.span
    kinds = ", ".join(f"{c} binary" for c in constant)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.string()), ("at", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))), *((c, pa.binary()) for c in constant)])
        for x, rows, _, tree in _chunks(batches, span):
            first = x["chunk"] * FANOUT**span
            out = [{"g": x["g"], "at": first + i, "path": _way(tree, i) + x["path"]} | {c: x[c] for c in constant} for i in range(len(rows))]
            yield pa.RecordBatch.from_pylist(out, schema)

    for table in reversed(rounds.tables[1:]):
        met = table.join(paths.withColumnRenamed("at", "chunk"), ["g", "chunk"])
        paths = met.mapInArrow(unfold, f"g string, at long, path {PATH}" + (f", {kinds}" if kinds else ""))
    return paths


def _way(tree: list[list[Parent]], i: int) -> list[dict]:
    """The siblings of node i on the way to the chunk's top."""
    out = []
    for level in tree:
        left, right = level[i // FANOUT].siblings(i % FANOUT)
        out.append({"left": left, "right": right})
        i //= FANOUT
    return out


def fold(manifest: Manifest, replacement: str | None = None) -> DataFrame:
    """One row a leaf: g, id, the manifest's kept columns, leaf, subroot, root, proof_sha256 and folded_root, all digests in hex.

    proof_sha256 is the digest of all siblings on the way to the root, level by level, left to right; folded_root is the
    root with the kept column `replacement` (where not null) in the leaf's place and all siblings as they were.
    """
    spark = manifest.leaves.tables[0].sparkSession
    ship(spark)
    # the groups' own paths: from a subroot to the root
    top = manifest.groups.tops.select(F.lit("").alias("g"), F.lit(0).cast("long").alias("at"), F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    span = manifest.groups.span

    def of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.string()), ("at", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))), ("root", pa.binary()), ("subroot", pa.binary())])
        for x, rows, nodes, tree in _chunks(batches, span):
            names = rows.field("id").to_pylist()
            out = [{"g": names[i], "at": 0, "path": _way(tree, i) + x["path"], "root": x["root"], "subroot": bytes.fromhex(nodes[i].decode())} for i in range(len(rows))]
            yield pa.RecordBatch.from_pylist(out, schema)

    upper = _descend(manifest.groups, top, ["root"])
    subs = manifest.groups.tables[0].join(upper.withColumnRenamed("at", "chunk"), ["g", "chunk"]).mapInArrow(of_groups, f"g string, at long, path {PATH}, root binary, subroot binary")
    paths = _descend(manifest.leaves, subs, ["root", "subroot"])
    table = manifest.leaves.tables[0]
    own = table.schema["rows"].dataType.elementType
    keep = ["id", *manifest.keys]
    shape = ", ".join(["g string", *(f"`{c}` {own[c].dataType.simpleString()}" for c in keep), *(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))])
    own_span = manifest.leaves.span

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, rows, nodes, tree in _chunks(batches, own_span):
            # the states before the chunk's own place in each level above it: once for all its leaves
            above = [(sha256(p["left"]), p["right"]) for p in x["path"]]
            rest = b"".join(p["left"] + p["right"] for p in x["path"])
            new = rows.field(replacement).to_pylist() if replacement else [None] * len(nodes)
            proofs, folded, near = [], [], (-1, b"")
            for i, leaf in enumerate(nodes):
                if near[0] != i // FANOUT:  # what the leaves of one parent share
                    near = (i // FANOUT, b"".join(s["left"] + s["right"] for s in _way(tree, i)[1:]) + rest)
                left, right = tree[0][i // FANOUT].siblings(i % FANOUT) if tree else (b"", b"")
                proofs.append(sha256(left + right + near[1]).hexdigest())
                h, at = leaf if new[i] is None else new[i].hex().encode(), i
                for level in tree:
                    h, at = level[at // FANOUT].fold(at % FANOUT, h), at // FANOUT
                for state, right in above:
                    state = state.copy()
                    state.update(h)
                    state.update(right)
                    h = state.hexdigest().encode()
                folded.append(h.decode())
            same = lambda v: pa.array([v] * len(nodes), pa.string())
            yield pa.RecordBatch.from_arrays(
                [same(x["g"]), *(rows.field(c) for c in keep), pa.array([n.decode() for n in nodes], pa.string()), same(x["subroot"].hex()), same(x["root"].hex()), pa.array(proofs, pa.string()), pa.array(folded, pa.string())],
                ["g", *keep, "leaf", "subroot", "root", "proof_sha256", "folded_root"],
            )

    met = table.join(paths.withColumnRenamed("at", "chunk"), ["g", "chunk"]).select("g", "chunk", "n", "rows", "path", "root", "subroot")
    return met.mapInArrow(leaves, shape)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tamper_check(docs: DataFrame, key: str = "doc_id", group: str = "lang", text: str = "text", fields: tuple[str, ...] = FIELDS, every: int = 3, span: int = SPAN) -> DataFrame:
    """fold() of docs where `every` divides the crc32 of the id (null: none) and tampering lower-cases the text's A-Z; plus verified."""
    changed = F.crc32(F.col(key).cast("string").cast("binary")) % every == 0
    new = leaf_of(*[ascii_lower(F.col(f)) if f == text else F.col(f) for f in fields])
    rows = docs.select(key, group, leaf_of(*[F.col(f) for f in fields]).alias("digest"), F.when(changed, new).alias("tampered"))
    found = fold(build(rows, group, key, ("tampered",), span), "tampered")
    return found.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", key).drop("g", "tampered")

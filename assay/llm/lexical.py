"""Ranked lexical search over a length-stratified index.

Terms are runs of ASCII letters and digits and of all other non-ASCII characters, only A-Z lower-cased. A document's
normaliser m follows from its number of terms alone, so documents with equal m form a stratum, in which a term's impact
depends on its frequency tf alone. A stratum is held in blocks of bounded size; a block has its documents in id order and,
for each of its terms, runs of postings by tf, so an impact is computed once per tf and not once per posting.

A search sums, for each item and stratum, the largest impacts of the item's terms there: no document of the stratum can
score more. Each item visits its strata in the order of these bounds, in waves: after a wave the item's k-th best score
so far is its threshold, and strata whose bound is below it are never visited. The last wave holds all that are left,
so the result is exact; all sums are whole numbers. Items are dealt into batches of bounded size, whose terms, weights and
bounds (items times strata) the driver holds; postings never leave the executors, only the k best of a block do.

With `terms` the index holds these only (all documents are counted all the same); without, every term of every document.

Null or empty texts hold no term: no document, no rows for an item. Each row with terms is a document of its own, so a
repeated row is ranked twice; null ids come last among equal scores. Items of equal id and text are one item. Empty
tables give no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.llm.common import rows_of, tidy
from assay.session import cut, shared_dir, ship

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Fixed values of the measure: share of length in the normaliser (of a hundred), scale of impacts, scale of weights.
LENGTH_SHARE, IMPACT, WEIGHT = 75, 1_000_000_000, 1_000
#: Documents and bytes of words in one block; bytes of terms that a filter may hold.
BLOCK_DOCS, BLOCK_BYTES, TERM_BYTES = 8_192, 16 << 20, 32 << 20
#: Pairs of item and term, and pairs of item and stratum, in one batch of items.
BATCH_PAIRS, BATCH_BOUNDS = 1 << 18, 1 << 22
#: Share of the documents that an item's strata of each wave may hold; the last one takes the rest.
WAVES = (1 / 16, 1 / 4, 1.0)
#: Postings, and sums of items and documents, at once.
CHUNK, SUMS = 1 << 21, 1 << 23


def terms_of(text: bytes | None) -> Counter:
    """Each term with its occurrences. Bytes will do: all bytes of a non-ASCII character are above 0x7F."""
    return Counter(WORD.findall((text or b"").lower()))


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (IMPACT * tf) // (1_000 * tf + 8 * m)


@dataclass
class LexicalIndex:
    """blocks: m, block, ids, terms, runs (of each term), tf and len (of each run), docs (positions in ids, by runs)."""

    blocks: DataFrame
    n_docs: int
    n_terms: int
    strata: int
    id_type: str


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", terms: set[bytes] | None = None) -> LexicalIndex:
    """Index all rows of docs, for the given terms or for all."""
    spark = docs.sparkSession
    ship(spark)
    wanted = None if terms is None else spark.sparkContext.broadcast(frozenset(terms))
    folder = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = None if wanted is None else wanted.value
        for b in batches:
            rows, n, words, tfs = [], [], [], []
            for i, t in enumerate(b.column("t")):
                found = terms_of(t.as_py())
                if found:
                    own = found if chosen is None else {w: c for w, c in found.items() if w in chosen}
                    rows.append(i)
                    n.append(found.total())
                    words.append(b" ".join(own).decode())
                    tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(words, pa.string()), pa.array(tfs, pa.list_(pa.int32()))], ["id", "n", "words", "tfs"])

    docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(tidy(count), f"id {kind}, n long, words string, tfs array<int>").write.parquet(f"{folder}/documents")
    seen = spark.read.schema(f"id {kind}, n long, words string, tfs array<int>").parquet(f"{folder}/documents")
    n_docs, n_terms = (x or 0 for x in seen.agg(F.count(F.lit(1)), F.sum("n")).first())
    measured = seen.withColumn("m", F.lit(100 - LENGTH_SHARE) + F.expr(f"({LENGTH_SHARE} * n * {n_docs}L) div {max(n_terms, 1)}L")).filter("words <> ''")
    strata = measured.groupBy("m").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum(F.octet_length("words")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = measured.join(strata, "m").withColumn("block", F.pmod(F.monotonically_increasing_id(), F.col("blocks")).cast("int"))
    shape = f"m long, block int, ids array<{kind}>, terms array<string>, runs array<int>, tf array<int>, len array<int>, docs binary"

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable", na_position="last")
        numbers: dict[str, int] = {}
        term = np.array([numbers.setdefault(w, len(numbers)) for words in rows["words"] for w in words.split(" ")], np.int64)
        tf = np.concatenate(rows["tfs"].to_list()).astype(np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(x) for x in rows["tfs"]])
        order = np.lexsort((doc, tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
        ids = [None if pd.isna(x) else x for x in rows["id"]]
        return pd.DataFrame([{"m": key[0], "block": key[1], "ids": ids, "terms": list(numbers), "runs": np.bincount(term[first], minlength=len(numbers)).astype(np.int32),
                              "tf": tf[first].astype(np.int32), "len": np.diff(np.r_[first, len(term)]).astype(np.int32), "docs": doc.astype("<u4").tobytes()}])

    dealt.select("m", "block", "id", "words", "tfs").groupBy("m", "block").applyInPandas(pack, shape).write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema(shape).parquet(f"{folder}/blocks")
    return LexicalIndex(blocks, n_docs, n_terms, blocks.agg(F.count_distinct("m")).first()[0], kind)


@dataclass
class Batch:
    """Items and their distinct terms: pairs (item, term, weight times occurrences) in item order."""

    terms: dict[str, int]
    item: np.ndarray
    term: np.ndarray
    gain: np.ndarray
    items: int


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0] .. lo[0]+n[0]-1, lo[1] .. in one array."""
    return np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum())) if len(n) else np.empty(0, np.int64)


def best_of_block(batch: Batch, m: int, terms: list[str], runs: np.ndarray, tf: np.ndarray, lens: np.ndarray, docs: np.ndarray, n: int,
                  visits: np.ndarray, floors: np.ndarray, k: int, large: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, positions, scores) of the k best of a block for each visiting item, from its floor on."""
    values, place = np.unique(tf, return_inverse=True)
    gain = np.repeat(impact(values.astype(np.int64), m)[place], lens)  # one impact a tf
    sizes = np.add.reduceat(lens.astype(np.int64), np.r_[0, np.cumsum(runs)[:-1]])
    start = np.cumsum(sizes) - sizes
    here = np.full(len(batch.terms), -1, np.int64)
    for i, t in enumerate(terms):
        j = batch.terms.get(t)
        if j is not None:
            here[j] = i
    used = np.flatnonzero(visits[batch.item] & (here[batch.term] >= 0))
    spot = here[batch.term[used]]
    item, total, at = batch.item[used], np.cumsum(sizes[spot]), 0
    while at < len(used):
        stop = int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right"))
        stop = int(np.searchsorted(item, item[min(stop, len(used) - 1)], "left")) if stop < len(used) else stop  # whole items
        stop = min(stop, int(np.searchsorted(item, item[at] + max(1, SUMS // n), "left")))
        stop = max(stop, int(np.searchsorted(item, item[at], "right")))
        part = slice(at, stop)
        posting = _ranges(start[spot[part]], sizes[spot[part]])
        low = item[at]
        cell = np.repeat((item[part] - low) * n, sizes[spot[part]]) + docs[posting]
        score = gain[posting] * np.repeat(batch.gain[used[part]], sizes[spot[part]])
        span = int(item[stop - 1] - low + 1)
        if large[low : low + span].any():  # beyond the whole numbers of doubles
            sums = np.zeros(span * n, np.int64)
            np.add.at(sums, cell, score)
        else:
            sums = np.bincount(cell, score, span * n).astype(np.int64)
        for i in np.unique(item[part]):
            s = sums[(i - low) * n : (i - low + 1) * n]
            some = np.flatnonzero(s >= max(floors[i], 1))
            if len(some) > k:
                some = some[s[some] >= np.partition(s[some], len(some) - k)[len(some) - k]]
            some = some[np.argsort(-s[some], kind="stable")][:k]  # positions follow ids
            if len(some):
                yield int(i), some, s[some]
        at = stop


def search(index: LexicalIndex, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's k documents of highest score above 0, equal scores by id: item_id, rank, doc_id, score."""
    spark = items.sparkSession
    ship(spark)
    kind = items.schema[key].dataType.simpleString()
    asked = cut(item_terms(items, key, text))
    n_items, pairs = (x or 0 for x in asked.agg(F.count(F.lit(1)), F.sum(F.size("tfs"))).first())
    batches = max(1, -(-pairs // BATCH_PAIRS), -(-n_items * index.strata // BATCH_BOUNDS))
    parts = [_search_batch(spark, index, asked.filter(F.pmod(F.xxhash64("id", "words"), F.lit(batches)) == b), k, kind) for b in range(batches)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """id, words (distinct terms), tfs of each distinct item with terms."""
    kind = items.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms_of(t.as_py()) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([b" ".join(f).decode() for f in found], pa.string()), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], ["id", "words", "tfs"])

    once = items.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("t")).distinct()
    return once.mapInArrow(count, f"id {kind}, words string, tfs array<int>").filter("words <> ''")


def _search_batch(spark: SparkSession, index: LexicalIndex, asked: DataFrame, k: int, kind: str) -> DataFrame:
    rows = sorted(asked.collect(), key=lambda r: (str(r["id"]), r["words"]))  # a batch is bounded
    terms: dict[str, int] = {}
    held = [[(terms.setdefault(w, len(terms)), c) for w, c in zip(r["words"].split(" "), r["tfs"], strict=True)] for r in rows]
    shape = f"item_id {kind}, rank int, doc_id {index.id_type}, score long"
    if not held:
        return spark.createDataFrame([], shape)
    names = spark.sparkContext.broadcast(terms)
    peaks = cut(index.blocks.select("m", "ids", "terms", "runs", "tf", "len").mapInArrow(tidy(_peaks(names)), "m long, docs long, term int, df long, top int"))
    df = dict.fromkeys(range(len(terms)), 0) | {r["term"]: r["df"] for r in peaks.filter("term >= 0").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weights = [weight(index.n_docs, df[i]) for i in range(len(terms))]
    flat = [(i, t, c * weights[t]) for i, pairs in enumerate(held) for t, c in pairs]
    batch = Batch(terms, *(np.array(x, np.int64) for x in zip(*flat, strict=True)), len(held))
    shared = spark.sparkContext.broadcast(batch)
    most = peaks.filter("term >= 0").groupBy("m", "term").agg(F.max("top").alias("top")).groupBy("m").agg(F.collect_list(F.struct("term", "top")).alias("tops"))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        for x in batches:
            for m, tops in zip(x["m"], x["tops"], strict=True):
                best = np.zeros(len(b.terms), np.int64)
                best[[t["term"] for t in tops]] = impact(np.array([t["top"] for t in tops], np.int64), m)
                sums = np.zeros(b.items, np.int64)
                np.add.at(sums, b.item, b.gain * best[b.term])
                yield pd.DataFrame({"m": [m], "bounds": [sums]})

    sizes = {r["m"]: r["docs"] for r in peaks.filter("term < 0").groupBy("m").agg(F.sum("docs").alias("docs")).collect()}
    bounds = {r["m"]: r["bounds"] for r in most.mapInPandas(bound, "m long, bounds array<long>").collect()}
    ms = np.array(sorted(bounds), np.int64)
    limit = np.array([bounds[m] for m in ms.tolist()], np.int64).reshape(len(ms), len(held))
    order = np.argsort(-limit, axis=0, kind="stable")  # strata of each item, best bound first
    docs_upto = np.cumsum(np.array([sizes[m] for m in ms.tolist()], np.int64)[order], axis=0)
    wave = np.searchsorted(np.array(WAVES[:-1]) * index.n_docs, docs_upto, "right")
    large, floors, found = limit.max(axis=0, initial=0) >= 1 << 53, np.zeros(len(held), np.int64), None
    for w in range(len(WAVES)):
        turn = np.zeros(limit.shape, bool)
        np.put_along_axis(turn, order, wave == w, axis=0)
        turn &= limit >= np.maximum(floors, 1)
        if not turn.any():
            continue
        got = cut(_visit(index, shared, ms, turn, floors, large, k))
        found = got if found is None else found.unionByName(got)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
        for r in ranked.filter(F.col("rank") == k).select("item", "score").collect():
            floors[r["item"]] = r["score"]
    if found is None:
        return spark.createDataFrame([], shape)
    named = rows_of(spark, [(i, r["id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def _peaks(names):
    """For each block: its documents (term -1), and for each asked term documents and largest tf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                m, own = b.column("m")[i].as_py(), b.column("terms")[i].as_py()
                runs, tf, lens = (np.asarray(b.column(c)[i].values, np.int64) for c in ("runs", "tf", "len"))
                first = np.r_[0, np.cumsum(runs)[:-1]]
                df, top = np.add.reduceat(lens, first), tf[np.cumsum(runs) - 1]  # runs ascend by tf
                at = [j for j, t in enumerate(own) if t in names.value]
                term = [-1, *(names.value[own[j]] for j in at)]
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(term), pa.int64()), pa.array([len(b.column("ids")[i])] * len(term), pa.int64()), pa.array(term, pa.int32()),
                                                  pa.array(np.r_[0, df[at]], pa.int64()), pa.array(np.r_[0, top[at]], pa.int32())], ["m", "docs", "term", "df", "top"])

    return run


def _visit(index: LexicalIndex, shared, ms: np.ndarray, turn: np.ndarray, floors: np.ndarray, large: np.ndarray, k: int) -> DataFrame:
    """The k best of each block for the items that visit its stratum in this turn: item, doc_id, score."""
    spark = index.blocks.sparkSession
    plan = spark.sparkContext.broadcast((ms, np.packbits(turn, axis=1), floors, large))
    some = rows_of(spark, [(int(m),) for m in ms[turn.any(axis=1)]], "m long")  # at most one row a stratum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, (strata, bits, floor, beyond) = shared.value, plan.value
        for b in batches:
            for i in range(b.num_rows):
                m = b.column("m")[i].as_py()
                visits = np.unpackbits(bits[int(np.searchsorted(strata, m))], count=batch.items).astype(bool)
                runs, tf, lens = (np.asarray(b.column(c)[i].values, np.int64) for c in ("runs", "tf", "len"))
                docs, ids = np.frombuffer(b.column("docs")[i].as_py(), "<u4").astype(np.int64), b.column("ids")[i].values
                got = list(best_of_block(batch, m, b.column("terms")[i].as_py(), runs, tf, lens, docs, len(ids), visits, floor, k, beyond))
                if got:
                    where = np.concatenate([g[1] for g in got])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]), pa.int32()), ids.take(pa.array(where)), pa.array(np.concatenate([g[2] for g in got]), pa.int64())],
                                                     ["item", "doc_id", "score"])

    return index.blocks.join(F.broadcast(some), "m", "left_semi").mapInArrow(tidy(run), f"item int, doc_id {index.id_type}, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """search() of all docs for the items. The index holds the items' terms, or all terms if those pass TERM_BYTES."""
    words = item_terms(items, item, text).select(F.explode(F.split("words", " ")).alias("w")).distinct()
    words = cut(words)
    total = words.agg(F.sum(F.octet_length("w") + 60)).first()[0] or 0
    terms = {r["w"].encode() for r in words.collect()} if total <= TERM_BYTES else None
    return search(build_index(docs, key, text, terms), items, k, item, text)

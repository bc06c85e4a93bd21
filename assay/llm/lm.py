"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the scoring tasks.

Counting: each task turns its texts into word hashes and sorts and merges the bigrams of about `FLUSH` tokens at a time;
the merged runs travel to buckets. A bucket is a slice of the previous word's hash. A word that is frequent as previous
word (found in a hash sample of the texts, which only sizes the buckets) has buckets of its own, sliced by the next word's
hash as finely as its share of the tokens asks for; a frequent pair costs one entry in each run. So buckets stay at about
`BUCKET_TOKENS` tokens. A bucket merges its runs into a sorted hash array with counts, and hands on, word by word, the counts of contexts and
continuations, which word buckets merge into a second sorted array. Both are files in the shared folder.

Scoring: narrow tasks map the arrays into memory and look up each slice's distinct words and pairs in sorted order,
so memory stays bounded by the slice while the page cache holds what is used. No text is shuffled. A map holds no file
descriptor, and at most OPEN_MAPS are kept, the latest used.

Hashes have 48 bits for a word and 64 for a pair; a thousand million words would see about one collision in a million.
The order is two: the disk budget of four times the input does not hold trigram runs (README).

Counts have 64 bits: those over 32 bits are kept apart in a bucket's file.

Null or empty text: only the end token. No training rows: every token gets the uniform floor. Repeated rows count as
often as they occur.
"""

from __future__ import annotations

import math
import mmap
import tempfile
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import aliased, tidy
from assay.session import shared_dir, ship

#: Tokens merged at a time in a counting task, bytes of text scored at a time, tokens meant for one bucket.
FLUSH, SLICE_BYTES, BUCKET_TOKENS = 1_000_000, 2_000_000, 300_000
START, END = 0, 1  # reserved word hashes
WORD_BITS, CUR_BITS = 48, 16
#: Words that may have buckets of their own, share of the texts that finds them, maps kept open by a task.
HOT_WORDS, HOT_SAMPLE, OPEN_MAPS = 10_000, 64, 4_096
BIG = 2**32 - 1
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORD_ROW = np.dtype([("h", "<u8"), ("c", "<i8"), ("t", "<i8"), ("n1", "<i8"), ("n2", "<i8"), ("n3", "<i8")])
RUN_TYPES = {"c": "<i8", "t": "<u4", "n1": "<u4", "n2": "<u4", "n3": "<u4"}  # one bucket's share fits


class Words(dict):
    """Word hashes with a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = max(xxhash.xxh64_intdigest(word) >> 16, 2)
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of the words and the end."""
        tokens = (text or b"").lower().split()
        out = np.empty(len(tokens) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        out[-1] = END
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    z = (x ^ (x >> np.uint64(23))) * K1
    return z ^ (z >> np.uint64(29))


@dataclass
class Layout:
    """Where a pair is kept: a bucket code, and a 64-bit key that orders pairs inside it."""

    p_bits: int  # slices of previous words
    hot: np.ndarray  # sorted hashes of frequent previous words
    s_bits: np.ndarray  # bits of the next word's hash for each of them

    def place(self, prev: np.ndarray, cur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, key). Codes of hot words' buckets lie behind those of the slices."""
        bucket = _top(prev, self.p_bits).astype(np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, prev), len(self.hot) - 1)
            rows = np.flatnonzero(self.hot[at] == prev)
            bits = self.s_bits[at[rows]]
            bucket[rows] = (1 << self.p_bits) + (at[rows] << CUR_BITS) + (_top(cur[rows], CUR_BITS).astype(np.int64) >> (CUR_BITS - bits))
        return bucket, _mix(_mix(prev) * K2 + cur) * K2


def _top(x: np.ndarray, n: int) -> np.ndarray:
    return _mix(x) * K2 >> np.uint64(64 - n) if n else np.zeros(len(x), np.uint64)


def _six(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(raw: bytes, at: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, at).reshape(-1, 6)
    return out.view("<u8").ravel()


def pack_pairs(prev: np.ndarray, cur: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs ordered by previous word: each previous word once, with the number of its pairs."""
    first = np.flatnonzero(np.r_[True, prev[1:] != prev[:-1]])
    lens = np.diff(np.r_[first, len(prev)]).astype("<u4")
    return np.array([len(first), len(prev)], "<u4").tobytes() + _six(prev[first]) + lens.tobytes() + _six(cur) + n.astype("<u4").tobytes()


def unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, n = np.frombuffer(raw, "<u4", 2)
    lens = np.frombuffer(raw, "<u4", k, 8 + 6 * k)
    at = 8 + 10 * int(k)
    return np.repeat(_unsix(raw, 8, k), lens), _unsix(raw, at, n), np.frombuffer(raw, "<u4", n, at + 6 * int(n))


def merge_pairs(prev: np.ndarray, cur: np.ndarray, n: np.ndarray, layout: Layout) -> tuple[np.ndarray, ...]:
    """Bucket, key, prev, cur and summed count of the distinct pairs, ordered by bucket and key."""
    bucket, keys = layout.place(prev, cur)
    order = np.lexsort((keys, bucket)) if len(bucket) and bucket.min() != bucket.max() else np.argsort(keys)
    bucket, keys = bucket[order], keys[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])]) if len(keys) else np.empty(0, np.int64)
    total = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    return bucket[first], keys[first], prev[order][first], cur[order][first], total


class Folder:
    """Files of the shared folder, whatever file system holds it."""

    def __init__(self, uri: str):
        self.uri = uri

    @cached_property
    def place(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (pafs.LocalFileSystem(), self.uri)

    def __getstate__(self) -> dict:
        return {"uri": self.uri}

    def write(self, name: str, data: bytes) -> None:
        """A file appears whole or not at all, so a retried task does no harm."""
        store, top = self.place
        part = f"{top}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(data)
        store.move(part, f"{top}/{name}")

    def map(self, name: str) -> memoryview:
        """The file mapped into memory, without a descriptor; from a remote store, a private copy that has no name any more."""
        store, top = self.place
        path = f"{top}/{name}"
        info = store.get_file_info(path)
        if info.type == pafs.FileType.NotFound or not info.size:
            return memoryview(b"")
        if isinstance(store, pafs.LocalFileSystem):
            with open(path, "rb") as src:
                return memoryview(mmap.mmap(src.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False))
        with tempfile.TemporaryFile() as copy, store.open_input_stream(path) as src:
            while chunk := src.read(1 << 24):
                copy.write(chunk)
            copy.flush()
            return memoryview(mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False))


def pack_counts(keys: np.ndarray, n: np.ndarray) -> bytes:
    """A bucket's file: numbers of pairs and of big counts, sorted keys, 32-bit counts, then (place, count) of the big ones."""
    big = np.flatnonzero(n >= BIG)
    return b"".join(x.tobytes() for x in (np.array([len(keys), len(big)], "<u8"), keys.astype("<u8"), np.minimum(n, BIG).astype("<u4"), big.astype("<i8"), n[big].astype("<i8")))


def find_counts(raw: memoryview, keys: np.ndarray) -> np.ndarray:
    """Counts of sorted keys in a bucket's file, zero where it has none."""
    out = np.zeros(len(keys), np.int64)
    if not len(raw):
        return out
    m, big = (int(x) for x in np.frombuffer(raw, "<u8", 2))
    have = np.frombuffer(raw, "<u8", m, 16)
    at = np.minimum(np.searchsorted(have, keys), m - 1)
    ok = have[at] == keys
    out[ok] = np.frombuffer(raw, "<u4", m, 16 + 8 * m)[at[ok]]
    if big:
        spots, counts = np.frombuffer(raw, "<i8", big, 16 + 12 * m), np.frombuffer(raw, "<i8", big, 16 + 12 * m + 8 * big)
        for i in np.flatnonzero(out == BIG):
            out[i] = counts[np.searchsorted(spots, at[i])]
    return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of entries with count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))  # type: ignore[return-value]


@dataclass
class LanguageModel:
    folder: Folder
    layout: Layout
    w_bits: int  # slices of words
    tokens: int  # N
    vocabulary: int  # V
    types: int  # distinct pairs
    low: tuple[float, float, float]
    low_back: float  # weight of the uniform distribution under the continuation distribution
    high: tuple[float, float, float]

    def __post_init__(self) -> None:
        self.open: OrderedDict[str, memoryview] = OrderedDict()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": OrderedDict()}

    def _map(self, name: str) -> memoryview:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        if len(self.open) >= OPEN_MAPS:
            self.open.popitem(last=False)
        got = self.open[name] = self.folder.map(name)
        return got

    def word_rows(self, words: np.ndarray) -> np.ndarray:
        """Rows of distinct sorted words; zeros where a word was never counted."""
        out = np.zeros(len(words), WORD_ROW)
        bucket = word_slices(words, self.w_bits)
        for b in np.unique(bucket).tolist():
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            raw = self._map(f"words-{b}")
            if len(raw):
                m = len(raw) // (8 + WORD_ROW.itemsize)  # hashes, then rows
                keys = np.frombuffer(raw, "<u8", m)
                at = np.minimum(np.searchsorted(keys, words[lo:hi]), m - 1)
                ok = keys[at] == words[lo:hi]
                out[lo:hi][ok] = np.frombuffer(raw, WORD_ROW, m, 8 * m)[at[ok]]
        return out

    def pair_counts(self, prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
        bucket, keys = self.layout.place(prev, cur)
        order = np.lexsort((keys, bucket))
        bucket, keys = bucket[order], keys[order]
        out = np.empty(len(keys), np.int64)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[order[lo:hi]] = find_counts(self._map(f"pairs-{bucket[lo]}"), keys[lo:hi])
        return out

    def score(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text of a slice (starts: first token of each): known tokens, base score, model score."""
        prev = np.r_[np.uint64(START), words[:-1]]
        prev[starts] = START
        seen, where = np.unique(np.r_[words, np.uint64(START)], return_inverse=True)
        rows = self.word_rows(seen)
        count = rows["c"].copy()
        count[seen == START] = 0
        at = where[:-1]
        at_prev = np.r_[where[-1], at[:-1]]
        at_prev[starts] = where[-1]
        context = rows["c"].copy()  # the row of START holds the number of texts
        t = rows["t"].astype(np.int64)
        low = np.maximum(t - np.select([t == 0, t == 1, t == 2], [0.0, self.low[0], self.low[1]], self.low[2]), 0.0) / max(self.types, 1)
        low = low + self.low_back / (self.vocabulary + 1)
        _, first, pair = np.unique(_mix(_mix(prev) * K2 + words), return_index=True, return_inverse=True)
        c = self.pair_counts(prev[first], words[first])
        top = np.maximum(c - np.select([c == 0, c == 1, c == 2], [0.0, self.high[0], self.high[1]], self.high[2]), 0.0)[pair]
        back = rows["n1"] * self.high[0] + rows["n2"] * self.high[1] + rows["n3"] * self.high[2]
        total = np.maximum(context, 1)[at_prev]
        p = np.where(context[at_prev] > 0, (top + back[at_prev] * low[at]) / total, low[at])
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))
        return np.add.reduceat((count > 0)[at].astype(np.int64), starts), np.add.reduceat(base[at], starts), np.add.reduceat(np.log10(p), starts)


def _slices(column: pa.Array, words: Words, most: int) -> Iterator[tuple[list[np.ndarray], int]]:
    """Word hashes of consecutive texts, cut where their bytes pass `most`; with the number of texts."""
    held, size = [], 0
    for x in column:
        raw = x.as_py()
        held.append(words.of(raw))
        size += len(raw or b"")
        if size >= most:
            yield held, len(held)
            held, size = [], 0
    if held:
        yield held, len(held)


def word_slices(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(WORD_BITS - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)


def bits_for(tokens: float) -> int:
    """Bits that number the buckets of this many tokens."""
    return max(0, math.ceil(math.log2(max(1, tokens / BUCKET_TOKENS))))


def hot_words(texts: DataFrame, text: str, tokens: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that fill more than a bucket as previous words, HOT_WORDS at most, and their slicing bits.

    Found by counts in one of HOT_SAMPLE texts; a word that is missed only makes a bucket larger.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), Counter()
        for batch in batches:
            for x in batch.column("t"):
                w = words.of(x.as_py())
                w[-1] = START  # the start precedes each text's first word
                seen.update(dict(zip(*(v.tolist() for v in np.unique(w, return_counts=True)), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    few = texts.filter(F.pmod(F.xxhash64(text), F.lit(HOT_SAMPLE)) == 0).select(F.col(text).cast("binary").alias("t"))
    counts = few.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.filter(F.col("n") > total * (BUCKET_TOKENS / max(tokens, 1.0))).orderBy(F.desc("n"), "w").limit(HOT_WORDS).collect()
    rows = sorted((r["w"], min(bits_for(2 * r["n"] / total * tokens), CUR_BITS)) for r in frequent)
    return np.array([w for w, _ in rows], np.uint64), np.array([b for _, b in rows], np.int64)


def fit(texts: DataFrame, text: str = "text") -> LanguageModel:
    """Count all rows of texts and write the model's arrays into the shared folder."""
    spark = texts.sparkSession
    ship(spark)
    tokens = (texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) / 6
    layout = Layout(bits_for(tokens), *hot_words(texts, text, tokens))
    w_bits = max(0, layout.p_bits - 2)
    uri = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    folder = Folder(uri)
    folder.place[0].create_dir(folder.place[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, prevs, curs, held = Words(), [], [], 0

        def flush() -> pa.RecordBatch:
            prev, cur = np.concatenate(prevs), np.concatenate(curs)
            bucket, _, prev, cur, n = merge_pairs(prev, cur, np.ones(len(prev), np.int64), layout)
            order = np.lexsort((prev, bucket))
            bucket, prev, cur, n = bucket[order], prev[order], cur[order], n[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(bucket)]
            blobs = [pack_pairs(prev[a:b], cur[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "run"])

        for batch in batches:
            for x in batch.column("t"):
                w = words.of(x.as_py())
                curs.append(w)
                prevs.append(np.r_[np.uint64(START), w[:-1]])
                held += len(w)
                if held >= FLUSH:
                    yield flush()
                    prevs, curs, held = [], [], 0
        if held:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        parts = [unpack_pairs(x) for x in pdf["run"]]
        _, keys, prev, cur, n = merge_pairs(*(np.concatenate([p[i] for p in parts]) for i in range(3)), layout)
        folder.write(f"pairs-{b}", pack_counts(keys, n))
        rows = np.zeros(len(keys) * 2, WORD_ROW)  # as context, then as continuation
        rows["h"] = np.r_[prev, cur]
        for i, k in enumerate(("n1", "n2", "n3"), 1):
            rows[k][: len(prev)] = (n == i) if i < 3 else (n >= 3)
        rows["t"][len(prev) :], rows["c"][len(prev) :] = 1, n
        rows = sum_words(rows)
        start = rows["h"] == START
        rows["c"][start] = n[prev == START].sum()
        bucket = word_slices(rows["h"], w_bits)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(rows)]
        blobs = [_six(rows["h"][a:z]) + b"".join(rows[k][a:z].astype(t).tobytes() for k, t in RUN_TYPES.items()) for a, z in zip(cuts, cuts[1:], strict=False)]
        out = pd.DataFrame({"bucket": bucket[cuts[:-1]], "run": blobs})
        coc = np.array([(n == i).sum() for i in range(1, 5)], "<i8").tobytes()
        return pd.concat([out, pd.DataFrame({"bucket": [0], "run": [b"" + coc]})])

    def words_of(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        coc, parts = np.zeros(4, np.int64), []
        for raw in pdf["run"]:
            if len(raw) == 32:  # counts of counts; a word run has 30 bytes a word
                coc += np.frombuffer(raw, "<i8")
                continue
            m = len(raw) // 30
            rows = np.zeros(m, WORD_ROW)
            rows["h"], at = _unsix(raw, 0, m), 6 * m
            for k, kind in RUN_TYPES.items():
                rows[k], at = np.frombuffer(raw, kind, m, at), at + np.dtype(kind).itemsize * m
            parts.append(rows)
        rows = sum_words(np.concatenate(parts)) if parts else np.zeros(0, WORD_ROW)
        folder.write(f"words-{b}", rows["h"].tobytes() + rows.tobytes())
        real = rows[rows["h"] != START]
        t = real["t"].astype(np.int64)
        numbers = [real["c"].sum(), (real["c"] > 0).sum(), t.sum(), *((t == i).sum() for i in range(1, 5)), *coc]
        return pd.DataFrame([dict(zip(NUMBERS, map(int, numbers), strict=True))])

    runs = texts.select(F.col(text).cast("binary").alias("t")).mapInArrow(tidy(count), "bucket long, run binary")
    partial = runs.groupBy("bucket").applyInPandas(merge, "bucket long, run binary")
    made = partial.groupBy("bucket").applyInPandas(words_of, ", ".join(f"{x} long" for x in NUMBERS))
    n = [x or 0 for x in made.agg(*(F.sum(x).alias(x) for x in NUMBERS)).first()]
    tokens, vocabulary, types, t, b = n[0], n[1], n[2], n[3:7], n[7:11]
    low = discounts(t)
    mass = low[0] * t[0] + low[1] * t[1] + low[2] * (vocabulary - t[0] - t[1])
    return LanguageModel(folder, layout, w_bits, tokens, vocabulary, types, low, mass / types if types else 1.0, discounts(b))


NUMBERS = ("tokens", "vocabulary", "types", "t1", "t2", "t3", "t4", "b1", "b2", "b3", "b4")


def sum_words(rows: np.ndarray) -> np.ndarray:
    """Rows summed by word, ordered by hash."""
    order = np.argsort(rows["h"], kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows["h"][1:] != rows["h"][:-1]]) if len(rows) else np.empty(0, np.int64)
    out = np.zeros(len(first), WORD_ROW)
    out["h"] = rows["h"][first]
    for k in ("c", "t", "n1", "n2", "n3"):
        out[k] = np.add.reduceat(rows[k].astype(np.int64), first) if len(first) else 0
    return out


def score(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score, score and perplexity in place of the text."""
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    others = [c for c in docs.columns if c not in (text, *new)]
    taken, own = aliased(others)
    shape = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(own, others, strict=True))
    shape += "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            at = 0
            for held, n in _slices(batch.column(len(others)), words, SLICE_BYTES):
                lens = np.array([len(w) for w in held])
                known, base, full = model.score(np.concatenate(held), np.cumsum(lens) - lens)
                rows = batch.slice(at, n)
                at += n
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in own), pa.array(lens), pa.array(known), pa.array(np.full(n, model.tokens)), pa.array(base), pa.array(full), pa.array(10.0 ** np.minimum(-full / lens, 300))],
                    [*own, *new],
                )

    ship(docs.sparkSession)
    return docs.select(*taken, F.col(text).cast("binary").alias("__text")).mapInArrow(tidy(run), shape).toDF(*others, *new)

"""Language identification with error-correcting output codes.

Each language has a codeword of bits; for every bit a binary character n-gram classifier says on which side a text
falls. Up to seven languages get the exhaustive code (all 2^(k-1) - 1 ways to part them), more get seeded random
codewords. A bit's classifier is a naive-Bayes log-odds table over hashed n-grams of one to three letters, word ends
marked. Decoding sums each bit's logistic loss, weighted by how well that bit parts the training counts, takes the
codeword of least loss, and flags a text as ambiguous when the runner-up is close.

The tables are counts over a sample of at most `max_labelled` documents by hash order; scoring reads whole
texts. Null texts and texts without a letter (digits, signs, emoji) are `und` with score 0. Without training rows everything is `und`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import aliased
from assay.session import ship

MAX_LABELLED, SLOTS, AMBIGUOUS = 20_000, 1 << 16, 0.9
#: Letters hashed at once.
CHUNK = 1 << 16


@cache
def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_slots(text: str, letters: np.ndarray) -> Iterator[np.ndarray]:
    """Slots of all letter n-grams, chunk by chunk; nothing for a text without letters."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters[cp]
    if not alpha.any():
        return
    keep = alpha | np.r_[False, alpha[:-1]]  # a letter, or the first gap after one
    seq = np.r_[np.uint64(1), np.where(alpha, cp, 1)[keep].astype(np.uint64), np.uint64(1)]
    k, shift, mask = np.uint64(0x9E3779B97F4A7C15), np.uint64(40), np.uint64(SLOTS - 1)
    for at in range(0, len(seq), CHUNK):
        s = seq[at : at + CHUNK + 2]
        h1 = s * k
        h2 = (h1[:-1] ^ s[1:]) * k
        h3 = (h2[:-1] ^ s[2:]) * k
        yield np.concatenate([((h >> shift) & mask)[:CHUNK] for h in (h1[1:], h2, h3)]).astype(np.int64)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1."""
    if k < 2:
        return np.ones((k, 0), np.int8)
    if k <= 7:
        columns = [[1, *c] for c in itertools.product((1, -1), repeat=k - 1)][1:]
        return np.array(columns, np.int8).T
    bits = 6 * int(np.ceil(np.log2(k)))
    rng = np.random.default_rng(seed)
    tries = [np.where(rng.random((k, bits)) < 0.5, -1, 1).astype(np.int8) for _ in range(200)]
    apart = lambda m: min(int((m[i] != m[i + 1 :]).sum(axis=1).min()) for i in range(k - 1))
    return max(tries, key=apart)


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray  # languages x bits
    tables: np.ndarray  # slots x bits, float32 log-odds
    trust: np.ndarray  # weight of each bit

    def decode(self, mean: np.ndarray) -> tuple[str, float, bool]:
        """Language, probability-like score and ambiguity from the bits' mean log-odds."""
        margin = 8.0 * mean
        loss = (self.trust * np.logaddexp(0.0, -self.code * margin)).sum(axis=1)
        p = np.exp(-(loss - loss.min()))
        p /= p.sum()
        best = int(np.argmax(p))
        return self.langs[best], float(p[best]), bool(p[best] < AMBIGUOUS)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_labelled: int = MAX_LABELLED) -> LanguageModel:
    """Learn from rows of docs with a language. The driver receives one count vector for each language."""
    ship(docs.sparkSession)
    ids = (
        docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull())
        .groupBy(key).agg(F.min(lang).alias("_lang"))
        .orderBy(F.xxhash64(key), key)
        .limit(max_labelled)
    )
    sample = docs.select(key, text).join(F.broadcast(ids), key).select(F.col("_lang").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = _letters(), {}
        for b in batches:
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for slots in gram_slots(t or "", letters):
                    total[name] = total.get(name, 0) + np.bincount(slots, minlength=SLOTS)
        for name, v in total.items():
            slots = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slots), pa.string()), pa.array(slots, pa.int64()), pa.array(v[slots], pa.int64())], ["lang", "slot", "n"])

    # sums of sparse counts, combined before the shuffle; the driver gets SLOTS numbers a language at most
    counts = sample.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    got = counts.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("counts")).toArrow()
    rows = []
    for name, pairs in zip(got.column("lang").to_pylist(), got.column("counts"), strict=True):
        v = np.zeros(SLOTS)
        v[pairs.values.field("slot").to_numpy(zero_copy_only=False)] = pairs.values.field("n").to_numpy(zero_copy_only=False)
        rows.append((name, v))
    rows.sort(key=lambda x: x[0])
    langs = [name for name, _ in rows]
    code = codewords(len(langs))
    if len(langs) < 2:
        return LanguageModel(langs, code, np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    rates = np.array([(c + 0.5) / (c.sum() + 0.5 * SLOTS) for _, c in rows])  # each language counts alike
    tables, trust = [], []
    for bit in code.T:
        a, b = rates[bit > 0].mean(axis=0), rates[bit < 0].mean(axis=0)
        odds = np.log(a) - np.log(b)
        tables.append(odds)
        trust.append(((a - b) * odds).sum())  # the symmetric divergence of the two sides
    weight = np.array(trust) / max(np.mean(trust), 1e-12)
    return LanguageModel(langs, code, np.array(tables, np.float32).T.copy(), weight)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous in place of the text."""
    others = [c for c in docs.columns if c not in (text, "lang_pred", "score", "ambiguous")]
    taken, own = aliased(others)
    shape = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(own, others, strict=True)) + "lang_pred string, score double, ambiguous boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots * bits floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, letters = shared.value, _letters()

        def one(t: str | None) -> tuple[str, float, bool]:
            total, n = 0.0, 0
            for slots in gram_slots(t or "", letters):
                total = total + np.bincount(slots, minlength=SLOTS).astype(np.float32) @ m.tables if len(slots) > SLOTS else total + m.tables[slots].sum(axis=0, dtype=np.float64)
                n += len(slots)
            if not n or not m.langs:
                return "und", 0.0, True
            if len(m.langs) == 1:
                return m.langs[0], 1.0, False
            return m.decode(np.asarray(total) / n * min(1.0, np.sqrt(n / 60)))

        for b in batches:
            got = [one(t.as_py()) for t in b.column("__text")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in own), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                [*own, "lang_pred", "score", "ambiguous"],
            )

    ship(docs.sparkSession)
    return docs.select(*taken, F.col(text).alias("__text")).mapInArrow(run, shape).toDF(*others, "lang_pred", "score", "ambiguous")

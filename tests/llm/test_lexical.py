import math
import re
from collections import Counter

import numpy as np
import pytest

from assay.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return Counter(WORD.findall(low))


def brute_force(docs, items, k):
    held = [(d, t) for d, text in docs if (t := terms(text))]
    n, length = len(held), sum(t.total() for _, t in held)
    df = Counter(w for _, t in held for w in t)
    out = set()
    for item, text in set(items):
        scored = []
        for d, t in held:
            m = 25 + (75 * t.total() * n) // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * t[w]) // (1000 * t[w] + 8 * m)) for w, q in terms(text).items() if w in t)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out |= {(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def items(spark, docs):
    rows = [(i, r.text) for i, r in enumerate(docs.filter("doc_id % 9 = 0").orderBy("doc_id").collect())]
    rows += [(90, "ALPHA1 alpha1 été Été gamma3 nowhere"), (91, None), (92, "...!"), (None, "beta2 beta2 zeta0"), (90, "ALPHA1 alpha1 été Été gamma3 nowhere"), (93, "alpha0")]
    return spark.createDataFrame(rows, "item_id long, text string")


def rows_of(df):
    return {tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()}


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, docs, items, monkeypatch, small):
    more = docs.select("doc_id", "text", "`a.b`").unionByName(spark.createDataFrame([(300, "Été été ÉTÉ alpha1", 1), (301, "été", 1)], "doc_id long, text string, `a.b` int"))
    if small:  # many blocks a stratum, several batches of items, all terms in the index
        monkeypatch.setattr(lexical, "BLOCK_DOCS", 3)
        monkeypatch.setattr(lexical, "BATCH_PAIRS", 60)
        monkeypatch.setattr(lexical, "TERM_BYTES", 1)
    got = rows_of(lexical.rank_documents(more, items, 5))
    assert got == brute_force([(r.doc_id, r.text) for r in more.collect()], [tuple(r) for r in items.collect()], 5)


def test_one_index_serves_many_searches(docs, items):
    index = lexical.build_index(docs)
    a = rows_of(lexical.search(index, items, 3))
    assert a == {r for r in rows_of(lexical.search(index, items, 7)) if r[1] <= 3}
    assert index.n_docs == docs.filter("regexp_like(text, '[0-9A-Za-z]')").count()


def test_nothing_to_rank(docs, empty, items):
    assert lexical.rank_documents(empty, items).count() == 0
    assert lexical.rank_documents(docs, items.filter("item_id = 91")).count() == 0


def test_a_stratum_is_left_out_only_below_the_floor(monkeypatch):
    """Blocks scored in small steps give what all at once gives; floors keep equal scores."""
    rng = np.random.default_rng(3)
    batch = lexical.Batch({str(i): i for i in range(12)}, np.repeat(np.arange(6), 4), rng.permuted(np.tile(np.arange(12), (6, 1)), axis=1)[:, :4].ravel(), rng.integers(1, 9, 24), 6)
    runs, tf, lens, docs = np.full(12, 2), np.tile([1, 3], 12), np.full(24, 4), rng.permuted(np.tile(np.arange(20), (12, 1)), axis=1)[:, :8].ravel()
    args = (batch, 40, [str(i) for i in range(12)], runs, tf, lens, docs, 20, np.ones(6, bool))
    whole = {i: (p.tolist(), s.tolist()) for i, p, s in lexical.best_of_block(*args, np.zeros(6, np.int64), 5, np.zeros(6, bool))}
    monkeypatch.setattr(lexical, "CHUNK", 7)
    monkeypatch.setattr(lexical, "SUMS", 1)
    steps = {i: (p.tolist(), s.tolist()) for i, p, s in lexical.best_of_block(*args, np.zeros(6, np.int64), 5, np.ones(6, bool))}
    assert whole == steps and len(whole) == 6
    floors = np.array([whole[i][1][-1] for i in range(6)])
    assert whole == {i: (p.tolist(), s.tolist()) for i, p, s in lexical.best_of_block(*args, floors, 5, np.zeros(6, bool))}

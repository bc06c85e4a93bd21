"""Language id, toxicity, nearest neighbours and the pipeline."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from assay.llm import ann, langid, toxicity

STEMS = {"aa": "der die und ist nicht haus wald berg".split(), "bb": "the and of house forest hill with that".split(), "cc": "le la et maison forêt avec une pas".split()}


@pytest.fixture(scope="module")
def tongues(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(STEMS[k]) for _ in range(rnd.randint(4, 60))), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 ... !!", "bb"), (1003, "haus " * 50_000, None), (1004, "\U0001F600 \U0001F680\U0001F4A1 \U0001F1E9\U0001F1EA", None), (None, "the house", "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_are_told_apart(tongues, docs, empty):
    model = langid.fit(tongues.filter("doc_id % 4 <> 2"))
    assert model.langs == ["aa", "bb", "cc"] and model.code.shape == (3, 3)
    got = langid.identify(tongues, model).collect()
    assert sum(r.lang_pred == r.lang for r in got if r.lang and r.doc_id is not None and r.doc_id < 1000) >= 177
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002, 1004))
    assert by_id[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(docs, model).count() == docs.count() and langid.identify(empty, model).count() == 0
    untrained = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(tongues, untrained).collect()} == {"und"}


def brute_languages(rows):
    """Counts, tables and decoding written out over dictionaries of hashed n-grams."""
    def grams(t):
        seq, before = ["\x01"], False
        for c in t.lower():
            if c.isalpha() or before:
                seq.append(c if c.isalpha() else "\x01")
            before = c.isalpha()
        seq = [ord(c) for c in [*seq, "\x01"]]
        mix = lambda h, c: (h ^ c) * 0x9E3779B97F4A7C15 % 2**64
        out = Counter()
        for n in (1, 2, 3):
            for i in range(1 if n == 1 else 0, len(seq) - n + 1):
                h = 0
                for c in seq[i : i + n]:
                    h = mix(h, c)
                out[h >> 40 & langid.SLOTS - 1] += 1
        return out if any(c.isalpha() for c in t) else Counter()
    total = {}
    for _, t, name in rows:
        if name is not None:
            total.setdefault(name, Counter()).update(grams(t or ""))
    names = sorted(total)
    rate = {k: lambda s, c=total[k], n=sum(total[k].values()): (c[s] + 0.5) / (n + 0.5 * langid.SLOTS) for k in names}
    code = langid.codewords(len(names))
    def predict(t):
        g, loss = grams(t or ""), np.zeros(len(names))
        n = sum(g.values())
        if not n:
            return "und"
        for bit in code.T:
            sides = [[k for k, b in zip(names, bit) if b == side] for side in (1, -1)]
            odds = lambda s: math.log(np.mean([rate[k](s) for k in sides[0]])) - math.log(np.mean([rate[k](s) for k in sides[1]]))  # noqa: B023, E731
            margin = 8 * sum(c * odds(s) for s, c in g.items()) / n * min(1, math.sqrt(n / 60))
            gap = sum((np.mean([rate[k](s) for k in sides[0]]) - np.mean([rate[k](s) for k in sides[1]])) * odds(s) for s in {s for c in total.values() for s in c})
            loss += gap * np.logaddexp(0, -bit * margin)
        return names[int(np.argmin(loss))]
    return predict


def test_languages_match_brute_force(spark, tongues):
    train = [r for r in tongues.collect() if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 4 != 2]
    model = langid.fit(spark.createDataFrame(train, tongues.schema))
    predict = brute_languages(train)
    some = [r for r in tongues.collect() if r.doc_id is not None and (r.doc_id % 6 == 0 or r.doc_id >= 1000) and r.doc_id != 1003]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(some, tongues.schema), model).collect()}
    assert got == {r.doc_id: predict(r.text) for r in some}


@pytest.mark.parametrize("k", [1, 2, 4, 7, 12])
def test_codewords_are_apart(k):
    code = langid.codewords(k)
    assert len(code) == k and len({tuple(r) for r in code}) == k or k == 1
    if k > 2:
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= max(2, 2 ** (k - 2) if k <= 7 else 4)


@pytest.fixture(scope="module")
def comments(spark):
    rnd = random.Random(2)
    plain = [f"word{i}" for i in range(80)] + ["you", "not", "said", "dogma"]
    rows, labels = [], []
    for i in range(600):
        w, bad = [rnd.choice(plain) for _ in range(30)], i % 5 == 0
        if bad:
            w[rnd.randrange(30)] = rnd.choice(["blockhead", "dolt", "zorbing", "zorbado", "zorber"])
            w[rnd.randrange(30)] = "dolt"
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(bad)))
    labels += [(0, 1, 1), (3, None, None), (None, 1, 1)]
    rows += [(1000, None), (1001, ""), (1002, "a calm text " * 20_000), (1003, "such a blockhead, a DOLT!"), (1004, "undolted doltish words")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_comments_are_found(comments, docs, empty):
    texts, labels = comments
    model = toxicity.fit(texts, labels)
    assert "dolt" in model.lexicon and not any(k.startswith("word") for k in model.lexicon)
    got = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(600))
    assert got[1000] == got[1001] == got[1002] < 0.5 <= got[1003]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, labels).lexicon == {} and toxicity.ToxicityModel().scanner().score("dolt") < 1e-9


def test_grammar_kinds():
    scan = toxicity.ToxicityModel({"dolt": 2.0, "zorb*": 3.0}).scanner()
    kinds = lambda text: dict(zip(toxicity.KINDS, scan.evidence(text).tolist(), strict=True))
    zero = dict.fromkeys(toxicity.KINDS, 0.0)
    assert kinds("a dolt here") == zero | {"plain": 2.0}
    assert kinds("you dolt") == zero | {"aimed": 2.0} and kinds("dolt are you") == zero | {"aimed": 2.0}
    assert kinds("he is not a dolt") == zero | {"negated": 2.0}
    assert kinds("she said dolt") == zero | {"reported": 2.0}
    assert kinds("not this. a zorbing one") == zero | {"plain": 3.0}
    assert kinds("i will kill you") == zero | {"threat": 1.0}
    assert kinds("adolt, undolt") == zero


def brute_clause(symbols):
    """The rules read off the whole clause, without states."""
    out = dict.fromkeys(toxicity.KINDS, 0.0)
    line = [c for c, _ in symbols]
    completes = set()  # a target ends the threats that it completes
    for i, c in enumerate(line):
        if c == "T":
            before = [j for j in range(max(0, i - 4), i) if line[j] == "V"]
            if before and not any(line[j] == "T" for j in range(before[-1] + 1, i)):
                completes.add(i)
    out["threat"] = float(len(completes))
    for i, (c, w) in enumerate(symbols):
        if c == "I":
            if "N" in line[max(0, i - 3) : i]:
                out["negated"] += w
            elif "R" in line[:i]:
                out["reported"] += w
            else:
                out["aimed" if "T" in line else "plain"] += w
    return [out[k] for k in toxicity.KINDS]


def test_grammar_matches_brute_force():
    rnd, grammar = random.Random(5), toxicity.Grammar()
    for _ in range(4000):
        symbols = [(c, 1.5 + i if c == "I" else 0.0) for i, c in enumerate(rnd.choices("IVTNRO", [2, 1, 1, 1, 1, 3], k=rnd.randint(0, 14)))]
        assert grammar.clause(symbols).tolist() == brute_clause(symbols), symbols
    assert len(grammar.arcs) < 6 * 2 * 5 * 2 * 4 * 2 + 1


def test_rare_insults_and_near_copies(spark):
    """Each of many insults is in few toxic texts; near copies of one toxic text teach none of its own words."""
    rnd = random.Random(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(4000):
        w = [rnd.choice(vocabulary) for _ in range(40)]
        if i % 8 == 0:
            w[rnd.randrange(40)] = f"slur{'abcdefghijklmnopqrstuvwxyz'[i // 8 % 25]}{i // 8 % 25}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 8 == 0)))
    base = [f"own{j}" for j in range(60)]
    for i in range(4000, 4060):
        copy = list(base)
        copy[rnd.randrange(60)] = f"edit{i}"
        rows.append((i, " ".join(copy)))
        labels.append((i, 1))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scan = model.scanner()
    assert all(scan.score(f"word1 slur{'abcdefghijklmnopqrstuvwxyz'[i]}{i} word2") >= 0.5 for i in range(25))
    assert not any(k.startswith(("word", "edit")) for k in model.lexicon)
    assert scan.score("own3 own4 word7 own9") < 0.5


def test_long_text_without_clause_ends_is_linear():
    scan = toxicity.ToxicityModel({"dolt": 2.0}).scanner()
    text = "dolt. " * 60_000
    began = time.perf_counter()
    assert scan.evidence(text)[0] == 120_000
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("scale,parts", [(False, False), (True, False), (True, True)])
def test_neighbours_against_brute_force(spark, monkeypatch, scale, parts):
    if parts:  # long lists, dealt into parts, with leaves that a query does not all see
        monkeypatch.setattr(ann, "MAX_LISTS", 8)
        monkeypatch.setattr(ann, "LIST_ROWS", 300)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if scale:
        x *= rng.uniform(0.5, 2.0, 3000)[:, None]
    x[100:400] = x[100]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    bad = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [float("inf")] * 16), (5100, [1.0])]
    df = df.union(spark.createDataFrame(bad, df.schema))
    got = ann.search(df, df.filter("vec_id % 20 = 0"), 20).toPandas()
    assert set(got["query_id"]) == set(range(0, 3000, 20)) and set(got["vec_id"]) < set(range(3000))
    recall = []
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        recall.append(len(set(want) & set(g["vec_id"])) / 20)
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g["score"], s[g["vec_id"]], atol=1e-12)
        assert list(zip(-g["score"], g["vec_id"], strict=True)) == sorted(zip(-g["score"], g["vec_id"], strict=True))
    assert np.mean(recall) >= 0.95


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.search(df, df.filter("vec_id = 20"), 20).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got)] == [(1, 21, 0.5), (2, 22, 0.0)]
    assert ann.search(df.limit(0), df, 20).count() == 0


def test_repeated_and_null_ids(spark):
    """An id with two vectors is one candidate; all candidates come back where there are fewer than asked for."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[8].tolist()), (20, x[21].tolist()), (None, x[3].tolist())] + [(i, x[0].tolist()) for i in range(500, 560)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pairs = [(i, np.array(v)) for i, v in rows if i is not None]
    for k in (20, 1000):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, df.filter("vec_id in (0, 7, 20, 500)"), k).collect()}
        want = {}
        for q in (0, 7, 20, 500):
            best = {}
            for v in [v for i, v in pairs if i == q]:
                for i, y in pairs:
                    if i != q:
                        best[i] = max(best.get(i, -math.inf), float((y * v).sum()))
            for rank, (i, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k], 1):
                want[(q, rank)] = (i, s)
        assert got == want


def test_pipeline_stages(spark, docs, comments, tmp_path):
    import corpus_pipeline as cp

    folder = str(tmp_path)
    comments[1].write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, docs.filter("doc_id = 7").first().text)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows, n = docs, [docs.count()]
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, rows, folder)
        assert i == len(cp.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{folder}/out{i}")
        rows = spark.read.parquet(f"{folder}/out{i}")
        n.append(rows.count())
    assert n[1] <= n[0] and n[2] < n[1] and n[3] < n[2] and n[4] == n[5] == n[3]
    assert rows.filter("doc_id = 7").count() == 0 < spark.read.parquet(f"{folder}/out1").filter("doc_id = 7").count()
    assert {"shard", "slot", "size"} < set(rows.columns)
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, folder).count() == 0

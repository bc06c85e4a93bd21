"""Decontamination, line de-duplication, SimHash, language model, token counts against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assay.llm import decontamination, linededup, lm, simhash, tokencount

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def bench(spark, docs):
    long_text = docs.filter("doc_id = 203").first().text.split(" ")
    rows = [(1, " ".join(long_text[50:75])), (2, "Alpha1 unknown"), (3, docs.filter("doc_id = 7").first().text.upper()), (4, None), (5, "..."), (6, "zzz qqq"), (1, "delta3"), (None, " ".join(long_text[80:95]))]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("broadcast_bytes", [decontamination.BROADCAST_BYTES, 0])
def test_decontamination_matches_brute_force(docs, bench, broadcast_bytes):
    wins = []
    for r in bench.collect():
        w = WORD.findall(lower(r.text))
        wins += [(r.item_id, tuple(w[i : i + 10])) for i in range(max(1, len(w) - 9))] if w else []
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in decontamination.contamination(docs, bench, broadcast_bytes=broadcast_bytes).collect()}
    want = set()
    for r in docs.collect():
        w, hit, items = WORD.findall(lower(r.text)), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    items |= {str(item)} if item is not None else set()
        want.add((r.doc_id, len(w), len(hit), tuple(sorted(items)), bool(hit)))
    assert got == want
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    dirty = {x[0] for x in want if x[4]}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id not in dirty or (r.doc_id is None and r.text is None))


def test_span_removal(spark):
    docs = spark.createDataFrame([(1, "keep  ONE, two; three end."), (2, "untouched"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert got == {1: "keep  end.", 2: "untouched", 3: None}


def test_span_removal_keeps_clashing_columns(docs, bench):
    extra = docs.withColumns({c: docs["name"] for c in ("spans", "n", "window", "span", "h", "_at", "_w", "item")})
    got = decontamination.remove_spans(extra, bench)
    assert got.columns == extra.columns and got.count() == extra.count()
    assert got.filter("doc_id = 7").select("items", "spans").distinct().collect() == [("x", "n")]
    assert decontamination.contamination(extra, bench).count() == extra.count()
    assert decontamination.drop_contaminated(extra, bench).columns == extra.columns


def test_many_windows_and_a_long_text(spark):
    """More windows than a broadcast should hold, and a text of 20,000 words against them; both plans agree."""
    words = [f"w{i * 7919 % 5003}" for i in range(20_000)]
    items = [(i, " ".join(f"i{i}x{j}" for j in range(210))) for i in range(1000)] + [(2000, " ".join(words[15_000:15_040])), (2001, "w0 w2916")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing"), (3, items[5][1])], "doc_id long, text string")
    both = [sorted(tuple(r) for r in decontamination.contamination(docs, bench, broadcast_bytes=b).drop("spans").collect()) for b in (1 << 30, 0)]
    assert both[0] == both[1]
    assert [(r[0], r[2] > 0, r[4]) for r in both[0]] == [(1, True, ["2000", "2001"]), (2, False, []), (3, True, ["5"])]


def test_decontamination_empty(docs, empty, bench):
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_line_dedup_matches_brute_force(spark):
    base = "  A common line of more than twenty characters\t"
    rows = [(i, f"own line number {i} which is long enough\n{base}\nshort\n{base.upper() if i % 2 else base}\n") for i in range(8)]
    rows += [(50, "x\ntwice in one document only, twice\ntwice in one document only, twice"), (51, None), (52, ""), (None, base), (60, base), (60, base + "\nextra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(-1 if i is None else i)
    want = set()
    for i, t in rows:
        parts = (t or "").split("\n")
        keep = [x for x in parts if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i)]
        want.add((i, len(parts), len(parts) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    got = linededup.dedup_lines(docs.withColumnRenamed("doc_id", "doc_id"), batches=3, fanout=2)
    assert {(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.collect()} == want


def test_line_dedup_of_one_id_with_two_texts_and_of_many_lines(spark):
    own = [f"this line number {i} is in three documents" for i in range(30_000)]
    text = "\n".join(own)
    docs = spark.createDataFrame([(1, text), (2, "head\n" + text), (2, text), (3, text + "\ntail"), (3, "tail")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text if len(r.kept_text) < 9 else len(r.kept_text)) for r in linededup.dedup_lines(docs).collect())
    assert got == Counter([(1, 30_000, 30_000, ""), (2, 30_001, 30_000, "head"), (2, 30_000, 30_000, ""), (3, 30_001, 0, len(text) + 5), (3, 1, 0, "tail")])


def test_line_dedup_odd_rows(docs, empty):
    got = linededup.dedup_lines(docs)
    assert got.count() == docs.count() and set(docs.columns) < set(got.columns)
    assert linededup.dedup_lines(empty).count() == 0


def test_line_runs_compact(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(1, 1, i), (2, i, i)], "h1 long, h2 long, doc_id long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.h2): (r.n_docs, r.top_doc) for r in runs.entries().collect()}[(1, 1)] == (5, 4)
    written = [r for i in range(runs.made) for r in spark.read.parquet(f"{runs.folder}/run-{i}").collect()]
    batches = [r for r in written if r.n_docs == 1]  # before any merge
    assert [(r.h2, r.top_doc, r.fresh) for r in sorted(batches, key=lambda r: (r.h1, r.top_doc)) if r.h1 == 1] == [(1, 0, True)] + [(1, i, False) for i in range(1, 5)]
    assert all(r.fresh for r in runs.entries().collect())
    fresh = linededup.unseen(spark.createDataFrame([(1, 1), (9, 9)], "h1 long, h2 long"), runs)
    assert [(r.h1, r.h2) for r in fresh.collect()] == [(9, 9)]


def brute_fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components_of(fps, radius):
    top = list(range(len(fps)))
    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_components_match_brute_force(docs):
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    label = components_of(fps, 4)
    low = {}
    for r, c in zip(rows, label, strict=True):
        if r.doc_id is not None:
            low[c] = min(low.get(c, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", low.get(c)) for r, f, c in zip(rows, fps, label, strict=True))
    got = Counter((r["__id"], bytes(r.fp).hex(), r.component_id) for r in simhash.components(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))


@pytest.mark.parametrize("wide,radius", [(1, 4), (4, 30)])
def test_forest_links_what_all_pairs_link(wide, radius):
    rng = np.random.default_rng(5)
    for _ in range(12):
        fps = []
        for _ in range(4):
            centre = rng.integers(0, 2**63, wide, dtype=np.uint64)
            for _ in range(int(rng.integers(1, 70))):
                y = centre.copy()
                for b in rng.integers(0, 64 * wide, rng.integers(0, radius)):
                    y[b // 64] ^= np.uint64(1 << int(b % 64))
                fps.append(y)
        fps = np.unique(np.array(fps), axis=0)
        shard = np.sort(rng.integers(0, 2, len(fps)))
        a, b, bits = simhash.spanning_links(fps, shard, radius)
        assert bits.tolist() == [int(np.bitwise_count(fps[i] ^ fps[j]).sum()) for i, j in zip(a, b, strict=True)]
        as_int = [int.from_bytes(x.astype(">u8").tobytes(), "big") | int(s) << 64 * wide + 200 for x, s in zip(fps, shard, strict=True)]
        as_int = [x if s == 0 else x ^ ((1 << 300) - 1) << 64 * wide for x, s in zip(as_int, shard, strict=True)]
        top = list(range(len(fps)))
        def find(x, top=top):
            while top[x] != x:
                x = top[x]
            return x
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = find(i), find(j)
            top[max(i, j)] = min(i, j)
        assert [find(i) for i in range(len(fps))] == components_of(as_int, radius)
        assert len(a) < len(fps)


def test_doubtful_links_are_checked(spark):
    w = [f"w{i}" for i in range(200)]
    def changed(n):
        return " ".join("x%d" % i if i % (200 // n) == 7 and i // (200 // n) < n else x for i, x in enumerate(w))
    texts = [" ".join(w), changed(4), changed(20)]  # Jaccard 1, about 0.82 and 0.33
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    far = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert 0.8 <= far[1] < 0.86 and far[2] < 0.5
    assert [round(simhash.jaccard(texts[0].encode(), t.encode(), 5), 9) for t in texts] == [round(x, 9) for x in far]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[1]), (4, None), (5, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs, **simhash.SIMILAR | {"radius": 300}).collect()) == [0, 2, 4]


def test_near_copies_leave_one(spark):
    import random

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts, kept = [], 0
    for _ in range(30):
        base = [word() for _ in range(120)]
        kept += 1
        for _ in range(4):
            copy = list(base)
            for at in rnd.sample(range(120), 1):
                copy[at] = word()
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one(docs, **simhash.SIMILAR).count() == kept


@pytest.mark.parametrize("wave", [1, 40, 150, 700])
def test_simhash_keeps_every_link_when_a_wave_cuts_a_tree(monkeypatch, wave):
    """Copies that are not linked to each other meet in texts that come after the cut."""
    monkeypatch.setattr(simhash, "WAVE", wave)
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(3, 60))
        fps = rng.integers(0, 1 << 63, (max(1, n // 8), 1), dtype=np.uint64)
        while len(fps) < n:  # chains and stars of copies, up to five bits from an earlier one
            flips = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            fps = np.r_[fps, fps[rng.integers(0, len(fps))][None] ^ np.uint64(flips)]
        fps = fps[rng.permutation(len(fps))]
        shard = np.sort(rng.integers(0, 3, len(fps)))
        near = (np.bitwise_count(fps ^ fps.T) <= 4) & (shard[:, None] == shard)
        a, b, bits = simhash.spanning_links(fps, shard, 4)
        assert near[a, b].all() and (np.bitwise_count(fps[a] ^ fps[b])[:, 0] == bits).all()
        assert _labels(len(fps), zip(a.tolist(), b.tolist())) == _labels(len(fps), zip(*(x.tolist() for x in np.nonzero(near))))


def _labels(n, links):
    name = list(range(n))
    for a, b in links:
        name = [min(name[a], name[b]) if x in (name[a], name[b]) else x for x in name]
    return name


def test_similar_texts_need_more_than_a_shared_filler(spark):
    """Most of each text is one repeated word; the rest differs, but for the last text."""
    texts = [" ".join(["0"] * n + [f"d{d}w{i}" for i in range(40)]) for d, n in ((0, 150), (1, 150), (2, 150), (0, 170))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs, **simhash.SIMILAR).collect()) == [0, 1, 2]


@pytest.mark.parametrize("most", [1, 8])
def test_a_failed_link_leaves_the_next_candidates(spark, monkeypatch, most):
    """Families with similarities around 0.8, against all pairs within the radius."""
    monkeypatch.setattr(simhash, "MOST", most)
    rng = np.random.default_rng(8)
    texts = []
    for f in range(8):
        base = [f"f{f}w{i}" for i in range(150)]
        for c in range(14):
            copy = list(base)
            for at in rng.choice(150, int(rng.integers(1, 7)), replace=False):
                copy[at] = f"c{c}x{at}"
            texts.append(" ".join(copy))
    fps = [simhash.fingerprint(t.encode(), 5, 8, True)[:64] for t in texts]
    links = [
        (i, j) for i, j in itertools.combinations(range(len(texts)), 2)
        if (int.from_bytes(fps[i]) ^ int.from_bytes(fps[j])).bit_count() <= 96 and simhash.jaccard(texts[i].encode(), texts[j].encode(), 5) >= 0.8
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["__id"]: r.component_id for r in simhash.components(docs, **simhash.SIMILAR | {"masks": [0]}).collect()}
    assert [got[i] for i in range(len(texts))] == _labels(len(texts), links)


def test_simhash_empty(empty):
    assert simhash.components(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def brute_lm(texts):
    tok = [[*(t or "").encode().lower().split(), None] for t in texts]
    uni, bi = Counter(), Counter()
    for t in tok:
        uni.update(t)
        bi.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v, cont, ctx, kinds = sum(uni.values()), len(uni), Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, w), c in bi.items():
        cont[w] += 1
        ctx[a] += c
        kinds[a][min(c, 3) - 1] += 1
    high = lm.discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])
    low = lm.discounts([sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)])
    back = sum(low[min(c, 3) - 1] for c in cont.values()) / len(bi)
    def p1(w):
        c = cont.get(w, 0)
        return max(c - (low[min(c, 3) - 1] if c else 0), 0) / len(bi) + back / (v + 1)
    def p(w, a):
        if not ctx.get(a):
            return p1(w)
        c = bi.get((a, w), 0)
        return (max(c - (high[min(c, 3) - 1] if c else 0), 0) + sum(x * y for x, y in zip(high, kinds[a], strict=True)) * p1(w)) / ctx[a]
    return uni, n, v, p


def test_language_model_matches_brute_force(docs, empty, monkeypatch):
    monkeypatch.setattr(lm, "FLUSH", 700)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 300)
    monkeypatch.setattr(lm, "HOT_SAMPLE", 2)
    docs = docs.withColumn("_text", docs["name"])
    train = docs.filter("coalesce(doc_id, 1) % 3 <> 0")
    uni, n, v, p = brute_lm([r.text for r in train.collect()])
    model = lm.fit(train)
    assert model.layout.p_bits > 2 and len(model.layout.hot) and max(model.layout.s_bits) > 1 and (model.tokens, model.vocabulary) == (n, v)
    got = lm.score(docs, model).collect()
    want = Counter()
    for r in docs.collect():
        t = [*(r.text or "").encode().lower().split(), None]
        s = sum(math.log10(p(w, a)) for a, w in zip(["<s>", *t[:-1]], t, strict=True))
        b = sum(math.log10((uni.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[(r.doc_id, len(t), sum(w in uni for w in t), f"{s:.6f}", f"{b:.6f}")] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, f"{r.score:.6f}", f"{r.base_score:.6f}") for r in got) == want
    context = next(iter(uni))
    assert abs(sum(p(w, context) for w in uni) + p("never seen", context) - 1) < 1e-9
    assert lm.score(empty, model).count() == 0
    untrained = lm.score(docs, lm.fit(empty)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untrained)


def test_counts_over_32_bits_are_kept():
    keys, n = np.arange(5, dtype=np.uint64) * 7, np.array([1, 2**32 - 2, 2**32 - 1, 2**40, 3])
    raw = memoryview(lm.pack_counts(keys, n))
    assert lm.find_counts(raw, np.array([0, 1, 7, 14, 21, 28, 99], np.uint64)).tolist() == [1, 0, *n[1:].tolist(), 0]
    assert lm.find_counts(memoryview(b""), keys).tolist() == [0] * 5


def test_many_maps_need_few_descriptors(tmp_path):
    """1,000 files mapped at once with 256 descriptors."""
    import subprocess
    import sys

    code = f"""
import resource
resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))
from assay.llm import lm
folder = lm.Folder({str(tmp_path)!r})
maps = []
for i in range(1000):
    folder.write(f"pairs-{{i}}", bytes([i % 256]) * 100)
    maps.append(folder.map(f"pairs-{{i}}"))
assert all(m[99] == i % 256 for i, m in enumerate(maps))
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(lm.__file__).parents[2]))


def test_frequent_words_are_sliced():
    """A third of all pairs has one previous word; no bucket holds many more than its share."""
    rng = np.random.default_rng(1)
    prev = rng.integers(2, 1 << 48, 300_000, dtype=np.uint64)
    prev[::3] = 77
    cur = rng.integers(2, 1 << 48, 300_000, dtype=np.uint64)
    layout = lm.Layout(6, np.array([77], np.uint64), np.array([6]))
    bucket, keys = layout.place(prev, cur)
    assert np.unique(bucket, return_counts=True)[1].max() < 3 * 300_000 / 64 and len(np.unique(keys)) == 300_000


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_token_sections_match_brute_force(docs, rule):
    encoding, sizes = tokencount.load()
    got = defaultdict(Counter)
    for r in tokencount.section_tokens(docs.select("doc_id", "text", "name"), rule=rule).collect():
        got[r.doc_id][(r.section, r.n_tokens, r.n_bytes)] += 1
    want = defaultdict(Counter)
    for r in docs.collect():
        raw = (r.text or "").encode()
        owner, s = [], 0
        for b in raw:
            owner.append(s)
            s += b == 10
        n, at = [0] * (s + 1), 0
        for i in encoding.encode_ordinary(r.text or ""):
            part = owner[at : at + sizes[i]]
            n[{"first": part[0], "last": part[-1], "most": max(sorted(set(part)), key=part.count)}[rule]] += 1
            at += sizes[i]
        for k, x in enumerate(n):
            want[r.doc_id][(k, x, owner.count(k))] += 1
    assert got == want


@pytest.mark.parametrize("text", ["a  b \n\n c", "  x", "x  ", "\t\t\n", "   ", "a\u00a0\u00a0\u3000b", "a \n\tb  \r\n\r\n  c d", "\x1c\x1c\x1cq"])
def test_long_runs_of_white_space_are_the_same_pieces(text):
    encoding, _ = tokencount.load()
    for n in (1, 2, 3):
        assert tokencount.encode(encoding, text, n) == encoding.encode_ordinary(text)
        assert tokencount.encode(encoding, text * 40, n) == encoding.encode_ordinary(text * 40)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n"])
def test_a_million_blanks(spark, blank):
    """Runs that the pattern's engine cannot hold; a run that it can hold gives the same tokens."""
    encoding, _ = tokencount.load()
    for n in (9_999, 12_345, 50_000):
        for text in (f"a{blank * n}b", blank * n, f"{blank * n}x"):
            assert tokencount.encode(encoding, text) == encoding.encode_ordinary(text)
    text = "a" + blank * 1_000_000 + "b"
    got = tokencount.section_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    r = got.selectExpr("count(*) AS n", "sum(n_tokens) AS t", "sum(n_bytes) AS b", "max(doc_tokens) AS d").first()
    assert r.n == 1 + text.count("\n") and r.b == len(text) and r.t == r.d > 2


def test_boundary_tokens_by_rule():
    lens, starts = np.array([2, 4, 3]), np.array([0, 3, 5])  # the second token covers bytes 2 to 5: 1 + 2 + 1
    count = lambda rule: tokencount.attribute(lens, starts, 9, rule)[0].tolist()
    assert (count("first"), count("last"), count("most")) == ([2, 0, 1], [1, 0, 2], [1, 1, 1])


def test_token_sections_empty(empty):
    assert tokencount.section_tokens(empty).count() == 0
    with pytest.raises(ValueError):
        tokencount.section_tokens(empty, rule="half")


def line_batches(spark, n, each):
    """n batches of (h1, h2, doc_id): keys of every batch, of some, and of one alone."""
    rows = [[(k, -k, 100 * b + d) for d in range(each) for k in {1, 2 + (b + d) % 3, 10 + b, 1000 + 50 * b + d}] for b in range(n)]
    return rows, [spark.createDataFrame(r, "h1 long, h2 long, doc_id long") for r in rows]


def test_runs_decide_what_a_batch_adds(spark, monkeypatch):
    """A key is fresh in one run; the counts depend on it: without the join of a batch with the runs they come out wrong."""
    rows, batches = line_batches(spark, 7, 4)

    def counted(runs):
        for b in batches:
            runs.add(b)
        return sorted((r.h1, r.h2, r.n_docs, r.top_doc) for r in runs.common(3).collect())

    holders = defaultdict(set)
    for h1, h2, doc in itertools.chain(*rows):
        holders[h1, h2].add(doc)
    expected = sorted((*k, len(v), max(v)) for k, v in holders.items() if len(v) >= 3)
    runs = linededup.LineRuns(spark, fanout=3)
    assert counted(runs) == expected
    fresh = [(r.h1, r.h2) for run in runs.runs() for r in run.rows.filter("fresh").collect()]
    assert len(fresh) == len(set(fresh)) == len(holders)
    assert [len(level) for level in runs.levels] == [1, 2]
    monkeypatch.setattr(linededup.LineRuns, "marked", lambda self, keys: keys.withColumn("fresh", F.lit(True)))
    assert counted(linededup.LineRuns(spark, fanout=3)) != expected


def test_compaction_brings_equal_keys_together(spark):
    """As a union of bucketed tables would not (Spark 4.1)."""
    runs = linededup.LineRuns(spark, fanout=2)
    for b in range(2):
        runs.add(spark.createDataFrame([(1, 1, b), (2, b, b)], "h1 long, h2 long, doc_id long"))
    assert sorted((r.h1, r.h2, r.n_docs, r.fresh) for r in runs.runs()[0].rows.collect()) == [(1, 1, 2, True), (2, 0, 1, True), (2, 1, 1, True)]


def test_runs_are_joined_as_they_lie(spark):
    """The runs' side of a batch's join, and of the last one, has no exchange."""
    _, batches = line_batches(spark, 2, 4)
    runs = linededup.LineRuns(spark, fanout=5)
    for b in batches:
        runs.add(b)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = batches[0].groupBy("h1", "h2").agg(F.count("doc_id").alias("n_docs"))
        plan = runs.marked(batch)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1  # the batch alone
        last = runs.common(3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert last.count("SortMergeJoin") == 2 and last.count("Exchange hashpartitioning") <= 2  # the counts, once for each run


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs planted at a similarity of 0.80 to 0.85: nearly all must be found, and nothing below 0.8."""
    rng = np.random.default_rng(11)
    rows, close = [], set()
    for i in range(240):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120 + i % 200)]
        other = list(words)
        for at in rng.choice(len(words) // 8, 1 + len(words) // 90, replace=False) * 8 + 2:
            other[at] = f"x{i}"
        sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, other)]
        share = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        if 0.8 <= share <= 0.87:
            close.add(i)
        elif share < 0.8:
            close.add(-i - 1)
    got = {r["__id"]: r.component_id for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.SIMILAR).collect()}
    at_threshold = [i for i in close if i >= 0]
    assert len(at_threshold) > 60
    assert sum(got[2 * i] == got[2 * i + 1] for i in at_threshold) >= 0.98 * len(at_threshold)
    assert not any(got[2 * (-i - 1)] == got[2 * (-i - 1) + 1] for i in close if i < 0)


def test_masks_grow_with_the_table():
    """Longer masks for more fingerprints, enough of them; exact blocks keep the pigeonhole."""
    for n, band in ((10**3, 12), (2**20, 14), (10**8, 21)):
        masks = simhash.similar_masks(n, 512)
        assert {m.bit_count() for m in masks} == {band} and (1 - 0.85**band) ** len(masks) <= 0.002
    assert [len(simhash.exact_masks(4, n)) for n in (10, 10**7)] == [5, 15]
    rng = np.random.default_rng(3)
    for _ in range(200):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not m & flip for m in simhash.exact_masks(4, 10**7))

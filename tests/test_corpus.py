import itertools
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import adapters, corpus
from assay.operators.graph import connected_components, spanning_links
from assay.operators.ordering import running_before
from assay.sources import files


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + rnd.randrange(80), 2000 + rnd.randrange(80)) for _ in range(60)] + [(5, None), (None, None)]
    top = {}
    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def greedy(rows, d):
    kept, out = [], []
    for i, h in sorted(rows):
        near = [k for k, g in kept if (g ^ h).bit_count() <= d]
        if near:
            out.append((near[0], i))
        else:
            kept.append((i, h))
    return out


@pytest.mark.parametrize("seed,d", [(1, 4), (2, 4), (3, 20)])
def test_keepers_match_the_greedy_walk(spark, seed, d):
    rnd = random.Random(seed)
    rows, ids = [], itertools.count()
    for g in "ab":
        for _ in range(6):
            base = rnd.getrandbits(63)
            for _ in range(8):
                h = base
                for b in rnd.sample(range(63), rnd.randrange(d)):
                    h ^= 1 << b
                rows.append((g, next(ids), h))
    rows.append(("a", 999, None))
    got = corpus.near_duplicate_keepers(spark.createDataFrame(rows, "group_id string, sample_id long, phash long"), d)
    want = [x for g in "ab" for x in greedy([(i, h) for k, i, h in rows if k == g and h is not None], d)]
    assert sorted((r.keeper, r.dropped) for r in got.collect()) == sorted(want)


def test_band_blocking_is_exact(spark):
    rnd = random.Random(8)
    base = [rnd.getrandbits(63) for _ in range(5)]
    rows = [("g", i, base[i % 5] ^ sum(1 << b for b in rnd.sample(range(63), rnd.randrange(7)))) for i in range(60)]
    got = {(r.a, r.b) for r in corpus.near_pairs(spark.createDataFrame(rows, "group_id string, sample_id long, phash long")).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and (a[2] ^ b[2]).bit_count() <= 4}


def quota(groups, want_f, want_r):
    f = r = 0
    out = []
    for g, nf, nr in groups:
        if f >= want_f and r >= want_r:
            break
        if (f < want_f and nf) or (r < want_r and nr):
            out.append(g)
            f, r = f + nf, r + nr
    return out


def test_two_quota_walk(spark):
    import hashlib

    for seed in range(4):
        rnd = random.Random(seed)
        groups = [(f"g{i}", rnd.choice([0, 0, 1, 3]), rnd.choice([0, 1, 2])) for i in range(60)]
        want = rnd.randrange(1, 30), rnd.randrange(1, 30)
        order = sorted(groups, key=lambda g: hashlib.md5(f"{seed}{g[0]}".encode()).hexdigest())
        got = corpus.two_quota_holdout(spark.createDataFrame(groups, "group_id string, n_fake int, n_real int"), *want, seed=seed)
        assert {r.group_id for r in got.collect()} == set(quota(order, *want))


def test_running_totals(spark):
    import hashlib

    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(500)]
    df = running_before(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v long").repartition(7), "k", {"before": __import__("pyspark.sql.functions", fromlist=["col"]).col("v")})
    seen, want = 0, {}
    for k, i in sorted(zip(keys, range(500), strict=True)):
        want[k] = seen
        seen += i
    assert {r.k: r.before for r in df.collect()} == want


ROW = "sample_id string, ord long, dataset string, group_id string, sha256 string, manipulation_method string, status string, rejection_reason string, split string"


def manifest(spark, rows):
    return spark.createDataFrame([(s, i, "x", g, h, "", "ACCEPTED", "", None) for i, (s, g, h) in enumerate(rows)], ROW)


def test_copy_in_two_groups_rejects_all(spark):
    rows = manifest(spark, [("a", "g1", "h"), ("b", "g2", "h"), ("c", "g1", "k"), ("d", "g1", "k"), ("e", "g3", "")])
    out = {r.sample_id: r.rejection_reason for r in corpus.assign_duplicate_status(rows, corpus.exact_duplicate_sets(rows)).collect()}
    assert out == {"a": "UNSAFE_GROUP", "b": "UNSAFE_GROUP", "c": "", "d": "EXACT_DUPLICATE", "e": ""}


def test_guards_refuse_dirty_data(spark):
    seal = corpus.Seal(groups=spark.createDataFrame([("listed",)], "group_id string"))
    bad = spark.createDataFrame([("1", "celebdf_v2", "g", ""), ("2", "ffpp", "g", "NeuralTextures"), ("3", "ffpp", "listed", ""), ("4", "ffpp", "free", "")], "sample_id string, dataset string, group_id string, manipulation_method string")
    assert {r.sample_id for r in corpus.seal_violations(bad, seal).collect()} == {"1", "2", "3"}
    with pytest.raises(corpus.SealError, match="3 sealed samples"):
        corpus.assert_clean(bad, seal)
    rows = manifest(spark, [("a", "g1", "1"), ("b", "g1", "2"), ("c", "g2", "3")])
    leaky = rows.withColumn("split", __import__("pyspark.sql.functions", fromlist=["expr"]).expr("CASE WHEN sample_id = 'a' THEN 'train' ELSE 'validation' END"))
    with pytest.raises(corpus.LeakError, match="g1"):
        corpus.assert_no_leaks(leaky, corpus.exact_duplicate_sets(leaky))


def test_build_keeps_every_row_and_whole_groups(spark):
    rows = manifest(spark, [(f"s{i}", f"g{i % 17}", f"h{i // 2 if i % 34 < 2 else i}") for i in range(200)])
    built = corpus.dataset_build(rows, corpus.Seal(groups=spark.createDataFrame([("g3",)], "group_id string")))
    parts = corpus.outputs(built)
    n = {k: v.count() for k, v in parts.items()}
    assert n["all"] == 200 == n["train"] + n["validation"] + n["sealed"] + n["rejected"]
    assert n["sealed"] == rows.filter("group_id = 'g3'").count()
    groups = built.filter("split IS NOT NULL").groupBy("group_id").agg({"split": "min", "*": "count"})
    assert built.filter("split IS NOT NULL").select("group_id", "split").distinct().count() == groups.count()
    again = corpus.dataset_build(rows.repartition(9), corpus.Seal(groups=spark.createDataFrame([("g3",)], "group_id string")))
    assert sorted(map(tuple, built.select("sample_id", "split").collect())) == sorted(map(tuple, again.select("sample_id", "split").collect()))


def test_frame_sampling(spark):
    df = spark.createDataFrame([(300, 30.0), (5, 25.0), (0, 25.0), (8, 25.0)], "n int, fps double")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(corpus.frame_indices(F.col("n"), F.col("fps"), 8)).collect()]
    assert len(got[0]) == 8 and got[0][0] > 0 and got[1] == [0, 1, 2, 3, 4] and got[2] == [] and got[3] == list(range(8))
    step, at, want = 8 / 7, 8 / 7 / 2, []
    for _ in range(7):
        want.append(int(at))
        at += step
    assert df.filter("n = 8").select(corpus.frame_indices(F.col("n"), F.col("fps"), 7)).first()[0] == sorted(set(want))


def test_unknown_adapter(spark):
    with pytest.raises(KeyError, match="known"):
        adapters.adapt("nope", spark.createDataFrame([("a",)], "path string"))


def test_balance_caps(spark):
    rows = [(f"s{i}", "REAL" if i % 3 else "FAKE", f"g{i % 4}", f"d{i % 3}", f"m{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "sample_id string, normalized_label string, group_id string, dataset string, manipulation_method string")
    got = corpus.balance_caps(df, per_group=40).toPandas()
    assert got.groupby("group_id").size().max() <= 40
    n = got["normalized_label"].value_counts()
    assert n["FAKE"] <= n["REAL"]


def test_keepers_of_a_long_chain_and_of_copies(spark):
    """A chain of near hashes needs more rounds than are made; equal hashes fill many blocks."""
    chain, h = [], 0
    for i in range(60):
        h |= 1 << i
        chain.append((f"c{i:03d}", "g", h))
    rows = chain + [(f"x{i:03d}", "h", 1 << 62) for i in range(50)]
    df = spark.createDataFrame(rows, "sample_id string, group_id string, phash long")
    for block in (3, 2000):
        pairs = {(r.a, r.b) for r in corpus.near_pairs(df, 4, block).collect()}
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (a[2] ^ b[2]).bit_count() <= 4}
        assert pairs == want
    kept, dropped = [], {}
    for name, group, x in rows:
        near = next((k for k, g, y in kept if g == group and (x ^ y).bit_count() <= 4), None)
        if near is None:
            kept.append((name, group, x))
        else:
            dropped[name] = near
    assert {r.dropped: r.keeper for r in corpus.near_duplicate_keepers(df, 4).collect()} == dropped


def test_null_groups_are_split_like_others(spark):
    rows = [(f"r{i}", None if i % 3 == 0 else f"g{i % 7}", "ACCEPTED") for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, group_id string, status string")
    assert corpus.group_split(df).filter("split IS NULL").count() == 0
    groups = spark.createDataFrame([(None, 3, 0), (1, 0, 2), (2, 1, 1)], "group_id int, n_fake int, n_real int")
    assert corpus.two_quota_holdout(groups, 100, 100).count() == 3


def test_components_by_brute_force(spark):
    import random

    rnd = random.Random(6)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)]
    top = {x: x for e in edges for x in e}
    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_quality_filters_keep_rows_of_a_null_dataset(spark):
    rows = [("a", float(i), 0.0, 100.0, 10, 10) for i in range(40)] + [(None, float(i), 0.0, 100.0, 10, 10) for i in range(40)] + [("b", None, 0.0, 100.0, 10, 10)]
    got = corpus.image_quality_filters(spark.createDataFrame(rows, "dataset string, blur double, yaw double, luma double, width int, height int"))
    assert got.count() == len(rows)
    assert got.groupBy("dataset", "quality_reason").count().filter("quality_reason = 'blurred'").orderBy("dataset").select("dataset", "count").collect() == [(None, 2), ("a", 2)]


def test_numbers_inside_groups_and_cells(spark):
    from assay.operators.ordering import numbered_by, seeded

    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN 'b' ELSE 'a' END AS g").withColumn("o", seeded(1, F.col("id")))
    got = numbered_by(rows, ["g"], "o", "r").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.o):
        by.setdefault(r.g, []).append(r.r)
    assert len(got) == 3000 and all(v == list(range(1, len(v) + 1)) for v in by.values())


def test_caps_of_a_large_class_follow_the_seeded_order(spark):
    rows = spark.range(2000).selectExpr("concat('s', id) AS sample_id", "id AS group_id", "CASE WHEN id % 4 = 0 THEN 'REAL' ELSE 'FAKE' END AS normalized_label",
                                        "CASE WHEN id % 5 < 3 THEN 'm' WHEN id % 5 = 3 THEN NULL ELSE 'n' END AS manipulation_method", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'd' END AS dataset")
    got = corpus.balance_caps(rows)
    counts = {r[0]: r[1] for r in got.groupBy("normalized_label").count().collect()}
    assert counts["FAKE"] <= counts["REAL"] <= 500
    assert got.filter("normalized_label = 'FAKE' AND manipulation_method = 'm'").count() <= 600
    assert got.filter("dataset IS NULL").count() > 0


def test_components_of_hubs_dealt_over_tasks(spark, monkeypatch):
    """A star, a path and cliques with hubs beyond what one task may meet."""
    from assay.operators import graph

    monkeypatch.setattr(graph, "HUB", 20)
    monkeypatch.setattr(graph, "FEW", 4)
    rng = random.Random(3)
    star = [(10_000 + i, 7) for i in range(600)] + [(20_000 + i, 8) for i in range(300)] + [(8, 10_005)]
    path = [(i, i + 1) for i in range(50_000, 50_060)]
    noise = [(rng.randrange(60_000, 60_400), rng.randrange(60_000, 60_400)) for _ in range(260)]
    edges = star + path + noise
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {}
    for x in {n for e in edges if e[0] != e[1] for n in e}:
        group[x] = x
    for a, b in edges * 1:
        if a != b:
            x, y = sorted((group[a], group[b]))
            for n, g in group.items():
                if g == y:
                    group[n] = x
    assert got == group


def test_a_star_of_many_leaves_is_even(spark, monkeypatch):
    """No task of the join meets over twice the median, though one node holds nearly all links."""
    from assay.operators import graph

    monkeypatch.setattr(graph, "HUB", 500)
    links = spark.range(40_000).selectExpr("0L AS a", "id + 1 AS b").unionByName(spark.range(100).selectExpr("id + 100000 AS a", "id + 200000 AS b"))
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = sorted(r["count"] for r in graph._meet(links, low, 40_100).groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert sum(sizes) == 40_100 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def walked(rows, d):
    """(keeper, dropped) by walking ids in order."""
    out, kept = set(), {}
    for g, i, h in sorted(rows, key=lambda r: (r[0], r[1])):
        near = [k for k, x in kept.get(g, []) if (x ^ h).bit_count() <= d]
        if near:
            out.add((min(near), i))
        else:
            kept.setdefault(g, []).append((i, h))
    return out


@pytest.mark.parametrize("most", [None, 3])
def test_keepers_of_copies_and_chains(spark, monkeypatch, most):
    """Hundreds of equal hashes, chains longer than the rounds, components above and below what one task walks."""
    if most:
        monkeypatch.setattr(corpus, "ROUNDS", 2)
        monkeypatch.setattr(corpus, "WALK", most)
    rng = random.Random(5)
    rows = [("g", i, 7) for i in range(300)] + [("g", 300 + i, 7 ^ (1 << rng.randrange(60))) for i in range(60)]
    rows += [("h", 1000 + i, (1 << (3 * i // 2 % 60)) - 1 & (1 << 62) - 1) for i in range(70)] + [("h", 1100 + i, rng.getrandbits(62)) for i in range(40)]
    df = spark.createDataFrame([*rows, ("g", 2000, None), (None, 2001, 7)], "group_id string, sample_id long, phash long").repartition(4)
    assert {(r.keeper, r.dropped) for r in corpus.near_duplicate_keepers(df, 4).collect()} == walked(rows, 4)
    pairs, members = corpus.near_classes(df, 4)
    assert members.count() == len(rows) and pairs.count() < 3000


def test_frequent_keys_are_joined_where_they_are(spark):
    from assay.operators.ordering import join_frequent

    big = spark.range(1000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k", "id")
    one = big.groupBy("k").count().withColumnRenamed("count", "n")
    got = join_frequent(big, one.withColumn("v", F.upper("k")), ["k"], "n", most=100, few=5)
    assert got.count() == 1000 and got.filter("v = upper(k)").count() == 1000
    some = join_frequent(big, one.filter("k <> 'k1'"), ["k"], "n", "left", most=100, few=5)
    assert some.count() == 1000 and some.filter("n IS NULL").count() == 20


def test_spanning_links_keep_components_and_are_few(spark):
    """Two hundred thousand links over nine hundred nodes shrink to a few forests with the same components; sparse ones stay."""
    links = spark.range(200_000).select(F.concat(F.lit("p"), F.col("id") * 7919 % 600).alias("a"), F.concat(F.lit("s"), F.col("id") * 7919 % 600 % 3 + F.floor(F.col("id") / 600) % 100 * 3).alias("b"))
    few = spanning_links(links).localCheckpoint()
    assert few.count() < 10_000
    got, expected = connected_components(few).collect(), connected_components(links).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len({r.component for r in got}) == 3
    sparse = spark.createDataFrame([(i, i + 1) for i in range(0, 99, 3)] + [(5, 5), (None, 1)], "a long, b long")
    assert sorted(map(tuple, spanning_links(sparse).collect())) == [(i, i + 1) for i in range(0, 99, 3)]


def test_adapters_deal_rows_without_an_id(spark):
    """Rows without a second id, or without any, are joined once or spread; an unlinked pair takes the smaller of two labels."""
    paths = [("m/manipulated_sequences/Deepfakes/c23/2_3.mp4",), ("m/manipulated_sequences/Deepfakes/c23/7_9.mp4",), ("o/raw/9_3.mp4",), ("o/raw/8_5.mp4",), ("o/raw/3.mp4",), ("o/raw/x.mp4",), ("o/raw/4.mp4",)]
    got = {r.path: r.grp for r in adapters.adapt("ffpp", spark.createDataFrame(paths, "path string")).collect()}
    assert [got[p] for (p,) in paths] == ["ffpp:2", "ffpp:7", "ffpp:2", "ffpp:5", "ffpp:2", None, "ffpp:4"]
    out = adapters.adapt("celebdf", spark.range(2000).select(F.concat(F.lit("YouTube-real/x"), F.col("id"), F.lit(".mp4")).alias("path")))
    assert out.select("grp").distinct().count() == 2000


def test_flatten_json_parses_a_text_once(spark):
    """One scan of the texts, whatever the depth; nested and empty containers, JSON nulls, texts that are no JSON."""
    texts = ['{"a": {"b": [1, {"c": null}]}, "d": "x", "e": [], "f": {}}', "not json", None, "7", '{"l": {"m": {"n": {"o": {"p": 1}}}}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, js string")
    flat = files.flatten_json(df.repartition(2), "id", "js")
    got = sorted((r.id, r.path, r.value) for r in flat.collect() if r.path != ".a.b[1].c")
    assert got == [(0, ".a.b#", "2"), (0, ".a.b[0]", "1"), (0, ".d", "x"), (0, ".e#", "0"), (3, "", "7"), (4, ".l.m.n.o", '{"p":1}')]
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # each level read all texts again


def _plain_groups(name, paths):
    """The reference's rule on a list of paths, with a plain union of ids."""
    import re

    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def ids(path):
        base = path.replace("\\", "/").split("/")[-1]
        stem = base[: base.rfind(".")] if base.rfind(".") > 0 else base
        m = re.match(r"(\d+)_(\d+)$" if name == "ffpp" else r"id(\d+)_id(\d+)_\d+$", stem)
        one = re.match(r"(\d+)\Z" if name == "ffpp" else r"id(\d+)_\d+$", stem)
        return (m.groups() if m else (one[1], None) if one else (None, None)), stem

    for path in paths:
        (a, b), _ = ids(path)
        if b and (name == "celebdf" or "manipulated_sequences" in path):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    out = {}
    for path in paths:
        (a, b), stem = ids(path)
        group = None if a is None else f"{name}:{min(find(a), find(b)) if b else find(a)}"
        out[path] = f"celebdf:youtube:{stem}" if group is None and name == "celebdf" and "youtube" in path.lower() else group
    return out


_ODD_FF = ["m/manipulated_sequences/Deepfakes/c23/2_3.mp4", "m\\manipulated_sequences\\FaceSwap\\c40\\3_10.mp4", "raw/9_3.mp4", "o/raw/12_11.a.mp4", "o/raw/12_11", "12.mp4", ".12", "o/5_", "o/5_6_7.mp4", "o/.mp4", "o/10", "", "o/manipulated_sequences/4_4.mp4", "o/4.mp4", "Deepfakes/8_2.", "o/c23"]
_ODD_CELEB = ["Celeb-synthesis/id1_id2_0000.mp4", "Celeb-real\\id2_0001.mp4", "id2_id30_0007", "Celeb-real/id30_1.x.mp4", "Celeb-real/id7_id_1.mp4", "YouTube-real/00001.mp4", "youtube\\.mp4", "real/synthesis", "id5_3.mp4", "", "x/Celeb-Real/", "id4_id4_1.mp4", "YouTube/id9_id5_2.mp4", "YouTube/id9_id5_.mp4"]


@pytest.mark.parametrize("name, paths, texts", [("ffpp", _ODD_FF, 4), ("celebdf", _ODD_CELEB, 1)])
def test_pair_adapters_work_ids_out_once(spark, name, paths, texts):
    """Odd names keep the reference's groups, repeats count once if so asked, and a path's stem stands in the plan once a branch and filter."""
    repeated = spark.createDataFrame([(p,) for p in paths * 3] + [(None,), (None,)], "path string").repartition(3)
    df = adapters.adapt(name, repeated, once=True)
    rows = df.collect()
    assert {r.path: r.grp for r in rows if r.path is not None} == _plain_groups(name, paths) and len(rows) == len(paths) + 1
    assert sorted(map(str, rows)) == sorted(map(str, adapters.adapt(name, repeated.distinct()).collect()))
    assert adapters.adapt(name, repeated).count() == 3 * len(paths) + 2
    if name == "ffpp":
        assert {r.path: (r.label, r.method, r.compression) for r in rows}["m\\manipulated_sequences\\FaceSwap\\c40\\3_10.mp4"] == ("fake", "faceswap", "c40")
        assert {r.compression for r in rows if r.path and r.path.startswith("raw/")} == {"unknown"} and {r.method for r in rows if r.path and "8_2" in r.path} == {"deepfakes"}
    else:
        assert {r.path: r.label for r in rows if r.path and "eal" in r.path} == {"Celeb-real\\id2_0001.mp4": "real", "Celeb-real/id30_1.x.mp4": "real", "Celeb-real/id7_id_1.mp4": "real", "YouTube-real/00001.mp4": "real", "real/synthesis": "real", "x/Celeb-Real/": "real"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= texts  # each use of an id worked the stem out again: 76 us a row


def test_links_are_cleaned_in_tasks(spark, monkeypatch):
    """Nulls and self links go before the forests, also where a task gives up thinning; no filter works the ids out a second time."""
    import pyarrow as pa

    from assay.operators import graph

    monkeypatch.setattr(graph, "CHUNK", 2)
    batches = [pa.record_batch({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())}) for a, b in ((["1", None, "3"], ["2", "9", "4"]), ([None, "5"], [None, "5"]), (["6", "7", None], ["8", None, "1"]))]
    assert [r for b in graph._forest(iter(batches)) for r in b.to_pylist()] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}, {"a": "6", "b": "8"}]
    links = spark.range(10).select(F.col("id").cast("string").alias("a"), F.nullif((F.col("id") % 3).cast("string"), F.lit("0")).alias("b"))
    assert "Filter" not in spanning_links(links)._jdf.queryExecution().optimizedPlan().toString()

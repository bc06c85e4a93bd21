"""Ranks, mergeable states and lattices against walks over sorted rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import ranks as rk
from assay.operators import sketches as sk


@pytest.fixture(scope="module")
def scores():
    """A value that holds a third of all rows, null groups and values, an outlier, repeated rows."""
    r = random.Random(2)
    rows = [("a" if i % 3 else "b", 0.5 if i % 3 == 0 else round(r.random(), 2), i, i % 9) for i in range(900)]
    rows += [(None, round(r.random(), 1), i, i % 5) for i in range(900, 960)] + [("c", 1e12, 960, 1), ("a", None, 961, 1), (None, None, 962, 2)]
    return [*rows, rows[3], rows[3]]


def expected_ranks(rows, buckets):
    out = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (r[1], r[2]))
        values = [r[1] for r in own]
        for i, r in enumerate(own):
            before, upto = values.index(r[1]), len(values) - values[::-1].index(r[1])
            size, more = divmod(len(own), buckets)
            tile = i // (size + 1) + 1 if i < more * (size + 1) else more + (i - more * (size + 1)) // size + 1
            out.append((*r, before + 1, len(set(values[:before])) + 1, i + 1, before / (len(own) - 1) if len(own) > 1 else 0.0, upto / len(own), tile))
        out += [(*r, *[None] * 6) for r in rows if r[0] == g and r[1] is None]
    return out


@pytest.mark.parametrize("most", [None, 40])
@pytest.mark.parametrize("by", [["g"], []])
def test_ranks(spark, scores, most, by):
    rows = scores if by else [("one", *r[1:]) for r in scores]
    got = rk.with_ranks(spark.createDataFrame(rows, "g string, x double, id long, `a.b` long"), "x", "id", by, 7, most)
    assert got.columns == ["g", "x", "id", "a.b", "rank", "dense_rank", "row_number", "percent_rank", "cume_dist", "ntile"]
    show = lambda r: str([round(x, 9) if isinstance(x, float) else x for x in r])
    assert sorted(map(show, got.collect())) == sorted(map(show, expected_ranks(rows, 7)))


def test_a_frequent_value_is_split(spark):
    """Half of all rows have one value: their numbers come from cells of ties, not from one window."""
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7.5D ELSE CAST(id AS DOUBLE) END AS x")
    got = rk.with_ranks(rows, "x", "id", most=100)
    hot = [r.row_number for r in got.filter("x = 7.5").orderBy("id").collect()]
    assert hot == list(range(hot[0], hot[0] + 2000)) and got.agg(F.count_distinct("row_number")).first()[0] == 4000


def test_nothing_to_rank(spark):
    assert rk.with_ranks(spark.createDataFrame([], "x double, id long"), "x", "id").count() == 0
    assert rk.with_ranks(spark.createDataFrame([(None, 1)], "x double, id long"), "x", "id").first()[2:] == (None,) * 6


def test_states_merge_to_what_all_rows_give(spark):
    r = random.Random(6)
    rows = spark.createDataFrame([(i, r.randrange(3000), r.gauss(50, 20), "hot" if i % 3 else f"k{i % 4}", f"2024-01-{1 + i % 28:02d} 10:00:00") for i in range(20_000)], "id long, user long, x double, g string, at string").withColumn("at", F.col("at").cast("timestamp"))
    days = sk.day_states(rows, ["g"], "user", "x")
    got = {x.g: x for x in sk.estimates(sk.merged(days, ["g"]), {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    exact = {x.g: x for x in rows.groupBy("g").agg(F.count_distinct("user").alias("users"), F.count("id").alias("n")).collect()}
    for g, x in got.items():
        assert x.n == exact[g].n and abs(x.distinct_members - exact[g].users) <= 0.05 * exact[g].users
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert abs(rows.filter((F.col("g") == g) & (F.col("x") <= x[name])).count() / x.n - q) <= 0.02
    top = sk.frequent_items(sk.frequent_states(rows, [F.to_date("at").alias("day")], "g"), [], 1).first()
    assert (top.item, top.n) == ("hot", rows.filter("g = 'hot'").count())


def test_lattice_equals_the_cube(spark):
    r = random.Random(7)
    rows = [(r.choice("ab"), r.choice(["x", "y", None]), r.randrange(3), r.choice([None, -1, *range(100_000, 100_040), 5]), i) for i in range(800)]
    df = spark.createDataFrame(rows, "p string, q string, z int, member long, v long")
    got = sk.lattice(df, ["p", "q", "z"], "member", {"v": F.sum("v")}).collect()
    expected = []
    for keep in itertools.product([True, False], repeat=3):
        cells = {}
        for row in rows:
            cells.setdefault(tuple(x if k else None for x, k in zip(row[:3], keep, strict=True)), []).append(row)
        mask = sum(1 << 2 - i for i, k in enumerate(keep) if not k)
        expected += [(*c, mask, len(own), len({x[3] for x in own if x[3] is not None and x[3] >= 0}), sum(x[4] for x in own)) for c, own in cells.items()]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert len(sk.lattice(df, ["p", "q", "z"], "member", {}, [["p"], []]).collect()) == 3

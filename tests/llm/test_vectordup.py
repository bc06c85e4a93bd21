import numpy as np
import pytest

from assay.llm import vectordup


def brute_force(rows, threshold):
    """rows: (id, vector or None, label) -> sorted (id, n_links, component_id, kept)."""
    fine = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    lens = [len(v) for (_, v, _), ok in zip(rows, fine, strict=True) if ok]
    usual = max(set(lens), key=lambda n: (lens.count(n), -n)) if lens else 0
    fine = [ok and len(r[1]) == usual for ok, r in zip(fine, rows, strict=True)]
    near = np.zeros((len(rows), len(rows)), bool)
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2]:
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                near[i, j] = near[j, i] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold
    group = list(range(len(rows)))
    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = group[i], group[j]
        group = [min(x, y) if g in (x, y) else g for g in group]
    out = []
    for i, (own, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        low = min(ids, default=None)
        out.append((own, int(near[i].sum()), low, own is not None and own == low))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = [(i, rng.normal(size=16), i % 3) for i in range(90)]
    rows += [(100 + i, centres[i % 6] + 0.09 * rng.normal(size=16) * (1 + i % 5), i % 2) for i in range(160)]  # around the threshold
    rows += [(300 + i, centres[0], 1) for i in range(30)] + [(340, 2.5 * centres[0], 1), (341, centres[0], None), (342, centres[0], 2)]
    rows += [(343, centres[0] * 1e200, 1), (344, centres[0] * 1e-200, 1)]
    rows = [(i, [float(x) for x in v], lab) for i, v, lab in rows]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [None] * 16, 1), (403, [float("nan")] * 16, 1), (404, [float("inf")] * 16, 1), (405, [1.0], 1), (None, rows[100][1], rows[100][2]), (300, rows[250][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("label", "a.b").repartition(5).cache()


@pytest.mark.parametrize("tile", [16, 1024])
def test_against_brute_force(vectors, monkeypatch, tile):
    monkeypatch.setattr(vectordup, "TILE", tile)
    rows = [tuple(r) for r in vectors.collect() if not (r[0] in (343, 344))]
    got = vectordup.near_duplicates(vectors.filter("vec_id IS NULL OR vec_id NOT IN (343, 344)"), 0.93, label="a.b")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(rows, 0.93)


def test_lengths_do_not_overflow(vectors):
    got = {r.vec_id: r for r in vectordup.near_duplicates(vectors, label="a.b").collect()}
    assert got[343].component_id == got[344].component_id == got[340].component_id
    assert got[343].n_links == got[340].n_links == got[344].n_links


def test_nothing_to_link(spark, vectors):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert vectordup.near_duplicates(none).count() == 0
    alone = vectordup.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], none.schema)).collect()
    assert sorted(map(tuple, alone)) == [(1, 0, 1, True), (2, 0, 2, True)]
    with pytest.raises(ValueError, match="threshold"):
        vectordup.near_duplicates(none, 0.0)


@pytest.mark.parametrize("spread", [0.01, 0.25, 3.0])
def test_steps_give_what_whole_products_give(spread):
    """Blocks that stay whole, lists of pairs, and both."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=24) + spread * rng.normal(size=(300, 24)) * np.linspace(2, 0.1, 24)
    _, axes = np.linalg.eigh(v.T @ v)
    x = vectordup.turned(v, axes[:, ::-1])
    i, j = vectordup.linked(x[:140], x[140:], v[:140], v[140:], 0.93)
    whole = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(whole[:140] @ whole[140:].T >= 0.93)), strict=True))


def test_tiles_too_far_apart_do_not_meet(spark):
    rows = [("l", t, [t / 4 - 1.0, 0.0], [t / 4 - 0.9, 0.1]) for t in range(8)] + [("m", 0, [-1.0, 0.0], [-0.9, 0.1])]
    got = vectordup.near_tiles(spark.createDataFrame(rows, "label string, tile long, low array<double>, high array<double>"), 0.93)
    assert sorted(map(tuple, got.collect())) == sorted([("l", a, b) for a in range(8) for b in range(a, min(a + 2, 8))] + [("m", 0, 0)])


def test_groups_are_joined_whole():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 200, (2, 170))
    group = vectordup.join_groups(np.arange(200), a[:90], b[:90])
    group = vectordup.join_groups(group, a[90:], b[90:])
    expected = list(range(200))
    for x, y in zip(a, b, strict=True):
        g, h = expected[x], expected[y]
        expected = [min(g, h) if e in (g, h) else e for e in expected]
    assert group.tolist() == expected

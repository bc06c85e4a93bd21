import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assay.operators import metrics as m
from assay.operators.percentiles import percentiles


def preds(spark, y, s, **more):
    rows = [(a, float(b), *(v[i] for v in more.values())) for i, (a, b) in enumerate(zip(y, s, strict=True))]
    kinds = "".join(f", {k} string" for k in more)
    return spark.createDataFrame(rows, f"y_true int, p_fake double{kinds}")


def one(df):
    return df.first().asDict()


def test_hand_worked(spark):
    # three fakes and two reals; one fake below and one real above the threshold
    r = one(m.classification_metrics(preds(spark, [1, 0, 1, 0, 1], [0.97, 0.66, 0.31, 0.05, 0.72])))
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 1, 1, 1)
    assert r["accuracy"] == 0.6 and r["fpr"] == 0.5 and abs(r["recall"] - 2 / 3) < 1e-12
    assert abs(r["roc_auc"] - 5 / 6) < 1e-12  # five of six pairs in order
    assert abs(r["pr_auc"] - (1 / 3 + 1 / 3 + 1 / 3 * 3 / 4)) < 1e-12
    r = one(m.classification_metrics(preds(spark, [0, 1, 1], [0.11, 0.83, 0.64])))
    assert (r["accuracy"], r["fpr"], r["fnr"], r["roc_auc"], r["pr_auc"]) == (1, 0, 0, 1, 1)
    assert one(m.roc_auc(preds(spark, [1, 1, 0], [0.42] * 3)))["roc_auc"] == 0.5  # all tied


def test_condensed_rows_give_the_same_sections(spark):
    rnd = random.Random(9)
    rows = [("real" if (y := rnd.randint(0, 1)) == 0 else "fake", f"s{rnd.randint(0, 2)}", y, rnd.randint(0, 10) / 10) for _ in range(300)]
    df = spark.createDataFrame(rows, "label string, source string, y_true int, p_fake double")
    few = m.condensed(df)
    assert few.count() < 70
    for section in (m.classification_metrics, m.brier, m.reliability, m.band_accuracy, m.per_source):
        show = lambda t: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in t.collect())
        assert show(section(df)) == show(section(few))


def test_percentiles_by_brute_force(spark):

    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in (rng.lognormal(3, 2, 400) if g == "a" else rng.integers(0, 5, 301))] + [("c", None), ("d", 7.5), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in percentiles(df, "v", {"m": ("cont", 0.5), "q": ("cont", 0.05), "p": ("disc", 0.95)}, ["g"]).collect()}
    assert set(got) == {"a", "b", None, "c", "d"} and got["c"].m is None and got["c"].p is None
    for g in ("a", "b", None, "d"):
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert abs(got[g].m - np.percentile(values, 50)) < 1e-9 and abs(got[g].q - np.percentile(values, 5)) < 1e-9
        assert got[g].p == values[max(0, -(-len(values) * 95 // 100) - 1)]
    assert percentiles(df, "v", {"m": ("cont", 0.5)}).first().m == np.percentile([v for _, v in rows if v is not None], 50)
    assert percentiles(df.limit(0), "v", {"m": ("cont", 0.5)}, ["g"]).count() == 0


def test_undefined_is_null(spark):
    r = one(m.classification_metrics(preds(spark, [1, 1], [0.9, 0.1])))
    assert r["fpr"] is None and r["specificity"] is None and r["roc_auc"] is None and r["pr_auc"] == 1
    empty = preds(spark, [], [])
    r = one(m.confusion(empty))
    assert r == {"tp": 0, "fp": 0, "tn": 0, "fn": 0}
    assert one(m.brier(empty))["brier"] is None
    r = one(m.classification_metrics(preds(spark, [1, 0], [0.1, 0.9])))
    assert r["f1"] == 0  # both defined and zero


def test_labels_must_be_binary(spark):
    with pytest.raises(PySparkException):
        m.confusion(preds(spark, [2], [0.5])).collect()


def test_areas_by_brute_force(spark):
    rnd = random.Random(3)
    for digits in (1, 2):
        y = [rnd.randint(0, 1) for _ in range(200)]
        s = [round(rnd.random(), digits) for _ in y]
        pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
        auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        ap, seen = 0.0, 0.0
        for t in sorted(set(s), reverse=True):
            tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
            ap += (tp / len(pos) - seen) * tp / (tp + fp)
            seen = tp / len(pos)
        r = one(m.areas(preds(spark, y, s)))
        assert abs(r["roc_auc"] - auc) < 1e-12 and abs(r["pr_auc"] - ap) < 1e-12


def test_threshold_for_fpr(spark):
    df = preds(spark, [1, 0, 1, 0, 0, 1, 1, 0, 1], [0.93, 0.52, 0.77, 0.08, 0.24, 0.51, 0.58, 0.33, 0.12])
    assert one(m.threshold_for_fpr(df, 0.0)) == {"threshold": 0.58, "fpr": 0.0, "recall": 0.6}
    assert one(m.threshold_for_fpr(df, 0.25)) == {"threshold": 0.51, "fpr": 0.25, "recall": 0.8}
    above = one(m.threshold_for_fpr(preds(spark, [0, 1], [1.0, 0.2]), 0.0))
    assert above == {"threshold": 1 + 1e-9, "fpr": 0.0, "recall": 0.0}
    assert one(m.threshold_for_fpr(preds(spark, [1], [0.5]), 0.1))["threshold"] is None


def test_bins_and_bands(spark):
    r = one(m.calibration_error(preds(spark, [1, 1, 1, 0], [0.9] * 4), mode="confidence"))
    assert abs(r["ece"] - 0.15) < 1e-12
    assert [x.bin for x in m.reliability(preds(spark, [1], [0.3])).collect()] == [2]  # 0.3 < 3 * 0.1
    rows = {x.lo: (x.n, x.accuracy) for x in m.band_accuracy(preds(spark, [1, 0, 1, 1], [0.95, 0.95, 0.75, 0.55])).collect()}
    assert {x.lo: x.band for x in m.band_accuracy(preds(spark, [1], [0.9])).collect()}[70] == "strong"
    assert [(x.lo, x.hi) for x in m.reliability(preds(spark, [1], [1.0])).collect()] == [(0.9, 1.0)]
    assert rows == {90: (2, 0.5), 70: (1, 1.0), 30: (1, 1.0), 0: (0, None)}


def test_checkpoint_and_interval(spark):
    h = spark.createDataFrame([(1, 0.9, 0.8, None), (2, 0.9, 0.8, 0.85), (3, None, None, None)], "epoch int, robust double, holdout double, swap double")
    assert one(m.select_checkpoint(h))["epoch"] == 1
    df = preds(spark, [0] * 10, [0.1] * 10, group_id=[str(i) for i in range(10)])
    r = one(m.error_intervals(df))
    assert (r["rate"], r["groups"], r["wrong"], r["low"], r["high"]) == ("fpr", 10, 0, 0.0, 0.3)


def test_percentiles_with_an_outlier_and_a_hot_value(spark):
    """Slices follow the values: an outlier leaves them even, and a value of half the rows is one entry."""
    from assay.operators.slices import borders, slice_of

    r = np.random.default_rng(3)
    rows = [("g", float(x)) for x in r.normal(size=3000)] + [("g", 1e12)] + [("h", 4.0)] * 2000 + [(None, float(i)) for i in range(50)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: x for x in percentiles(df, "v", {"m": ("cont", 0.5), "q": ("cont", 0.05), "p": ("disc", 0.95)}, ["g"], most=100).collect()}
    for g in ("g", "h", None):
        own = sorted(v for k, v in rows if k == g)
        assert got[g].m == pytest.approx(np.percentile(own, 50)) and got[g].q == pytest.approx(np.percentile(own, 5))
        assert got[g].p == own[math.ceil(0.95 * len(own)) - 1]
    assert got["none"].m is None
    counts = df.filter("v IS NOT NULL").groupBy("g", "v").count()
    sizes = [x["count"] for x in counts.groupBy(slice_of(F.col("v"), borders(counts, "v", 100)).alias("s")).count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_stage_profile_sums_totals_and_meets_a_span_once(spark):
    from pyspark.sql import functions as F

    from assay.operators.frames import stage_profile

    spans = spark.range(500).select((F.col("id") % 3).cast("string").alias("case_name"), (F.col("id") % 41).alias("run_id"), (F.col("id") % 5).cast("string").alias("stage"), (F.col("id") % 17 / 4).alias("seconds"))
    named = stage_profile(spans.unionByName(spans.withColumn("stage", F.lit("total"))), ["1", "2"], 10)
    summed = stage_profile(spans, ["1", "2"], 10, summed=True)
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, named.collect())) and summed.count() == 9

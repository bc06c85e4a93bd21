"""Classification metrics of prediction tables: y_true 0/1 (1 = fake), p_fake in [0, 1].

Everything rests on one pre-aggregation: the numbers of positives and negatives at each distinct score.
Running sums over scores are two-level (coarse score cells, then within a cell), so no window holds all scores.
A metric without a denominator is NULL, never 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.percentiles import with_percentiles
from assay.session import cut

CELLS = 1024
WEIGHT = "_weight"
RATES = ("accuracy", "precision", "recall", "specificity", "f1", "fpr", "fnr")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b)


def harmonic(p: Column, r: Column) -> Column:
    """F1 that is 0 where both rates are defined and zero, and NULL where one is undefined."""
    return F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def check_labels(preds: DataFrame) -> DataFrame:
    """Raise at run time on a label other than 0 and 1."""
    bad = ~F.coalesce(F.col("y_true").isin(0, 1), F.lit(False))
    return preds.withColumn("y_true", F.when(bad, F.raise_error(F.lit("labels must be 0 or 1"))).otherwise(F.col("y_true")))


def score_counts(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = weight(preds)
    return check_labels(preds).groupBy(*(by or []), "p_fake").agg(
        F.sum(F.col("y_true") * n).alias("pos"), F.sum((1 - F.col("y_true")) * n).alias("neg")
    )


def weight(preds: DataFrame) -> Column:
    """How many predictions a row stands for: the column WEIGHT of `condensed`, else one."""
    return F.col(WEIGHT) if WEIGHT in preds.columns else F.lit(1)


def mean(value: Column, n: Column) -> Column:
    """The weighted mean; values that are NULL do not count."""
    return F.sum(value * n) / F.nullif(F.sum(F.when(value.isNotNull(), n)), F.lit(0))


def condensed(preds: DataFrame) -> DataFrame:
    """Equal predictions of a source as one row with a WEIGHT: all that most sections of a report read."""
    return preds.groupBy("label", "source", "y_true", "p_fake").agg(F.count(F.lit(1)).alias(WEIGHT))


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_{c}"]) for c in by])


def running_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """counts plus pos_below and neg_below: totals at strictly smaller scores of the same group."""
    by = by or []
    cell = F.floor(F.least(F.greatest(F.col("p_fake"), F.lit(0.0)), F.lit(1.0)) * CELLS)
    counts = counts.withColumn("cell", cell)
    inside = Window.partitionBy(*by, "cell").orderBy("p_fake")
    cells = counts.groupBy(*[F.col(c).alias(f"_{c}") for c in [*by, "cell"]]).agg(F.sum("pos").alias("cp"), F.sum("neg").alias("cn"))
    across = Window.partitionBy(*[f"_{c}" for c in by]).orderBy("_cell")  # at most CELLS + 1 rows for each group
    ahead = cells.select(
        *[f"_{c}" for c in [*by, "cell"]], (F.sum("cp").over(across) - F.col("cp")).alias("ap"), (F.sum("cn").over(across) - F.col("cn")).alias("an")
    )
    local = counts.withColumn("lp", F.sum("pos").over(inside) - F.col("pos")).withColumn("ln", F.sum("neg").over(inside) - F.col("neg"))
    return local.join(ahead, _same(local, ahead, [*by, "cell"])).select(
        *by, "p_fake", "pos", "neg", (F.col("ap") + F.col("lp")).alias("pos_below"), (F.col("an") + F.col("ln")).alias("neg_below")
    )


def _tallies(t: Column) -> list[Column]:
    hit = F.col("p_fake") >= t
    return [
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
    ]


def confusion(preds: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn with fake as positive; a fake call needs a score of the threshold or more."""
    counts = score_counts(preds, by)
    tallies = counts.groupBy(*(by or [])).agg(*_tallies(F.lit(threshold)))
    return tallies.fillna(0, subset=["tp", "fp", "tn", "fn"])


def with_rates(tallies: DataFrame) -> DataFrame:
    """Add n, n_real, n_fake and the rates to tp, fp, tn, fn."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    df = tallies.withColumns({
        "n": tp + fp + tn + fn, "n_real": tn + fp, "n_fake": tp + fn,
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp),
    })
    return df.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def areas(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """roc_auc (ties share their rank) and pr_auc (average precision) from one running sum."""
    by = by or []
    run = running_counts(score_counts(preds, by), by)
    totals = run.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    both = run.join(totals, _same(run, totals, by)) if by else run.crossJoin(F.broadcast(totals))  # one row of totals
    found, false = F.col("P") - F.col("pos_below"), F.col("N") - F.col("neg_below")  # at this score and above
    return both.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("won"),
        F.sum(F.col("pos") * F.when(found + false > 0, found / (found + false)).otherwise(0.0)).alias("steps"),
        F.max("P").alias("P"), F.max("N").alias("N"),
    ).select(*by, ratio(F.col("won"), F.col("P") * F.col("N")).alias("roc_auc"), ratio(F.col("steps"), F.col("P")).alias("pr_auc"))


def roc_auc(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    return areas(preds, by).drop("pr_auc")


def pr_auc(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    return areas(preds, by).drop("roc_auc")


def classification_metrics(preds: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    by = by or []
    rates, auc = with_rates(confusion(preds, threshold, by)), areas(preds, by)
    if not by:
        return rates.crossJoin(F.broadcast(auc))  # one row each
    named = auc.select(*[F.col(c).alias(f"_{c}") for c in by], "roc_auc", "pr_auc")
    return rates.join(named, _same(rates, named, by), "left").drop(*[f"_{c}" for c in by])


def threshold_sweep(preds: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """The rates at each threshold of a short list, from the score counts alone."""
    steps = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    tallies = score_counts(preds, by).select("*", steps).groupBy(*(by or []), "threshold").agg(*_tallies(F.col("threshold")))
    return with_rates(tallies)


def full_sweep(preds: DataFrame, thresholds: list[float]) -> DataFrame:
    """The sweep with the areas beside each threshold, as reports show them."""
    return threshold_sweep(preds, thresholds).crossJoin(F.broadcast(areas(preds)))  # one row of areas


def threshold_for_fpr(preds: DataFrame, target: float) -> DataFrame:
    """(threshold, fpr, recall): the lowest distinct score with FPR at most target, else just above 1."""
    run = running_counts(score_counts(preds))
    totals = run.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    at = run.crossJoin(F.broadcast(totals)).select(
        "p_fake", ratio(F.col("N") - F.col("neg_below"), F.col("N")).alias("fpr"), ratio(F.col("P") - F.col("pos_below"), F.col("P")).alias("recall")
    )
    best = at.filter(F.col("fpr") <= target).agg(F.min_by(F.struct("p_fake", "fpr", "recall"), "p_fake").alias("b"))
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    pick = lambda c, d: F.when(ok, F.coalesce(F.col(f"b.{c}"), F.lit(d)))
    return totals.crossJoin(best).select(
        pick("p_fake", 1 + 1e-9).alias("threshold"), pick("fpr", 0.0).alias("fpr"), pick("recall", 0.0).alias("recall")
    )


def brier(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    return preds.groupBy(*(by or [])).agg(mean(F.pow(F.col("p_fake") - F.col("y_true"), 2), weight(preds)).alias("brier"))


def _bins(bins: int, mode: str) -> list[tuple[int, float, float]]:
    lo, hi = (0.0, 1.0) if mode == "probability" else (0.5, 1.0)
    step = (hi - lo) / bins
    edges = [lo + i * step for i in range(bins)] + [hi]
    return [(i, edges[i], edges[i + 1]) for i in range(bins)]


def reliability(preds: DataFrame, bins: int = 10, mode: str = "probability") -> DataFrame:
    """Bins of p_fake, or of max(p, 1 - p) against correctness; the last bin is closed, empty bins are left out.

    Edges are lo + i * step in doubles, so 0.3 lies in the bin below 3 * 0.1.
    """
    p = F.col("p_fake")
    value = p if mode == "probability" else F.greatest(p, 1 - p)
    event = F.col("y_true") if mode == "probability" else ((p >= 0.5) == (F.col("y_true") == 1)).cast("int")
    spots = [(F.lit(i), lo) for i, lo, _ in _bins(bins, mode)]
    where = F.lit(None).cast("int")
    for i, lo in spots:
        where = F.when(value >= lo, i).otherwise(where)
    return (
        preds.select(where.alias("bin"), value.alias("v"), event.alias("e"), weight(preds).alias("w"))
        .filter("bin IS NOT NULL")
        .groupBy("bin")
        .agg(F.sum("w").cast("bigint").alias("n"), mean(F.col("v"), F.col("w")).alias("mean_score"), mean(F.col("e"), F.col("w")).alias("observed"))
        .withColumn("gap", F.col("observed") - F.col("mean_score"))
        .withColumns({c: F.element_at(F.array(*[F.lit(b[k]) for b in _bins(bins, mode)]), F.col("bin") + 1) for k, c in ((1, "lo"), (2, "hi"))})
    )


def calibration_error(preds: DataFrame, bins: int = 10, mode: str = "probability") -> DataFrame:
    """ece and mce over the reliability bins."""
    table = reliability(preds, bins, mode)
    return table.agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"), F.max(F.abs("gap")).alias("mce"))


#: Keys and lower bounds of the certainty bands, highest first.
BANDS = (("very_strong", 90), ("strong", 70), ("uncertain", 30), ("low_evidence", 0))


def confidence(p: Column) -> Column:
    """Half-even rounded percent of the winning side."""
    return F.bround(100 * F.greatest(p, 1 - p), 0)


def band_accuracy(preds: DataFrame, lowers: list[int] | None = None) -> DataFrame:
    """Accuracy of each confidence band [lo, hi), empty bands kept; the top band ends at 101."""
    lowers = sorted(lowers or [lo for _, lo in BANDS])
    spark = preds.sparkSession
    named = {lo: name for name, lo in BANDS}
    bands = spark.createDataFrame([(named.get(lo), lo, hi) for lo, hi in zip(lowers, [*lowers[1:], 101], strict=True)], "band string, lo int, hi int")
    right = (F.col("p_fake") >= 0.5) == (F.col("y_true") == 1)
    band = F.lit(None).cast("int")
    for lo in lowers:
        band = F.when(confidence(F.col("p_fake")) >= lo, F.lit(lo)).otherwise(band)
    seen = preds.select(band.alias("lo"), right.cast("int").alias("ok"), weight(preds).alias("w")).groupBy("lo").agg(F.sum("w").cast("bigint").alias("n"), mean(F.col("ok"), F.col("w")).alias("accuracy"))
    return bands.join(F.broadcast(seen), "lo", "left").select("band", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def bin_occupancy(preds: DataFrame) -> DataFrame:
    """Share of the predictions in each band, and whether it is empty."""
    bands = band_accuracy(preds)
    total = bands.agg(F.sum("n").alias("total"))
    return bands.crossJoin(F.broadcast(total)).select("band", "lo", "hi", "n", ratio(F.col("n"), F.col("total")).alias("share"), (F.col("n") == 0).alias("is_empty"))


def per_source(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """By label and source: n, mean score, and the FPR of real or the recall of fake sources."""
    n = weight(preds)
    rate = mean((F.col("p_fake") >= threshold).cast("double"), n)
    return preds.groupBy("label", "source").agg(F.sum(n).cast("bigint").alias("n"), mean(F.col("p_fake"), n).alias("mean_p"), rate.alias("called_fake")).select(
        "label", "source", "n", "mean_p",
        F.when(F.col("label") == "real", F.col("called_fake")).alias("fpr"),
        F.when(F.col("label") == "fake", F.col("called_fake")).alias("recall"),
    )


def independent_groups(preds: DataFrame) -> DataFrame:
    """Rows against distinct non-empty groups; a note where they differ."""
    group = F.nullif(F.col("group_id").cast("string"), F.lit(""))
    return preds.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups")).withColumn(
        "differs", F.col("n_rows") != F.col("n_groups")
    )


def seen_flag(preds: DataFrame, seen: list[str]) -> DataFrame:
    return preds.withColumn("is_seen", F.lower("source").isin([s.lower() for s in seen]))


def generalisation_gap(preds: DataFrame, seen: list[str], threshold: float = 0.5) -> DataFrame:
    """Accuracy and recall of seen and unseen sources, and their differences in points."""
    flagged = seen_flag(preds, seen).withColumn("is_seen", F.coalesce("is_seen", F.lit(False)))
    t = with_rates(confusion(flagged, threshold, ["is_seen"]))
    side = lambda c, s: F.max(F.when(F.col("is_seen") == s, F.col(c)))
    one = t.agg(*[side(c, s).alias(f"{c}_{'seen' if s else 'unseen'}") for c in ("n", "accuracy", "recall") for s in (True, False)])
    return one.withColumn("accuracy_gap", 100 * (F.col("accuracy_seen") - F.col("accuracy_unseen"))).withColumn(
        "recall_gap", 100 * (F.col("recall_seen") - F.col("recall_unseen"))
    )


def condition_of(path: Column) -> Column:
    """The condition suffix of a file stem (`__cond-x`), `orig` without one."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"__cond-([^./\\]+)", 1), F.lit("")), F.lit("orig"))


def robustness(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """By condition: how many of all are detected as fake, and the mean score."""
    return preds.groupBy(condition_of(F.col("path")).alias("condition")).agg(
        F.sum((F.col("p_fake") >= threshold).cast("int")).alias("detected"), F.count(F.lit(1)).alias("total"), F.avg("p_fake").alias("mean_p")
    )


def score_distribution(preds: DataFrame) -> DataFrame:
    """Lowest, median and highest score by class, with the gap from the highest real to the lowest fake."""
    ends = preds.groupBy("label").agg(F.min("p_fake").alias("low"), F.max("p_fake").alias("high"))
    per = with_percentiles(ends, preds, "p_fake", {"median": ("cont", 0.5)}, ["label"]).select("label", "low", "median", "high")
    gap = per.agg((F.min(F.when(F.col("label") == "fake", F.col("low"))) - F.max(F.when(F.col("label") == "real", F.col("high")))).alias("gap"))
    return per.crossJoin(F.broadcast(gap))


def select_checkpoint(history: DataFrame) -> DataFrame:
    """The epoch with the best mean of its present accuracies; the first of equals."""
    parts = [F.col(c) for c in ("robust", "holdout", "swap")]
    present = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in parts])
    score = ratio(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in parts]), present)
    scored = history.withColumn("score", score)
    return scored.agg(F.max_by(F.struct("epoch", "score"), F.struct(F.col("score"), -F.col("epoch"))).alias("b")).select("b.*")


def rate_interval(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % Wilson interval of hits / n; with no hits the upper bound is 3 / n; NULL without n."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    none = hits == 0
    return F.when(none, F.when(n.isNotNull(), 0.0)).otherwise(centre - half), F.when(none, F.least(3 / n, F.lit(1.0))).otherwise(centre + half)


def error_intervals(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """FPR and FNR with intervals; the denominators are independent groups, an error counts once for its group."""
    wrong = F.when((F.col("p_fake") >= threshold) != (F.col("y_true") == 1), F.col("group_id"))
    per = preds.groupBy("y_true").agg(F.countDistinct("group_id").alias("groups"), F.countDistinct(wrong).alias("wrong"))
    low, high = rate_interval(F.col("wrong"), F.col("groups"))
    return per.select(F.when(F.col("y_true") == 1, "fnr").otherwise("fpr").alias("rate"), "groups", "wrong", low.alias("low"), high.alias("high"))


def model_comparison(a: DataFrame, b: DataFrame, by: str = "source", target: float = 0.01) -> DataFrame:
    """Per slice: accuracy, recall and FPR differences (b - a) at 0.5; plus whether b is promoted.

    Promoted: no slice loses recall, no slice gains FPR, overall accuracy does not fall, and the recall at the
    threshold for the target FPR does not fall.
    """
    side = lambda df, tag: with_rates(confusion(df, 0.5, [by])).select(by, *[F.col(c).alias(f"{c}_{tag}") for c in ("accuracy", "recall", "fpr")])
    slices = side(a, "a").join(side(b, "b"), by)
    diff = slices.select(by, *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"d_{c}") for c in ("accuracy", "recall", "fpr")])
    overall = lambda df, tag: with_rates(confusion(df)).select(F.col("accuracy").alias(f"acc_{tag}"))
    strict = lambda df, tag: threshold_for_fpr(df, target).select(F.col("recall").alias(f"strict_{tag}"))
    worst = diff.agg(F.min("d_recall").alias("mr"), F.max("d_fpr").alias("mf"))
    verdict = worst.crossJoin(overall(a, "a")).crossJoin(overall(b, "b")).crossJoin(strict(a, "a")).crossJoin(strict(b, "b")).select(
        (F.coalesce(F.col("mr") >= 0, F.lit(True)) & F.coalesce(F.col("mf") <= 0, F.lit(True)) & (F.col("acc_b") >= F.col("acc_a")) & (F.col("strict_b") >= F.col("strict_a"))).alias("promote")
    )
    return diff.crossJoin(F.broadcast(verdict))


def long_rows(df: DataFrame, section: str, key: Column, columns: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")
    return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), pairs).select("section", "key", "m.metric", "m.value")


def evaluation_report(preds: DataFrame, seen: list[str], thresholds: list[float], target: float = 0.01, bins: int = 10) -> DataFrame:
    """Every section of the evaluation as one long table (section, key, metric, value); NULL is not measurable."""
    rates = ["n", "n_real", "n_fake", *RATES]
    none = F.lit("all")
    every = preds
    preds = cut(condensed(every))  # counted once; all sections but the last read the counts
    parts = [
        long_rows(classification_metrics(preds), "overall", none, [*rates, "roc_auc", "pr_auc"]),
        long_rows(per_source(preds), "source", F.concat_ws("/", "label", "source"), ["n", "mean_p", "fpr", "recall"]),
        long_rows(threshold_sweep(preds, thresholds), "sweep", F.format_string("%.1f", "threshold"), rates),
        long_rows(brier(preds), "calibration", none, ["brier"]),
        *[long_rows(calibration_error(preds, bins, m), "calibration", F.lit(m), ["ece", "mce"]) for m in ("probability", "confidence")],
        long_rows(band_accuracy(preds), "band", F.col("lo"), ["n", "accuracy"]),
        long_rows(threshold_for_fpr(preds, target), "fpr_budget", F.lit(str(target)), ["threshold", "fpr", "recall"]),
        long_rows(generalisation_gap(preds, seen), "seen", none, ["n_seen", "n_unseen", "accuracy_gap", "recall_gap"]),
        long_rows(independent_groups(every), "groups", none, ["n_rows", "n_groups"]),
    ]
    return reduce(DataFrame.unionByName, parts)

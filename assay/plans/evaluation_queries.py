"""Queries of the evaluation core: metrics, thresholds, calibration, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import verdicts as v
from assay.operators import metrics as m
from assay.plans.registry import query
from assay.plans.views import duck, table, view

SEEN = [f"src{i}" for i in range(0, 20, 2)]
SWEEP = [i / 10 for i in range(1, 10)]
RATES = ("accuracy", "precision", "recall", "specificity", "f1", "fpr", "fnr")
P, BIG = duck("pred"), duck("pred_big")


def _counts(by: str, where: str = "true", threshold: str = "0.5e0") -> str:
    hit = f"p_fake >= {threshold}"
    return f"""SELECT {by + ',' if by else ''} count(*) FILTER (WHERE y_true = 1 AND {hit}) AS tp, count(*) FILTER (WHERE y_true = 0 AND {hit}) AS fp,
      count(*) FILTER (WHERE y_true = 0 AND NOT ({hit})) AS tn, count(*) FILTER (WHERE y_true = 1 AND NOT ({hit})) AS fn
      FROM p WHERE {where} {'GROUP BY ' + by if by else ''}"""


def _rates(counts: str) -> str:
    return f"""SELECT *, CASE WHEN precision IS NULL OR recall IS NULL THEN NULL WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END AS f1
      FROM (SELECT *, tp + fp + tn + fn AS n, tn + fp AS n_real, tp + fn AS n_fake,
        (tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0) AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall,
        tn::DOUBLE / nullif(tn + fp, 0) AS specificity, fp::DOUBLE / nullif(fp + tn, 0) AS fpr, fn::DOUBLE / nullif(fn + tp, 0) AS fnr FROM ({counts}))"""


def _areas(by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    pre = f"{by}, " if by else ""
    return f"""SELECT {pre} sum(pos * (below + neg / 2e0)) / nullif(any_value(tp_all) * any_value(fp_all), 0) AS roc_auc,
      sum(pos * (found / nullif(found + wrong, 0)::DOUBLE)) / nullif(any_value(tp_all), 0) AS pr_auc
      FROM (SELECT {pre} pos, neg, sum(neg) OVER ({part} ORDER BY p_fake) - neg AS below, sum(pos) OVER ({part} ORDER BY p_fake DESC) AS found,
        sum(neg) OVER ({part} ORDER BY p_fake DESC) AS wrong, sum(pos) OVER ({part}) AS tp_all, sum(neg) OVER ({part}) AS fp_all
        FROM (SELECT {pre} p_fake, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM p GROUP BY {pre} p_fake)) {'GROUP BY ' + by if by else ''}"""


def _with(text: str, view_sql: str = P) -> str:
    return f"WITH p AS ({view_sql}) {text}"


@query("d1_confusion", _with(_counts("")))
def _(spark, sf):
    return m.confusion(view(spark, sf, "pred"))


@query("d2_classification_metrics", _with(f"SELECT r.*, a.roc_auc, a.pr_auc FROM ({_rates(_counts('source'))}) r JOIN ({_areas('source')}) a USING (source)"), (*RATES, "roc_auc", "pr_auc"))
def _(spark, sf):
    return m.classification_metrics(view(spark, sf, "pred"), by=["source"])


@query("d2_classification_metrics_big", _with(f"SELECT * FROM ({_rates(_counts(''))}), ({_areas()})", BIG), (*RATES, "roc_auc", "pr_auc"))
def _(spark, sf):
    return m.classification_metrics(view(spark, sf, "pred_big"))


@query("d3_roc_auc", _with(f"SELECT roc_auc FROM ({_areas()})", BIG), ("roc_auc",))
def _(spark, sf):
    return m.roc_auc(view(spark, sf, "pred_big"))


@query("d4_pr_auc", _with(f"SELECT source, pr_auc FROM ({_areas('source')})", BIG), ("pr_auc",))
def _(spark, sf):
    return m.pr_auc(view(spark, sf, "pred_big"), ["source"])


_STEPS = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold" for t in SWEEP)


@query(
    "d5_threshold_sweep",
    _with(_rates(f"""SELECT threshold, count(*) FILTER (WHERE y_true = 1 AND p_fake >= threshold) AS tp, count(*) FILTER (WHERE y_true = 0 AND p_fake >= threshold) AS fp,
      count(*) FILTER (WHERE y_true = 0 AND p_fake < threshold) AS tn, count(*) FILTER (WHERE y_true = 1 AND p_fake < threshold) AS fn FROM p, ({_STEPS}) GROUP BY threshold"""), BIG),
    RATES,
)
def _(spark, sf):
    return m.threshold_sweep(view(spark, sf, "pred_big"), SWEEP)


@query("d5_full_sweep", _with(f"""SELECT s.*, a.roc_auc, a.pr_auc FROM ({_rates(f"""SELECT threshold, count(*) FILTER (WHERE y_true = 1 AND p_fake >= threshold) AS tp, count(*) FILTER (WHERE y_true = 0 AND p_fake >= threshold) AS fp,
      count(*) FILTER (WHERE y_true = 0 AND p_fake < threshold) AS tn, count(*) FILTER (WHERE y_true = 1 AND p_fake < threshold) AS fn FROM p, ({_STEPS}) GROUP BY threshold""")}) s, ({_areas()}) a"""), (*RATES, "roc_auc", "pr_auc"))
def _(spark, sf):
    return m.full_sweep(view(spark, sf, "pred"), SWEEP)


_BUDGET = """c AS (SELECT p_fake, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM p GROUP BY p_fake),
  r AS (SELECT p_fake, sum(neg) OVER w / (SELECT sum(neg) FROM c) AS fpr, sum(pos) OVER w / (SELECT sum(pos) FROM c) AS recall FROM c WINDOW w AS (ORDER BY p_fake DESC))"""


def _budget(target: str) -> str:
    return f"""SELECT coalesce(min(p_fake), 1e0 + 1e-9) AS threshold, coalesce(arg_min(fpr, p_fake), 0e0) AS fpr, coalesce(arg_min(recall, p_fake), 0e0) AS recall FROM r WHERE fpr <= {target}"""


@query("d6_threshold_for_fpr", f"WITH p AS ({BIG}), {_BUDGET} {_budget('0.05e0')}", ("threshold", "fpr", "recall"))
def _(spark, sf):
    return m.threshold_for_fpr(view(spark, sf, "pred_big"), 0.05)


@query("d7_brier", _with("SELECT source, avg((p_fake - y_true) * (p_fake - y_true)) AS brier FROM p GROUP BY source", BIG), ("brier",))
def _(spark, sf):
    return m.brier(view(spark, sf, "pred_big"), ["source"])


def _edges(mode: str, bins: int = 10) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS bin, CAST({lo!r} AS DOUBLE) AS lo, CAST({(2.0 if i == bins - 1 else hi)!r} AS DOUBLE) AS hi" for i, lo, hi in m._bins(bins, mode))


def _reliability(mode: str) -> str:
    value, event = ("p_fake", "y_true") if mode == "probability" else ("greatest(p_fake, 1 - p_fake)", "((p_fake >= 0.5e0) = (y_true = 1))::INT")
    return f"""SELECT bin, lo, least(hi, 1e0) AS hi, count(*) AS n, avg(v) AS mean_score, avg(e) AS observed, avg(e) - avg(v) AS gap
      FROM (SELECT {value} AS v, {event} AS e FROM p) JOIN ({_edges(mode)}) ON v >= lo AND v < hi GROUP BY bin, lo, hi"""


for _mode in ("probability", "confidence"):

    @query(f"d8_reliability_{_mode}", _with(_reliability(_mode), BIG), ("mean_score", "observed", "gap"))
    def _(spark, sf, mode=_mode):
        return m.reliability(view(spark, sf, "pred_big"), mode=mode)

    @query(f"d9_calibration_error_{_mode}", _with(f"SELECT sum(n * abs(gap)) / sum(n) AS ece, max(abs(gap)) AS mce FROM ({_reliability(_mode)})", BIG), ("ece", "mce"))
    def _(spark, sf, mode=_mode):
        return m.calibration_error(view(spark, sf, "pred_big"), mode=mode)


_BANDS = """(SELECT 'low_evidence' AS band, 0 AS lo, 30 AS hi UNION ALL SELECT 'uncertain', 30, 70 UNION ALL SELECT 'strong', 70, 90 UNION ALL SELECT 'very_strong', 90, 101)"""
_CONF = "round_even(100 * greatest(p_fake, 1 - p_fake), 0)"
_BAND_SQL = f"""SELECT band, lo, hi, count(c) AS n, avg(ok) AS accuracy FROM {_BANDS} LEFT JOIN
  (SELECT {_CONF} AS c, ((p_fake >= 0.5e0) = (y_true = 1))::INT AS ok FROM p) ON c >= lo AND c < hi GROUP BY band, lo, hi"""


@query("d10_band_accuracy", _with(_BAND_SQL), ("accuracy",))
def _(spark, sf):
    return m.band_accuracy(view(spark, sf, "pred"))


@query("k5_bin_occupancy", _with(f"SELECT band, lo, hi, n, n / nullif(sum(n) OVER (), 0)::DOUBLE AS share, n = 0 AS is_empty FROM ({_BAND_SQL})"), ("share",))
def _(spark, sf):
    return m.bin_occupancy(view(spark, sf, "pred"))


_SOURCE_SQL = """SELECT label, source, count(*) AS n, avg(p_fake) AS mean_p,
  CASE WHEN label = 'real' THEN avg((p_fake >= 0.5e0)::INT) END AS fpr, CASE WHEN label = 'fake' THEN avg((p_fake >= 0.5e0)::INT) END AS recall FROM p GROUP BY label, source"""


@query("d11_per_source_matrix", _with(_SOURCE_SQL), ("mean_p", "fpr", "recall"))
def _(spark, sf):
    return m.per_source(view(spark, sf, "pred"))


@query("d12_independent_groups", _with("SELECT count(*) AS n_rows, count(DISTINCT nullif(group_id, '')) AS n_groups, count(*) <> count(DISTINCT nullif(group_id, '')) AS differs FROM p"))
def _(spark, sf):
    return m.independent_groups(view(spark, sf, "pred"))


_SEEN = "lower(source) IN (" + ", ".join(f"'{s}'" for s in SEEN) + ")"
_GAP_SQL = f"""SELECT s.n AS n_seen, u.n AS n_unseen, s.accuracy AS accuracy_seen, u.accuracy AS accuracy_unseen, s.recall AS recall_seen, u.recall AS recall_unseen,
  100 * (s.accuracy - u.accuracy) AS accuracy_gap, 100 * (s.recall - u.recall) AS recall_gap
  FROM ({_rates(_counts('', _SEEN))}) s, ({_rates(_counts('', 'NOT ' + _SEEN))}) u"""


@query("d13_generalisation_gap", _with(_GAP_SQL), ("accuracy_seen", "accuracy_unseen", "recall_seen", "recall_unseen", "accuracy_gap", "recall_gap"))
def _(spark, sf):
    return m.generalisation_gap(view(spark, sf, "pred"), SEEN)


@query("c9_seen_vs_unseen", _with(f"SELECT {_SEEN} AS is_seen, count(*) AS n, sum(y_true) AS n_fake FROM p GROUP BY 1"))
def _(spark, sf):
    return m.seen_flag(view(spark, sf, "pred"), SEEN).groupBy("is_seen").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("n_fake"))


_COND = "concat('doc/', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 1 THEN '__cond-phone' WHEN 2 THEN '__cond-screenshot' WHEN 3 THEN '__cond-social' WHEN 4 THEN '__cond-reencode' ELSE '' END, '.jpg')"


@query(
    "d30_robustness_matrix",
    f"""SELECT CASE doc_id % 5 WHEN 1 THEN 'phone' WHEN 2 THEN 'screenshot' WHEN 3 THEN 'social' WHEN 4 THEN 'reencode' ELSE 'orig' END AS condition,
  count(*) FILTER (WHERE (doc_id * 7919) % 71 >= 50) AS detected, count(*) AS total, avg(((doc_id * 7919) % 71) / 100e0) AS mean_p FROM documents GROUP BY 1""",
    ("mean_p",),
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return m.robustness(docs.select(F.expr(_COND).alias("path"), ((F.col("doc_id") * 7919 % 71) / 100).alias("p_fake")))


@query("d31_score_distribution", _with("""SELECT label, low, median, high, min(low) FILTER (WHERE label = 'fake') OVER () - max(high) FILTER (WHERE label = 'real') OVER () AS gap
  FROM (SELECT label, min(p_fake) AS low, median(p_fake) AS median, max(p_fake) AS high FROM p GROUP BY label)"""), ("gap", "median"))
def _(spark, sf):
    return m.score_distribution(view(spark, sf, "pred"))


_HISTORY = """SELECT CAST(o_custkey AS INT) AS epoch, max(o_totalprice % 97) / 97 AS robust, max(o_totalprice % 89) / 89 AS holdout,
  CASE WHEN o_custkey % 2 = 0 THEN max(o_totalprice % 83) / 83 END AS swap FROM orders GROUP BY o_custkey"""


@query("d33_select_checkpoint", f"""SELECT epoch, score FROM (SELECT epoch, (robust + holdout + coalesce(swap, 0)) / (2 + (swap IS NOT NULL)::INT) AS score FROM ({_HISTORY}))
  ORDER BY score DESC, epoch LIMIT 1""", ("score",))
def _(spark, sf):
    return m.select_checkpoint(spark.sql(_HISTORY.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders")))


@query("b8_risk_for", """SELECT prediction, confidence, CASE WHEN prediction = 'deepfake' AND confidence >= 85 THEN 'High' WHEN prediction = 'real' AND confidence >= 80 THEN 'Low' ELSE 'Medium' END AS risk,
  count(*) AS n FROM ({}) GROUP BY ALL""".format(duck("scans")))
def _(spark, sf):
    scans = view(spark, sf, "scans").withColumn("risk", v.risk_for(F.col("prediction"), F.col("confidence")))
    return scans.groupBy("prediction", "confidence", "risk").agg(F.count(F.lit(1)).alias("n"))


@query("b9_certainty_for", """SELECT scan_id, CASE WHEN confidence >= 90 THEN 'very_strong' WHEN confidence >= 70 THEN 'strong' WHEN confidence >= 30 THEN 'uncertain' ELSE 'low_evidence' END AS certainty FROM ({})""".format(duck("scans")))
def _(spark, sf):
    return view(spark, sf, "scans").select("scan_id", v.certainty_for(F.col("confidence")).alias("certainty"))


@query("b10_verdict", """SELECT video_id, frame_index, CASE WHEN faces_found > 0 AND p_fake >= 0.5e0 THEN 'deepfake' ELSE 'real' END AS prediction,
  CAST(CASE WHEN faces_found > 0 THEN round_even(100 * greatest(p_fake, 1 - p_fake), 0) ELSE 50 END AS INT) AS confidence, NOT faces_found > 0 AS insufficient_evidence FROM ({})""".format(duck("frames")))
def _(spark, sf):
    return view(spark, sf, "frames").select("video_id", "frame_index", *[c.alias(k) for k, c in v.verdict(F.col("p_fake"), F.col("faces_found") > 0).items()])


@query("b17_certainty_bands", """SELECT band, lo AS "from", hi AS "to", count(confidence) AS n, count(confidence) FILTER (WHERE prediction = 'deepfake') AS n_deepfake
  FROM (SELECT band, lo, coalesce(lag(lo) OVER (ORDER BY lo DESC), 100) AS hi FROM (VALUES ('very_strong', 90), ('strong', 70), ('uncertain', 30), ('low_evidence', 0)) AS b(band, lo)) b
  LEFT JOIN ({}) s ON s.confidence >= b.lo AND (s.confidence < b.hi OR b.hi = 100) GROUP BY band, lo, hi""".format(duck("scans")))
def _(spark, sf):
    """The bands with the scans that fall into each; the highest band is closed."""
    seen = view(spark, sf, "scans").groupBy(v.certainty_for(F.col("confidence")).alias("band")).agg(
        F.count("confidence").alias("n"), F.count_if(F.col("prediction") == "deepfake").alias("n_deepfake"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return v.certainty_bands(spark).join(F.broadcast(seen), "band", "left").select("band", "from", "to", zero("n"), zero("n_deepfake"))


@query("k1_fpr_interval", _with("""SELECT CASE WHEN y_true = 1 THEN 'fnr' ELSE 'fpr' END AS rate, g AS groups, w AS wrong,
  CASE WHEN w = 0 THEN 0e0 ELSE (ph + z * z / (2 * g)) / (1 + z * z / g) - z / (1 + z * z / g) * sqrt(ph * (1 - ph) / g + z * z / (4 * g * g)) END AS low,
  CASE WHEN w = 0 THEN least(3e0 / g, 1e0) ELSE (ph + z * z / (2 * g)) / (1 + z * z / g) + z / (1 + z * z / g) * sqrt(ph * (1 - ph) / g + z * z / (4 * g * g)) END AS high
  FROM (SELECT y_true, count(DISTINCT group_id) AS g, count(DISTINCT CASE WHEN (p_fake >= 0.5e0) <> (y_true = 1) THEN group_id END) AS w,
    count(DISTINCT CASE WHEN (p_fake >= 0.5e0) <> (y_true = 1) THEN group_id END)::DOUBLE / count(DISTINCT group_id) AS ph, 1.959963984540054e0 AS z FROM p GROUP BY y_true)"""), ("low", "high"))
def _(spark, sf):
    return m.error_intervals(view(spark, sf, "pred"))


_B = "least(1e0, p_fake + 0.1e0 * y_true)"


def _slice_sql(score: str, tag: str) -> str:
    return f"SELECT source, accuracy AS accuracy_{tag}, recall AS recall_{tag}, fpr AS fpr_{tag} FROM ({_rates(_counts('source').replace('FROM p', f'FROM (SELECT * REPLACE ({score} AS p_fake) FROM p)'))})"


def _strict(score: str) -> str:
    return f"""(SELECT coalesce(max(recall), 0) FROM (SELECT sum(neg) OVER w / (sum(neg) OVER ())::DOUBLE AS fpr, sum(pos) OVER w / (sum(pos) OVER ())::DOUBLE AS recall
      FROM (SELECT {score} AS s, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM p GROUP BY 1) WINDOW w AS (ORDER BY s DESC)) WHERE fpr <= 0.01e0)"""


def _acc(score: str) -> str:
    return f"(SELECT avg((({score}) >= 0.5e0) = (y_true = 1)) FROM p)".replace("avg((", "avg(CAST((").replace("(y_true = 1))", "(y_true = 1) AS INT))")


@query("k4_model_comparison", _with(f"""SELECT source, d_accuracy, d_recall, d_fpr, coalesce(min(d_recall) OVER () >= 0, true) AND coalesce(max(d_fpr) OVER () <= 0, true)
  AND {_acc(_B)} >= {_acc('p_fake')} AND {_strict(_B)} >= {_strict('p_fake')} AS promote
  FROM (SELECT source, accuracy_b - accuracy_a AS d_accuracy, recall_b - recall_a AS d_recall, fpr_b - fpr_a AS d_fpr FROM ({_slice_sql('p_fake', 'a')}) JOIN ({_slice_sql(_B, 'b')}) USING (source))"""), ("d_accuracy", "d_recall", "d_fpr"))
def _(spark, sf):
    a = view(spark, sf, "pred")
    return m.model_comparison(a, a.withColumn("p_fake", F.least(F.lit(1.0), F.col("p_fake") + 0.1 * F.col("y_true"))))


def _long(section: str, key: str, columns: list[str], text: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {key} AS key, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM ({text})" for c in columns)


_N = ["n", "n_real", "n_fake", *RATES]
_SWEEP_COUNTS = " UNION ALL ".join(f"SELECT '{t:.1f}' AS k, * FROM ({_rates(_counts('', threshold=f'CAST({t} AS DOUBLE)'))})" for t in SWEEP)
_REPORT = " UNION ALL ".join([
    _long("overall", "'all'", [*_N, "roc_auc", "pr_auc"], f"SELECT * FROM ({_rates(_counts(''))}), ({_areas()})"),
    _long("source", "concat(label, '/', source)", ["n", "mean_p", "fpr", "recall"], _SOURCE_SQL),
    _long("sweep", "k", _N, _SWEEP_COUNTS),
    _long("calibration", "'all'", ["brier"], "SELECT avg((p_fake - y_true) * (p_fake - y_true)) AS brier FROM p"),
    *[_long("calibration", f"'{x}'", ["ece", "mce"], f"SELECT sum(n * abs(gap)) / sum(n) AS ece, max(abs(gap)) AS mce FROM ({_reliability(x)})") for x in ("probability", "confidence")],
    _long("band", "CAST(lo AS VARCHAR)", ["n", "accuracy"], _BAND_SQL),
    _long("fpr_budget", "'0.01'", ["threshold", "fpr", "recall"], _budget("0.01e0")),
    _long("seen", "'all'", ["n_seen", "n_unseen", "accuracy_gap", "recall_gap"], _GAP_SQL),
    _long("groups", "'all'", ["n_rows", "n_groups"], "SELECT count(*) AS n_rows, count(DISTINCT nullif(group_id, '')) AS n_groups FROM p"),
])


@query("j7_evaluation_report", f"WITH p AS ({P}), {_BUDGET} {_REPORT}", ("value",), 8)
def _(spark, sf):
    return m.evaluation_report(view(spark, sf, "pred"), SEEN, SWEEP)

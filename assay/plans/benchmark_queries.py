"""Queries of the benchmark analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import verdicts as v
from assay.operators import benchmark as b
from assay.plans.registry import query
from assay.plans.views import duck, table, view

RATES = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")
LATENCY = ("mean_ms", "median_ms", "p95_ms")
BENCH, MANIFEST = duck("bench"), duck("bench_manifest")
JOIN = f"""SELECT p.file, coalesce(m.label, p.label) AS label, p.prediction, p.confidence, p.inconclusive, p.face_found, p.error, p.latency_ms,
  m.source_dataset, m.manipulation_type, m.relative_path IS NOT NULL AS matched FROM ({BENCH}) p LEFT JOIN ({MANIFEST}) m ON p.file = m.relative_path"""


def joined(spark, sf):
    manifest = view(spark, sf, "bench_manifest")
    return b.join_manifest(view(spark, sf, "bench"), manifest, F.col("relative_path"))


def _tally(source: str, all_rows: bool, by: str = "", extra: str = "") -> str:
    unsure = "inconclusive" if all_rows else "inconclusive AND error = ''"
    used = "error = '' AND NOT inconclusive"
    f = lambda c: f"count(*) FILTER (WHERE {c})"
    pre = f"{by}, " if by else ""
    return f"""SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM (
  SELECT *, (tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0) AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall,
    fp::DOUBLE / nullif(fp + tn, 0) AS fpr, fn::DOUBLE / nullif(fn + tp, 0) AS fnr FROM (
  SELECT {pre} count(*) AS samples, {f("error = ''")} AS successful, {f("error <> ''")} AS errors, {f(unsure)} AS inconclusive, {f(used)} AS evaluated,
    {f(used + " AND label = 'fake' AND prediction = 'deepfake'")} AS tp, {f(used + " AND label = 'real' AND prediction = 'deepfake'")} AS fp,
    {f(used + " AND label = 'real' AND prediction <> 'deepfake'")} AS tn, {f(used + " AND label = 'fake' AND prediction <> 'deepfake'")} AS fn {extra}
  FROM ({source}) {'GROUP BY ' + by if by else ''}))"""


_LAT = "avg(latency_ms) AS mean_ms, median(latency_ms) AS median_ms, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_ms"


@query("c1_predictions_manifest", JOIN)
def _(spark, sf):
    return joined(spark, sf)


@query("c2_files_metadata", f"""SELECT coalesce(f.relative_path, m.relative_path) AS relative_path, label, provenance,
  CASE WHEN f.relative_path IS NULL OR (m.relative_path IS NOT NULL AND coalesce(label, '') NOT IN ('real', 'fake')) THEN 'error'
    WHEN m.relative_path IS NULL OR provenance = '' THEN 'needs_review' ELSE 'ok' END AS status,
  concat_ws(' | ', CASE WHEN m.relative_path IS NULL THEN 'missing metadata' END, CASE WHEN f.relative_path IS NULL THEN 'missing file' END,
    CASE WHEN m.relative_path IS NOT NULL AND coalesce(label, '') NOT IN ('real', 'fake') THEN 'invalid label' END, CASE WHEN provenance = '' THEN 'missing provenance' END) AS validation_errors
  FROM ({duck('files')}) f FULL JOIN ({duck('meta')}) m ON f.relative_path = m.relative_path""")
def _(spark, sf):
    return b.build_manifest(view(spark, sf, "files"), view(spark, sf, "meta"))


_ROWS = """SELECT doc_id AS line, CASE doc_id % 7 WHEN 0 THEN '../x' WHEN 1 THEN '/abs' WHEN 2 THEN 'C:\\x' WHEN 3 THEN concat(' a\\b//', CAST(doc_id % 50 AS STRING), '/./c ') ELSE concat('d/', CAST(doc_id % 90 AS STRING)) END AS relative_path FROM documents"""
_SAFE = """SELECT line, relative_path, CASE WHEN x = '' THEN 'missing path' WHEN x LIKE '/%' OR regexp_matches(x, '^[A-Za-z]:') THEN 'absolute path' WHEN list_contains(string_split(x, '/'), '..') THEN 'parent reference' END AS error,
  array_to_string(list_filter(string_split(x, '/'), lambda s: s NOT IN ('', '.')), '/') AS p FROM (SELECT *, replace(trim(relative_path), '\\', '/') AS x FROM ({}))""".format(_ROWS)
_RANKED = f"SELECT line, relative_path, error, p, CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY error IS NULL, p ORDER BY line) END AS rn FROM ({_SAFE})"


def _rows(spark, sf):
    return spark.sql(_ROWS.replace("\\", "\\\\").replace("FROM documents", "FROM {documents}"), documents=table(spark, sf, "documents"))


@query("c3_metadata_index", f"SELECT line, p AS relative_path FROM ({_RANKED}) WHERE rn = 1")
def _(spark, sf):
    return b.metadata_index(_rows(spark, sf))[0].select("line", "relative_path")


@query("c3_metadata_errors", f"SELECT line, CASE WHEN error IS NULL THEN p ELSE relative_path END AS relative_path, coalesce(error, 'duplicate path') AS error FROM ({_RANKED}) WHERE rn IS NULL OR rn > 1")
def _(spark, sf):
    return b.metadata_index(_rows(spark, sf))[1]


@query("b14_safe_relative_path", f"SELECT line, CASE WHEN error IS NULL THEN p END AS safe_path, error FROM ({_SAFE})")
def _(spark, sf):
    path, error = b.safe_relative_path(F.col("relative_path"))
    return _rows(spark, sf).select("line", path.alias("safe_path"), error.alias("error"))


@query("c4_identity_overlap", """WITH a AS (SELECT DISTINCT source AS id FROM documents WHERE doc_id % 2 = 0 AND source <> ''), b AS (SELECT DISTINCT source AS id FROM documents WHERE doc_id % 3 = 0 AND source <> '')
  SELECT CASE WHEN na = 0 OR nb = 0 THEN 'cannot_verify' WHEN shared <> '' THEN 'overlap' ELSE 'no_overlap' END AS status, na AS n_eval, nb AS n_train, n_shared, shared
  FROM (SELECT (SELECT count(*) FROM a WHERE id IN (SELECT id FROM b)) AS n_shared, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM a WHERE id IN (SELECT id FROM b) ORDER BY id LIMIT 20)), '') AS shared)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("source", "identity_id")
    return b.identity_overlap(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 3 = 0"))


_ISSUES = """SELECT coalesce(f.relative_path, m.relative_path) AS relative_path, label, provenance,
  CASE WHEN width IS NULL OR width <= 0 THEN 'unknown' WHEN width < 128 THEN 'under_128px' WHEN width < 256 THEN '128_to_255px' WHEN width < 512 THEN '256_to_511px' WHEN width < 1024 THEN '512_to_1023px' ELSE '1024px_or_larger' END AS resolution
  FROM ({}) f FULL JOIN ({}) m ON f.relative_path = m.relative_path""".format(duck("files"), duck("meta"))


@query("d19_quality_report", f"""WITH q AS (SELECT *, label IS NULL OR label NOT IN ('real', 'fake') AS bad, coalesce(provenance, '') = '' AS nop, resolution = 'unknown' AS nor FROM ({_ISSUES}))
  SELECT 'totals' AS section, 'total' AS key, count(*) AS n FROM q UNION ALL SELECT 'totals', 'problems', count(*) FILTER (WHERE bad OR nop OR nor) FROM q
  UNION ALL SELECT 'label', coalesce(nullif(label, ''), '(none)'), count(*) FROM q GROUP BY 2 UNION ALL SELECT 'resolution', resolution, count(*) FROM q GROUP BY 2
  UNION ALL SELECT 'issue', k, n FROM (SELECT 'invalid_label' AS k, count(*) FILTER (WHERE bad) AS n FROM q UNION ALL SELECT 'missing_provenance', count(*) FILTER (WHERE nop) FROM q
    UNION ALL SELECT 'unknown_resolution', count(*) FILTER (WHERE nor) FROM q) WHERE n > 0""")
def _(spark, sf):
    both = view(spark, sf, "files").join(view(spark, sf, "meta"), "relative_path", "full_outer")
    width = F.col("width").cast("string")
    return b.quality_report(both.withColumn("resolution", b.resolution_bucket(width, width)))


@query("b13_resolution_bucket", f"SELECT resolution, count(*) AS n FROM ({_ISSUES}) GROUP BY resolution")
def _(spark, sf):
    both = view(spark, sf, "files").join(view(spark, sf, "meta"), "relative_path", "full_outer")
    width = F.col("width").cast("string")
    return both.groupBy(b.resolution_bucket(width, width).alias("resolution")).agg(F.count(F.lit(1)).alias("n"))


@query("d21_visual_duplicate_sets", "SELECT n_chars AS dhash, count(DISTINCT sha256(text)) AS n_digests, count(*) AS n FROM documents GROUP BY n_chars HAVING count(DISTINCT sha256(text)) > 1")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("n_chars").alias("dhash"), F.sha2("text", 256).alias("sha256"))
    return b.visual_duplicate_sets(docs)


@query("b11_is_inconclusive", f"SELECT file, coalesce(inconclusive, false) OR NOT coalesce(face_found, false) AS unsure FROM ({BENCH})")
def _(spark, sf):
    return view(spark, sf, "bench").select("file", v.is_inconclusive(F.col("inconclusive"), F.col("face_found")).alias("unsure"))


@query("b11_is_inconclusive_scan", f"SELECT scan_id, coalesce(NOT face_found, false) AS unsure FROM ({duck('scans')})")
def _(spark, sf):
    return view(spark, sf, "scans").select("scan_id", v.is_inconclusive_scan(F.col("face_found")).alias("unsure"))


_CONF = "CASE WHEN regexp_matches(confidence, '^\\s*[+-]?\\d+\\s*$') THEN CAST(confidence AS BIGINT) END"
_K = "CASE WHEN matched THEN label ELSE '' END"
_LEDGER = f"""WITH j AS (SELECT *, {_K} AS known, {_CONF} AS conf FROM ({JOIN})), k AS (SELECT *, known = 'real' AND prediction = 'deepfake' AS fp, known = 'fake' AND prediction = 'real' AS fn FROM j)
  SELECT category, file, known AS true_label, prediction AS predicted_label, conf AS confidence, source_dataset, manipulation_type, latency_ms FROM (
  SELECT *, 'no_face' AS category FROM k WHERE error = '' AND (inconclusive OR NOT face_found) UNION ALL SELECT *, 'false_positive' FROM k WHERE fp UNION ALL SELECT *, 'false_negative' FROM k WHERE fn
  UNION ALL SELECT *, 'high_confidence_wrong' FROM k WHERE (fp OR fn) AND conf >= 90 UNION ALL SELECT *, 'low_confidence' FROM k WHERE conf <= 70)"""


@query("b12_failure_categories", _LEDGER)
def _(spark, sf):
    return b.failure_ledger(joined(spark, sf))


_FAILURES = f"""SELECT category, (SELECT count(*) FROM ({_LEDGER}) l WHERE l.category = c.category) AS n
  FROM (SELECT unnest(['false_positive', 'false_negative', 'high_confidence_wrong', 'low_confidence', 'no_face']) AS category) c"""


@query("d17_failure_counts", _FAILURES)
def _(spark, sf):
    return b.failure_counts(b.failure_ledger(joined(spark, sf)))


@query("d14_benchmark_metrics", _tally(BENCH, False), RATES)
def _(spark, sf):
    return b.benchmark_metrics(view(spark, sf, "bench"))


@query("d15_latency_summary", f"SELECT label, {_LAT} FROM ({BENCH}) GROUP BY label", LATENCY, 4)
def _(spark, sf):
    return b.latency_summary(view(spark, sf, "bench"), ["label"])


_SWAP = "lower(trim(coalesce(manipulation_type, ''))) IN (" + ", ".join(f"'{x}'" for x in b.FACE_SWAP_TYPES) + ")"
_MEMBERS = " UNION ALL ".join(f"SELECT *, '{n}' AS subgroup FROM j WHERE {c}" for n, c in (
    ("all_samples", "true"), ("real_samples", "label = 'real'"), ("fake_samples", "label = 'fake'"), ("face_swap_samples", f"label = 'fake' AND {_SWAP}"),
    ("other_manipulation_samples", f"label = 'fake' AND NOT {_SWAP}"), ("real_phone_photo_samples", "label = 'real' AND lower(trim(source_dataset)) = 'real_phone'")))
_SUBGROUPS = _tally(f"WITH j AS ({JOIN}) {_MEMBERS}", True, "subgroup", ", " + _LAT)


@query("d16_subgroup_report", f"SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in LATENCY)}) FROM ({_SUBGROUPS})", RATES)
def _(spark, sf):
    report = b.subgroup_report(joined(spark, sf))
    return report.withColumns({c: F.round(c, 4) for c in LATENCY})


@query("g6_declared_minus_present", f"SELECT relative_path FROM ({duck('meta')}) WHERE relative_path NOT IN (SELECT relative_path FROM ({duck('files')}))")
def _(spark, sf):
    return view(spark, sf, "meta").join(view(spark, sf, "files"), "relative_path", "left_anti").select("relative_path").orderBy("relative_path")


@query("h10_truthy", "SELECT event_type, lower(trim(event_type)) IN ('1', 'true', 'yes') AS t, lower(trim(event_type)) IN ('1', 'true', 'yes', 'on') AS t_on, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN ' True ' WHEN 1 THEN 'YES' WHEN 2 THEN '1' WHEN 3 THEN 'on' WHEN 4 THEN '0' ELSE event_type END AS event_type FROM events) GROUP BY ALL")
def _(spark, sf):
    x = F.expr("CASE event_id % 6 WHEN 0 THEN ' True ' WHEN 1 THEN 'YES' WHEN 2 THEN '1' WHEN 3 THEN 'on' WHEN 4 THEN '0' ELSE event_type END")
    rows = table(spark, sf, "events").select(x.alias("event_type"))
    return rows.groupBy("event_type", v.truthy(F.col("event_type")).alias("t"), v.truthy(F.col("event_type"), True).alias("t_on")).agg(F.count(F.lit(1)).alias("n"))


@query("h11_int_or_null", f"SELECT file, {_CONF} AS confidence FROM ({BENCH})")
def _(spark, sf):
    return view(spark, sf, "bench").select("file", v.int_or_null(F.col("confidence")).alias("confidence"))


_METRICS = ["samples", "successful", "errors", "inconclusive", "evaluated", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "fpr", "fnr"]


def _long(section: str, key: str, columns: list[str], text: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {key} AS key, '{c}' AS metric, round(CAST({c} AS DOUBLE), 4) AS value FROM ({text})" for c in columns)


@query("j9_benchmark_report", " UNION ALL ".join([
    _long("metrics", "'all'", _METRICS, _tally(BENCH, False)), _long("latency", "'all'", list(LATENCY), f"SELECT {_LAT} FROM ({BENCH})"),
    _long("subgroup", "subgroup", [*_METRICS, *LATENCY], _SUBGROUPS), _long("failures", "category", ["n"], _FAILURES),
    "SELECT 'protocol', 'threshold', '0.5', CAST(NULL AS DOUBLE)"]))
def _(spark, sf):
    return b.benchmark_report(view(spark, sf, "bench"), joined(spark, sf), {"threshold": "0.5"}).withColumn("value", F.round("value", 4))

"""Queries of the verdict store and the batch twins of the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.operators import store as st
from assay.plans.registry import query
from assay.plans.views import duck, table, view
from assay.session import shared_dir
from assay.sources.files import csv_write, table_append
from assay.streaming import streams

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
S, FB = duck("scans"), duck("feedback")


def scans(spark, sf):
    return view(spark, sf, "scans").withColumn("at", F.col("at").cast("timestamp"))


def feedback(spark, sf):
    return view(spark, sf, "feedback").withColumn("at", F.col("at").cast("timestamp"))


_PRIVATE = f"""SELECT scan_id, file_type, prediction, '' AS certainty, '' AS risk, '' AS engine, '' AS model_version, '' AS runtime, lower(regexp_extract(file_name, '[^/\\\\.](\\.[^./\\\\]*)$', 1))[1:8] AS file_ext,
  CAST(0 AS BIGINT) AS file_bytes, CAST(confidence AS BIGINT) AS confidence, CAST(0 AS BIGINT) AS frames, CAST(0 AS BIGINT) AS suspicious, CAST(latency_ms AS BIGINT) AS latency_ms, -1 AS faces, face_found FROM ({S})"""


@query("b6_privacy_projection", _PRIVATE)
def _(spark, sf):
    return st.privacy_projection(scans(spark, sf)).drop("at")


@query("i5_privacy_projection_stream", _PRIVATE)
def _(spark, sf):
    return streams.privacy_stream(scans(spark, sf)).drop("at")


_ENTRIES = "SELECT concat('SCAN-', CAST(event_id AS STRING)) AS scan_id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN ' False' WHEN 2 THEN 'yes' ELSE 'false' END AS agree, CASE WHEN event_id % 3 = 0 THEN '' ELSE repeat(event_type, 60) END AS note FROM events"


def _entries(spark, sf):
    return spark.sql(_ENTRIES.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events"))


@query("b7_feedback_projection", f"SELECT scan_id[1:40] AS scan_id, lower(trim(agree)) = 'true' AS agree, nullif(note[1:280], '') AS note FROM ({_ENTRIES}) WHERE lower(trim(agree)) IN ('true', 'false')")
def _(spark, sf):
    return st.feedback_projection(_entries(spark, sf))[0]


@query("b7_feedback_quarantine", f"SELECT * FROM ({_ENTRIES}) WHERE agree = 'yes'")
def _(spark, sf):
    return st.feedback_projection(_entries(spark, sf))[1]


_LINK = f"SELECT s.scan_id, epoch_us(s.at) AS scan_at, s.prediction, s.confidence, epoch_us(f.at) AS feedback_at, f.agree FROM ({S}) s JOIN ({FB}) f USING (scan_id)"


@query("c5_verdict_feedback", _LINK)
def _(spark, sf):
    linked = st.verdict_feedback(scans(spark, sf), feedback(spark, sf))
    return linked.withColumns({c: F.unix_micros(c) for c in ("scan_at", "feedback_at")})


@query("i3_verdict_feedback_join", _LINK.replace("USING (scan_id)", "ON s.scan_id = f.scan_id AND f.at >= s.at AND f.at <= s.at + INTERVAL '1' HOUR"))
def _(spark, sf):
    linked = streams.verdict_feedback_stream(scans(spark, sf), feedback(spark, sf))
    return linked.withColumns({c: F.unix_micros(c) for c in ("scan_at", "feedback_at")})


@query("d28_analytics_summary", f"""WITH s AS (SELECT * FROM ({S}) WHERE "at" > {NOW} - INTERVAL '20' DAY), f AS (SELECT * FROM ({FB}) WHERE "at" > {NOW} - INTERVAL '20' DAY)
  SELECT 'counts' AS section, 'analyses' AS key, CAST(count(*) AS DOUBLE) AS value FROM s UNION ALL SELECT 'counts', 'feedback', count(*) FROM f UNION ALL SELECT 'counts', 'disagreements', count(*) FILTER (WHERE NOT agree) FROM f
  UNION ALL SELECT 'counts', 'disagreement_rate', round(count(*) FILTER (WHERE NOT agree) / count(*)::DOUBLE, 4) FROM f UNION ALL SELECT 'latency_ms', 'mean', round(avg(latency_ms), 0) FROM s UNION ALL SELECT 'latency_ms', 'max', max(latency_ms) FROM s
  UNION ALL SELECT 'by_prediction', coalesce(prediction, '?'), count(*) FROM s GROUP BY 2 UNION ALL SELECT 'by_file_type', coalesce(file_type, '?'), count(*) FROM s GROUP BY 2""")
def _(spark, sf):
    return st.analytics_summary(scans(spark, sf), feedback(spark, sf), F.expr(NOW), 20)


@query("h16_day_window", f"""SELECT scan_id FROM ({S}) WHERE "at" > {NOW} - INTERVAL '7' DAY""")
def _(spark, sf):
    return st.day_window(scans(spark, sf), F.expr(NOW), 7).select("scan_id")


@query("f2_recent_disagreements", f"""SELECT scan_id, prediction, confidence FROM ({FB}) WHERE NOT agree ORDER BY "at" DESC, scan_id DESC LIMIT 20""")
def _(spark, sf):
    return st.recent_disagreements(feedback(spark, sf)).select("scan_id", "prediction", "confidence")


@query("f3_history_cap", f"""SELECT user_id, scan_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, scan_id DESC) AS place FROM ({S})) WHERE place <= 50""")
def _(spark, sf):
    return st.history_cap(scans(spark, sf)).select("user_id", "scan_id", "place")


@query("f3_recent_six", f"""SELECT user_id, scan_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, scan_id DESC) AS place FROM ({S})) WHERE place <= 6""")
def _(spark, sf):
    return st.history_cap(scans(spark, sf), 6).select("user_id", "scan_id", "place")


@query("d29_dashboard_stats", f"""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE sure AND prediction = 'deepfake') AS fake, count(*) FILTER (WHERE sure AND prediction = 'real') AS real, avg(confidence) FILTER (WHERE sure) AS avg_confidence, avg(agree::INT) AS user_accuracy
  FROM (SELECT s.*, f.agree, NOT coalesce(NOT face_found, false) AS sure FROM ({S}) s LEFT JOIN (SELECT scan_id, agree FROM ({FB})) f USING (scan_id)) GROUP BY user_id""", ("avg_confidence", "user_accuracy"))
def _(spark, sf):
    history = scans(spark, sf).join(feedback(spark, sf).select("scan_id", "agree"), "scan_id", "left")
    return st.dashboard_stats(history)


@query("a11_additive_schema_evolution", f"SELECT scan_id, prediction, NULL AS agree FROM ({S}) UNION ALL SELECT scan_id, prediction, agree FROM ({FB})")
def _(spark, sf):
    from assay.sources.files import evolve

    return evolve(scans(spark, sf).select("scan_id", "prediction"), feedback(spark, sf).select("scan_id", "prediction", "agree"))


@query("a10_table_append", f"SELECT prediction, count(*) * 2 AS n FROM ({S}) GROUP BY prediction")
def _(spark, sf):
    """Two appends to one table in the shared folder."""
    path = f"{shared_dir(spark)}/analyses-{uuid.uuid4().hex}"
    for _ in range(2):
        table_append(st.privacy_projection(scans(spark, sf)), path)
    return spark.read.parquet(path).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("a12_disagreements_export", f"SELECT scan_id, prediction, confidence FROM ({FB}) WHERE NOT agree")
def _(spark, sf):
    """The list as CSV with a header, read back."""
    path = f"{shared_dir(spark)}/disagreements-{uuid.uuid4().hex}"
    csv_write(feedback(spark, sf).filter("NOT agree").select("scan_id", "prediction", "confidence"), path)
    return spark.read.schema("scan_id string, prediction string, confidence int").option("header", True).csv(path)


@query("a9_feedback_jsonl_append", f"SELECT scan_id, agree FROM ({FB})")
def _(spark, sf):
    """The feedback table as a file stream, appended as JSON lines with an ingestion time, read back."""
    folder = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = source.filter("event_id % 3 = 0").select(F.concat(F.lit("SCAN-"), F.col("event_id").cast("string")).alias("scan_id"), (F.col("event_type") != "error").alias("agree"))
    streams.jsonl_append(rows, f"{folder}/lines", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("scan_id string, agree boolean, ingested_at timestamp").json(f"{folder}/lines").filter("ingested_at IS NOT NULL").select("scan_id", "agree")


RATE_LIMIT = """WITH RECURSIVE e AS (SELECT user_id AS client, epoch_us(ts) / 1000000e0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
  walk AS (SELECT DISTINCT client, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DOUBLE) AS t, CAST([] AS DOUBLE[]) AS held, CAST(NULL AS BOOLEAN) AS accepted, CAST(NULL AS BIGINT) AS retry_after FROM e
    UNION ALL SELECT client, rn, t, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3, CASE WHEN len(live) >= 3 THEN CAST(trunc(86400 - (t - live[1])) AS BIGINT) + 1 END
    FROM (SELECT e.client, e.rn, e.t, list_filter(w.held, lambda h: e.t - h <= 86400) AS live FROM walk w JOIN e ON e.client = w.client AND e.rn = w.rn + 1))
  SELECT client, t, accepted, retry_after FROM walk WHERE rn > 0"""


@query("i1_sliding_rate_limit", RATE_LIMIT)
def _(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("client"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"))
    return streams.sliding_rate_limit_batch(events, 3, 86400.0)




@query("i2_abandoned_uploads", """WITH u AS (SELECT user_id AS upload_id, ts AS at, event_id FROM events WHERE event_id % 2 = 0), a AS (SELECT user_id AS upload_id, ts AS at FROM events WHERE event_id % 2 = 1)
  SELECT event_id, upload_id FROM u WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.upload_id = u.upload_id AND a.at >= u.at AND a.at <= u.at + INTERVAL '30' MINUTE)""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("upload_id"), F.col("ts").cast("timestamp").alias("at"))
    return st.abandoned_uploads(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")).select("event_id", "upload_id")


@query("i4_rolling_summary", f"""SELECT epoch_us(w) AS window_start, prediction, count(*) AS n, sum(latency_ms) AS latency_sum, max(latency_ms) AS latency_max FROM (SELECT *, unnest(generate_series(date_trunc('day', "at") - INTERVAL '29' DAY, date_trunc('day', "at"), INTERVAL '1' DAY)) AS w FROM ({S})) GROUP BY ALL""")
def _(spark, sf):
    per = streams.rolling_summary(scans(spark, sf))
    return per.withColumn("window_start", F.unix_micros("window_start"))


_CLIP = f"""SELECT video_id, n AS frames, suspicious, CASE WHEN face_found THEN 0.40e0 * median + 0.25e0 * mean + 0.35e0 * list_sum(ps[1:k]) / k ELSE 0.5e0 END AS score, face_found
  FROM (SELECT *, least(n, greatest(1, CAST(round_even(greatest(0.15e0, 1e0 / n) * n, 0) AS INT))) AS k FROM (SELECT video_id, CAST(count(*) AS INT) AS n, median(p) AS median, avg(p) AS mean, count(*) FILTER (WHERE p >= 0.7e0) AS suspicious, bool_or(faces_found > 0) AS face_found, list_reverse_sort(list(p)) AS ps
    FROM (SELECT *, CASE WHEN faces_found > 0 THEN least(1e0, greatest(0e0, p_fake)) ELSE 0.5e0 END AS p FROM ({duck('frames')}) WHERE frame_index < 60) GROUP BY video_id))"""


@query("i6_incremental_clip_score", f"SELECT *, CASE WHEN face_found AND score >= 0.5e0 THEN 'deepfake' ELSE 'real' END AS prediction, CAST(CASE WHEN face_found THEN round_even(100 * greatest(score, 1 - score), 0) ELSE 50 END AS INT) AS confidence, NOT face_found AS insufficient_evidence FROM ({_CLIP})", ("score",))
def _(spark, sf):
    return streams.incremental_clip_score(view(spark, sf, "frames"))

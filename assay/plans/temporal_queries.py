"""Queries over event time: as-of joins, sessions, moving frames."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.operators import temporal as tp
from assay.plans import store_queries
from assay.plans.registry import query
from assay.plans.store_queries import scans
from assay.plans.views import duck, view
from assay.session import shared_dir
from assay.streaming import stateful, streams

S = duck("scans")


def reviews(spark, sf):
    return view(spark, sf, "reviews").withColumn("at", F.col("at").cast("timestamp"))


def releases(spark, sf):
    return view(spark, sf, "releases").withColumn("at", F.col("at").cast("timestamp"))


@query("m1_asof_feedback", f"""SELECT scan_id, r.review_id, r.agree FROM ({S}) s
  LEFT JOIN LATERAL (SELECT arg_max(review_id, (epoch_us(f.at), f.review_id)) AS review_id, arg_max(agree, (epoch_us(f.at), f.review_id)) AS agree FROM ({duck('reviews')}) f WHERE f.user_id = s.user_id AND f.at <= s.at) r ON true""")
def _(spark, sf):
    """Each scan with the latest feedback that its user had given by then."""
    out = tp.asof_join(scans(spark, sf).select("scan_id", "user_id", "at"), reviews(spark, sf), ["user_id"], {"review_id": "review_id", "agree": "agree"}, order=["review_id"])
    return out.select("scan_id", "review_id", "agree")


@query("m1_asof_feedback_within", f"""SELECT scan_id, r.review_id FROM ({S}) s
  LEFT JOIN LATERAL (SELECT arg_max(review_id, (epoch_us(f.at), f.review_id)) AS review_id FROM ({duck('reviews')}) f WHERE f.user_id = s.user_id AND f.at < s.at AND f.at >= s.at - INTERVAL '6' HOUR) r ON true""")
def _(spark, sf):
    """The same, strictly before the scan and at most six hours old."""
    out = tp.asof_join(scans(spark, sf).select("scan_id", "user_id", "at"), reviews(spark, sf), ["user_id"], {"review_id": "review_id"}, order=["review_id"], within=6 * 3600, strict=True)
    return out.select("scan_id", "review_id")


@query("m1_asof_model_version", f"""SELECT s.scan_id, r.version FROM ({S}) s LEFT JOIN LATERAL (SELECT arg_max(version, epoch_us(v.at)) AS version FROM ({duck('releases')}) v WHERE v.file_type = s.file_type AND v.at <= s.at) r ON true""")
def _(spark, sf):
    """Each scan with the model version of its media type that was live: two keys, each with half of all rows."""
    return tp.asof_join(scans(spark, sf).select("scan_id", "file_type", "at"), releases(spark, sf), ["file_type"], {"version": "version"}).select("scan_id", "version")


_SESSIONS = f"""WITH e AS (SELECT user_id, "at", latency_ms, CASE WHEN epoch_us("at") - lag(epoch_us("at")) OVER w < 86400000000 THEN 0 ELSE 1 END AS opens FROM ({S}) WINDOW w AS (PARTITION BY user_id ORDER BY "at")),
  n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY "at" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM e)"""


@query("m2_session_summary", f"""{_SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min("at")) AS session_start, epoch_us(max("at")) + 86400000000 AS session_end, count(*) AS events, CAST(sum(latency_ms) AS BIGINT) AS latency_sum FROM n GROUP BY user_id, session""")
def _(spark, sf):
    """Analysis sessions of a user (a day's pause ends one), over all scans."""
    out = tp.session_summary(scans(spark, sf), ["user_id"], 86400, {"latency_sum": F.sum("latency_ms")})
    return out.withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")})


_STREAM = f"""{_SESSIONS} SELECT user_id, epoch_us(min("at")) AS session_start, epoch_us(max("at")) + 86400000000 AS session_end, count(*) AS events, CAST(sum(latency_ms) AS BIGINT) AS latency_sum FROM n GROUP BY user_id, session
  HAVING max("at") + INTERVAL '1' DAY <= (SELECT max("at") - INTERVAL '1' HOUR FROM n)"""


@query("m2_session_stream", _STREAM)
def _(spark, sf):
    """The sessions that the watermark has closed, from a stream of the events file."""
    folder = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    rows = _event_stream(spark, sf).select("user_id", "at", F.floor(F.col("value") * 10).cast("int").alias("latency_ms"))
    sessions = streams.sessions(rows, ["user_id"], "1 day", {"latency_sum": F.sum("latency_ms")})
    closed = streams.run_to_table(sessions, f"{folder}/out", f"{folder}/checkpoint").drop("batch")
    return closed.withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")})


def _event_stream(spark, sf):
    """The events file as a stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("at", F.col("ts").cast("timestamp"))


@query("m3_abandoned_uploads_stateful", """WITH u AS (SELECT user_id AS upload_id, ts AS at, event_id FROM events WHERE event_id % 2 = 0), a AS (SELECT user_id AS upload_id, ts AS at FROM events WHERE event_id % 2 = 1)
  SELECT event_id, upload_id FROM u WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.upload_id = u.upload_id AND a.at >= u.at AND a.at <= u.at + INTERVAL '30' MINUTE)
    AND epoch_us(u.at) // 1000 + 1800001 <= (SELECT epoch_us(max(ts)) // 1000 - 300000 FROM events)""")
def _(spark, sf):
    """Uploads that no analysis follows within half an hour, by one state value and one event-time timer of each user."""
    folder = f"{shared_dir(spark)}/abandoned-{uuid.uuid4().hex}"
    rows = _event_stream(spark, sf).select("event_id", F.col("user_id").alias("upload_id"), "at", (F.col("event_id") % 2 == 0).alias("is_upload"))
    with stateful.rocksdb(spark):
        return streams.run_to_table(stateful.abandoned_uploads(rows), f"{folder}/out", f"{folder}/checkpoint").drop("batch")


@query("m3_rate_limit_stateful", store_queries.RATE_LIMIT)
def _(spark, sf):
    """The sliding limit of each client, three a day, with list state and a timer that forgets idle clients."""
    folder = f"{shared_dir(spark)}/limits-{uuid.uuid4().hex}"
    rows = _event_stream(spark, sf).select(F.col("user_id").alias("client"), "at")
    with stateful.rocksdb(spark):
        return streams.run_to_table(stateful.rate_limit(rows, 3, 86400.0), f"{folder}/out", f"{folder}/checkpoint").drop("batch")


_FRAME = """OVER (PARTITION BY user_id ORDER BY "at" RANGE BETWEEN INTERVAL '12' HOUR PRECEDING AND CURRENT ROW)"""


@query("m4_range_frames", f"""SELECT scan_id, count(*) {_FRAME} AS scans_12h, CAST(sum(latency_ms) {_FRAME} AS BIGINT) AS latency_12h, max(latency_ms) {_FRAME} AS slowest_12h, min(confidence) {_FRAME} AS least_sure_12h FROM ({S})""")
def _(spark, sf):
    """Rate and load of each scan's user in the twelve hours before it."""
    measures = {"scans_12h": ("count", F.lit(1)), "latency_12h": ("sum", F.col("latency_ms")), "slowest_12h": ("max", F.col("latency_ms")), "least_sure_12h": ("min", F.col("confidence"))}
    return tp.range_frames(scans(spark, sf), ["user_id"], 12 * 3600, measures).select("scan_id", *measures)


@query("m4_range_frames_by_type", f"""SELECT scan_id, count(*) OVER (PARTITION BY file_type ORDER BY "at" RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS scans_1h FROM ({S})""")
def _(spark, sf):
    """The same for two keys that hold all rows."""
    return tp.range_frames(scans(spark, sf), ["file_type"], 3600, {"scans_1h": ("count", F.lit(1))}).select("scan_id", "scans_1h")

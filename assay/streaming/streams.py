"""Structured Streaming forms of the store's operators. Event times are timestamps; late rows are dropped past the watermark."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assay.functions.verdicts import verdict
from assay.operators.frames import MAX_FRAMES, SUSPICIOUS, TOP_FRACTION, clean_weights
from assay.operators.store import privacy_projection
from assay.session import ship

log = logging.getLogger(__name__)


def accept_times(times: list[float], held: list[float], limit: int, window: float) -> Iterator[tuple[float, bool, int | None]]:
    """(time, accepted, seconds to wait) of events in order; `held` is the list of accepted times and is kept up to date.

    A hit expires when it is strictly older than the window; a refused event is not held.
    """
    for t in times:
        while held and t - held[0] > window:
            held.pop(0)
        if len(held) < limit:
            held.append(t)
            yield t, True, None
        else:
            yield t, False, int(window - (t - held[0])) + 1


def sliding_rate_limit_batch(events: DataFrame, limit: int, window: float, client: str = "client", at: str = "t") -> DataFrame:
    """client, t, accepted, retry_after for every event. A partition is read in (client, time) order with the accepted
    times of one client in memory, so a very busy client costs time but no memory."""
    kind = events.schema[client].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, held = None, []
        for b in batches:
            out = []
            for c, t in zip(b["client"], b["t"], strict=True):
                if c != who:
                    who, held = c, []
                out.append((c, *next(accept_times([t], held, limit, window))))
            yield pd.DataFrame(out, columns=["client", "t", "accepted", "retry_after"]).astype({"retry_after": "Int64"})

    ship(events.sparkSession)
    rows = events.select(F.col(client).alias("client"), F.col(at).cast("double").alias("t")).filter("client IS NOT NULL AND t IS NOT NULL")
    return rows.repartition("client").sortWithinPartitions("client", "t").mapInPandas(run, f"client {kind}, t double, accepted boolean, retry_after bigint")


def sliding_rate_limit(events: DataFrame, limit: int, window: float, lateness: str = "1 minute") -> DataFrame:
    """events: client string, at timestamp, streaming -> decisions. State is a client's accepted times; it goes a window
    after the last event, by event time. Events of a micro-batch are taken in time order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        times = sorted(x.timestamp() for b in batches for x in b["at"])
        out = [(key[0], *d) for d in accept_times(times, held, limit, window)]
        state.update((held,))
        state.setTimeoutTimestamp(int(max(times[-1] + window, state.getCurrentWatermarkMs() / 1000 + 1) * 1000) + 1)
        yield pd.DataFrame(out, columns=["client", "t", "accepted", "retry_after"]).astype({"retry_after": "Int64"})

    ship(events.sparkSession)
    return events.withWatermark("at", lateness).groupBy("client").applyInPandasWithState(
        step, "client string, t double, accepted boolean, retry_after bigint", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def abandoned_uploads_stream(uploads: DataFrame, analyses: DataFrame, ttl: str = "30 minutes", lateness: str = "5 minutes") -> DataFrame:
    """Uploads without an analysis within the time to live: a left outer interval join that gives its unmatched rows."""
    u = uploads.withWatermark("at", lateness)
    a = analyses.select(F.col("upload_id").alias("_id"), F.col("at").alias("_at")).withWatermark("_at", lateness)
    on = F.expr(f"upload_id = _id AND _at >= at AND _at <= at + INTERVAL {ttl}")
    return u.join(a, on, "leftOuter").filter("_id IS NULL").drop("_id", "_at")


def verdict_feedback_stream(scans: DataFrame, feedback: DataFrame, within: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Feedback joined to its verdict if it comes within a stated time after it."""
    s = scans.select("scan_id", F.col("at").alias("scan_at"), "prediction", "confidence").withWatermark("scan_at", lateness)
    f = feedback.select(F.col("scan_id").alias("_id"), F.col("at").alias("feedback_at"), "agree").withWatermark("feedback_at", lateness)
    return s.join(f, F.expr(f"scan_id = _id AND feedback_at >= scan_at AND feedback_at <= scan_at + INTERVAL {within}")).drop("_id")


def rolling_summary(scans: DataFrame, days: int = 30, slide: str = "1 day", lateness: str | None = "1 day") -> DataFrame:
    """Counts by prediction over sliding windows; works on a batch too."""
    if lateness and scans.isStreaming:
        scans = scans.withWatermark("at", lateness)
    per = scans.groupBy(F.window("at", f"{days} days", slide), "prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency_sum"), F.max("latency_ms").alias("latency_max"))
    return per.select(F.col("window.start").alias("window_start"), "prediction", "n", "latency_sum", "latency_max")


def privacy_stream(scans: DataFrame, enabled: bool = True) -> DataFrame:
    return privacy_projection(scans, enabled)


def incremental_clip_score(frames: DataFrame, most: int = MAX_FRAMES) -> DataFrame:
    """Clip score and verdict kept up to date as frames arrive, from the first `most` frames of a clip (update mode)."""
    seen = F.col("faces_found") > 0
    p = F.when(seen, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p_fake")))).otherwise(0.5)
    rows = F.slice(F.array_sort(F.collect_list(F.struct("frame_index", p.alias("p")))), 1, most)
    clips = frames.filter(F.col("frame_index") < most).groupBy("video_id").agg(rows.alias("rows"), F.bool_or(seen).alias("face_found"))
    ps, n, w = F.sort_array(F.transform("rows", lambda x: x["p"]), asc=False), F.size("rows"), clean_weights(None)
    k = F.least(n, F.greatest(F.lit(1), F.bround(F.greatest(F.lit(TOP_FRACTION), 1 / n) * n, 0).cast("int")))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    median = (F.get(ps, F.floor((n - 1) / 2).cast("int")) + F.get(ps, F.floor(n / 2).cast("int"))) / 2
    score = F.when(F.col("face_found"), median * w["median"] + mean(ps) * w["mean"] + mean(F.slice(ps, 1, k)) * w["top_k"]).otherwise(0.5)
    scored = clips.select("video_id", n.alias("frames"), F.size(F.filter(ps, lambda x: x >= SUSPICIOUS)).alias("suspicious"), score.alias("score"), "face_found")
    return scored.withColumns(verdict(F.col("score"), F.col("face_found")))


def jsonl_append(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each record with its ingestion time as one JSON line."""
    return stream.withColumn("ingested_at", F.current_timestamp()).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def sessions(events: DataFrame, by: list[str], gap: str, measures: dict[str, Column] | None = None, lateness: str = "1 hour", at: str = "at") -> DataFrame:
    """by, session_start, session_end (last event plus gap), events and the measures of each session, from a stream or a table.

    Sessions that a new event joins are merged in the state; a stream puts a session out (append mode) once the watermark
    has passed its end, so the last ones stay open. Later events are dropped by the watermark: late_rows tells how many.
    """
    windowed = events.withWatermark(at, lateness).groupBy(*by, F.session_window(at, gap).alias("_w"))
    found = windowed.agg(F.count(F.lit(1)).alias("events"), *[c.alias(n) for n, c in (measures or {}).items()])
    return found.select(*by, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "events", *(measures or {}))


def late_rows(stream: StreamingQuery) -> int:
    """Rows that came behind the watermark so far and count nowhere else."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in stream.recentProgress for s in p["stateOperators"])


def run_to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a Parquet table with the number of each batch, and read it back.

    A batch that is run again after a failure replaces its own folder, so no row is lost or doubled.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    writer.trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, batch long").option("basePath", path).parquet(path)


def best_effort_sink(write: Callable[[DataFrame], None], dead_letters: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch that cannot be written goes to a dead-letter table instead of being lost."""

    def sink(batch: DataFrame, epoch: int) -> None:
        try:
            write(batch)
        except Exception:
            log.exception("batch %d goes to dead letters", epoch)
            batch.write.mode("append").parquet(f"{dead_letters}/epoch={epoch}")

    return sink

"""Arbitrary state with timers: abandoned uploads and per-client limits as stateful processors.

State is kept in RocksDB, so a client's state is not held in memory between its events. Timers run on event time: what they
put out depends on the events and the watermark alone, so a stream equals its batch twin up to the last watermark.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assay.session import ship
from assay.streaming.streams import accept_times

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which timers and typed states need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class AbandonedUploads(StatefulProcessor):
    """Puts out each upload that no analysis of its key follows within ttl.

    A key's state is one value: the uploads that wait, and the analyses that an upload still on its way could need. Its only
    timer is that of the earliest upload; when it ends, all waits that the watermark has passed end with it, as no analysis
    in time can come for them any more. So a key costs a few calls and a sort each batch, however many uploads it has.
    """

    STATE = "ids array<long>, us array<long>, analyses array<long>, timer long"

    def __init__(self, ttl: float):
        self.ttl = int(ttl * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waits", self.STATE)

    def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None]:
        ids, us, analyses, timer = self.state.get() or ([], [], [], None)
        return *(np.array(x, dtype="int64") for x in (ids, us, analyses)), timer

    def _hold(self, ids: np.ndarray, us: np.ndarray, analyses: np.ndarray, timer: int | None, watermark: int, fired: bool = False) -> None:
        """Keep what the next batches need and see to the timer; Spark removes one that has fired."""
        analyses = analyses[analyses >= watermark * 1000]  # an upload that is still to come is later than the watermark
        wanted = int(us.min() + self.ttl) // 1000 + 1 if len(us) else None
        if wanted != timer:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if len(ids) or len(analyses):
            self.state.update((ids.tolist(), us.tolist(), analyses.tolist(), wanted))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids, us, analyses, timer = self._held()
        new = pd.concat(list(rows), ignore_index=True)
        upload = new["is_upload"].to_numpy(dtype=bool)
        at, events = new["us"].to_numpy(dtype="int64"), new["event_id"].to_numpy(dtype="int64")
        ids, us = np.concatenate([ids, events[upload]]), np.concatenate([us, at[upload]])
        analyses = np.sort(np.concatenate([analyses, at[~upload]]))
        if len(analyses) and not pd.isna(key[0]):  # a null key is equal to none
            first = np.searchsorted(analyses, us)  # the earliest analysis at or after each upload
            waits = (first == len(analyses)) | (analyses[np.minimum(first, len(analyses) - 1)] > us + self.ttl)
            ids, us = ids[waits], us[waits]
        self._hold(ids, us, analyses, timer, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids, us, analyses, timer = self._held()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = (us + self.ttl) // 1000 + 1 <= now
        self._hold(ids[~over], us[~over], analyses, timer, timerValues.getCurrentWatermarkInMs(), fired=timer == expiredTimerInfo.getExpiryTimeInMs())
        name = None if pd.isna(key[0]) else key[0]
        yield pd.DataFrame({"event_id": ids[over], "upload_id": pd.Series([name] * int(over.sum()), dtype="Int64")})

    def close(self) -> None:
        pass


def abandoned_uploads(events: DataFrame, ttl: float = 1800.0, lateness: str = "5 minutes") -> DataFrame:
    """events: upload_id, event_id (long), at, is_upload; streaming -> event_id, upload_id of the uploads without an analysis in time.

    Rows without a time, or of unknown kind, and uploads without an event_id are left out.
    """
    ship(events.sparkSession)
    rows = events.filter("at IS NOT NULL AND (event_id IS NOT NULL AND is_upload OR NOT is_upload)").withColumn("event_id", F.coalesce("event_id", F.lit(0)))
    rows = rows.withWatermark("at", lateness).withColumn("us", F.unix_micros("at"))
    return rows.groupBy("upload_id").transformWithStateInPandas(AbandonedUploads(ttl), "event_id long, upload_id long", "Append", "EventTime")


class RateLimit(StatefulProcessor):
    """At most `limit` accepted events of a client in any window: a list holds the accepted times, a timer forgets an idle client."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [t for (t,) in self.accepted.get()] if self.accepted.exists() else []
        times = sorted(t for part in rows for t in part["t"].tolist())
        out = [(key[0], *d) for d in accept_times(times, held, self.limit, self.window)]
        self.accepted.put([(t,) for t in held])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(int((max(held[-1], times[-1]) + self.window) * 1000) + 1)
        yield pd.DataFrame(out, columns=["client", "t", "accepted", "retry_after"]).astype({"retry_after": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.accepted.clear()
        yield pd.DataFrame({"client": [], "t": [], "accepted": [], "retry_after": []}).astype({"client": "int64", "t": "float64", "accepted": "bool", "retry_after": "Int64"})

    def close(self) -> None:
        pass


def rate_limit(events: DataFrame, limit: int, window: float, lateness: str = "1 minute") -> DataFrame:
    """events: client (long), at; streaming -> client, t, accepted, retry_after. Events of a micro-batch are taken in time order."""
    ship(events.sparkSession)
    rows = events.withWatermark("at", lateness).withColumn("t", F.unix_micros("at") / 1_000_000)
    return rows.groupBy("client").transformWithStateInPandas(RateLimit(limit, window), "client long, t double, accepted boolean, retry_after bigint", "Append", "EventTime")

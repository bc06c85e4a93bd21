"""As-of joins, sessions and moving frames against walks over sorted rows; streams against their batch twins."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from assay.operators import temporal as tp
from assay.operators.slices import borders, slice_of
from assay.streaming import stateful, streams

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def events(spark):
    """One key holds a third of all rows, most of it in one hour; ties, null keys, null times, repeated rows."""
    r = random.Random(4)
    rows = [(i, "hot", r.randrange(3600) if i % 4 else r.randrange(10**6), i % 7) for i in range(600)]
    rows += [(600 + i, f"u{i % 40}", r.randrange(10**6), i % 7) for i in range(1000)]
    rows += [(1600 + i, None, r.randrange(10**5), i % 7) for i in range(150)]
    rows += [(1750, "hot", None, 1), (1751, None, None, 2), rows[5], rows[5], (1752, "once", 5, 3)]
    return [(i, u, at(t), v) for i, u, t, v in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, user string, at timestamp, v long")


@pytest.mark.parametrize("most", [None, 50])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, events, most, strict):
    left, right = [e for e in events if e[0] % 3], [e for e in events if e[0] % 3 == 0]
    got = tp.asof_join(frame(spark, left), frame(spark, right), ["user"], {"id": "last_id", "v": "last_v"}, order=["id"], within=50_000.0, strict=strict, most=most)
    expected = []
    for e in left:
        fits = [r for r in right if e[2] and r[2] and r[1] == e[1] and (r[2] < e[2] if strict else r[2] <= e[2])]
        last = max(fits, key=lambda r: (r[2], r[0]), default=None)
        if last and (e[2] - last[2]).total_seconds() > 50_000:
            last = None
        expected.append((*e, *((last[0], last[3]) if last else (None, None))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_asof_join_keeps_names_and_rows(spark, events):
    left = frame(spark, events).withColumnRenamed("v", "a.b")
    got = tp.asof_join(left, frame(spark, events).limit(0), ["user"], {"v": "seen"})
    assert got.columns == ["id", "user", "at", "a.b", "seen"] and got.count() == len(events) and got.filter("seen IS NOT NULL").isEmpty()


@pytest.mark.parametrize("most", [None, 50])
def test_sessions(spark, events, most):
    got = tp.session_summary(frame(spark, events), ["user"], 1800.0, {"v_sum": F.sum("v")}, most=most).collect()
    expected = []
    for user in {e[1] for e in events}:
        own, number = sorted((e for e in events if e[1] == user and e[2]), key=lambda e: e[2]), 0
        for i, e in enumerate(own):
            if i == 0 or (e[2] - own[i - 1][2]).total_seconds() >= 1800:
                number += 1
                expected.append([user, number, e[2], e[2], 0, 0])
            expected[-1][3:] = [e[2], expected[-1][4] + 1, expected[-1][5] + e[3]]
    assert sorted([(r.user, r.session, r.session_start, r.session_end - dt.timedelta(seconds=1800), r.events, r.v_sum) for r in got], key=str) == sorted(map(tuple, expected), key=str)


@pytest.mark.parametrize("most", [None, 50])
def test_range_frames(spark, events, most):
    got = tp.range_frames(frame(spark, events), ["user"], 600.0, {"n": F.count(F.lit(1)), "top": F.max("v")}, most=most)
    expected = []
    for e in events:
        inside = [x for x in events if e[2] and x[2] and x[1] == e[1] and 0 <= (e[2] - x[2]).total_seconds() <= 600]
        expected.append((*e, len(inside) if e[2] else None, max((x[3] for x in inside), default=None)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_no_slice_holds_a_hot_key(spark, events):
    """The hot key's rows spread over slices, each with few rows of the table, though they lie in one hour of twelve days."""
    rows = frame(spark, events).withColumn("t", tp.seconds(F.col("at")))
    ends = borders(rows, "t", 50)
    sizes = [r["count"] for r in rows.filter("t IS NOT NULL").groupBy(slice_of(F.col("t"), ends).alias("s")).count().collect()]
    assert len(sizes) > 30 and max(sizes) <= 110
    assert spark.range(1).select(*[slice_of(F.lit(x), [float(i) for i in range(300)]).alias(str(x)) for x in (-1, 0, 128, 128.5, 299, 1e9)]).first()[:] == (0, 1, 129, 129, 300, 300)
    assert spark.range(1).select(slice_of(F.lit(None).cast("double"), [1.0])).first()[0] == 0


def as_files(spark, tmp_path, rows, schema, parts):
    """A stream that takes one file a batch, in the order of the parts."""
    for i, part in enumerate(parts):
        path = tmp_path / "in" / f"{i}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))


def test_session_stream_equals_its_twin(spark, tmp_path):
    r = random.Random(8)
    rows = sorted([(f"u{i % 5}", at(r.randrange(40_000)), i) for i in range(400)], key=lambda x: x[1])
    late = [("u0", at(0), 1000), ("u1", at(1), 1001)]  # in the last file: behind the watermark by then
    parts = [rows[:150], rows[150:300], rows[300:] + late]
    schema = "user string, at timestamp, v long"
    stream = streams.sessions(as_files(spark, tmp_path, rows, schema, parts), ["user"], "10 minutes", {"v_sum": F.sum("v")}, lateness="1 minute")
    query = stream.writeStream.format("memory").queryName("session_rows").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.table("session_rows").collect()
    end = max(x[1] for x in rows) - dt.timedelta(minutes=1)
    twin = [s for s in tp.session_summary(spark.createDataFrame(rows, schema), ["user"], 600.0, {"v_sum": F.sum("v")}).collect() if s.session_end <= end]
    assert sorted((s.user, s.session_start, s.session_end, s.events, s.v_sum) for s in closed) == sorted((s.user, s.session_start, s.session_end, s.events, s.v_sum) for s in twin)
    assert len(twin) > 20 and streams.late_rows(query) == 2


def test_abandoned_uploads_with_timers_equal_their_twin(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, i % 6, at(r.randrange(60_000)), i % 2 == 0) for i in range(300)]
    rows = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=(x[0] % 5) * 20))  # out of order, within the allowed lateness
    schema = "event_id long, upload_id long, at timestamp, is_upload boolean"
    stream = as_files(spark, tmp_path, rows, schema, [rows[:100], rows[100:200], rows[200:]])
    with stateful.rocksdb(spark):
        got = streams.run_to_table(stateful.abandoned_uploads(stream, 1800.0, "2 minutes"), str(tmp_path / "out"), str(tmp_path / "c")).collect()
    end = max(x[2] for x in rows) - dt.timedelta(minutes=2)
    wait = dt.timedelta(minutes=30)
    expected = {(e, u) for e, u, t, up in rows if up and t + wait < end and not any(u2 == u and not up2 and t <= t2 <= t + wait for _, u2, t2, up2 in rows)}
    assert {(x.event_id, x.upload_id) for x in got} == expected and len(got) == len(expected) > 10
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stateful.ROCKSDB


def test_rate_limit_with_timers_equals_its_twin(spark, tmp_path):
    r = random.Random(10)
    rows = sorted([(i % 4, at(r.randrange(20_000))) for i in range(240)], key=lambda x: x[1])
    schema = "client long, at timestamp"
    stream = as_files(spark, tmp_path, rows, schema, [rows[:80], rows[80:160], rows[160:]])
    with stateful.rocksdb(spark):
        got = streams.run_to_table(stateful.rate_limit(stream, 3, 600.0), str(tmp_path / "out"), str(tmp_path / "c")).drop("batch").collect()
    twin = streams.sliding_rate_limit_batch(spark.createDataFrame(rows, schema).select("client", (F.unix_micros("at") / 1_000_000).alias("t")), 3, 600.0).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, twin), key=str)
    assert {x.accepted for x in got} == {True, False}


def test_one_busy_key_of_uploads_takes_a_few_state_calls(spark, tmp_path):
    """All uploads of one key, most of which wait through the batch; null keys match nothing, repeated rows are rows."""
    rows = [(i, None if i % 50 == 0 else 1, at(i * 7), i % 3 > 0) for i in range(60_000)] + [(60_000, 1, None, True), (1, 1, at(7), True)]
    schema = "event_id long, upload_id long, at timestamp, is_upload boolean"
    stream = as_files(spark, tmp_path, rows, schema, [rows])
    began = time.monotonic()
    with stateful.rocksdb(spark):
        got = streams.run_to_table(stateful.abandoned_uploads(stream, 6.0, "2 minutes"), str(tmp_path / "out"), str(tmp_path / "c")).collect()
    took = time.monotonic() - began
    end = at(59_999 * 7) - dt.timedelta(minutes=2)
    done = {(u, t) for _, u, t, up in rows if not up and u}
    expected = [(e, u) for e, u, t, up in rows if up and t and t + dt.timedelta(seconds=6) < end and not any((u, t + dt.timedelta(seconds=s)) in done for s in range(7))]
    assert sorted(((x.event_id, x.upload_id) for x in got), key=str) == sorted(expected, key=str)
    assert len(expected) > 39_000 and took < 60  # waits were compared with each other and each had its timer: minutes


def test_range_frames_of_parts_equal_any_aggregates(spark, events):
    """Parts put together equal aggregates over whole frames; rows ask nothing of a frame twice."""
    rows = frame(spark, events).withColumn("w", F.when(F.col("v") > 2, F.col("v") / 4))
    rows = rows.unionByName(rows.limit(40).withColumn("at", F.col("at") + F.expr("INTERVAL 600 SECONDS")))
    both = {"n": ("count", F.lit(1)), "some": ("count", F.col("w")), "sum": ("sum", F.col("w")), "top": ("max", F.col("v")), "low": ("min", F.col("w"))}
    whole = {"n": F.count(F.lit(1)), "some": F.count("w"), "sum": F.sum("w"), "top": F.max("v"), "low": F.min("w")}
    for span in (600.0, 0.0):
        got = tp.range_frames(rows, ["user"], span, both)
        expected = tp.range_frames(rows, ["user"], span, whole)
        assert got.dtypes == expected.dtypes and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    mixed = tp.range_frames(rows, ["user"], 600.0, {"n": both["n"], "kinds": F.collect_set("v"), "top": both["top"]})
    assert mixed.columns == [*rows.columns, "n", "kinds", "top"] and mixed.count() == rows.count()


def test_a_dense_hour_costs_each_row_the_same(spark):
    """A hundred thousand rows of one key within an hour: each frame holds half of them on average."""
    rows = spark.range(100_000).select("id", F.lit("k").alias("user"), F.timestamp_micros(F.col("id") * 30_000).alias("at"))
    began = time.monotonic()
    got = tp.range_frames(rows, ["user"], 3600.0, {"n": ("count", F.lit(1)), "first": ("min", F.col("id"))})
    assert got.filter("n <> id + 1 OR first <> 0").isEmpty() and time.monotonic() - began < 60

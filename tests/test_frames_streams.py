import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import text as tx
from assay.functions import verdicts as v
from assay.operators import frames as fr
from assay.operators import sampling as sa
from assay.operators import scoring
from assay.operators import store as st
from assay.sources import files as fl
from assay.streaming import streams


def clip(spark, ps, **more):
    return spark.createDataFrame([(1, i, float(p)) for i, p in enumerate(ps)], "video_id int, frame_index int, p_fake double")


def test_hand_worked_aggregate(spark):
    r = fr.frame_aggregate(clip(spark, [0.1, 0.2, 0.3, 0.4, 0.5] + [0.9] * 5)).first()
    assert (r.k, round(r.median, 9), round(r["mean"], 9), round(r.top_k, 9), r.peak, r.lowest) == (2, 0.7, 0.6, 0.9, 0.9, 0.1)
    r = fr.frame_aggregate(clip(spark, [0.03] * 59 + [0.99])).first()
    assert r.score < 0.5 and r.suspicious == 1
    assert fr.frame_aggregate(clip(spark, [0.95] * 30 + [0.05] * 30)).first().score >= 0.5
    assert fr.frame_aggregate(clip(spark, [0.2, 0.4]), weights={"odd": 3.0}).first().score == pytest.approx(0.3)
    assert fr.frame_aggregate(clip(spark, [])).count() == 0


def test_random_aggregates(spark):
    rnd = random.Random(4)
    for n in (1, 2, 7, 30, 61):
        ps = [rnd.uniform(-0.2, 1.2) for _ in range(n)]
        c = [min(1.0, max(0.0, p)) for p in ps]
        k = max(1, min(n, round(max(1 / n, 0.15) * n)))
        want = 0.4 * statistics.median(c) + 0.25 * statistics.mean(c) + 0.35 * statistics.mean(sorted(c)[::-1][:k])
        r = fr.frame_aggregate(clip(spark, ps)).first()
        assert r.k == k and r.score == pytest.approx(want) and r.variance == pytest.approx(statistics.pvariance(c))


def test_mmss(spark):
    xs = [0, 7, 61, 599, 3599, 3600, -5, 9.6]
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "s double").select(v.mmss(F.col("s"))).collect()]
    assert got == "00:00 00:07 01:01 09:59 59:59 60:00 00:00 00:10".split()


def test_temporal_signals_with_landmarks_and_thumbs(spark):
    rng = np.random.default_rng(0)
    rows, marks, thumbs = [], [], []
    for i in range(10):
        lm = {"nose": (float(rng.normal()), 2.0), "left_eye": (1.0, float(rng.normal()))} | ({"mouth_left": (3.0, 3.0)} if i % 2 else {})
        th = [5.0] * 16 if i == 4 else rng.normal(size=16).tolist()
        marks.append(lm)
        thumbs.append(th)
        rows.append((1, i, 10.0, 20.0, 64.0, 64.0, 640.0, 480.0, 1.0, 2.0, lm, th))
    rows.append((1, 10, None, None, None, None, 640.0, 480.0, None, None, None, None))
    kind = "video_id int, frame_index int, box_x double, box_y double, box_w double, box_h double, frame_w double, frame_h double, origin_x double, origin_y double, landmarks map<string, struct<x: double, y: double>>, thumb array<double>"
    r = fr.temporal_signals(spark.createDataFrame(rows, kind)).first()
    steps = [np.mean([math.hypot(b[k][0] - a[k][0], b[k][1] - a[k][1]) / 64 for k in set(a) & set(b)]) for a, b in zip(marks, marks[1:], strict=False)]
    sims = [np.corrcoef(a, b)[0, 1] for i, (a, b) in enumerate(zip(thumbs, thumbs[1:], strict=False)) if i not in (3, 4)]
    assert (r.frames_sampled, r.faces_found, r.position_jitter, r.size_jitter) == (11, 10, 0.0, 0.0)
    assert r.landmark_jitter == pytest.approx(np.mean(steps)) and r.appearance_continuity == pytest.approx(np.mean(sims))


def test_dhash(spark):
    grids = {"ffffffffffffffff": [[i for i in range(9)]] * 8, "0000000000000000": [[9 - i for i in range(9)]] * 8}
    for want, g in grids.items():
        assert spark.createDataFrame([(g,)], "g array<array<int>>").select(fr.dhash(F.col("g"))).first()[0] == want


def brute_limit(times, limit, window):
    held, out = [], []
    for t in times:
        held = [h for h in held if t - h <= window]
        if len(held) < limit:
            held.append(t)
            out.append((t, True, None))
        else:
            out.append((t, False, int(window - (t - held[0])) + 1))
    return out


def test_rate_limit_batch(spark):
    rnd = random.Random(1)
    rows = [(c, round(rnd.uniform(0, 300), 1)) for c in "abc" for _ in range(150)] + [("d", 0.0), ("d", 60.0), ("d", 60.1)]
    got = streams.sliding_rate_limit_batch(spark.createDataFrame(rows, "client string, t double"), 3, 60.0).collect()
    for c in "abcd":
        mine = [(r.t, r.accepted, r.retry_after) for r in got if r.client == c]
        want = brute_limit(sorted(t for k, t in rows if k == c), 3, 60.0)
        assert sorted(mine, key=str) == sorted(want, key=str)


def run_stream(spark, build, schema, batches, tmp, mode="append", name="out"):
    src = f"{tmp}/src-{name}"
    q = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = build(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode(mode).format("memory").queryName(name)
        q = q.option("checkpointLocation", f"{tmp}/cp-{name}").trigger(availableNow=True).start() if mode != "append" else q.trigger(availableNow=True).option("checkpointLocation", f"{tmp}/cp-{name}-{i}").start()
        q.awaitTermination(120)
    return spark.table(name).collect()


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [(c, f"2024-01-01 00:{m:02d}:{s:02d}") for c in "ab" for m in range(4) for s in (0, 10, 20, 30, 31, 32)]
    data = spark.createDataFrame(rows, "client string, at string").withColumn("at", F.col("at").cast("timestamp"))
    data.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = streams.sliding_rate_limit(spark.readStream.schema("client string, at timestamp").parquet(f"{tmp_path}/in"), 3, 60.0)
    q = s.writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.client, r.t, r.accepted) for r in spark.table("limited").collect())
    batch = streams.sliding_rate_limit_batch(data.withColumn("t", F.unix_timestamp("at").cast("double")), 3, 60.0).collect()
    assert got == sorted((r.client, r.t, r.accepted) for r in batch) and len(got) == 48


def test_stateless_and_windowed_streams(spark, tmp_path):
    kind = "scan_id string, at timestamp, user_id long, file_name string, prediction string, confidence int, latency_ms int, face_found boolean, media binary"
    rows = [(f"S{i}", f"2024-01-{1 + i % 9:02d} 00:00:00", i, "holiday.JPEG" if i % 2 else None, "real", 90, i, None, b"x") for i in range(30)]
    data = spark.createDataFrame(rows, kind.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))
    data.write.parquet(f"{tmp_path}/scans")
    read = lambda: spark.readStream.schema(data.schema).parquet(f"{tmp_path}/scans")
    q = streams.jsonl_append(streams.privacy_stream(read()), f"{tmp_path}/json", f"{tmp_path}/cpj").trigger(availableNow=True).start()
    q.awaitTermination(120)
    lines = spark.read.json(f"{tmp_path}/json")
    assert lines.count() == 30 and {"media", "file_name"}.isdisjoint(lines.columns) and {r.file_ext for r in lines.collect()} == {".jpeg", ""}
    assert {r.faces for r in lines.collect()} == {-1}
    q = streams.rolling_summary(read()).writeStream.outputMode("update").format("memory").queryName("rolling").option("checkpointLocation", f"{tmp_path}/cpr").trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = {(r.window_start, r.n) for r in streams.rolling_summary(data).collect()}
    assert {(r.window_start, r.n) for r in spark.table("rolling").collect()} == want
    seen = []
    q = streams.privacy_stream(read(), enabled=False).writeStream.foreachBatch(streams.best_effort_sink(lambda b: seen.append(b.count()), f"{tmp_path}/dead")).option("checkpointLocation", f"{tmp_path}/cpd").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(seen) == 0
    def fails(batch):
        raise OSError("store is away")
    q = streams.privacy_stream(read()).writeStream.foreachBatch(streams.best_effort_sink(fails, f"{tmp_path}/dead")).option("checkpointLocation", f"{tmp_path}/cpe").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 30


def test_interval_join_streams(spark, tmp_path):
    t = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    make = lambda rows, kind: spark.createDataFrame(rows, kind).withColumn("at", F.col("at").cast("timestamp"))
    ups = make([("u1", t(0)), ("u2", t(5)), ("u3", t(10)), ("late", t(900))], "upload_id string, at string")
    ans = make([("u1", t(20)), ("u2", t(50)), ("none", t(900))], "upload_id string, at string")
    ups.coalesce(1).write.parquet(f"{tmp_path}/u")
    ans.coalesce(1).write.parquet(f"{tmp_path}/a")
    read = lambda p: spark.readStream.schema("upload_id string, at timestamp").parquet(f"{tmp_path}/{p}")
    q = streams.abandoned_uploads_stream(read("u"), read("a")).writeStream.outputMode("append").format("memory").queryName("gone").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    batch = {r.upload_id for r in st.abandoned_uploads(ups, ans).collect()}
    assert batch == {"u2", "u3", "late"} and {r.upload_id for r in spark.table("gone").collect()} == {"u2", "u3"}  # `late` may still come


def test_score_batch_records_failures(spark):
    def load():
        def scorer(xs):
            if any(x < 0 for x in xs):
                raise ValueError
            return [x / 10 for x in xs]
        return scorer
    got = {r.k: (r.p_fake, r.error) for r in scoring.score_batch(spark.createDataFrame([(i, i - 2) for i in range(12)], "k int, x int"), load, "k", "x").collect()}
    assert got[0] == (None, "ValueError") and got[5] == (0.3, None) and len(got) == 12


def test_manifest_round_trip(spark, tmp_path):
    rows = [{"sample_id": "a", "width": "12", "duration": "x", "face_found": "True", "status": "ACCEPTED", "notes": 'say "hi",\nthere'}, {"sample_id": "b", "width": "1.5", "face_found": "no", "status": "REJECTED"}]
    raw = spark.createDataFrame([tuple(r.get(c) for c in fl.MANIFEST) for r in rows], ", ".join(f"{c} string" for c in fl.MANIFEST))
    typed = fl.typed_manifest(raw)
    assert len(typed.columns) == 31
    for form in ("csv", "parquet"):
        fl.manifest_write(typed, f"{tmp_path}/{form}", form)
    back = fl.manifest_read(spark, f"{tmp_path}/csv").orderBy("sample_id").collect()
    assert (back[0].width, back[0].duration, back[0].face_found, back[0].notes) == (12, -1.0, True, 'say "hi",\nthere')
    assert (back[1].width, back[1].face_found) == (-1, False)
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 2
    with pytest.raises(ValueError, match="p_fake"):
        fl.typed_predictions(spark.createDataFrame([("1",)], "y_true string"))


def test_tree_intake_and_lists(spark, tmp_path):
    heads = {
        "real/x/a.JPG": b"\xff\xd8\xff\xe0" + b"0" * 40, "fake/b.png": b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (100).to_bytes(4, "big") + (50).to_bytes(4, "big"), "real/x/note.txt": b"hello",
        "fake/y/c.webp": b"RIFF\0\0\0\0WEBPVP8 ", "fake/y/d.mp4": b"\0\0\0\x18ftypmp42", "fake/y/e.webm": b"\x1aE\xdf\xa3", "fake/y/f.png": b"plain text", "fake/y/g.jpg": b"",
        "fake/y/h.png": b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (9000).to_bytes(4, "big") + (9000).to_bytes(4, "big"),
    }
    for name, data in heads.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    scan = {(r.label, r.source, r.path.rsplit("/", 1)[1]) for r in fl.labelled_tree_scan(spark, f"{tmp_path}/tree").collect()}
    assert ("real", "x", "a.JPG") in scan and ("fake", "(root)", "b.png") in scan and len(scan) == 5  # Spark lists no empty file
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/tree")
    got = {r.path.rsplit("/", 1)[1]: r.reject_code or r.kind for r in fl.intake_screen(files).collect()}
    assert got == {"a.JPG": "image", "b.png": "image", "note.txt": "bad_type", "c.webp": "image", "d.mp4": "video", "e.webm": "video", "f.png": "bad_magic", "h.png": "too_many_pixels"}
    empty = spark.createDataFrame([("x/g.jpg", 0, b"")], "path string, length long, content binary")
    assert fl.intake_screen(empty).first().reject_code == "empty_file"
    (tmp_path / "seal.txt").write_text("# comment\n\n g1 \ng2\ng1\n")
    assert sorted(r.group_id for r in fl.seal_list_read(spark, f"{tmp_path}/seal.txt").collect()) == ["g1", "g2"]
    fl.csv_write(spark.createDataFrame([("a", 'x "y"')], "k string, v string"), f"{tmp_path}/csv")
    assert fl._csv(spark, f"{tmp_path}/csv").first().v == 'x "y"'
    fl.report_json(spark.range(3), f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 3
    for _ in range(2):
        fl.table_append(spark.range(3), f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 6
    with pytest.raises(TypeError):
        fl.evolve(spark.range(1), spark.createDataFrame([("x",)], "id string"))


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.safe_log_text(F.lit("a\r\n\tb\x00\x7f"))) == "a\\r\\n\\tb\\x00\\x7f" and len(one(tx.safe_log_text(F.lit("x" * 900)))) == 500
    assert one(tx.safe_name(F.lit("é a/b"))) == "é_a_b" and one(tx.safe_name(F.lit(""))) == "ungrouped"
    assert [one(tx.extension(F.lit(x))) for x in ("holiday.JPEG", "clip.mp4", "noext", None, ".hidden")] == [".jpeg", ".mp4", "", "", ""]
    assert one(tx.url_policy(F.lit("https://user@192.168.0.1:8080/x"))) == "private address" and one(tx.url_policy(F.lit("https://notyoutube.com/"))) == "ok"
    assert one(tx.url_policy(F.lit("https://[fe80::1]/"))) == "link-local address" and one(tx.url_policy(F.lit("https://a/" + "x" * 2100))) == "missing or too long"


def _judge(ip):
    """The rules on Python's own address objects."""
    if ip.version == 6 and ip.ipv4_mapped:
        return _judge(ip.ipv4_mapped)
    if ip.version == 6 and ip.sixtofour:
        return _judge(ip.sixtofour)
    if ip.version == 6 and int(ip) >> 108 == 0x3FFF0:  # documentation addresses, which older versions of Python do not list
        return "private address"
    for bad, reason in ((ip.is_loopback, "loopback address"), (ip.is_link_local, "link-local address"), (ip.is_private, "private address"), (ip.is_reserved or ip.is_multicast or ip.is_unspecified, "reserved address")):
        if bad:
            return reason
    return "ok"


def test_addresses_match_brute_force(spark):
    import ipaddress
    import random

    rnd = random.Random(4)
    tops = [int(ipaddress.ip_address(x.split("/")[0])) for x, _ in tx.RANGES_6]
    six = [ipaddress.IPv6Address((t + rnd.choice([0, 1, rnd.getrandbits(64), (1 << rnd.randint(80, 125)) - 1])) % 2**128) for t in tops for _ in range(8)]
    six += [ipaddress.IPv6Address(rnd.getrandbits(128)) for _ in range(200)]
    four = [ipaddress.IPv4Address((int(ipaddress.ip_network(x).network_address) + rnd.choice([-1, 0, 1, 255])) % 2**32) for x, _ in tx.RANGES for _ in range(4)]
    six += [ipaddress.IPv6Address((0xFFFF << 32) + int(x)) for x in four] + [ipaddress.IPv6Address((0x2002 << 112) + (int(x) << 80) + 5) for x in four]
    rows = [(f"https://{x}/a", _judge(x)) for x in four]
    for x in six:
        spelled = [str(x), x.exploded, x.exploded.upper()]
        if x.ipv4_mapped:
            spelled += [f"::ffff:{x.ipv4_mapped}", f"0:0:0:0:0:FFFF:{x.ipv4_mapped}"]
        rows += [(f"https://[{s}]:443/x?y", _judge(x)) for s in spelled]
    rows += [(f"https://[{s}]/", "no host") for s in ("1:2:3", "::1::", "12345::", "1:2:3:4:5:6:7:8:9", "g::", "", ":::", ":1:2:3:4:5:6:7:8", "::1.2.3.400")]
    got = spark.createDataFrame(rows, "url string, want string").select("url", "want", tx.url_policy(F.col("url")).alias("got")).filter("NOT got <=> want").collect()
    assert got == []


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (None,), (3,)], "k int")
    got = sa.holdout_first(df, "k", 3).collect()
    assert len(got) == 5 and sum(r.is_holdout for r in got) == 3
    pools = [spark.createDataFrame([(p,), (p + 100,), (None,)], "k int") for p in range(20)]
    for budget in (1, 7, 50, 59):
        got = sa.budget_fill(pools, "k", budget).groupBy("pool").count().collect()
        assert {r["pool"]: r["count"] for r in got} == {p: min(3, budget - 3 * p) for p in range(-(-budget // 3))}


def test_numeric_hosts_as_the_resolver_reads_them(spark):
    import itertools
    import socket

    parts = ["0", "1", "127", "255", "256", "0x7f", "0177", "08", "0x", "65535", "65536", "16777215", "16777216", "4294967295", "4294967296", "0x0000000000ff", "000000000000001", "a"]
    hosts = parts + [".".join(x) for x in itertools.product(parts, parts)] + [".".join(x) for n in (3, 4) for x in itertools.product(["1", "0x7f", "0177", "256", "65536", "a"], repeat=n)] + ["1.2.3.4.5", "1..2", ".1", "1.", "127.0.0.1x"]

    def read(host):
        try:
            return int.from_bytes(socket.inet_aton(host), "big")
        except OSError:
            return None

    got = {r.h: r.n for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", tx.inet_aton(F.col("h")).alias("n")).collect()}
    assert {h: read(h) for h in hosts} == got


def test_local_names(spark):
    one = lambda u: spark.range(1).select(tx.url_policy(F.lit(u))).first()[0]
    assert [one(f"https://{h}/") for h in ("localhost.localdomain", "LOCALHOST.", "a.localhost", "localhost.example")] == ["loopback address"] * 3 + ["ok"]


def test_sizes_from_headers(spark):
    """Segments before the frame, fill bytes, progressive frames, cut files; unknown sizes reject nothing."""
    jpeg = lambda *segments: b"\xff\xd8" + b"".join(segments)
    seg = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    frame = lambda w, h, kind=0xC0: seg(kind, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03")
    webp = lambda form, body: b"RIFF\0\0\0\0WEBP" + form + b"\0\0\0\0" + body
    cases = {
        "a.jpg": (jpeg(seg(0xE0, b"JFIF" * 3), seg(0xE1, b"\xff\xc0" * 40), frame(640, 480)), None),
        "b.jpg": (jpeg(b"\xff" + frame(9000, 9000, 0xC2)), "too_many_pixels"), "c.jpeg": (jpeg(seg(0xC4, b"x" * 30), frame(15, 400)), "too_small"),
        "d.jpg": (jpeg(seg(0xE0, b"JFIF")), None), "e.jpg": (jpeg(seg(0xDA, b"scan") + frame(2, 2)), None), "f.jpg": (jpeg(*[seg(0xFE, b"note")] * 300, frame(8, 8)), "too_small"),
        "g.webp": (webp(b"VP8X", b"\0\0\0\0" + (8999).to_bytes(3, "little") + (8999).to_bytes(3, "little")), "too_many_pixels"),
        "h.webp": (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + (15).to_bytes(2, "little") + (300).to_bytes(2, "little")), "too_small"),
        "i.webp": (webp(b"VP8L", b"\x2f" + (639 | 14 << 14).to_bytes(4, "little")), "too_small"), "j.webp": (webp(b"VP8L", b"\x2f" + (639 | 479 << 14).to_bytes(4, "little")), None),
        "k.png": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (16).to_bytes(4, "big") + (16).to_bytes(4, "big"), None), "l.png": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", None),
        "m.mp4": (b"\0\0\0\x18ftypmp42", "too_long"), "n.mp4": (b"\0\0\0\x18ftypmp42", None), "o.webm": (b"\x1aE\xdf\xa3", None),
    }
    files = spark.createDataFrame([(p, len(c), bytearray(c)) for p, (c, _) in cases.items()], "path string, length long, content binary")
    clips = spark.createDataFrame([("m.mp4", 300.5), ("n.mp4", 300.0), ("a.jpg", 1000.0)], "path string, seconds double")
    assert {r.path: r.reject_code for r in fl.intake_screen(files, clips).collect()} == {p: want for p, (_, want) in cases.items()}

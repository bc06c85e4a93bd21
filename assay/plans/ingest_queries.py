"""Queries of sources, sinks and small text functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.functions import text as tx
from assay.operators.adapters import stem_of
from assay.operators.scoring import apply_hooks, score_batch
from assay.plans.registry import query
from assay.plans.views import duck, table, view
from assay.session import shared_dir
from assay.sources import files as fl


@query("a1_typed_manifest", """SELECT CAST(doc_id AS VARCHAR) AS sample_id, coalesce(TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE CAST(n_chars AS VARCHAR) END AS INT), -1) AS width, doc_id % 4 IN (0, 1) AS face_found FROM documents""")
def _(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("sample_id"), F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("n_chars").cast("string")).alias("width"),
        F.element_at(F.array(F.lit("1"), F.lit("True"), F.lit("0"), F.lit("no")), (F.col("doc_id") % 4 + 1).cast("int")).alias("face_found"))
    return fl.typed_manifest(raw).select("sample_id", "width", "face_found")


@query("a3_typed_predictions", "SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), '(all)') AS source, CASE WHEN doc_id % 3 = 1 THEN 'fake' ELSE 'real' END AS label, CAST(doc_id % 3 = 1 AS INT) AS y_true, (doc_id % 100) / 100e0 AS p_fake FROM documents")
def _(spark, sf):
    raw = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")).alias("source"),
        (F.col("doc_id") % 3 == 1).cast("int").cast("string").alias("y_true"), (F.col("doc_id") % 100 / 100).cast("string").alias("p_fake"))
    return fl.typed_predictions(raw).drop("group_id")


@query("a4_tree_columns", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'real' ELSE 'fake' END AS label, CASE WHEN doc_id % 5 = 0 THEN '(root)' ELSE source END AS source FROM documents")
def _(spark, sf):
    side = F.when(F.col("doc_id") % 2 == 0, "real").otherwise("fake")
    path = F.concat_ws("/", side, F.when(F.col("doc_id") % 5 != 0, F.col("source")), F.lit("x.jpg"))
    label, source = fl.tree_columns(path)
    return table(spark, sf, "documents").select("doc_id", label.alias("label"), source.alias("source"))


_INDEX = """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'not json' ELSE concat('{"c', CAST(event_id AS STRING), '.mp4": {"label": "FAKE", "original": ', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE concat('"o', CAST(user_id AS STRING), '.mp4"') END, '}, "d', CAST(event_id AS STRING), '.mp4": {"label": "Real"}}') END AS value FROM events"""


@query("a6_explode_clip_index", """SELECT concat('c', CAST(event_id AS VARCHAR), '.mp4') AS clip, 'fake' AS label, CASE WHEN event_id % 3 = 0 THEN concat('c', CAST(event_id AS VARCHAR), '.mp4') ELSE concat('o', CAST(user_id AS VARCHAR), '.mp4') END AS original FROM events WHERE event_id % 10 <> 0
  UNION ALL SELECT concat('d', CAST(event_id AS VARCHAR), '.mp4'), 'real', concat('d', CAST(event_id AS VARCHAR), '.mp4') FROM events WHERE event_id % 10 <> 0""")
def _(spark, sf):
    return fl.explode_clip_index(spark.sql(_INDEX.replace("FROM events", "FROM {e}").replace('{"c', '{{"c').replace('": {"label": "FAKE"', '": {{"label": "FAKE"').replace("'}, \"d'", "'}}, \"d'").replace('": {"label": "Real"}}', '": {{"label": "Real"}}}}'), e=table(spark, sf, "events")))


@query("a7_group_overrides", "SELECT d.doc_id, coalesce(s.g, d.source) AS group_id FROM documents d LEFT JOIN (SELECT doc_id, concat('g', CAST(doc_id % 5 AS VARCHAR)) AS g FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0) s USING (doc_id)")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", F.concat(F.lit("A/"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("group_id"))
    side = docs.filter("doc_id % 4 = 0").select(F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("g"), (F.col("doc_id") % 5).cast("string"))).alias("group"))
    return fl.group_overrides(rows, side).select("doc_id", "group_id")


@query("a8_upsert_groups", "SELECT concat(lang, '/', CAST(doc_id AS VARCHAR)) AS path, source AS g FROM documents WHERE lang <> 'es' UNION ALL SELECT concat('es/new', CAST(doc_id AS VARCHAR)), 'fresh' FROM documents WHERE doc_id % 7 = 0")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    old = docs.select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("g"))
    new = docs.filter("doc_id % 7 = 0").select(F.concat(F.lit("es/new"), F.col("doc_id").cast("string")).alias("path"), F.lit("fresh").alias("g"))
    return fl.upsert_groups(old, new, "es/")


@query("a13_seal_list", "SELECT DISTINCT trim(v) AS group_id FROM (SELECT CASE doc_id % 4 WHEN 0 THEN concat('# ', source) WHEN 1 THEN '  ' WHEN 2 THEN concat(' ', source, ' ') ELSE lang END AS v FROM documents) WHERE trim(v) <> '' AND trim(v) NOT LIKE '#%' UNION SELECT region FROM (SELECT r_name AS region FROM region)")
def _(spark, sf):
    lines = table(spark, sf, "documents").select(F.expr("CASE doc_id % 4 WHEN 0 THEN concat('# ', source) WHEN 1 THEN '  ' WHEN 2 THEN concat(' ', source, ' ') ELSE lang END AS value"))
    return fl.seal_list_append(fl.seal_list_rows(lines), table(spark, sf, "region").select(F.col("r_name").alias("group_id")))


_URLS = "SELECT page_id, CASE page_id % 30 WHEN 0 THEN concat('http://a.example/', CAST(page_id AS STRING)) WHEN 1 THEN 'https://www.youtube.com/watch?v=1' WHEN 2 THEN 'https://youtu.be./x' WHEN 3 THEN 'ftp://a.example/x' WHEN 4 THEN 'https://127.0.0.1/x' WHEN 5 THEN 'https://10.2.3.4:8080/x' WHEN 6 THEN 'https://172.31.0.9/' WHEN 7 THEN 'https://169.254.1.1/meta' WHEN 8 THEN 'https://LOCALHOST/x' WHEN 9 THEN 'https://8.8.8.8/x' WHEN 10 THEN '' WHEN 12 THEN 'https://[::ffff:127.0.0.1]/' WHEN 13 THEN 'https://[::ffff:a00:1]:8443/x' WHEN 14 THEN 'https://[0:0:0:0:0:0:0:1]/' WHEN 15 THEN 'https://[FF02::1]/' WHEN 16 THEN 'https://[2002:7f00:1::]/x' WHEN 17 THEN 'https://[fe80::1%25eth0]/' WHEN 18 THEN 'https://[2606:4700:4700::1111]/' WHEN 19 THEN 'https://[fd12:3456::1]/' WHEN 20 THEN 'https://[::]/' WHEN 21 THEN 'https://[1::2::3]/' WHEN 22 THEN 'https://127.1/' WHEN 23 THEN 'https://2130706433/' WHEN 24 THEN 'https://0x7F000001/' WHEN 25 THEN 'https://0177.0.0.1/' WHEN 26 THEN 'https://localhost.localdomain/x' WHEN 27 THEN 'https://0xA.2.3:8443/' WHEN 28 THEN 'https://134744072/' WHEN 29 THEN 'https://192.168.257/' ELSE url END AS url FROM pages"


_HEADS = ("FFD8FFE0", "89504E470D0A1A0A0000000D494844520000006400000032", "89504E470D0A1A0A0000000D494844520000C8000000C800", "524946460000000057454250", "000000186674797069736F6D", "1A45DFA3", "48656C6C6F", "")
_EXTS = ("jpg", "png", "png", "webp", "mp4", "webm", "png", "txt")


@query("a14_media_intake_screen", """SELECT path, ext, CASE WHEN code IS NULL THEN CASE WHEN ext IN ('.mp4', '.webm') THEN 'video' ELSE 'image' END END AS kind, code AS reject_code
  FROM (SELECT concat('up/', CAST(doc_id AS VARCHAR), '.', ['jpg', 'png', 'png', 'webp', 'mp4', 'webm', 'png', 'txt'][k + 1]) AS path, concat('.', ['jpg', 'png', 'png', 'webp', 'mp4', 'webm', 'png', 'txt'][k + 1]) AS ext,
    CASE WHEN k = 7 THEN 'bad_type' WHEN n_chars % 11 = 0 THEN 'empty_file' WHEN k = 6 THEN 'bad_magic' WHEN k = 2 THEN 'too_many_pixels' END AS code FROM (SELECT *, doc_id % 8 AS k FROM documents))""")
def _(spark, sf):
    k = (F.col("doc_id") % 8 + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), k)
    content = F.when(F.col("n_chars") % 11 == 0, F.lit(b"")).otherwise(F.concat(F.unhex(pick(_HEADS)), F.col("text").cast("binary")))
    files = table(spark, sf, "documents").select(F.concat(F.lit("up/"), F.col("doc_id").cast("string"), F.lit("."), pick(_EXTS)).alias("path"), content.alias("content"))
    return fl.intake_screen(files.withColumn("length", F.octet_length("content"))).select("path", "ext", "kind", "reject_code")


@query("a14_media_sizes", f"""SELECT path, CASE WHEN k < 4 AND w * h > 40000000 THEN 'too_many_pixels' WHEN k < 4 AND (w < 16 OR h < 16) THEN 'too_small' WHEN k = 4 AND h > 300 THEN 'too_long' END AS reject_code
  FROM (SELECT concat('up/', CAST(doc_id AS VARCHAR), ['.jpg', '.webp', '.webp', '.webp', '.mp4'][doc_id % 5 + 1]) AS path, CASE WHEN doc_id % 7 = 0 THEN 6000 ELSE CAST(1 + doc_id % 40 AS INT) END AS w, CAST(12 + n_chars % 9000 AS INT) AS h, doc_id % 5 AS k FROM documents)""")
def _(spark, sf):
    """Sizes from JPEG segments and the three WEBP forms, clip lengths from a table."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "text", "CASE WHEN doc_id % 7 = 0 THEN 6000 ELSE CAST(1 + doc_id % 40 AS INT) END AS w", "CAST(12 + n_chars % 9000 AS INT) AS h", "doc_id % 5 AS k")
    big = lambda c: F.lpad(F.hex(c), 4, "0")
    little = lambda c, n: F.concat(*[F.substring(F.lpad(F.hex(c), 2 * n, "0"), 2 * i + 1, 2) for i in reversed(range(n))])
    w, h = F.col("w"), F.col("h")
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFFFC4000401FF"), F.lit("FFC0001108"), big(h), big(w), F.lit("03"))
    riff = lambda form: F.concat(F.lit(f"524946460000000057454250{form}00000000"))
    forms = F.array(
        jpeg, F.concat(riff("56503858"), F.lit("00000000"), little(w - 1, 3), little(h - 1, 3)), F.concat(riff("56503820"), F.lit("0000009D012A"), little(w, 2), little(h, 2)),
        F.concat(riff("5650384C"), F.lit("2F"), little((w - 1) + F.shiftleft((h - 1).cast("bigint"), 14), 4)), F.lit("000000186674797069736F6D"))
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".webp", ".webp", ".webp", ".mp4"))), (F.col("k") + 1).cast("int"))
    files = docs.select(F.concat(F.lit("up/"), F.col("doc_id").cast("string"), ext).alias("path"), F.concat(F.unhex(F.element_at(forms, (F.col("k") + 1).cast("int"))), F.col("text").cast("binary")).alias("content"), "h", "k")
    clips = files.filter("k = 4").select("path", F.col("h").alias("seconds"))
    return fl.intake_screen(files.select("path", "content", F.octet_length("content").alias("length")), clips).select("path", "reject_code")


@query("a15_url_policy_screen", f"""SELECT page_id, CASE page_id % 30 WHEN 0 THEN 'insecure scheme' WHEN 1 THEN 'streaming platform' WHEN 2 THEN 'streaming platform' WHEN 3 THEN 'unsupported scheme' WHEN 4 THEN 'loopback address' WHEN 5 THEN 'private address' WHEN 6 THEN 'private address' WHEN 7 THEN 'link-local address' WHEN 8 THEN 'loopback address' WHEN 9 THEN 'ok' WHEN 10 THEN 'missing or too long' WHEN 12 THEN 'loopback address' WHEN 13 THEN 'private address' WHEN 14 THEN 'loopback address' WHEN 15 THEN 'reserved address' WHEN 16 THEN 'loopback address' WHEN 17 THEN 'link-local address' WHEN 18 THEN 'ok' WHEN 19 THEN 'private address' WHEN 20 THEN 'private address' WHEN 21 THEN 'no host' WHEN 22 THEN 'loopback address' WHEN 23 THEN 'loopback address' WHEN 24 THEN 'loopback address' WHEN 25 THEN 'loopback address' WHEN 26 THEN 'loopback address' WHEN 27 THEN 'private address' WHEN 28 THEN 'ok' WHEN 29 THEN 'private address'
  ELSE CASE WHEN url LIKE 'https://%' THEN 'ok' WHEN url LIKE 'http://%' THEN 'insecure scheme' ELSE 'unsupported scheme' END END AS policy FROM ({_URLS})""")
def _(spark, sf):
    pages = spark.sql(_URLS.replace("FROM pages", "FROM {p}"), p=table(spark, sf, "pages"))
    return pages.select("page_id", tx.url_policy(F.col("url")).alias("policy"))


@query("a16_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return fl.content_hash(docs).withColumnRenamed("path", "doc_id")


@query("a16_hash_issues", "SELECT doc_id AS source_path FROM documents WHERE doc_id % 6 = 0")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    manifest = docs.select(F.col("doc_id").alias("source_path"), F.when(F.col("doc_id") % 6 == 0, "bad").when(F.col("doc_id") % 6 == 1, "").otherwise(F.sha2("text", 256)).alias("sha256"))
    return fl.hash_issues(manifest, docs.select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))).select("source_path")


@query("a17_crop_index_to_groups", """SELECT concat('crops/', CAST(doc_id AS VARCHAR), '.png') AS path, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN concat('clip', CAST(doc_id % 20 AS VARCHAR)) ELSE CAST(doc_id AS VARCHAR) END AS group_id FROM documents WHERE doc_id % 5 <> 0""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("crops/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path")
    original = F.when(F.col("doc_id") % 6 == 0, "nan").otherwise(F.concat(F.lit("clip"), (F.col("doc_id") % 20).cast("string"), F.lit(".mp4")))
    index = docs.select(path, F.when(F.col("doc_id") % 2 == 0, "FAKE").otherwise("REAL").alias("label"), original.alias("original"))
    return fl.crop_index_to_groups(index, docs.filter("doc_id % 5 <> 0").select(path)).select("path", "group_id")


def _snapshots(spark, sf):
    events = table(spark, sf, "events")
    old = events.select("event_id", F.to_json(F.struct(F.struct(F.col("event_type").alias("kind"), F.col("value").alias("score")).alias("r"), F.col("user_id").alias("uploadId"), F.array(F.col("user_id") % 3, F.lit(1)).alias("list"))).alias("props"))
    changed = F.when(F.col("event_id") % 5 == 0, F.lit("other")).otherwise(F.col("event_type"))
    new = events.select("event_id", F.to_json(F.struct(F.struct(changed.alias("kind"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("score"), F.when(F.col("event_id") % 11 == 0, F.lit(True)).alias("extra")).alias("r"), (F.col("user_id") + 1).alias("uploadId"), F.array(F.col("user_id") % 3, F.lit(1)).alias("list"))).alias("props"))
    return old, new


@query("c12_snapshot_diff", """SELECT event_id, '.r.kind' AS path, '~' AS op FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, '.r.score', '-' FROM events WHERE event_id % 7 = 0 AND value IS NOT NULL UNION ALL SELECT event_id, '.r.extra', '+' FROM events WHERE event_id % 11 = 0""")
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    return fl.snapshot_diff(fl.flatten_json(old, "event_id", "props"), fl.flatten_json(new, "event_id", "props"), "event_id").select("event_id", "path", "op")


@query("h9_model_version", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'v4.1' WHEN doc_id % 3 = 1 THEN 'V3-Max' ELSE 'unversioned' END AS version FROM documents")
def _(spark, sf):
    given = F.when(F.col("doc_id") % 3 == 0, "v4.1").when(F.col("doc_id") % 2 == 0, "")
    trained = F.when(F.col("doc_id") % 3 == 1, "V3-Max multi: faces").when(F.col("doc_id") % 2 == 0, "generic mix: all")
    return table(spark, sf, "documents").select("doc_id", tx.model_version(given, trained).alias("version"))


@query("h12_safe_log_text", r"SELECT doc_id, replace(replace(replace(text, chr(13), '\r'), chr(10), '\n'), chr(9), '\t')[1:500] AS line FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.safe_log_text(F.col("text")).alias("line"))


@query("h13_safe_name", "SELECT doc_id, coalesce(nullif(regexp_replace(CASE WHEN doc_id % 9 = 0 THEN '' ELSE text[1:90] END, '[^\\p{L}\\p{N}\\-_.]', '_', 'g')[1:80], ''), 'ungrouped') AS name FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.safe_name(F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.substring("text", 1, 90))).alias("name"))


@query("j2_inventory_hooks", "SELECT concat('r/', lang, '/', CAST(doc_id AS VARCHAR), '.jpg') AS path, CASE WHEN lang = 'en' THEN 'real' ELSE 'fake' END AS label, CAST(doc_id AS VARCHAR) AS grp, NULL AS method, NULL AS compression, NULL AS subject FROM documents")
def _(spark, sf):
    paths = table(spark, sf, "documents").select(F.concat(F.lit("r/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    return apply_hooks(paths, {"label": lambda p: F.when(p.contains("/en/"), "real").otherwise("fake"), "grp": stem_of})


@query("j3_score_batch", "SELECT doc_id, CASE WHEN n_chars % 10 = 3 THEN NULL ELSE (n_chars % 100) / 100e0 END AS p_fake, CASE WHEN n_chars % 10 = 3 THEN 'ValueError' END AS error FROM documents")
def _(spark, sf):
    def load():
        def scorer(values):
            if any(x % 10 == 3 for x in values):
                raise ValueError("unreadable")
            return [x % 100 / 100 for x in values]
        return scorer

    return score_batch(table(spark, sf, "documents").select("doc_id", "n_chars"), load, "doc_id", "n_chars")


@query("a18_report_json", f"SELECT label, source, count(*) AS n, avg(p_fake) AS mean_p FROM ({duck('pred')}) GROUP BY label, source", ("mean_p",))
def _(spark, sf):
    """The report is written as JSON to the shared folder and read again."""
    report = view(spark, sf, "pred").groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("p_fake").alias("mean_p"))
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    fl.report_json(report, path)
    return spark.read.schema("label string, source string, n bigint, mean_p double").json(path)


@query("a18_report_rows", f"SELECT label, count(*) AS n FROM ({duck('pred')}) GROUP BY label")
def _(spark, sf):
    return view(spark, sf, "pred").groupBy("label").agg(F.count(F.lit(1)).alias("n"))

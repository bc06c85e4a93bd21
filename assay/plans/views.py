"""Input views over the star-schema tables: the same rows in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from assay.session import ship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: What the two dialects spell differently.
DIALECT = {
    "spark": {
        "sha": "sha2(d.text, 256)",
        "us": "unix_micros(CAST(ts AS TIMESTAMP))",
        "signs": "concat_ws('', transform(embedding, x -> CASE WHEN x > 0 THEN '1' ELSE '0' END))",
    },
    "duck": {
        "sha": "sha256(d.text)",
        "us": "epoch_us(ts)",
        "signs": "array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')",
    },
}

VIEWS = {
    "pred": """SELECT concat('doc/', CAST(d.doc_id AS STRING)) AS path, d.source AS source,
  CASE WHEN l.toxic = 1 THEN 'fake' ELSE 'real' END AS label, l.toxic AS y_true,
  CAST(30 * l.toxic + (d.doc_id * 7919) % 71 AS DOUBLE) / CAST(100 AS DOUBLE) AS p_fake,
  concat(d.source, ':', CAST(d.doc_id % 37 AS STRING)) AS group_id
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "pred_big": """SELECT concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS path,
  l_linestatus AS source, CASE WHEN l_returnflag = 'R' THEN 'fake' ELSE 'real' END AS label,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
  CAST((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p_fake,
  l_orderkey AS group_id
FROM lineitem""",
    "manifest": """SELECT concat('d', CAST(d.doc_id AS STRING)) AS sample_id, d.doc_id AS ord, d.lang AS dataset,
  d.source AS group_id, {sha} AS sha256,
  CASE WHEN l.quality = 1 THEN 'real' WHEN l.quality = 0 THEN 'Deepfakes' ELSE 'mystery' END AS original_label,
  CASE WHEN l.quality = 0 THEN 'deepfakes' ELSE '' END AS manipulation_method,
  CASE WHEN d.n_chars % 3 = 0 THEN 'jpeg' ELSE 'unknown' END AS compression,
  CAST(d.n_chars % 4 AS INT) AS face_count,
  CASE WHEN l.quality IS NULL THEN 'REJECTED' ELSE 'ACCEPTED' END AS status,
  CASE WHEN l.quality IS NULL THEN 'INVALID_LABEL' ELSE '' END AS rejection_reason
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "hash": "SELECT vec_id AS sample_id, label AS group_id, {signs} AS signs FROM embeddings",
    "edges": """SELECT DISTINCT concat('p', CAST(l_partkey AS STRING)) AS a, concat('s', CAST(l_suppkey AS STRING)) AS b
FROM lineitem""",
    "frames": """SELECT user_id AS video_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
  CAST({us} AS DOUBLE) / CAST(1000000 AS DOUBLE) AS t, least(CAST(1 AS DOUBLE), value / CAST(250 AS DOUBLE)) AS p_fake,
  CAST(event_id % 4 AS INT) AS faces_found,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(10 + event_id % 400 AS DOUBLE) END AS box_x,
  CAST(20 + event_id % 300 AS DOUBLE) AS box_y, CAST(64 + event_id % 50 AS DOUBLE) AS box_w,
  CAST(64 + event_id % 40 AS DOUBLE) AS box_h, CAST(640 AS DOUBLE) AS frame_w, CAST(480 AS DOUBLE) AS frame_h
FROM events""",
    "faces": """SELECT l_orderkey AS image_id, l_linenumber AS face_id, l_extendedprice AS area,
  CAST((l_partkey * 31 + l_suppkey) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS p_fake
FROM lineitem""",
    "scans": """SELECT concat('SCAN-', CAST(event_id AS STRING)) AS scan_id, ts AS at, user_id,
  CASE WHEN user_id % 2 = 0 THEN 'image' ELSE 'video' END AS file_type,
  concat('file_', event_type, CASE WHEN user_id % 2 = 0 THEN '.JPG' ELSE '.mp4' END) AS file_name,
  CASE WHEN value > 60 THEN 'deepfake' ELSE 'real' END AS prediction,
  CAST(50 + event_id % 51 AS INT) AS confidence, CAST(floor(value * 10) AS INT) AS latency_ms,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 5 <> 0 END AS face_found
FROM events""",
    "feedback": """SELECT concat('SCAN-', CAST(event_id AS STRING)) AS scan_id, ts + INTERVAL '10' MINUTE AS at,
  event_type <> 'error' AS agree, CASE WHEN value > 60 THEN 'deepfake' ELSE 'real' END AS prediction,
  CAST(50 + event_id % 51 AS INT) AS confidence
FROM events WHERE event_id % 3 = 0""",
    "reviews": """SELECT event_id AS review_id, user_id, ts + INTERVAL '10' MINUTE AS at, event_type <> 'error' AS agree
FROM events WHERE event_id % 3 = 0""",
    "releases": """SELECT file_type, min(ts) AS at, concat('v', CAST(min(event_id) AS STRING)) AS version
FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'image' ELSE 'video' END AS file_type FROM events WHERE event_type = 'error')
GROUP BY file_type, date_trunc('day', ts)""",
    "bench": """SELECT concat('f/', CAST(o_orderkey AS STRING)) AS file,
  CASE WHEN o_orderkey % 3 = 0 THEN 'fake' ELSE 'real' END AS label,
  CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_custkey % 4 = 0 THEN 'deepfake' ELSE 'real' END AS prediction,
  CASE WHEN o_orderkey % 23 = 0 THEN '95.5' ELSE CAST(50 + o_custkey % 51 AS STRING) END AS confidence,
  o_custkey % 11 = 0 AS inconclusive, o_custkey % 11 <> 0 AS face_found,
  CASE WHEN o_orderkey % 19 = 0 THEN 'RuntimeError' ELSE '' END AS error,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice END AS latency_ms
FROM orders""",
    "bench_manifest": """SELECT concat('f/', CAST(o_orderkey AS STRING)) AS relative_path,
  CASE WHEN o_orderkey % 3 = 0 THEN 'fake' ELSE 'real' END AS label,
  CASE WHEN o_orderkey % 3 = 0 THEN 'dfdc' WHEN o_orderkey % 2 = 0 THEN 'real_phone' ELSE 'lfw' END AS source_dataset,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'none' WHEN o_orderkey % 2 = 0 THEN 'face_swap' ELSE 'stylegan' END AS manipulation_type
FROM orders WHERE o_orderkey % 10 <> 0""",
    "files": "SELECT concat('doc/', CAST(doc_id AS STRING)) AS relative_path, n_chars AS width FROM documents",
    "meta": """SELECT concat('doc/', CAST(doc_id AS STRING)) AS relative_path,
  CASE WHEN toxic = 1 THEN 'fake' ELSE 'real' END AS label, CASE WHEN quality = 1 THEN 'src' ELSE '' END AS provenance
FROM labels UNION ALL SELECT 'doc/missing', 'real', 'src'""",
    "urls": "SELECT page_id, url FROM pages",
    "json": "SELECT event_id, props FROM events",
    "spans": "SELECT l_returnflag AS case_name, l_orderkey AS run_id, l_linenumber AS stage, l_quantity AS seconds FROM lineitem",
}


def duck(name: str) -> str:
    """The view's text for DuckDB."""
    return VIEWS[name].format(**DIALECT["duck"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; its scans keep pruning and push-down."""
    ship(spark)
    text = VIEWS[name].format(**DIALECT["spark"])
    for t in TABLES:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})

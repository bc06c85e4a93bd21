"""Queries of laid-out tables, of the feedback source and of SQL texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.plans.catalog import SqlCatalog
from assay.plans.registry import query
from assay.plans.store_queries import feedback, scans
from assay.plans.views import duck, table, view
from assay.session import shared_dir
from assay.sources import feedback_source
from assay.sources.layout import bucketed_table, joined_in_place, orc_table
from assay.streaming import streams

S, FB = duck("scans"), duck("feedback")


@query("m9_bucketed_join", f"SELECT scan_id, s.user_id, s.prediction, f.agree FROM ({S}) s LEFT JOIN (SELECT scan_id, agree FROM ({FB})) f USING (scan_id)")
def _(spark, sf):
    """Scans and feedback as tables in buckets of scan_id, joined as they lie."""
    tag = uuid.uuid4().hex
    folder, buckets = f"{shared_dir(spark)}/tables-{tag}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucketed_table(scans(spark, sf).select("scan_id", "user_id", "prediction"), f"scans_{tag}", f"{folder}/scans", ["scan_id"], buckets)
    bucketed_table(feedback(spark, sf).select("scan_id", "agree"), f"feedback_{tag}", f"{folder}/feedback", ["scan_id"], buckets)
    return joined_in_place(spark, f"scans_{tag}", f"feedback_{tag}", ["scan_id"], "left")


@query("m9_orc_filtered", f"SELECT scan_id, user_id, latency_ms FROM ({S}) WHERE latency_ms > 900 AND user_id IS NOT NULL")
def _(spark, sf):
    """The slow scans, from ORC files sorted by latency."""
    slow = orc_table(scans(spark, sf).select("scan_id", "user_id", "latency_ms"), f"{shared_dir(spark)}/orc-{uuid.uuid4().hex}", ["latency_ms"], ["user_id"])
    return slow.filter("latency_ms > 900 AND user_id IS NOT NULL")


def _notes(spark, sf):
    return feedback(spark, sf).select("scan_id", "agree", F.when(F.length("scan_id") % 2 == 0, F.concat(F.lit('said "ok"\n'), "prediction")).alias("note"), F.unix_micros("at").cast("string").alias("at"))


_NOTES = f"""SELECT scan_id, agree, CASE WHEN length(scan_id) % 2 = 0 THEN 'said "ok"' || chr(10) || prediction END AS note, CAST(epoch_us("at") AS VARCHAR) AS "at" FROM ({FB})"""


@query("m10_feedback_source", _NOTES)
def _(spark, sf):
    """All feedback written and read through the data source."""
    feedback_source.register(spark)
    path = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    _notes(spark, sf).write.format("feedback_jsonl").mode("append").save(path)
    return spark.read.format("feedback_jsonl").option("split", 1 << 20).load(path)


@query("m10_feedback_stream", _NOTES)
def _(spark, sf):
    """The same through its stream, with offsets."""
    feedback_source.register(spark)
    path = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    _notes(spark, sf).write.format("feedback_jsonl").mode("append").save(f"{path}/lines")
    rows = spark.readStream.format("feedback_jsonl").load(f"{path}/lines")
    return streams.run_to_table(rows, f"{path}/out", f"{path}/checkpoint").drop("batch")


_SLOW = """SELECT s.scan_id, s.user_id FROM scans s
WHERE s.latency_ms > (SELECT avg(x.latency_ms) FROM scans x WHERE x.user_id = s.user_id) AND EXISTS (SELECT 1 FROM feedback f WHERE f.scan_id = s.scan_id AND NOT f.agree)"""


@query("m8_correlated_subqueries", f"WITH scans AS ({S}), feedback AS ({FB}) {_SLOW} AND s.prediction = 'deepfake'")
def _(spark, sf):
    """A SQL text with correlated subqueries and a parameter: disputed scans slower than their user's average."""
    catalog = SqlCatalog(spark, {"scans": scans(spark, sf), "feedback": view(spark, sf, "feedback")})
    return catalog.query(f"{_SLOW} AND s.prediction = :verdict", verdict="deepfake")


_CHAIN = """SELECT doc_id AS node, doc_id AS spot, 0 AS depth FROM documents
  UNION ALL SELECT c.node, d.parent, c.depth + 1 FROM chain c JOIN derived d ON c.spot = d.doc_id"""


@query("m8_derivation_chain", f"""WITH RECURSIVE derived AS (SELECT doc_id, doc_id // 3 AS parent FROM documents WHERE doc_id % 4 <> 0), chain(node, spot, depth) AS ({_CHAIN})
  SELECT node, max(depth) AS depth, arg_max(spot, depth) AS origin FROM chain GROUP BY node""")
def _(spark, sf):
    """How far each document is from the origin of its chain of derivations, by a recursive query."""
    documents = table(spark, sf, "documents").select("doc_id")
    catalog = SqlCatalog(spark, {"documents": documents, "derived": documents.filter("doc_id % 4 <> 0").select("doc_id", F.floor(F.col("doc_id") / 3).alias("parent"))})
    return catalog.query(f"WITH RECURSIVE chain(node, spot, depth) AS ({_CHAIN}) SELECT node, max(depth) AS depth, max_by(spot, depth) AS origin FROM chain GROUP BY node")

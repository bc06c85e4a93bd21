"""Queries of ranks of every row, mergeable states and lattices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.operators import ranks as rk
from assay.operators import sketches as sk
from assay.plans.registry import query
from assay.plans.store_queries import scans
from assay.plans.views import duck, view
from assay.session import shared_dir

S = duck("scans")
_W = "(PARTITION BY source ORDER BY p_fake)"


@query("m5_score_ranks", f"""SELECT path, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist,
  CAST(ntile(10) OVER (PARTITION BY source ORDER BY p_fake, l_orderkey * 10 + l_linenumber) AS INT) AS ntile FROM ({duck('pred_big').replace('FROM lineitem', ', l_orderkey, l_linenumber FROM lineitem')}) WINDOW w AS {_W}""", ("percent_rank", "cume_dist"))
def _(spark, sf):
    """Every prediction's place among the predictions of its source: three groups of many rows, many ties."""
    parts = F.split("path", "/")
    rows = view(spark, sf, "pred_big").withColumn("tie", F.get(parts, F.lit(0)).cast("long") * 10 + F.get(parts, F.lit(1)).cast("long"))
    return rk.with_ranks(rows, "p_fake", "tie", ["source"], 10).select("path", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")


@query("m5_latency_ranks", f"SELECT scan_id, row_number() OVER (ORDER BY latency_ms, CAST(scan_id[6:] AS BIGINT)) AS row_number, cume_dist() OVER (ORDER BY latency_ms) AS cume_dist FROM ({S})", ("cume_dist",))
def _(spark, sf):
    """All scans in one group."""
    rows = scans(spark, sf).withColumn("tie", F.expr("CAST(substring(scan_id, 6) AS BIGINT)"))
    return rk.with_ranks(rows, "latency_ms", "tie").select("scan_id", "row_number", "cume_dist")


_WEEK = """date_trunc('week', "at")"""


def _weeks(spark, sf):
    """States of days, written and read back, then merged to weeks."""
    path = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    days = sk.day_states(scans(spark, sf), ["file_type"], "user_id", "latency_ms")
    days.write.parquet(path)
    states = spark.read.schema(days.schema).parquet(path)
    return sk.merged(states, [F.date_trunc("week", "day").cast("date").alias("week"), "file_type"])


@query("m6_weekly_sketch_errors", f"""SELECT CAST({_WEEK} AS DATE) AS week, file_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close, true AS p95_close FROM ({S}) GROUP BY ALL""")
def _(spark, sf):
    """The error of merged states against exact results: distinct users within 5 %, quantiles within 2 % of ranks."""
    found = sk.estimates(_weeks(spark, sf), {"median": 0.5, "p95": 0.95})
    rows = scans(spark, sf).withColumn("week", F.date_trunc("week", "at").cast("date"))
    met = rows.join(found, ["week", "file_type"])
    below = lambda q: F.avg((F.col("latency_ms") < F.col(q)).cast("double"))
    upto = lambda q: F.avg((F.col("latency_ms") <= F.col(q)).cast("double"))
    exact = met.groupBy("week", "file_type").agg(
        F.first("n").alias("n"), F.countDistinct("user_id").alias("users"), F.first("distinct_members").alias("_e"),
        *[x for q in ("median", "p95") for x in (below(q).alias(f"_lo_{q}"), upto(q).alias(f"_hi_{q}"))])
    close = lambda q, at: (F.col(f"_lo_{q}") <= at + 0.02) & (F.col(f"_hi_{q}") >= at - 0.02)
    return exact.select("week", "file_type", "n", "users", (F.abs(F.col("_e") - F.col("users")) <= F.greatest(0.05 * F.col("users"), F.lit(1))).alias("users_close"), close("median", 0.5).alias("median_close"), close("p95", 0.95).alias("p95_close"))


@query("m6_frequent_files", f"""SELECT file_type, CAST(row_number() OVER (PARTITION BY file_type ORDER BY count(*) DESC, file_name) AS INT) AS rank, count(*) AS n FROM ({S}) GROUP BY file_type, file_name QUALIFY row_number() OVER (PARTITION BY file_type ORDER BY count(*) DESC, file_name) <= 3""")
def _(spark, sf):
    """The counts of the most frequent file names of each type, from states of days. Names are few, so counts are exact."""
    days = sk.frequent_states(scans(spark, sf), [F.to_date("at").alias("day"), "file_type"], "file_name")
    return sk.frequent_items(days, ["file_type"], 3).select("file_type", F.col("rank").cast("int").alias("rank"), "n")


_CELLS = f"SELECT file_type, prediction, face_found, CAST(grouping(file_type, prediction, face_found) AS INT) AS grouping, count(*) AS n, count(DISTINCT user_id) AS distinct_members, CAST(sum(latency_ms) AS BIGINT) AS latency FROM ({S}) GROUP BY "


@query("m7_cube_of_users", _CELLS + "CUBE (file_type, prediction, face_found)")
def _(spark, sf):
    """Exact distinct users, scans and latency for every combination of type, verdict and face, rolled up from bitmaps."""
    return sk.lattice(scans(spark, sf), ["file_type", "prediction", "face_found"], "user_id", {"latency": F.sum("latency_ms")})


@query("m7_rollup_of_users", _CELLS + "ROLLUP (file_type, prediction, face_found)")
def _(spark, sf):
    dims = ["file_type", "prediction", "face_found"]
    return sk.lattice(scans(spark, sf), dims, "user_id", {"latency": F.sum("latency_ms")}, [dims[:i] for i in range(4)])

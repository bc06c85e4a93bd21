"""The verdict and feedback store: privacy projections, links, summaries. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import extension
from assay.functions.verdicts import is_inconclusive_scan
from assay.operators.metrics import ratio
from assay.operators.ordering import first_of_each

# The longest text kept of each column.
TEXT_LIMITS = {"scan_id": 64, "file_type": 10, "prediction": 20, "certainty": 20, "risk": 10, "engine": 12, "model_version": 32, "runtime": 16}
NUMBERS = ("file_bytes", "confidence", "frames", "suspicious", "latency_ms")


def _have(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def privacy_projection(scans: DataFrame, enabled: bool = True) -> DataFrame:
    """Keep a verdict's shape only: the extension instead of the name, short texts, numbers; no media columns.

    Missing numbers are 0, a missing face count is -1 and a missing face flag NULL. Switched off, no row is kept.
    """
    text = {n: F.substring(F.coalesce(_have(scans, n, "string"), F.lit("")), 1, k).alias(n) for n, k in TEXT_LIMITS.items()}
    numbers = [F.coalesce(_have(scans, n, "bigint"), F.lit(0)).alias(n) for n in NUMBERS]
    at = [F.col("at")] if "at" in scans.columns else []
    out = scans.select(
        *at, *text.values(), extension(_have(scans, "file_name", "string")).alias("file_ext"), *numbers,
        F.coalesce(_have(scans, "faces", "int"), F.lit(-1)).alias("faces"), _have(scans, "face_found", "boolean").alias("face_found"),
    )
    return out if enabled else out.filter(F.lit(False))


def feedback_projection(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): agree must be a boolean text; note up to 280 characters, empty is NULL; id up to 40."""
    agree = F.lower(F.trim("agree")).isin("true", "false")
    kept = entries.filter(F.coalesce(agree, F.lit(False))).select(
        F.substring("scan_id", 1, 40).alias("scan_id"), (F.lower(F.trim("agree")) == "true").alias("agree"), F.nullif(F.substring("note", 1, 280), F.lit("")).alias("note"),
    )
    return kept, entries.filter(~F.coalesce(agree, F.lit(False)))


def verdict_feedback(scans: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each feedback with the verdict it is about."""
    f = feedback.select("scan_id", F.col("at").alias("feedback_at"), "agree")
    return scans.select("scan_id", F.col("at").alias("scan_at"), "prediction", "confidence").join(f, "scan_id")


def day_window(df: DataFrame, now: Column, days: int, at: str = "at") -> DataFrame:
    return df.filter(F.col(at) > now - F.make_interval(days=F.lit(days)))


def analytics_summary(scans: DataFrame, feedback: DataFrame, now: Column, days: int) -> DataFrame:
    """Long table (section, key, value) of the window: counts, rate, predictions, file types, latency."""
    s, f = day_window(scans, now, days), day_window(feedback, now, days)
    row = lambda section, key, value: F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), value.cast("double").alias("value"))
    n_s = s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 0).alias("mean"), F.max("latency_ms").alias("max"))
    n_f = f.agg(F.count(F.lit(1)).alias("nf"), F.sum(F.when(~F.col("agree"), 1).otherwise(0)).alias("nd"))
    totals = n_s.crossJoin(n_f).select(F.explode(F.array(
        row("counts", "analyses", F.col("n")), row("counts", "feedback", F.col("nf")), row("counts", "disagreements", F.coalesce("nd", F.lit(0))),
        row("counts", "disagreement_rate", F.round(ratio(F.col("nd"), F.col("nf")), 4)), row("latency_ms", "mean", F.coalesce("mean", F.lit(0))), row("latency_ms", "max", F.coalesce("max", F.lit(0))),
    )).alias("x")).select("x.*").filter("NOT (key = 'disagreement_rate' AND value IS NULL)")
    per = lambda c: s.groupBy(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?")).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(f"by_{c}").alias("section"), "key", "value")
    return totals.unionByName(per("prediction")).unionByName(per("file_type"))


def recent_disagreements(feedback: DataFrame, k: int = 20) -> DataFrame:
    """Newest first and not restricted to any window."""
    return feedback.filter("agree = false").orderBy(F.desc("at"), F.desc("scan_id")).limit(k)


def history_cap(scans: DataFrame, k: int = 50) -> DataFrame:
    """The newest k scans of each user."""
    return first_of_each(scans, ["user_id"], [F.desc("at"), F.desc("scan_id")], k, "place")


def dashboard_stats(history: DataFrame) -> DataFrame:
    """Per user: total; fakes, reals and mean confidence of conclusive scans; share of agreeing feedback."""
    sure = ~is_inconclusive_scan(F.col("face_found"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return history.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), n(sure & (F.col("prediction") == "deepfake")).alias("fake"), n(sure & (F.col("prediction") == "real")).alias("real"),
        F.avg(F.when(sure, F.col("confidence"))).alias("avg_confidence"), F.avg(F.col("agree").cast("int")).alias("user_accuracy"),
    )


def abandoned_uploads(uploads: DataFrame, analyses: DataFrame, ttl: str = "30 minutes") -> DataFrame:
    """The batch twin of the stream: uploads no analysis took up before their time to live ran out."""
    a = analyses.select(F.col("upload_id").alias("_id"), F.col("at").alias("_at"))
    taken = (F.col("upload_id") == F.col("_id")) & (F.col("_at") >= F.col("at")) & (F.col("_at") <= F.col("at") + F.expr(f"INTERVAL {ttl}"))
    return uploads.join(a, taken, "left_anti")

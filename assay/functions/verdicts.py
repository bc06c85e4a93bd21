"""Column rules of verdicts: risk, certainty, confidence, inconclusive rows, failure categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.operators.metrics import BANDS, confidence


def risk_for(prediction: Column, conf: Column) -> Column:
    return (
        F.when((prediction == "deepfake") & (conf >= 85), "High")
        .when((prediction == "real") & (conf >= 80), "Low")
        .otherwise("Medium")
    )


def certainty_for(conf: Column) -> Column:
    """The key of the highest band whose lower bound is reached; the last band below all."""
    key = F.lit(BANDS[-1][0])
    for name, lower in sorted(BANDS, key=lambda b: b[1]):
        key = F.when(conf >= lower, F.lit(name)).otherwise(key)
    return key


def certainty_bands(spark: SparkSession) -> DataFrame:
    """The bands as contiguous [from, to) ranges; the top edge is 100."""
    bands = spark.createDataFrame(list(BANDS), "band string, lower int")
    upper = F.lag("lower").over(Window.orderBy(F.desc("lower")))
    return bands.select("band", F.col("lower").alias("from"), F.coalesce(upper, F.lit(100)).alias("to"))


def verdict(p: Column, any_face: Column | None = None) -> dict[str, Column]:
    """prediction, confidence and insufficient_evidence of a score; without any face: real, 50, insufficient."""
    has = F.lit(True) if any_face is None else F.coalesce(any_face, F.lit(False))
    return {
        "prediction": F.when(has & (p >= 0.5), "deepfake").otherwise("real"),
        "confidence": F.when(has, confidence(p)).otherwise(50).cast("int"),
        "insufficient_evidence": ~has,
    }


def is_inconclusive(insufficient: Column, face_found: Column) -> Column:
    """The benchmark's rule: the flag, or no face; a missing face flag counts as no face."""
    return F.coalesce(insufficient, F.lit(False)) | ~F.coalesce(face_found, F.lit(False))


def is_inconclusive_scan(face_found: Column) -> Column:
    """The dashboard's rule: only an explicit false."""
    return F.coalesce(~face_found, F.lit(False))


def truthy(x: Column, also_on: bool = False) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin(["1", "true", "yes", *(["on"] if also_on else [])]), F.lit(False))


def int_or_null(x: Column) -> Column:
    """The integer a text spells; decimals do not count."""
    return F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(x).try_cast("bigint"))


def mmss(seconds: Column) -> Column:
    """Half-even rounded, not below zero, minutes unbounded."""
    s = F.greatest(F.bround(seconds.cast("double"), 0), F.lit(0.0)).cast("bigint")
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), F.greatest(F.length(F.floor(s / 60).cast("string")), F.lit(2)), F.lit("0")), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))

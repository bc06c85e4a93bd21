"""Benchmark tables: predictions joined to a provenance manifest, rates, latency, failures, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.verdicts import int_or_null, is_inconclusive
from assay.operators.metrics import long_rows, ratio
from assay.operators.percentiles import with_percentiles
from assay.session import cut

#: The manipulation types that count as face swaps.
FACE_SWAP_TYPES = ("face_swap", "face-swap", "deepfakes", "faceswap", "faceshifter", "celeb-synthesis", "dfdc")
#: Names of the longest side's ranges.
LARGEST_SIDE, SIDES = "1024px_or_larger", ((1024, "512_to_1023px"), (512, "256_to_511px"), (256, "128_to_255px"), (128, "under_128px"))
#: Failure categories.
CATEGORIES = ("false_positive", "false_negative", "high_confidence_wrong", "low_confidence", "no_face")


def join_manifest(preds: DataFrame, manifest: DataFrame, order: Column) -> DataFrame:
    """Left join on file = relative_path. Manifest columns replace prediction columns of the same name; of repeated
    manifest keys the last by `order` counts. `matched` marks the rows that found one."""
    columns = [c for c in manifest.columns if c != "relative_path"]
    last = manifest.groupBy("relative_path").agg(F.max_by(F.struct(*columns), order).alias("_m"))
    joined = preds.join(last, F.col("file") == F.col("relative_path"), "left")
    found = F.col("_m").isNotNull()
    own = [F.coalesce(F.col(f"_m.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in preds.columns]
    return joined.select(*own, *[F.col(f"_m.{c}").alias(c) for c in columns if c not in preds.columns], found.alias("matched"))


def errors_of(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def build_manifest(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Full outer join on relative_path: status, errors. A file without metadata needs review; metadata without a file is an error."""
    f = files.withColumn("_f", F.lit(True))
    m = metadata.withColumn("_m", F.lit(True))
    both = f.join(m, "relative_path", "full_outer")
    label = F.col("_m").isNotNull() & ~F.coalesce(F.col("label").isin("real", "fake"), F.lit(False))
    errors = errors_of(
        ("missing metadata", F.col("_m").isNull()),
        ("missing file", F.col("_f").isNull()),
        ("invalid label", label),
        ("missing provenance", F.col("_m").isNotNull() & (F.coalesce(F.col("provenance"), F.lit("")) == "")),
    )
    status = F.when(F.col("_f").isNull() | label, "error").when(F.size(errors) > 0, "needs_review").otherwise("ok")
    return both.select("relative_path", "label", "provenance", status.alias("status"), F.array_join(errors, " | ").alias("validation_errors"))


def safe_relative_path(p: Column) -> tuple[Column, Column]:
    """(collapsed posix path, error): absolute paths, drive letters and `..` parts are refused."""
    x = F.translate(F.trim(p), "\\", "/")
    error = F.when(F.coalesce(x, F.lit("")) == "", "missing path").when(x.startswith("/") | x.rlike("^[A-Za-z]:"), "absolute path").when(
        F.array_contains(F.split(x, "/"), ".."), "parent reference"
    )
    parts = F.filter(F.split(x, "/"), lambda s: ~s.isin("", "."))
    return F.when(error.isNull(), F.array_join(parts, "/")), error


#: Shared ids that a report shows.
SHOWN = 20


def metadata_index(rows: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(index, errors): the first row of each safe path, and an error with its line for every other row."""
    path, error = safe_relative_path(F.col("relative_path"))
    checked = rows.withColumn("_path", path).withColumn("error", error)
    good = checked.filter("error IS NULL").withColumn("_n", F.row_number().over(Window.partitionBy("_path").orderBy(line)))
    index = good.filter("_n = 1").withColumn("relative_path", F.col("_path")).drop("_path", "_n", "error")
    repeated = good.filter("_n > 1").select(F.col(line), F.col("_path").alias("relative_path"), F.lit("duplicate path").alias("error"))
    return index, checked.filter("error IS NOT NULL").select(line, "relative_path", "error").unionByName(repeated)


def identity_overlap(evaluated: DataFrame, trained: DataFrame, column: str = "identity_id") -> DataFrame:
    """Three-valued status, the number of shared ids and the first SHOWN of them in order."""
    ids = lambda df: df.select(F.col(column).cast("string").alias("id")).filter("coalesce(id, '') <> ''").distinct()
    a, b = ids(evaluated), ids(trained)
    both = a.join(b, "id", "left_semi")
    shown = both.orderBy("id").limit(SHOWN).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    shared = both.agg(F.count(F.lit(1)).alias("n_shared")).crossJoin(shown)
    sizes = a.agg(F.count(F.lit(1)).alias("na")).crossJoin(b.agg(F.count(F.lit(1)).alias("nb")))
    status = F.when((F.col("na") == 0) | (F.col("nb") == 0), "cannot_verify").when(F.size("ids") > 0, "overlap").otherwise("no_overlap")
    return sizes.crossJoin(shared).select(status.alias("status"), F.col("na").alias("n_eval"), F.col("nb").alias("n_train"), "n_shared", F.array_join("ids", ",").alias("shared"))


def resolution_bucket(w: Column, h: Column) -> Column:
    side = F.greatest(w.try_cast("double"), h.try_cast("double"))
    known = w.try_cast("double").isNotNull() & h.try_cast("double").isNotNull() & (side > 0)
    bucket = F.lit(LARGEST_SIDE)
    for top, name in SIDES:
        bucket = F.when(side < top, name).otherwise(bucket)
    return F.when(known, bucket).otherwise("unknown")


def _wrong(label: Column, prediction: Column) -> tuple[Column, Column]:
    return (label == "real") & (prediction == "deepfake"), (label == "fake") & (prediction == "real")


def failure_ledger(joined: DataFrame, high: int = 90, low: int = 70) -> DataFrame:
    """One row for each failure category of each prediction. Wrong calls need a label from the manifest."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    conf = int_or_null(F.col("confidence"))
    known = F.when(F.col("matched"), F.col("label")).otherwise("")
    fp, fn = _wrong(known, F.col("prediction"))
    kinds = errors_of(
        ("no_face", ~failed & is_inconclusive(F.col("inconclusive"), F.col("face_found"))),
        ("false_positive", fp), ("false_negative", fn),
        ("high_confidence_wrong", (fp | fn) & (conf >= high)),
        ("low_confidence", conf <= low),
    )
    return joined.select(F.explode(kinds).alias("category"), "file", known.alias("true_label"), F.col("prediction").alias("predicted_label"),
                         conf.alias("confidence"), "source_dataset", "manipulation_type", "latency_ms")


def failure_counts(ledger: DataFrame) -> DataFrame:
    """Counts of all categories, zeros included."""
    names = ledger.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = ledger.groupBy("category").agg(F.count(F.lit(1)).alias("c"))
    return names.join(F.broadcast(counts), "category", "left").select("category", F.coalesce("c", F.lit(0)).alias("n"))


def _flag(x: Column) -> Column:
    return F.sum(F.when(x, 1).otherwise(0))


def tally_columns(all_rows: bool) -> list[Column]:
    """Counts of a benchmark table; inconclusive among successful rows, or among all rows."""
    bad = F.coalesce(F.col("error"), F.lit("")) != ""
    unsure = F.coalesce(F.col("inconclusive"), F.lit(False))
    used = ~bad & ~unsure
    real, fake = F.col("label") == "real", F.col("label") == "fake"
    called = F.col("prediction") == "deepfake"
    return [
        F.count(F.lit(1)).alias("samples"), _flag(~bad).alias("successful"), _flag(bad).alias("errors"),
        _flag(unsure if all_rows else unsure & ~bad).alias("inconclusive"), _flag(used).alias("evaluated"),
        _flag(used & fake & called).alias("tp"), _flag(used & real & called).alias("fp"),
        _flag(used & real & ~called).alias("tn"), _flag(used & fake & ~called).alias("fn"),
    ]


LATENCY = {"median_ms": ("cont", 0.5), "p95_ms": ("disc", 0.95)}


def tally_rates(df: DataFrame) -> DataFrame:
    """Rates of the conclusive rows; F1 is NULL where precision + recall is 0."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    df = df.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp),
    })
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", F.when(p + r != 0, 2 * p * r / (p + r)))


def benchmark_metrics(rows: DataFrame) -> DataFrame:
    return tally_rates(rows.agg(*tally_columns(all_rows=False)))


def latency_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return with_percentiles(rows.groupBy(*(by or [])).agg(F.avg("latency_ms").alias("mean_ms")), rows, "latency_ms", LATENCY, by)


def subgroup_report(joined: DataFrame) -> DataFrame:
    """Rates and latency of six overlapping groups; here errors and inconclusive rows count over all rows."""
    kind = F.lower(F.trim(F.coalesce(F.col("manipulation_type"), F.lit(""))))
    fake, swap = F.col("label") == "fake", kind.isin(*FACE_SWAP_TYPES)
    names = errors_of(
        ("all_samples", F.lit(True)), ("real_samples", F.col("label") == "real"), ("fake_samples", fake),
        ("face_swap_samples", fake & swap), ("other_manipulation_samples", fake & ~swap),
        ("real_phone_photo_samples", (F.col("label") == "real") & (F.lower(F.trim("source_dataset")) == "real_phone")),
    )
    # rows are counted by their set of groups and latency once, before a row goes to each of its groups
    counted = cut(joined.groupBy(names.alias("subgroups"), "latency_ms").agg(*tally_columns(all_rows=True)))
    counts = [c for c in counted.columns if c not in ("subgroups", "latency_ms")]
    member = counted.withColumn("subgroup", F.explode("subgroups"))
    timed = F.when(F.col("latency_ms").isNotNull(), F.col("samples"))
    mean = F.sum(F.col("latency_ms") * timed) / F.sum(timed)
    tallies = member.groupBy("subgroup").agg(*[F.sum(c).alias(c) for c in counts], mean.alias("mean_ms"))
    return tally_rates(with_percentiles(tallies, member, "latency_ms", LATENCY, ["subgroup"], "samples"))


def quality_report(manifest: DataFrame) -> DataFrame:
    """Long table (section, key, n): totals, distributions and numbers of rows with each issue."""
    issues = errors_of(
        ("invalid_label", ~F.coalesce(F.col("label").isin("real", "fake"), F.lit(False))),
        ("missing_provenance", F.coalesce(F.col("provenance"), F.lit("")) == ""),
        ("unknown_resolution", F.col("resolution") == "unknown"),
    )
    with_issues = manifest.withColumn("issues", issues)
    dims = {"label": F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("(none)")), "resolution": F.col("resolution")}
    count = F.count(F.lit(1)).alias("n")
    parts = [with_issues.agg(count, _flag(F.size("issues") > 0).alias("problems"))]
    totals = parts[0].select(F.explode(F.array(F.struct(F.lit("total").alias("k"), "n"), F.struct(F.lit("problems").alias("k"), F.col("problems").alias("n")))).alias("x")).select(F.lit("totals").alias("section"), F.col("x.k").alias("key"), F.col("x.n").cast("long").alias("n"))
    out = [totals] + [with_issues.groupBy(c.alias("key")).agg(count).select(F.lit(name).alias("section"), "key", "n") for name, c in dims.items()]
    out.append(with_issues.select(F.explode("issues").alias("key")).groupBy("key").agg(count).select(F.lit("issue").alias("section"), "key", "n"))
    return reduce(DataFrame.unionByName, out)


def visual_duplicate_sets(rows: DataFrame, visual: str = "dhash", digest: str = "sha256") -> DataFrame:
    """Groups of one visual hash with at least two different digests."""
    return rows.groupBy(visual).agg(F.countDistinct(digest).alias("n_digests"), F.count(F.lit(1)).alias("n")).filter("n_digests > 1")


def benchmark_report(rows: DataFrame, joined: DataFrame, protocol: dict[str, str]) -> DataFrame:
    """Metrics, latency, subgroups and failures as one long table (section, key, metric, value)."""
    metrics = ["samples", "successful", "errors", "inconclusive", "evaluated", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "fpr", "fnr"]
    latency = ["mean_ms", "median_ms", "p95_ms"]
    parts = [
        long_rows(benchmark_metrics(rows), "metrics", F.lit("all"), metrics),
        long_rows(latency_summary(rows), "latency", F.lit("all"), latency),
        long_rows(subgroup_report(joined), "subgroup", F.col("subgroup"), [*metrics, *latency]),
        long_rows(failure_counts(failure_ledger(joined)), "failures", F.col("category"), ["n"]),
    ]
    parts += [rows.sparkSession.range(1).select(F.lit("protocol").alias("section"), F.lit(k).alias("key"), F.lit(v).alias("metric"), F.lit(None).cast("double").alias("value")) for k, v in protocol.items()]
    return reduce(DataFrame.unionByName, parts)

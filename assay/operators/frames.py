"""Frame and face sequences: aggregation, verdicts, votes, temporal signals, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.verdicts import mmss, verdict
from assay.operators.metrics import ratio
from assay.operators.ordering import first_of_each
from assay.operators.percentiles import percentiles

# How a clip's score is made.
WEIGHTS = {"median": 0.40, "mean": 0.25, "top_k": 0.35}
TOP_FRACTION, SUSPICIOUS, MAX_FRAMES = 0.15, 0.70, 60
OWN_WEIGHT, OVERRULE = 0.75, 0.85
MAX_FACES = 6
# What each landmark's neighbourhood is called.
REGIONS = {
    "right_eye": "the eye region", "left_eye": "the eye region", "nose": "the nose area",
    "mouth_right": "the mouth area", "mouth_left": "the mouth area",
}
CENTRAL = "the central face region"


def clean_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """Known names only, not negative, summing to one; the median alone if nothing is left."""
    kept = {k: max(0.0, float((weights or WEIGHTS).get(k, 0.0))) for k in WEIGHTS}
    total = sum(kept.values())
    return {k: v / total for k, v in kept.items()} if total > 0 else {"median": 1.0, "mean": 0.0, "top_k": 0.0}


def frame_aggregates(p: Column, rank: Column, n: Column, weights: dict[str, float] | None = None, fraction: float = TOP_FRACTION, suspicious: float = SUSPICIOUS) -> list[Column]:
    """The clip aggregate as columns for any groupBy: p clamped, rank by falling p from 1, n rows in the group.

    All are plain sums over ranked rows, so a clip of any length needs no array.
    """
    w = clean_weights(weights)
    k = F.least(n, F.greatest(F.lit(1), F.bround(F.greatest(F.lit(fraction), 1 / n) * n, 0).cast("int")))
    middle = (rank == F.floor((n + 1) / 2)) | (rank == F.ceil((n + 1) / 2))
    median, mean, top = F.avg(F.when(middle, p)), F.avg(p), F.avg(F.when(rank <= k, p))
    return [
        F.count(F.lit(1)).alias("frames"), F.max(k).alias("k"), median.alias("median"), mean.alias("mean"), top.alias("top_k"),
        (median * w["median"] + mean * w["mean"] + top * w["top_k"]).alias("score"),
        F.sum((p >= suspicious).cast("int")).alias("suspicious"), F.max(p).alias("peak"), F.min(p).alias("lowest"), F.var_pop(p).alias("variance"),
    ]


def ranked_frames(frames: DataFrame, by: list[str]) -> DataFrame:
    clamped = frames.filter("p_fake IS NOT NULL").withColumn("p_fake", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p_fake"))))
    part = Window.partitionBy(*by)
    return clamped.withColumn("_n", F.count(F.lit(1)).over(part).cast("int")).withColumn("_rank", F.row_number().over(part.orderBy(F.desc("p_fake"))))


def frame_aggregate(frames: DataFrame, by: list[str] | None = None, **opts) -> DataFrame:
    """One row for each clip; a clip without scores gives no row."""
    by = by or ["video_id"]
    return ranked_frames(frames, by).groupBy(*by).agg(*frame_aggregates(F.col("p_fake"), F.col("_rank"), F.col("_n"), **opts))


def clip_verdict(frames: DataFrame) -> DataFrame:
    """Aggregate and verdict of each clip: a frame without a face counts 0.5, a clip without any is not judged."""
    seen = F.coalesce(F.col("faces_found"), F.lit(0))
    scored = frames.withColumn("p_fake", F.when(seen > 0, F.col("p_fake")).otherwise(0.5))
    clips = ranked_frames(scored, ["video_id"]).groupBy("video_id").agg(
        *frame_aggregates(F.col("p_fake"), F.col("_rank"), F.col("_n")), F.max(seen).alias("faces"), F.bool_or(seen > 0).alias("face_found")
    )
    clips = clips.withColumn("score", F.when(F.col("face_found"), F.col("score")).otherwise(0.5))
    return clips.withColumns(verdict(F.col("score"), F.col("face_found")))


def image_verdict(faces: DataFrame) -> DataFrame:
    """The highest face score of each image, with the face that has it (of equals the first, then the largest)."""
    best = F.max_by(F.struct("face_id", "area"), F.struct(F.col("p_fake"), -F.col("face_id"), F.col("area")))
    per = faces.groupBy("image_id").agg(F.max("p_fake").alias("score"), best.alias("b"), F.count(F.lit(1)).alias("faces"))
    return per.select("image_id", "score", "faces", F.col("b.face_id").alias("face_id"), F.col("b.area").alias("area"))


def face_limit(faces: DataFrame, k: int = MAX_FACES) -> DataFrame:
    """The k largest faces of each image."""
    return first_of_each(faces, ["image_id"], [F.desc("area"), F.col("face_id")], k).drop("rn")


def most_suspicious(faces: DataFrame) -> DataFrame:
    return faces.withColumn("is_most_suspicious", F.col("p_fake") == F.max("p_fake").over(Window.partitionBy("image_id")))


def vote_combine(votes: DataFrame) -> DataFrame:
    """votes: image_id, model_no (0 = own), p_fake -> combined score and whether any vote is on the other side."""
    own = F.col("model_no") == 0
    others = F.sum(F.when(own, 0).otherwise(1))
    per = votes.groupBy("image_id").agg(
        F.max(F.when(own, F.col("p_fake"))).alias("own"), others.alias("m"), F.sum(F.when(~own, F.col("p_fake"))).alias("rest"),
        F.avg(F.when(~own, F.col("p_fake"))).alias("mean"), F.min(F.when(~own, F.col("p_fake"))).alias("least"),
        F.min("p_fake").alias("lo"), F.max("p_fake").alias("hi"),
    )
    share = F.bround(F.lit(1.0 - OWN_WEIGHT) / F.nullif(F.col("m"), F.lit(0)), 3)  # rounded before use
    blend = F.when(F.col("m") > 0, F.col("own") * OWN_WEIGHT + F.col("rest") * share).otherwise(F.col("own"))
    raised = F.when(F.col("least") >= OVERRULE, F.greatest(blend, F.col("mean"))).otherwise(blend)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raised))
    disputed = F.when(score >= 0.5, F.col("lo") < 0.5).otherwise(F.col("hi") >= 0.5)
    return per.select("image_id", score.alias("score"), disputed.alias("disputed"))


def flip_average(scores: DataFrame) -> DataFrame:
    """Mean over an image's variants (itself and its mirror)."""
    return scores.groupBy("image_id").agg(F.avg("p_fake").alias("p_fake"))


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def nearest_region(x: Column, y: Column, landmarks: Column) -> Column:
    """The region of the nearest landmark of a map name -> struct<x, y>; NULL without landmarks. Ties go to the first name."""
    rows = F.transform(F.map_entries(landmarks), lambda e: F.struct((F.pow(e["value"]["x"] - x, 2) + F.pow(e["value"]["y"] - y, 2)).alias("d"), e["key"].alias("name")))
    name = F.array_min(rows)["name"]
    pairs = [F.lit(v) for kv in REGIONS.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), name)


def region_attribution(cells: DataFrame, most: int = 3, least_share: float = 0.25) -> DataFrame:
    """cells: image_id, cell, region, base_score, score -> the regions an image's score leans on, with weights.

    A cell's drop is max(0, base - score) over the image's largest; a region weighs its largest cell; weak regions go.
    """
    drop = F.greatest(F.lit(0.0), F.col("base_score") - F.col("score"))
    top = F.max("drop").over(Window.partitionBy("image_id"))
    share = cells.withColumn("drop", drop).withColumn("share", ratio(F.col("drop"), top)).filter("share > 0 AND region IS NOT NULL")
    per = share.groupBy("image_id", "region").agg(F.max("share").alias("weight"))
    best = F.max("weight").over(Window.partitionBy("image_id"))
    strong = per.withColumn("_best", best).filter(F.col("weight") >= least_share * F.col("_best")).drop("_best")
    return first_of_each(strong, ["image_id"], [F.desc("weight"), F.col("region")], most, "place")


def timeline(frames: DataFrame) -> DataFrame:
    """Time-ordered {t, p} of each clip; a clip holds at most MAX_FRAMES sampled frames."""
    rows = F.array_sort(F.collect_list(F.struct("frame_index", "t", "p_fake")))
    return frames.groupBy("video_id").agg(F.transform(rows, lambda x: F.struct(x["t"].alias("t"), x["p_fake"].alias("p"))).alias("timeline"))


def top_timestamps(frames: DataFrame, k: int = 3, seconds: str = "t") -> DataFrame:
    best = first_of_each(frames, ["video_id"], [F.desc("p_fake"), F.col("frame_index")], k, "place")
    return best.select("video_id", "place", "frame_index", "p_fake", mmss(F.col(seconds)).alias("mmss"))


def frame_stride(frames: DataFrame, fps: float | None, rate: float, most: int = MAX_FRAMES) -> DataFrame:
    """Every step-th frame, the first `most`; a bad fps counts as 25."""
    good = fps if fps and fps == fps and fps > 0 else 25.0
    step = max(1, round(good / max(0.25, rate)))  # half-even, like the sampler it stands for
    return first_of_each(frames.filter(F.col("frame_index") % step == 0), ["video_id"], [F.col("frame_index")], most).drop("rn")


def dhash(grid: Column) -> Column:
    """8 x 9 grey values -> 16 hex digits: a bit is set where the right neighbour is brighter, row by row."""
    bits = F.flatten(F.transform(grid, lambda row: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.get(row, i) > F.get(row, i - 1)).cast("bigint"))))
    nibbles = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get(bits, i * 4) * 8 + F.get(bits, i * 4 + 1) * 4 + F.get(bits, i * 4 + 2) * 2 + F.get(bits, i * 4 + 3))
    return F.array_join(F.transform(nibbles, lambda x: F.lower(F.hex(x))), "")


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def _std(a: Column) -> Column:
    return F.sqrt(_mean(F.transform(a, lambda x: F.pow(x - _mean(a), 2))))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; NULL if either is flat or missing."""
    ma, mb = _mean(a), _mean(b)
    cov = _mean(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    sa, sb = _std(a), _std(b)
    return F.when((sa >= 1e-6) & (sb >= 1e-6), cov / (sa * sb))


def temporal_signals(frames: DataFrame) -> DataFrame:
    """Steadiness of the face over the frames that have one; NULL where fewer than two or nothing to measure.

    Optional columns: origin_x, origin_y, landmarks map<string, struct<x, y>>, thumb array<double>.
    """
    have = set(frames.columns)
    faces = frames.filter("box_x IS NOT NULL")
    cx, cy = (F.col("box_x") + F.col("box_w") / 2) / F.col("frame_w"), (F.col("box_y") + F.col("box_h") / 2) / F.col("frame_h")
    size = F.sqrt(F.greatest(F.col("box_w") * F.col("box_h"), F.lit(1e-6)))
    before = Window.partitionBy("video_id").orderBy("frame_index")
    step, similar = F.lit(None).cast("double"), F.lit(None).cast("double")
    if "landmarks" in have:
        ox, oy = (F.col(c) if c in have else F.lit(0.0) for c in ("origin_x", "origin_y"))
        faces = faces.withColumns({"_prev": F.lag("landmarks").over(before), "_px": F.lag(ox).over(before), "_py": F.lag(oy).over(before)})
        shared = F.array_intersect(F.map_keys("landmarks"), F.map_keys("_prev"))
        moved = F.transform(shared, lambda n: F.hypot(
            F.col("landmarks")[n]["x"] + ox - F.col("_prev")[n]["x"] - F.col("_px"), F.col("landmarks")[n]["y"] + oy - F.col("_prev")[n]["y"] - F.col("_py")
        ) / F.greatest(F.col("box_w"), F.lit(1e-6)))
        step = _mean(moved)
    if "thumb" in have:
        faces = faces.withColumn("_thumb", F.lag("thumb").over(before))
        similar = correlation(F.col("thumb"), F.col("_thumb"))
    faces = faces.withColumns({"_step": step, "_similar": similar})
    enough = lambda c: F.when(F.count(F.lit(1)) >= 2, c)
    per = faces.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("faces_found"), enough((F.stddev_pop(cx) + F.stddev_pop(cy)) / 2).alias("position_jitter"),
        enough(F.stddev_pop(size) / F.avg(size)).alias("size_jitter"), enough(F.avg("_step")).alias("landmark_jitter"), enough(F.avg("_similar")).alias("appearance_continuity"),
    )
    clips = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames_sampled"))
    return clips.join(per, "video_id", "left").withColumn("faces_found", F.coalesce("faces_found", F.lit(0)))


def stage_profile(spans: DataFrame, stages: list[int | str], frames: int | None = None, summed: bool = False) -> DataFrame:
    """Per case and stage: median seconds over the runs (a missing stage is 0), share of the median total; plus the rest.

    spans: case_name, run_id, stage, seconds, where stage 'total' names the whole run; `summed`: a run's total is the sum of all its
    spans. Each span is met once, and medians come from counted values, so that no group is held whole.
    """
    stage = F.col("stage").cast("string")
    total = F.sum("seconds") if summed else F.sum(F.when(stage == "total", F.col("seconds")))
    sums = [F.sum(F.when(stage == str(s), F.col("seconds"))).alias(f"_{i}") for i, s in enumerate(stages)]
    runs = spans.groupBy("case_name", "run_id").agg(*sums, total.alias(f"_{len(stages)}"))
    each = runs.select("case_name", F.posexplode(F.array(*[F.coalesce(F.col(f"_{i}").cast("double"), F.lit(0.0)) for i in range(len(stages) + 1)])).alias("at", "seconds"))
    medians = percentiles(each, "seconds", {"seconds": ("cont", 0.5)}, ["case_name", "at"])
    med = lambda i: F.max(F.when(F.col("at") == i, F.col("seconds")))
    per = medians.groupBy("case_name").agg(*[med(i).alias(f"m_{s}") for i, s in enumerate(stages)], med(len(stages)).alias("total"))
    known = sum((F.col(f"m_{s}") for s in stages), F.lit(0.0))
    rows = [F.struct(F.lit(str(s)).alias("stage"), F.col(f"m_{s}").alias("seconds")) for s in stages]
    rows.append(F.struct(F.lit("other").alias("stage"), F.greatest(F.lit(0.0), F.col("total") - known).alias("seconds")))
    out = per.select("case_name", "total", F.explode(F.array(*rows)).alias("x")).select("case_name", "x.stage", "x.seconds", ratio(F.col("x.seconds"), F.col("total")).alias("share"))
    return out.withColumn("ms_per_frame", F.col("seconds") * 1000 / frames) if frames else out


def resource_summary(samples: DataFrame) -> DataFrame:
    """samples: case_name, at, rss, cpu_s -> peak over the first sample, CPU seconds and busy cores."""
    first = F.min_by("rss", "at")
    cpu, wall = F.max("cpu_s") - F.min("cpu_s"), (F.max("at") - F.min("at")).cast("double")
    return samples.groupBy("case_name").agg(F.max("rss").alias("peak"), (F.max("rss") - first).alias("over_baseline"), cpu.alias("cpu_s"), ratio(cpu, wall).alias("cores"))

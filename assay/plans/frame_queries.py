"""Queries of frame and face sequences, sampling and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import verdicts as v
from assay.operators import frames as fr
from assay.operators import sampling as sa
from assay.plans.registry import query
from assay.plans.views import duck, table, view

FR, FA = duck("frames"), duck("faces")
AGG = ("median", "mean", "top_k", "score", "variance")


def _clips(p: str = "least(1e0, greatest(0e0, p_fake))", extra: str = "") -> str:
    return f"""SELECT video_id, frames, k, median, mean, tk AS top_k, 0.40e0 * median + 0.25e0 * mean + 0.35e0 * tk AS score, suspicious, peak, lowest, variance {', faces, face_found' if extra else ''}
  FROM (SELECT *, list_sum(ps[1:k]) / k AS tk FROM (SELECT *, least(frames, greatest(1, CAST(round_even(greatest(0.15e0, 1e0 / frames) * frames, 0) AS INT))) AS k
    FROM (SELECT video_id, CAST(count(*) AS INT) AS frames, median(p) AS median, avg(p) AS mean, count(*) FILTER (WHERE p >= 0.7e0) AS suspicious, max(p) AS peak, min(p) AS lowest, var_pop(p) AS variance, list_reverse_sort(list(p)) AS ps {extra}
      FROM (SELECT *, {p} AS p FROM ({FR})) GROUP BY video_id)))"""


@query("d22_frame_aggregate", _clips(), AGG)
def _(spark, sf):
    return fr.frame_aggregate(view(spark, sf, "frames"))


@query("j4_frame_aggregate_udaf", f"SELECT bucket, mean, tk, frames FROM (SELECT bucket, frames, mean, list_sum(ps[1:k]) / k AS tk FROM (SELECT *, least(frames, greatest(1, CAST(round_even(0.5e0 * frames, 0) AS INT))) AS k FROM (SELECT faces_found AS bucket, count(*) AS frames, avg(p_fake) AS mean, list_reverse_sort(list(p_fake)) AS ps FROM ({FR}) GROUP BY faces_found)))", ("mean", "tk"))
def _(spark, sf):
    return fr.frame_aggregate(view(spark, sf, "frames"), ["faces_found"], fraction=0.5).select(F.col("faces_found").alias("bucket"), "mean", F.col("top_k").alias("tk"), "frames")


@query("d23_clip_verdict", f"""SELECT * EXCLUDE (score, s), s AS score, CASE WHEN face_found AND s >= 0.5e0 THEN 'deepfake' ELSE 'real' END AS prediction,
  CAST(CASE WHEN face_found THEN round_even(100 * greatest(s, 1 - s), 0) ELSE 50 END AS INT) AS confidence, NOT face_found AS insufficient_evidence
  FROM (SELECT *, CASE WHEN face_found THEN score ELSE 0.5e0 END AS s FROM ({_clips("CASE WHEN faces_found > 0 THEN least(1e0, greatest(0e0, p_fake)) ELSE 0.5e0 END", ", max(faces_found) AS faces, bool_or(faces_found > 0) AS face_found")}))""", AGG)
def _(spark, sf):
    return fr.clip_verdict(view(spark, sf, "frames"))


@query("d24_image_verdict", f"""SELECT image_id, p_fake AS score, n AS faces, face_id, area FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS n,
  row_number() OVER (PARTITION BY image_id ORDER BY p_fake DESC, face_id, area DESC) AS rn FROM ({FA})) WHERE rn = 1""")
def _(spark, sf):
    return fr.image_verdict(view(spark, sf, "faces"))


@query("b16_face_limit", f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, face_id) AS rn FROM ({FA})) WHERE rn <= 3")
def _(spark, sf):
    return fr.face_limit(view(spark, sf, "faces"), 3)


@query("e7_most_suspicious_face", f"SELECT *, p_fake = max(p_fake) OVER (PARTITION BY image_id) AS is_most_suspicious FROM ({FA})")
def _(spark, sf):
    return fr.most_suspicious(view(spark, sf, "faces"))


_VOTES = f"SELECT image_id, face_id - 1 AS model_no, p_fake FROM ({FA}) WHERE face_id <= 3"


@query("d25_vote_combine", f"""SELECT image_id, score, CASE WHEN score >= 0.5e0 THEN lo < 0.5e0 ELSE hi >= 0.5e0 END AS disputed FROM (SELECT image_id, lo, hi, least(1e0, greatest(0e0, CASE WHEN least_v >= 0.85e0 THEN greatest(blend, mean) ELSE blend END)) AS score
  FROM (SELECT *, CASE WHEN m > 0 THEN own * 0.75e0 + rest * round_even(0.25e0 / nullif(m, 0), 3) ELSE own END AS blend FROM (SELECT image_id, max(p_fake) FILTER (WHERE model_no = 0) AS own, count(*) FILTER (WHERE model_no > 0) AS m, sum(p_fake) FILTER (WHERE model_no > 0) AS rest,
    avg(p_fake) FILTER (WHERE model_no > 0) AS mean, min(p_fake) FILTER (WHERE model_no > 0) AS least_v, min(p_fake) AS lo, max(p_fake) AS hi FROM ({_VOTES}) GROUP BY image_id)))""", ("score",))
def _(spark, sf):
    votes = view(spark, sf, "faces").filter("face_id <= 3").select("image_id", (F.col("face_id") - 1).alias("model_no"), "p_fake")
    return fr.vote_combine(votes)


@query("d26_flip_average", f"SELECT image_id, avg(p_fake) AS p_fake FROM ({FA}) WHERE face_id <= 2 GROUP BY image_id", ("p_fake",))
def _(spark, sf):
    return fr.flip_average(view(spark, sf, "faces").filter("face_id <= 2"))


_REG = "CASE face_id % 4 WHEN 0 THEN 'the eye region' WHEN 1 THEN 'the nose area' WHEN 2 THEN 'the mouth area' END"


@query("d27_region_attribution", f"""SELECT image_id, region, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY weight DESC, region) AS place FROM (SELECT *, max(weight) OVER (PARTITION BY image_id) AS best FROM (
  SELECT image_id, region, max(share) AS weight FROM (SELECT *, d / nullif(max(d) OVER (PARTITION BY image_id), 0) AS share FROM (SELECT image_id, {_REG} AS region, greatest(0e0, 0.8e0 - p_fake) AS d FROM ({FA}))) WHERE share > 0 AND region IS NOT NULL GROUP BY image_id, region))
  WHERE weight >= 0.25e0 * best) WHERE place <= 3""", ("weight",))
def _(spark, sf):
    cells = view(spark, sf, "faces").select("image_id", F.col("face_id").alias("cell"), F.expr(_REG).alias("region"), F.lit(0.8).alias("base_score"), F.col("p_fake").alias("score"))
    return fr.region_attribution(cells)


@query("c11_nearest_landmark", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CASE name WHEN 'nose' THEN 'the nose area' WHEN 'left_eye' THEN 'the eye region' WHEN 'right_eye' THEN 'the eye region' ELSE 'the mouth area' END END AS region FROM (
  SELECT event_id, arg_min(name, (lx - x) * (lx - x) + (ly - y) * (ly - y)) AS name FROM (SELECT event_id, CAST(event_id % 101 AS DOUBLE) + 0.25e0 AS x, CAST((event_id * 7) % 103 AS DOUBLE) + 0.125e0 AS y FROM events),
  (VALUES ('right_eye', 30.0, 40.0), ('left_eye', 70.0, 41.0), ('nose', 50.0, 60.0), ('mouth_right', 35.0, 80.0), ('mouth_left', 66.0, 82.0)) AS l(name, lx, ly) GROUP BY event_id)""")
def _(spark, sf):
    spot = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    marks = {"right_eye": (30.0, 40.0), "left_eye": (70.0, 41.0), "nose": (50.0, 60.0), "mouth_right": (35.0, 80.0), "mouth_left": (66.0, 82.0)}
    table_map = F.create_map(*[c for k, xy in marks.items() for c in (F.lit(k), spot(*xy))])
    landmarks = F.when(F.col("event_id") % 7 != 0, table_map)
    return table(spark, sf, "events").select("event_id", fr.nearest_region((F.col("event_id") % 101).cast("double") + 0.25, (F.col("event_id") * 7 % 103).cast("double") + 0.125, landmarks).alias("region"))


_SIGNALS = f"""SELECT video_id, count(*) AS frames_sampled, count(box_x) AS faces_found,
  CASE WHEN count(box_x) >= 2 THEN (stddev_pop((box_x + box_w / 2) / frame_w) FILTER (WHERE box_x IS NOT NULL) + stddev_pop((box_y + box_h / 2) / frame_h) FILTER (WHERE box_x IS NOT NULL)) / 2 END AS position_jitter,
  CASE WHEN count(box_x) >= 2 THEN stddev_pop(sqrt(box_w * box_h)) FILTER (WHERE box_x IS NOT NULL) / avg(sqrt(box_w * box_h)) FILTER (WHERE box_x IS NOT NULL) END AS size_jitter,
  CAST(NULL AS DOUBLE) AS landmark_jitter, CAST(NULL AS DOUBLE) AS appearance_continuity FROM ({FR}) GROUP BY video_id"""


@query("e5_temporal_signals", _SIGNALS, ("position_jitter", "size_jitter"))
def _(spark, sf):
    return fr.temporal_signals(view(spark, sf, "frames"))


@query("e6_timeline", f"SELECT video_id, array_to_string(list(concat(CAST(CAST(t AS BIGINT) AS VARCHAR), ':', CAST(CAST(floor(p_fake * 1000) AS INT) AS VARCHAR)) ORDER BY frame_index), ',') AS line FROM ({FR}) GROUP BY video_id")
def _(spark, sf):
    lines = fr.timeline(view(spark, sf, "frames"))
    return lines.select("video_id", F.array_join(F.transform("timeline", lambda x: F.concat(F.bround(x["t"], 0).cast("bigint").cast("string"), F.lit(":"), F.floor(x["p"] * 1000).cast("string"))), ",").alias("line"))


_MMSS = "concat(lpad(CAST(s // 60 AS VARCHAR), CAST(greatest(2, length(CAST(s // 60 AS VARCHAR))) AS INT), '0'), ':', lpad(CAST(s % 60 AS VARCHAR), 2, '0'))"


@query("f1_top_timestamps", f"SELECT video_id, place, frame_index, p_fake, {_MMSS} AS mmss FROM (SELECT *, CAST(frame_index * 7 AS BIGINT) AS s, row_number() OVER (PARTITION BY video_id ORDER BY p_fake DESC, frame_index) AS place FROM ({FR})) WHERE place <= 3")
def _(spark, sf):
    return fr.top_timestamps(view(spark, sf, "frames").withColumn("t7", F.col("frame_index") * 7), seconds="t7")


@query("h8_mmss", f"SELECT event_id, {_MMSS} AS mmss FROM (SELECT event_id, CAST(greatest(round_even(value * 20 - 50, 0), 0) AS BIGINT) AS s FROM events)")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", v.mmss(F.col("value") * 20 - 50).alias("mmss"))


@query("h3_frame_stride", f"SELECT video_id, frame_index, p_fake FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS rn FROM ({FR}) WHERE frame_index % 6 = 0) WHERE rn <= 8")
def _(spark, sf):
    return fr.frame_stride(view(spark, sf, "frames"), 25.0, 4.0, 8).select("video_id", "frame_index", "p_fake")


@query("h4_dhash", """SELECT vec_id, array_to_string(list_transform(range(16), lambda i: lower(to_hex(b[i * 4 + 1] * 8 + b[i * 4 + 2] * 4 + b[i * 4 + 3] * 2 + b[i * 4 + 4]))), '') AS dhash FROM (SELECT vec_id, list_transform(range(64), lambda k: CASE WHEN e[((k // 8) * 9 + k % 8 + 1) % 64 + 1] > e[((k // 8) * 9 + k % 8) % 64 + 1] THEN 1 ELSE 0 END) AS b FROM (SELECT vec_id, embedding AS e FROM embeddings))""")
def _(spark, sf):
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda c: F.get("embedding", (r * 9 + c) % 64)))
    return table(spark, sf, "embeddings").select("vec_id", fr.dhash(grid).alias("dhash"))


@query("h14_softmax", """SELECT vec_id, round(max(x), 9) AS top, round(min(x), 9) AS low, round(sum(x), 6) AS total FROM (SELECT vec_id, unnest(list_transform(e, lambda x: exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e)))))) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)) GROUP BY vec_id""")
def _(spark, sf):
    s = fr.softmax(F.col("embedding").cast("array<double>"))
    rows = table(spark, sf, "embeddings").select("vec_id", s.alias("s"))
    return rows.select("vec_id", F.round(F.array_max("s"), 9).alias("top"), F.round(F.array_min("s"), 9).alias("low"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_SPANS = duck("spans")


@query("d32_stage_latency_profile", f"""WITH r AS (SELECT case_name, run_id, coalesce(sum(seconds) FILTER (WHERE stage = 1), 0) AS a, coalesce(sum(seconds) FILTER (WHERE stage = 2), 0) AS b, coalesce(sum(seconds) FILTER (WHERE stage = 3), 0) AS c, sum(seconds) AS t FROM ({_SPANS}) GROUP BY ALL),
  m AS (SELECT case_name, median(a) AS a, median(b) AS b, median(c) AS c, median(t) AS t FROM r GROUP BY case_name)
  SELECT case_name, stage, seconds, seconds / nullif(t, 0) AS share, seconds * 1000 / 10 AS ms_per_frame FROM (SELECT case_name, t, '1' AS stage, a AS seconds FROM m UNION ALL SELECT case_name, t, '2', b FROM m UNION ALL SELECT case_name, t, '3', c FROM m UNION ALL SELECT case_name, t, 'other', greatest(0, t - a - b - c) FROM m)""", ("share", "ms_per_frame"))
def _(spark, sf):
    return fr.stage_profile(view(spark, sf, "spans"), ["1", "2", "3"], frames=10, summed=True)


@query("h17_resource_summary", f"SELECT case_name, max(seconds) AS peak, max(seconds) - arg_min(seconds, run_id * 10 + stage) AS over_baseline, max(stage) - min(stage) AS cpu_s, (max(stage) - min(stage)) / nullif(max(run_id * 10 + stage) - min(run_id * 10 + stage), 0)::DOUBLE AS cores FROM ({_SPANS}) GROUP BY case_name", ("cores",))
def _(spark, sf):
    spans = view(spark, sf, "spans")
    return fr.resource_summary(spans.select("case_name", (F.col("run_id") * 10 + F.col("stage")).alias("at"), F.col("seconds").alias("rss"), F.col("stage").alias("cpu_s")))


# ---- sampling
_M = "md5(concat('42', CAST(doc_id AS VARCHAR)))"


@query("f4_balanced_sample", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_M}, doc_id) AS rn FROM documents) WHERE rn <= 50")
def _(spark, sf):
    return sa.balanced_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)


@query("e8_cap_per_identity", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5 ORDER BY doc_id LIMIT 60")
def _(spark, sf):
    return sa.cap_per_identity(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 5, 60)


@query("f6_holdout_first", f"SELECT doc_id, row_number() OVER (ORDER BY {_M}) <= 100 AS is_holdout FROM documents")
def _(spark, sf):
    return sa.holdout_first(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


_FILL = f"SELECT doc_id, pool FROM (SELECT doc_id, CASE lang WHEN 'es' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS pool, {_M} AS h FROM documents WHERE lang IN ('es', 'fr', 'de')) ORDER BY pool, h LIMIT 250"


@query("f5_budget_fill", _FILL)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sa.budget_fill([docs.filter(F.col("lang") == x) for x in ("es", "fr", "de")], "doc_id", 250).select("doc_id", "pool")


@query("f5_match_count", f"SELECT doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY {_M} LIMIT (SELECT count(*) FROM documents WHERE lang = 'es'))")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sa.match_count(docs.filter("lang = 'en'"), "doc_id", docs.filter("lang = 'es'")).select("doc_id")


@query("f7_withheld_family", f"SELECT 'train' AS part, doc_id FROM documents WHERE lower(source) <> 'src5' UNION ALL SELECT 'test', doc_id FROM (SELECT doc_id FROM documents WHERE lower(source) = 'src5' ORDER BY {_M}, doc_id LIMIT 20)")
def _(spark, sf):
    train, test = sa.withheld_family(table(spark, sf, "documents").select("doc_id", "source"), "source", "SRC5", "doc_id", 20)
    return train.select(F.lit("train").alias("part"), "doc_id").unionByName(test.select(F.lit("test").alias("part"), "doc_id"))


@query("f8_blind_pack", f"SELECT doc_id, lang, 'sample_' || lpad(CAST(row_number() OVER (ORDER BY md5(concat('pack42', CAST(doc_id AS VARCHAR))), doc_id) AS VARCHAR), 2, '0') AS sample_name FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_M}, doc_id) AS rn FROM documents) WHERE rn <= 6")
def _(spark, sf):
    return sa.blind_pack(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("g5_concat_predictions", f"WITH p AS ({duck('pred')}) SELECT holdout, count(*) AS n, sum(y_true) AS n_fake FROM (SELECT 'even' AS holdout, y_true FROM p WHERE source IN ('src0', 'src2') UNION ALL SELECT 'odd', y_true FROM p WHERE source IN ('src1', 'src3')) GROUP BY holdout")
def _(spark, sf):
    p = view(spark, sf, "pred")
    both = sa.concat_predictions({"even": p.filter("source IN ('src0', 'src2')"), "odd": p.filter("source IN ('src1', 'src3')")})
    return both.groupBy("holdout").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("n_fake"))


_CONDS = "(VALUES ('orig', NULL::INT, 'JPEG', 95), ('phone', 1440, 'JPEG', 92), ('screenshot', 1080, 'PNG', NULL), ('social', 720, 'JPEG', 60), ('reencode', NULL, 'JPEG', 40)) AS c(condition, side, format, quality)"
_FIT = "CASE WHEN side IS NULL OR greatest(width, height) <= side THEN {0} ELSE greatest(1, CAST(round_even({0} * (side::DOUBLE / greatest(width, height)), 0) AS INT)) END"


@query("h15_condition_plan", f"""SELECT path, condition, format, quality, {_FIT.format('width')} AS target_width, {_FIT.format('height')} AS target_height, concat(condition, '/', stem, '__cond-', condition, CASE WHEN format = 'PNG' THEN '.png' ELSE '.jpg' END) AS target
  FROM (SELECT concat('img/', CAST(doc_id AS VARCHAR), '.jpeg') AS path, CAST(doc_id AS VARCHAR) AS stem, CAST(1 + n_chars % 3001 AS INT) AS width, CAST(1 + doc_id % 1999 AS INT) AS height FROM documents), {_CONDS}""")
def _(spark, sf):
    images = table(spark, sf, "documents").select(F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".jpeg")).alias("path"), (1 + F.col("n_chars") % 3001).cast("int").alias("width"), (1 + F.col("doc_id") % 1999).cast("int").alias("height"))
    return sa.condition_plan(images)

"""Readers and writers of manifests, predictions, trees, seal lists and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The manifest's columns and their kinds.
MANIFEST = {
    "sample_id": "string", "dataset": "string", "source_path": "string", "source_id": "string", "video_id": "string", "frame_index": "int", "timestamp": "double",
    "subject_id": "string", "group_id": "string", "group_source": "string", "original_label": "string", "normalized_label": "string", "manipulation_method": "string",
    "manipulation_family": "string", "compression": "string", "media_type": "string", "width": "int", "height": "int", "duration": "double", "frame_count": "int",
    "sha256": "string", "phash": "string", "face_found": "boolean", "face_score": "double", "face_count": "int", "crop_box": "string", "crop_path": "string",
    "split": "string", "status": "string", "rejection_reason": "string", "notes": "string",
}
# Extensions and limits of the intake.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp")
IMAGE_TYPES, VIDEO_TYPES = (".jpg", ".jpeg", ".png", ".webp"), (".mp4", ".mov", ".webm")
MAX_BYTES, MAX_PIXELS, MIN_SIDE, MAX_SECONDS = 100 * 1024 * 1024, 40_000_000, 16, 300
#: Segments of a JPEG file that are looked at for its size.
SEGMENTS = 512


def typed_manifest(raw: DataFrame) -> DataFrame:
    """All-string columns to the manifest's types; a number that does not parse is -1, a missing column its default."""
    def cast(name: str, kind: str) -> Column:
        col = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        if kind == "string":
            return F.coalesce(col, F.lit(""))
        if kind == "boolean":
            return F.coalesce(col.isin("1", "True", "true"), F.lit(False))
        return F.coalesce(F.trim(col).try_cast(kind), F.lit(-1).cast(kind))
    return raw.select(*[cast(n, k).alias(n) for n, k in MANIFEST.items()])


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def manifest_read(spark: SparkSession, path: str) -> DataFrame:
    return typed_manifest(_csv(spark, path))


def manifest_write(df: DataFrame, path: str, form: str = "parquet") -> None:
    """All columns and rows, partitioned by status; CSV spells booleans 1 and 0."""
    if form == "csv":
        df = df.withColumns({n: F.col(n).cast("int") for n, k in MANIFEST.items() if k == "boolean"})
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").partitionBy("status").parquet(path)


def typed_predictions(raw: DataFrame) -> DataFrame:
    missing = [c for c in ("y_true", "p_fake") if c not in raw.columns]
    if missing:
        raise ValueError(f"predictions lack {missing}")
    y = F.col("y_true").cast("int")
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    return raw.select(
        text("path").alias("path"), F.coalesce(text("source"), F.lit("(all)")).alias("source"),
        F.coalesce(text("label"), F.when(y == 1, "fake").otherwise("real")).alias("label"), y.alias("y_true"), F.col("p_fake").cast("double").alias("p_fake"), text("group_id").alias("group_id"),
    )


def predictions_read(spark: SparkSession, path: str) -> DataFrame:
    return typed_predictions(_csv(spark, path))


def tree_columns(path: Column) -> tuple[Column, Column]:
    """(label, source) of a path below a root: real/<source>/... or fake/<source>/..., `(root)` without a folder."""
    parts = F.split(path, "/")
    return F.get(parts, F.lit(0)), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("(root)")


def labelled_tree_scan(spark: SparkSession, root: str) -> DataFrame:
    """Image files under real/ and fake/; the contents are never read. Spark's listing leaves out empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    below = F.regexp_extract("path", r"/((?:real|fake)/.*)$", 1)
    label, source = tree_columns(below)
    kept = files.withColumn("_below", below).filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGE_EXTENSIONS) & (below != ""))
    return kept.select("path", F.col("length").alias("bytes"), label.alias("label"), source.alias("source")).drop("_below")


def explode_clip_index(index: DataFrame, column: str = "value") -> DataFrame:
    """JSON text `{clip: {label, original}}` -> clip, label, original; a missing original is the clip itself."""
    parsed = F.from_json(column, "map<string,struct<label:string,original:string>>")
    rows = index.select(F.explode(parsed).alias("clip", "info"))
    return rows.select("clip", F.lower(F.coalesce("info.label", F.lit(""))).alias("label"), F.coalesce(F.nullif("info.original", F.lit("")), F.col("clip")).alias("original"))


def unreadable_index(index: DataFrame, column: str = "value") -> DataFrame:
    """The quarantine of explode_clip_index."""
    return index.filter(F.from_json(column, "map<string,struct<label:string,original:string>>").isNull())


def clip_index_read(spark: SparkSession, root: str) -> DataFrame:
    return explode_clip_index(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").text(root, wholetext=True))


def group_overrides(rows: DataFrame, groups: DataFrame, path: str = "path", group: str = "group_id") -> DataFrame:
    """A side table (path, group) beats the derived group; empty paths and groups are ignored, keys compared in lower case."""
    side = groups.filter("coalesce(path, '') <> '' AND coalesce(`group`, '') <> ''").groupBy(F.lower("path").alias("_p")).agg(F.max("group").alias("_g"))
    return rows.join(side, F.lower(path) == F.col("_p"), "left").withColumn(group, F.coalesce("_g", group)).drop("_p", "_g")


def upsert_groups(existing: DataFrame, new: DataFrame, prefix: str) -> DataFrame:
    return existing.filter(~F.coalesce(F.col("path").startswith(prefix), F.lit(False))).unionByName(new)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows that bring new nullable columns; none is dropped or retyped."""
    for f in old.schema:
        if f.name in new.columns and new.schema[f.name].dataType != f.dataType:
            raise TypeError(f"{f.name} would change from {f.dataType.simpleString()} to {new.schema[f.name].dataType.simpleString()}")
    return old.unionByName(new, allowMissingColumns=True)


def seal_list_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Group ids of a text list; comments and blanks are ignored."""
    return lines.select(F.trim(column).alias("group_id")).filter("group_id <> '' AND NOT startswith(group_id, '#')").distinct()


def seal_list_read(spark: SparkSession, path: str) -> DataFrame:
    return seal_list_rows(spark.read.text(path))


def seal_list_append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("group_id").union(new.select("group_id")).distinct().orderBy("group_id")


def csv_write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def table_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("mergeSchema", True).parquet(path)


def _number(content: Column, at: Column | int, n: int, little: bool = False) -> Column:
    """The unsigned number in n bytes from byte `at` (from 0); NULL beyond the end."""
    raw = F.substring(content, F.lit(at) + 1, F.lit(n))
    digits = F.hex(raw)
    if little:
        digits = F.concat(*[F.substring(F.hex(raw), 2 * i + 1, 2) for i in reversed(range(n))])
    return F.when(F.octet_length(raw) == n, F.conv(digits, 16, 10).cast("bigint"))


def jpeg_size(content: Column) -> Column:
    """(w, h) from the frame header, found by walking from segment to segment; NULLs where there is none."""
    def step(s: Column, _: Column) -> Column:
        mark = _number(content, s["at"], 2)
        kind = mark % 256
        frame = (mark >= 0xFFC0) & (mark <= 0xFFCF) & ~kind.isin(0xC4, 0xC8, 0xCC)
        bare = kind.isin(0x01, *range(0xD0, 0xDA))
        then = F.when(mark == 0xFFFF, s["at"] + 1).when(bare, s["at"] + 2).otherwise(s["at"] + 2 + _number(content, s["at"] + 2, 2))
        over = F.coalesce((mark < 0xFF00) | (kind == 0xDA), F.lit(True))  # no marker, or the picture itself
        moved = F.struct(
            F.when(~over & ~frame, F.coalesce(then, s["at"])).otherwise(s["at"]).cast("bigint").alias("at"),
            F.when(frame, _number(content, s["at"] + 7, 2)).alias("w"), F.when(frame, _number(content, s["at"] + 5, 2)).alias("h"),
            (over | F.coalesce(frame, F.lit(False))).alias("done"),
        )
        return F.when(s["done"], s).otherwise(moved)

    none = F.lit(None).cast("bigint")
    start = F.struct(F.lit(2).cast("bigint").alias("at"), none.alias("w"), none.alias("h"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step, lambda s: F.struct(s["w"].alias("w"), s["h"].alias("h")))


def webp_size(content: Column) -> Column:
    """(w, h) of the extended, lossy and lossless forms."""
    form = F.hex(F.substring(content, 13, 4))
    lossless = _number(content, 21, 4, little=True)
    pick = lambda x, l, v: F.when(form == "56503858", x).when((form == "56503820") & (F.hex(F.substring(content, 24, 3)) == "9D012A"), l).when((form == "5650384C") & (_number(content, 20, 1) == 0x2F), v)
    return F.struct(
        pick(_number(content, 24, 3, little=True) + 1, _number(content, 26, 2, little=True) % 16384, lossless % 16384 + 1).alias("w"),
        pick(_number(content, 27, 3, little=True) + 1, _number(content, 28, 2, little=True) % 16384, F.shiftright(lossless, 14) % 16384 + 1).alias("h"),
    )


def image_size(content: Column, ext: Column) -> Column:
    """(w, h) from the headers of PNG, JPEG and WEBP files; NULLs where the header does not tell. Nothing is decoded."""
    none = F.lit(None).cast("bigint")
    png = F.struct(_number(content, 16, 4).alias("w"), _number(content, 20, 4).alias("h"))
    return F.when(ext == ".png", png).when(ext.isin(".jpg", ".jpeg"), jpeg_size(content)).when(ext == ".webp", webp_size(content)).otherwise(F.struct(none.alias("w"), none.alias("h")))


def intake_screen(files: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """path, length, content -> ext, kind, reject_code (NULL = accepted), by ordered checks; listing columns come first.

    clips (path, seconds; one row a path): lengths that a decoder has measured. Sizes and lengths that are not known
    reject nothing.
    """
    if clips is not None:
        files = files.join(clips.select("path", F.col("seconds").cast("double").alias("_seconds")), "path", "left")
    else:
        files = files.withColumn("_seconds", F.lit(None).cast("double"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    head = F.hex(F.substring("content", 1, 32))
    starts = lambda x: head.startswith(x)
    magic = (
        F.when(ext.isin(".jpg", ".jpeg"), starts("FFD8FF")).when(ext == ".png", starts("89504E470D0A1A0A"))
        .when(ext == ".webp", starts("52494646") & (F.substring(head, 17, 8) == "57454250"))
        .when(ext.isin(".mp4", ".mov"), F.substring(head, 1, 32).contains("66747970")).when(ext == ".webm", starts("1A45DFA3")).otherwise(False)
    )
    code = lambda w, h: (
        F.when(~ext.isin(*IMAGE_TYPES, *VIDEO_TYPES), "bad_type").when(F.col("length") == 0, "empty_file").when(F.col("length") > MAX_BYTES, "too_large")
        .when(~magic, "bad_magic").when(w * h > MAX_PIXELS, "too_many_pixels").when((w < MIN_SIDE) | (h < MIN_SIDE), "too_small")
        .when(ext.isin(*VIDEO_TYPES) & (F.col("_seconds") > MAX_SECONDS), "too_long")
    )
    kind = F.when(F.col("ext").isin(*IMAGE_TYPES), "image").when(F.col("ext").isin(*VIDEO_TYPES), "video")
    # the size is bound once (by the array), not computed again for each check
    judged = F.transform(F.array(image_size(F.col("content"), ext)), lambda size: code(size["w"], size["h"]))
    return files.select("path", "length", ext.alias("ext"), F.get(judged, F.lit(0)).alias("reject_code")).select("path", "length", "ext", F.when(F.col("reject_code").isNull(), kind).alias("kind"), "reject_code")


def content_hash(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def hash_issues(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows whose digest is not the file's."""
    found = content_hash(files).select(F.col("path").alias("_path"), F.col("sha256").alias("found_sha256"))
    joined = manifest.join(found, F.col("source_path") == F.col("_path"))
    return joined.filter((F.coalesce("sha256", F.lit("")) != "") & (F.col("sha256") != F.col("found_sha256"))).drop("_path")


def crop_index_to_groups(index: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose crop exists; a fake goes to its original's group, a real to its own stem."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")
    own = stem(F.col("path"))
    there = index.join(files.select(F.col("path")).distinct(), "path", "left_semi")
    if "original" not in index.columns:
        return there.withColumn("group_id", own)
    original = F.nullif(F.nullif(F.col("original"), F.lit("")), F.lit("nan"))
    return there.withColumn("group_id", F.when((F.lower("label") == "fake") & original.isNotNull(), stem(original)).otherwise(own))


JSON_LEAVES = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])


def flatten_json(df: DataFrame, key: str, column: str, depth: int = 4) -> DataFrame:
    """key, path, value of every leaf down to a depth; arrays give their length too. Text that is not JSON gives nothing."""
    # one chain: each text is parsed once, and leaves found (rows without v) go along with what is still to be opened
    rows = df.repartition(key).select(F.col(key), F.lit("").alias("path"), F.explode(F.filter(F.array(F.try_parse_json(column)), lambda v: v.isNotNull())).alias("v"), F.lit(None).cast("string").alias("value"))
    for _ in range(depth):
        kind = F.col("kind")
        row = lambda path, v, value, deep: F.struct(path.alias("path"), v.cast("variant").alias("v"), value.cast("string").alias("value"), deep.alias("deep"))
        found, none = F.lit(False), F.lit(None)
        own = row(F.col("path"), F.col("v"), F.col("value"), F.lit(True))
        size = row(F.concat("path", F.lit("#")), none, F.size(F.expr("try_cast(v as array<variant>)")), found)
        leaf = row(F.col("path"), none, F.coalesce("value", F.col("v").try_cast("string")), found)
        parts = F.when(kind.startswith("ARRAY"), F.array(own, size)).when(kind.startswith("OBJECT"), F.array(own)).otherwise(F.array(leaf))
        marked = rows.withColumn("kind", F.substring(F.schema_of_variant("v"), 1, 6)).select(key, F.explode(parts).alias("x")).select(key, F.col("x.path").alias("path"), F.col("x.v").alias("v"), F.col("x.value").alias("value"), F.col("x.deep").alias("deep"))
        opened = marked.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).toDF("_pos", "_name", "_v")).filter("_pos IS NOT NULL OR NOT deep")
        step = F.when(F.col("_name").isNotNull(), F.concat(F.lit("."), "_name")).when(F.col("_pos").isNotNull(), F.format_string("[%d]", "_pos")).otherwise("")
        rows = opened.select(key, F.concat("path", step).alias("path"), F.col("_v").alias("v"), "value")
    return rows.select(key, "path", F.coalesce("value", F.to_json("v")).alias("value"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, volatile: tuple[str, ...] = ("processingTime", "completedAt", "uploadId", "heatmapDataUrl")) -> DataFrame:
    """Leaves of two flattened snapshots that differ: op is + added, - removed, ~ changed. Volatile leaves count by presence;
    numbers are rounded to six places."""
    quiet = F.element_at(F.split("path", r"\."), -1).isin(*volatile)
    number = F.col("value").try_cast("double")
    norm = F.when(quiet, "<volatile>").when(number.isNotNull(), F.bround(number, 6).cast("string")).otherwise(F.col("value"))
    side = lambda df, c: df.select(key, "path", F.struct(norm.alias("x")).alias(c))
    both = side(old, "a").join(side(new, "b"), [key, "path"], "full_outer")
    op = F.when(F.col("a").isNull(), "+").when(F.col("b").isNull(), "-").otherwise("~")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(key, "path", op.alias("op"), F.col("a.x").alias("before"), F.col("b.x").alias("after"))

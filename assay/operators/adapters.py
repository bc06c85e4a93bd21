"""Dataset adapters: how a path tells label, group, method, compression and subject. Each is a set of column expressions.

`adapt(name, paths, ...)` takes a one-column frame `path` and returns path, label, grp, method, compression, subject. The two
adapters with pairs of ids read their paths more than once; `once=True` has them drop repeated paths only where rows come out.
Absent data contributes nothing; an unknown name is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.corpus import pair_components
from assay.session import cut

# Folder names of the methods and generators, which must match the collections.
FFPP_METHODS = ("Deepfakes", "Face2Face", "FaceSwap", "NeuralTextures", "FaceShifter")
GENERATORS = ("stylegan2", "stylegan", "tpdn", "diffusion", "stable-diffusion")


def slashed(path: Column) -> Column:
    """The path with / for each backslash; `translate` would go through it character by character."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def group_from_path(path: Column) -> Column:
    """The stem without its `__cond-*` suffix."""
    return F.split_part(stem_of(path), F.lit("__cond-"), F.lit(1))


def person_from_filename(path: Column) -> Column:
    """The stem without our own `__` suffix and without a trailing `_digits`."""
    own = F.split_part(stem_of(path), F.lit("__"), F.lit(1))
    return F.coalesce(F.nullif(F.regexp_replace(own, r"_\d+$", ""), F.lit("")), own)


def _hit(x: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))


def _out(df: DataFrame, label: Column, grp: Column, method: Column | str = "", compression: Column | str = "unknown", subject: Column | str = "") -> DataFrame:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("path", label.alias("label"), grp.alias("grp"), col(method).alias("method"), col(compression).alias("compression"), col(subject).alias("subject"))


def _with_component(df: DataFrame, labels: DataFrame, at: str, name: str) -> DataFrame:
    """df plus the label of the id in `at`; an id without a pair is its own label. Rows without an id are dealt by their paths."""
    names = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    df = df.withColumn("_k", F.coalesce(at, F.xxhash64("path").cast("string")))
    return df.join(names, (F.col("_k") == F.col("_n")) & F.col(at).isNotNull(), "left").withColumn(name, F.coalesce("_c", at)).drop("_k", "_n", "_c")


def _with_ids(paths: DataFrame, pattern: str) -> DataFrame:
    """paths plus _stem and its ids _a and _b, the groups of the pattern. Each step is a column that several others use, so Spark works it out once a row."""
    df = paths.withColumn("_stem", stem_of(F.col("path")))
    df = df.withColumns({c: F.regexp_extract("_stem", pattern, i) for i, c in enumerate(("_a", "_b"), 1)})
    return df.withColumns({c: F.nullif(c, F.lit("")) for c in ("_a", "_b")})


def _with_components(paths: DataFrame, pattern: str, once: bool, linked: Column | None = None) -> DataFrame:
    """paths plus _stem and _component: the smaller label of the two ids in the stem. `linked` rows (None: all) link theirs, so that one id tells the label.

    No filter stands on ids: Spark would move it down and work the ids out again. Links pass with nulls, which the graph leaves out.
    """
    a = F.col("_a") if linked is None else F.when(linked, F.col("_a"))
    labels = cut(pair_components(_with_ids(paths, pattern).select(a.alias("a"), F.col("_b").alias("b"))))
    paths = paths.distinct() if once else paths
    if linked is None:
        return _with_component(_with_ids(paths, pattern), labels, "_a", "_component")
    apart = F.coalesce(~linked & (F.regexp_extract(stem_of(F.col("path")), pattern, 2) != ""), F.lit(False))
    first = _with_component(_with_ids(paths.filter(~apart), pattern), labels, "_a", "_component")
    both = _with_component(_with_component(_with_ids(paths.filter(apart), pattern), labels, "_a", "_ac"), labels, "_b", "_bc")
    return first.unionByName(both.withColumn("_component", F.least("_ac", "_bc")).drop("_ac", "_bc"))


def faceforensics(paths: DataFrame, once: bool = False) -> DataFrame:
    """once: repeated paths count once."""
    fake = F.col("path").contains("manipulated_sequences")
    df = _with_components(paths, r"^(\d+)(?:\z|_(\d+)$)", once, fake).withColumn("_p", slashed(F.col("path")))
    df = df.withColumn("_parts", F.concat(F.lit("/"), F.col("_p"), F.lit("/")))
    method = F.coalesce(*[F.when(F.col("_parts").contains(f"/{m}/"), m.lower()) for m in FFPP_METHODS], F.lit(""))
    level = F.coalesce(*[F.when(F.col("_p").contains(f"/{x}/"), x) for x in ("raw", "c23", "c40")], F.lit("unknown"))
    return _out(df, F.when(fake, "fake").otherwise("real"), F.concat(F.lit("ffpp:"), F.col("_component")), method, level)


def dfdc(paths: DataFrame, clips: DataFrame) -> DataFrame:
    """clips: clip, label, original (from explode_clip_index)."""
    df = paths.withColumn("_clip", base_name(F.col("path"))).join(clips.dropDuplicates(["clip"]).withColumnRenamed("label", "_label"), F.col("_clip") == F.col("clip"), "left")
    label = F.coalesce("_label", F.lit(""))
    return _out(df, label, F.concat(F.lit("dfdc:"), stem_of(F.col("original"))), F.when(label == "fake", "dfdc").otherwise(""))


def celebdf(paths: DataFrame, once: bool = False) -> DataFrame:
    """once: repeated paths count once."""
    df = _with_components(paths, r"^id(\d+)_(?:id(\d+)_)?\d+$", once).withColumn("_low", F.lower(slashed(F.col("path"))))
    folder = F.when(F.col("_low").contains("/"), F.substring_index(F.substring_index("_low", "/", -2), "/", 1)).otherwise("")
    df = df.withColumn("_folder", folder)
    label = F.when(F.col("_folder").contains("synthesis"), "celeb-synthesis").when(F.col("_folder").contains("real"), "real").otherwise("")
    grp = F.coalesce(F.concat(F.lit("celebdf:"), F.col("_component")), F.when(F.col("_low").contains("youtube"), F.concat(F.lit("celebdf:youtube:"), F.col("_stem"))))
    return _out(df, label, grp, F.when(F.col("_low").contains("synthesis"), "celeb-synthesis").otherwise(""))


def deeperforensics(paths: DataFrame) -> DataFrame:
    p = F.translate("path", "\\", "/")
    low = F.lower(p)
    label = F.when(low.contains("manipulated") | low.contains("/end_to_end"), "fake").when(low.contains("source") | low.contains("/original"), "real").otherwise("")
    actor = F.upper(_hit(p, r"(?i)(?:^|[_/])([MW]\d{3})"))
    return _out(paths, label, F.concat(F.lit("deeperforensics:"), actor), F.when(label == "fake", "deeperforensics").otherwise(""), subject=F.coalesce(actor, F.lit("")))


def phone(paths: DataFrame, groups: DataFrame) -> DataFrame:
    """groups: path, group; keyed by base name, empty paths ignored, the last of repeated names by path order."""
    side = groups.filter("coalesce(path, '') <> ''").select(base_name(F.col("path")).alias("_name"), F.col("group").alias("_group"), F.col("path").alias("_from"))
    side = side.groupBy("_name").agg(F.max_by("_group", "_from").alias("_group"))
    df = paths.withColumn("_base", base_name(F.col("path"))).join(side, F.col("_base") == F.col("_name"), "left")
    return _out(df, F.lit("real"), F.concat(F.lit("phone:"), F.nullif("_group", F.lit(""))), compression="jpeg")


def generated(paths: DataFrame) -> DataFrame:
    low = F.lower(F.translate("path", "\\", "/"))
    method = F.coalesce(*[F.when(low.contains(g), g) for g in GENERATORS], F.lit(""))
    return _out(paths, F.lit("fake"), F.concat(F.lit("generated:"), stem_of(F.col("path"))), method, "jpeg")


def lfw(paths: DataFrame) -> DataFrame:
    person = person_from_filename(F.col("path"))
    return _out(paths, F.lit("real"), F.concat(F.lit("lfw:"), person), compression="jpeg", subject=person)


def local_clips(paths: DataFrame) -> DataFrame:
    name = F.lower(base_name(F.col("path")))
    label = F.when(name.contains("authentic") | name.contains("real"), "real").when(name.contains("synthetic") | name.contains("fake"), "fake").otherwise("")
    return _out(paths, label, F.concat(F.lit("local_clips:"), stem_of(F.col("path"))), F.when(label == "fake", "stylegan2").otherwise(""))


ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "ffpp": faceforensics, "dfdc": dfdc, "celebdf": celebdf, "deeperforensics": deeperforensics,
    "phone": phone, "generated": generated, "lfw": lfw, "local_clips": local_clips,
}


def adapt(name: str, paths: DataFrame, **side: DataFrame | bool) -> DataFrame:
    if name not in ADAPTERS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(ADAPTERS)}")
    return ADAPTERS[name](paths, **side)

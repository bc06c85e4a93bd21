"""Corpus preparation: labels, ids, seal, quality, duplicates, split, guards, composition. Rows are re-statused, never dropped."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.graph import connected_components, spanning_links
from assay.operators.metrics import ratio
from assay.operators.ordering import first_of_each, join_frequent, numbered_by, running_before, seeded
from assay.operators.percentiles import with_percentiles
from assay.session import cut, ship

# The closed vocabularies.
LABELS = {
    "real": "REAL", "original": "REAL", "pristine": "REAL", "youtube": "REAL", "actors": "REAL", "celeb-real": "REAL",
    "fake": "FAKE", "manipulated": "FAKE", "synthesis": "FAKE", "celeb-synthesis": "FAKE", "deepfakes": "FAKE",
    "face2face": "FAKE", "faceswap": "FAKE", "neuraltextures": "FAKE", "faceshifter": "FAKE",
}
FAMILIES = {
    "deepfakes": "FACE_SWAP", "faceswap": "FACE_SWAP", "faceshifter": "FACE_SWAP", "face2face": "FACE_REENACTMENT",
    "neuraltextures": "FACE_REENACTMENT", "dfdc": "FACE_SWAP", "celeb-synthesis": "FACE_SWAP", "stylegan": "GAN",
    "stylegan2": "GAN", "tpdn": "GAN", "stable-diffusion": "DIFFUSION", "diffusion": "DIFFUSION", "none": "REAL", "": "REAL",
}
SEALED_DATASETS, WITHHELD_METHOD, SEALED_SPLITS = ("celebdf", "deeperforensics"), "neuraltextures", ("phone_sealed",)
MIN_SIDE, MIN_FACE, MIN_SCORE = 32, 64, 0.6
NEAR_BITS = 4


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def _key(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit(""))))


def normalise_label(label: Column, method: Column) -> tuple[Column, Column]:
    """(normalized_label, manipulation_family); what is not in the tables stays unknown."""
    known = F.coalesce(_lookup(LABELS, _key(label)), F.lit("UNKNOWN"))
    via = F.when(_key(method) != "", _key(method)).otherwise(_key(label))
    family = F.when(known == "REAL", "REAL").when(known == "FAKE", F.coalesce(_lookup(FAMILIES, via), F.lit("UNKNOWN_FAKE"))).otherwise("UNKNOWN_FAKE")
    return known, family


def stable_id(dataset: Column, path: Column, frame: Column) -> Column:
    return F.concat(dataset, F.lit("_"), F.substring(F.sha1(F.concat_ws("|", dataset, path, frame.cast("string")).cast("binary")), 1, 16))


@dataclass
class Seal:
    """What may never train. `groups` is a one-column DataFrame of group ids, or None."""

    datasets: tuple[str, ...] = SEALED_DATASETS
    withheld: str = WITHHELD_METHOD
    splits: tuple[str, ...] = SEALED_SPLITS
    groups: DataFrame | None = field(default=None)

    def reasons(self, rows: DataFrame) -> DataFrame:
        """rows plus seal_reason: the first rule that holds, else NULL."""
        have = set(rows.columns)
        col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
        dataset, method = F.lower(col("dataset")), F.lower(col("manipulation_method"))
        listed = F.lit(False)
        if self.groups is not None:
            ids = self.groups.select(F.col(self.groups.columns[0]).cast("string").alias("_sealed_group")).filter("_sealed_group <> ''").distinct()
            rows = rows.join(ids, col("group_id") == F.col("_sealed_group"), "left")
            listed = F.col("_sealed_group").isNotNull()
        starts = reduce(lambda a, b: a | b, [dataset.startswith(d) for d in self.datasets], F.lit(False))
        reason = (
            F.when(starts, F.concat(F.lit("sealed dataset: "), dataset))
            .when((method == self.withheld) & F.lit(bool(self.withheld)), F.concat(F.lit("withheld method: "), method))
            .when(listed, F.concat(F.lit("sealed group: "), col("group_id")))
            .when(col("split").isin(*self.splits), F.concat(F.lit("sealed split: "), col("split")))
        )
        return rows.withColumn("seal_reason", reason).drop("_sealed_group")


def seal_partition(rows: DataFrame, seal: Seal) -> DataFrame:
    """Sealed rows get status SEALED, whatever they were, and the reason appended to notes; all rows are kept."""
    notes = F.coalesce(F.col("notes"), F.lit("")) if "notes" in rows.columns else F.lit("")
    marked, sealed = seal.reasons(rows), F.col("seal_reason").isNotNull()
    joined = F.concat(F.when(notes != "", F.concat(notes, F.lit("; "))).otherwise(""), F.col("seal_reason"))
    return marked.withColumns({"status": F.when(sealed, "SEALED").otherwise(F.col("status")), "notes": F.when(sealed, joined).otherwise(notes)}).drop("seal_reason")


class SealError(AssertionError):
    """Sealed data reached a manifest that may train."""


def seal_violations(rows: DataFrame, seal: Seal) -> DataFrame:
    return seal.reasons(rows).filter("seal_reason IS NOT NULL").select("sample_id", "seal_reason")


def assert_clean(rows: DataFrame, seal: Seal, where: str = "training manifest") -> None:
    bad = seal_violations(rows, seal)
    shown = bad.orderBy("sample_id").limit(20).collect()
    if shown:
        raise SealError(f"{bad.count()} sealed samples in {where}: " + ", ".join(f"{r[0]} ({r[1]})" for r in shown))


def inventory(paths: DataFrame, dataset: str) -> DataFrame:
    """Rows of (path, label, grp, method, compression, subject) as manifest rows; a missing label beats a missing group."""
    label, family = normalise_label(F.col("label"), F.col("method"))
    name = F.element_at(F.split("path", "/"), -1)
    group = F.coalesce(F.col("grp"), F.lit(""))
    unmapped, unsafe = label == "UNKNOWN", group == ""
    return paths.select(
        stable_id(F.lit(dataset), F.col("path"), F.lit(-1)).alias("sample_id"), F.lit(dataset).alias("dataset"), F.col("path").alias("source_path"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("source_id"), F.coalesce("label", F.lit("")).alias("original_label"), label.alias("normalized_label"),
        F.coalesce("method", F.lit("")).alias("manipulation_method"), family.alias("manipulation_family"),
        F.coalesce(F.nullif("compression", F.lit("")), F.lit("unknown")).alias("compression"), F.coalesce("subject", F.lit("")).alias("subject_id"),
        group.alias("group_id"), F.when(unsafe, "NONE").otherwise("dataset metadata").alias("group_source"),
        F.when(unmapped | unsafe, "REJECTED").otherwise("PENDING").alias("status"),
        F.when(unmapped, "INVALID_LABEL").when(unsafe, "UNSAFE_GROUP").otherwise("").alias("rejection_reason"),
        F.when(unmapped, F.concat(F.lit("unmapped label "), F.coalesce("label", F.lit("")))).when(unsafe, "no group from metadata").otherwise("").alias("notes"),
    )


def label_gaps(rows: DataFrame) -> DataFrame:
    """Rows whose label no table knows, with a note."""
    label, _ = normalise_label(F.col("original_label"), F.col("manipulation_method"))
    return rows.filter(label == "UNKNOWN").withColumn("notes", F.concat(F.lit("unmapped label "), F.coalesce("original_label", F.lit(""))))


def face_quality_status(rows: DataFrame, reject_multiple: bool = False) -> DataFrame:
    """status and rejection_reason from a detector's table: readable, width, height, face_found, face_count, face_side, face_score, media_type."""
    reason = (
        F.when(~F.coalesce(F.col("readable"), F.lit(False)), F.when(F.col("media_type") == "video", "UNREADABLE_VIDEO").otherwise("CORRUPT_FILE"))
        .when(F.least("width", "height") < MIN_SIDE, "INVALID_DIMENSIONS")
        .when(~F.coalesce(F.col("face_found"), F.lit(False)), "NO_FACE")
        .when(F.col("face_side") < MIN_FACE, "FACE_TOO_SMALL")
        .when((F.col("face_score") >= 0) & (F.col("face_score") < MIN_SCORE), "LOW_DETECTION_SCORE")
        .when(F.lit(reject_multiple) & (F.col("face_count") > 1), "MULTIPLE_FACE_POLICY")
    )
    return rows.withColumn("status", F.when(reason.isNull(), "ACCEPTED").otherwise("REJECTED")).withColumn("rejection_reason", F.coalesce(reason, F.lit("")))


#: Ids of a set that a report shows; rows in one block of a pair search; rounds of joins in the search for keepers.
SHOWN, BLOCK, ROUNDS, WALK = 20, 2_000, 8, 200_000


def exact_duplicate_sets(rows: DataFrame) -> DataFrame:
    """Sets of two or more ACCEPTED or SEALED rows with one digest: how many rows and groups, the first row's ord and id,
    and the first SHOWN ids in order. A set's members are found by their digest, so no row holds them all."""
    live = rows.filter(_in_sets())
    first = F.min(F.struct("ord", "sample_id"))
    sets = live.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("n_groups"), first.alias("f")).filter("n > 1")
    shown = first_of_each(live.select("sha256", "ord", "sample_id"), ["sha256"], [F.col("ord"), F.col("sample_id")], SHOWN)
    ids = shown.groupBy("sha256").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sample_id"))), lambda x: x["sample_id"]).alias("ids"))
    return sets.join(ids, "sha256").select("sha256", "n", "n_groups", F.col("f.ord").alias("first_ord"), F.col("f.sample_id").alias("first_id"), "ids")


def _in_sets() -> Column:
    return F.col("status").isin("ACCEPTED", "SEALED") & (F.coalesce("sha256", F.lit("")) != "")


def hamming_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hex digests; 64 where one is missing or the lengths differ."""
    bits = hamming_bits(F.conv(a, 16, -10).cast("bigint"), F.conv(b, 16, -10).cast("bigint"))
    usable = (F.coalesce(F.length(a), F.lit(0)) > 0) & (F.length(a) == F.length(b))
    return F.when(usable, bits).otherwise(64)


def near_pairs(rows: DataFrame, d: int = NEAR_BITS, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of one group whose 64-bit hashes differ in at most d bits.

    For small d the rows are blocked by d + 1 bit bands: close hashes agree on one, so the result is exact. What one key
    holds is dealt into blocks of about `block` rows, and each pair of blocks meets in a task of its own, so a group
    with a third of all rows spreads over many tasks. Equal hashes give all their pairs; near_classes does without them.
    """
    live = rows.filter("phash IS NOT NULL").select("group_id", "sample_id", "phash")
    keys = ["group_id"]
    if 64 // (d + 1) >= 8:
        edges = [64 * i // (d + 1) for i in range(d + 2)]
        band = F.array(*[
            F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("phash", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("v"))
            for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
        ])
        live = live.withColumn("band", F.explode(band))
        keys = ["group_id", "band"]
    sizes = live.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_k"))
    dealt = live.join(sizes, keys).withColumn("_own", F.pmod(F.xxhash64("sample_id"), "_k").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    a = dealt.select(*keys, F.col("_own").alias("_i"), F.col("_other").alias("_j"), F.col("sample_id").alias("a"), F.col("phash").alias("ha"))
    b = dealt.select(*keys, F.col("_other").alias("_i"), F.col("_own").alias("_j"), F.col("sample_id").alias("b"), F.col("phash").alias("hb"))
    bits = hamming_bits(F.col("ha"), F.col("hb"))
    pairs = a.join(b, [*keys, "_i", "_j"]).filter((F.col("a") < F.col("b")) & (bits <= d)).select("group_id", "a", "b", bits.alias("bits"))
    return pairs.distinct() if len(keys) > 1 else pairs


def hash_classes(rows: DataFrame) -> DataFrame:
    """One row for each distinct hash of a group: group_id, phash, sample_id (its smallest) and n (its rows)."""
    live = rows.filter("phash IS NOT NULL AND group_id IS NOT NULL AND sample_id IS NOT NULL")
    return live.groupBy("group_id", "phash").agg(F.min("sample_id").alias("sample_id"), F.count(F.lit(1)).alias("n"))


def near_classes(rows: DataFrame, d: int = NEAR_BITS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): near_pairs of one representative for each distinct hash of a group, and group_id, sample_id, first
    (its representative) of every row. A thousand copies are a thousand members, not half a million pairs."""
    classes = cut(hash_classes(rows))
    live = rows.filter("phash IS NOT NULL AND group_id IS NOT NULL AND sample_id IS NOT NULL").select("group_id", "phash", "sample_id")
    members = join_frequent(live, classes.withColumnRenamed("sample_id", "first"), ["group_id", "phash"], "n")
    return near_pairs(classes.drop("n"), d, block), members.select("group_id", "sample_id", "first")


def _walk_components(edges: DataFrame) -> DataFrame:
    """(group_id, a) dropped by walking each component's ids in order. Components have WALK links at most."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        after = pdf.groupby("a")["b"].apply(list).to_dict()
        gone: set = set()
        for a in sorted(after):
            if a not in gone:
                gone.update(after[a])
        return pd.DataFrame({"group_id": [pdf["group_id"].iloc[0]] * len(gone), "a": sorted(gone)})

    ship(edges.sparkSession)
    kinds = dict(edges.dtypes)
    return edges.groupBy("component").applyInPandas(walk, f"group_id {kinds['group_id']}, a {kinds['a']}")


def _with_components(edges: DataFrame) -> DataFrame:
    """edges with their component and its number of links."""
    node = lambda c: F.struct("group_id", F.col(c).alias("id"))
    classes = connected_components(edges.select(node("a").alias("a"), node("b").alias("b")))
    named = cut(edges.join(classes, node("a") == F.col("node")).select("component", "group_id", "a", "b"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return join_frequent(named, sizes, ["component"], "n")


def near_duplicate_keepers(rows: DataFrame, d: int = NEAR_BITS) -> DataFrame:
    """(keeper, dropped): walking ids in order, a row goes if an earlier kept row of its group is within d bits.

    Only distinct hashes are compared: what holds for the first row of a hash holds for its others, and if it is kept
    it keeps them. Rounds of joins: a row without undecided or kept smaller neighbours is kept, and its neighbours go.
    After ROUNDS of them what is undecided are chains of near rows: components of up to WALK links are walked in order, each
    in a task; larger ones go on in rounds until they have fallen apart.
    """
    pairs, members = near_classes(rows, d)
    edges = cut(pairs.select("group_id", "a", "b"))
    left, dropped, rounds = edges, edges.select("group_id", F.col("b").alias("a")).limit(0), 0
    while not left.isEmpty():
        rounds += 1
        if rounds % ROUNDS == 0:
            sized = cut(_with_components(left))
            dropped = dropped.unionByName(cut(_walk_components(sized.filter(F.col("n") <= WALK))))
            left = cut(sized.filter(F.col("n") > WALK).select("group_id", "a", "b"))
            continue
        blocked = left.select("group_id", F.col("b").alias("a")).distinct()
        kept = cut(left.select("group_id", "a").distinct().join(blocked, ["group_id", "a"], "left_anti"))
        gone = cut(left.join(kept, ["group_id", "a"], "left_semi").select("group_id", F.col("b").alias("a")).distinct())
        dropped = dropped.unionByName(gone)
        out = kept.unionByName(gone)
        left = cut(left.join(out, ["group_id", "a"], "left_anti").join(gone.withColumnRenamed("a", "b"), ["group_id", "b"], "left_anti"))
    # the first keeper of a dropped row is its smallest neighbour that was never dropped
    by_keeper = edges.join(dropped, ["group_id", "a"], "left_anti").join(dropped.withColumnRenamed("a", "b"), ["group_id", "b"], "left_semi")
    keepers = cut(by_keeper.groupBy("group_id", "b").agg(F.min("a").alias("keeper")).withColumnRenamed("b", "first"))
    # a dropped hash takes its rows along; a kept one keeps its first row only
    gone_classes = cut(keepers.join(hash_classes(rows).select("group_id", F.col("sample_id").alias("first"), "n"), ["group_id", "first"]))
    taken = join_frequent(members, gone_classes, ["group_id", "first"], "n", "left").withColumn("_by", F.coalesce("keeper", "first"))
    return taken.filter(F.col("keeper").isNotNull() | (F.col("sample_id") != F.col("first"))).select(F.col("_by").alias("keeper"), F.col("sample_id").alias("dropped"))


def assign_duplicate_status(rows: DataFrame, exact: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Redundant ACCEPTED rows become REJECTED: all copies of a set that spans groups, later exact copies, near copies."""
    sets = exact.select(F.col("sha256").alias("_sha"), "n_groups", "first_ord", "first_id")
    rows_, types = rows.columns, dict(rows.dtypes)
    marked = rows.join(sets, (F.col("sha256") == F.col("_sha")) & _in_sets(), "left")
    later = ~(F.col("ord").eqNullSafe(F.col("first_ord")) & F.col("sample_id").eqNullSafe(F.col("first_id")))
    copy = F.when(F.col("n_groups") > 1, 0).when(F.col("_sha").isNotNull() & later, 1)
    if near is not None:
        gone = near.select(F.col("dropped").cast(types["sample_id"]).alias("_id")).distinct()
        marked = marked.join(gone, F.col("sample_id") == F.col("_id"), "left")
        copy = F.coalesce(copy, F.when(F.col("_id").isNotNull(), 2))
    marked = marked.withColumn("_p", copy)
    hit = F.col("_p").isNotNull() & (F.col("status") == "ACCEPTED")
    reason = F.element_at(F.array(F.lit("UNSAFE_GROUP"), F.lit("EXACT_DUPLICATE"), F.lit("NEAR_DUPLICATE")), F.coalesce("_p", F.lit(0)) + 1)
    return marked.withColumns({
        "rejection_reason": F.when(hit, reason).otherwise(F.col("rejection_reason")), "status": F.when(hit, "REJECTED").otherwise(F.col("status")),
    }).select(*rows_)


def group_split(rows: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """rows plus split: ACCEPTED rows go by whole groups, shuffled by seed, to validation while it is short of its share."""
    live = F.col("status") == "ACCEPTED"
    groups = rows.filter(live).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.sum("n").alias("total"))
    ordered = running_before(groups.withColumn("_order", seeded(seed, F.col("group_id"))), "_order", {"before": F.col("n")})
    side = ordered.crossJoin(F.broadcast(total)).select(
        F.col("group_id").alias("_g"), F.when(F.col("before") < fraction * F.col("total"), "validation").otherwise("train").alias("split")
    )
    return rows.drop("split").join(side, live & F.col("group_id").eqNullSafe(F.col("_g")), "left").drop("_g")


def split_share(rows: DataFrame) -> DataFrame:
    """Rows and groups of each side, and the achieved share."""
    per = rows.filter("split IS NOT NULL").groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("group_id").alias("n_groups"))
    return per.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))  # two rows


def two_quota_holdout(groups: DataFrame, want_fake: int, want_real: int, seed: int = 42) -> DataFrame:
    """Walk shuffled groups (group_id, n_fake, n_real) and take those that help a quota not yet met."""
    ordered = groups.filter("n_fake > 0 OR n_real > 0").withColumn("_order", seeded(seed, F.col("group_id")))
    first = running_before(ordered, "_order", {"bf": F.col("n_fake"), "br": F.col("n_real")}).withColumn("_one", (F.col("bf") < want_fake) & (F.col("br") < want_real))
    got = first.filter("_one").agg(F.coalesce(F.sum("n_fake"), F.lit(0)).alias("gf"), F.coalesce(F.sum("n_real"), F.lit(0)).alias("gr"))
    rest = first.crossJoin(F.broadcast(got)).drop("bf", "br")
    late = ~F.col("_one")
    both = running_before(rest, "_order", {"bf": F.when(late, F.col("n_fake")).otherwise(0), "br": F.when(late, F.col("n_real")).otherwise(0)})
    more = ((F.col("n_fake") > 0) & (F.col("gf") + F.col("bf") < want_fake)) | ((F.col("n_real") > 0) & (F.col("gr") + F.col("br") < want_real))
    return both.filter(F.col("_one") | more).select("group_id", "n_fake", "n_real")


def path_leakage(train: DataFrame, holdouts: DataFrame) -> DataFrame:
    """Paths of each named holdout that also train; every holdout is listed."""
    hits = holdouts.join(train.select("path").distinct(), "path", "left_semi").groupBy("holdout").agg(F.countDistinct("path").alias("n"))
    return holdouts.select("holdout").distinct().join(hits, "holdout", "left").select("holdout", F.coalesce("n", F.lit(0)).alias("shared"))


def group_leakage(rows: DataFrame) -> DataFrame:
    """Groups on more than one of train, validation and sealed, with the sides they are on."""
    side = F.when(F.col("status") == "SEALED", "sealed").otherwise(F.col("split"))
    sides = rows.withColumn("_side", side).filter("_side IS NOT NULL AND coalesce(group_id, '') <> ''").groupBy("group_id").agg(F.array_sort(F.collect_set("_side")).alias("s"))
    return sides.filter(F.size("s") > 1).select("group_id", F.array_join("s", ",").alias("sides"))


def duplicate_leakage(exact: DataFrame, rows: DataFrame) -> DataFrame:
    """Sets with members on two sides, and sets that span groups with a surviving member."""
    members = rows.select("sha256", "split", "status").join(exact.select("sha256", (F.col("n_groups") > 1).alias("spans")), "sha256")
    per = members.groupBy("sha256").agg(F.countDistinct("split").alias("sides"), F.max(F.col("spans") & (F.col("status") == "ACCEPTED")).alias("survivor"))
    return per.filter("sides > 1 OR survivor").select("sha256", F.when(F.col("sides") > 1, "two sides").otherwise("survivor of a cross-group set").alias("problem"))


class LeakError(AssertionError):
    """A group or a duplicate set is on two sides."""


def assert_no_leaks(rows: DataFrame, exact: DataFrame) -> None:
    for name, found in (("groups", group_leakage(rows)), ("duplicate sets", duplicate_leakage(exact, rows))):
        shown = found.limit(10).collect()
        if shown:
            raise LeakError(f"{name} leak, for example {[tuple(r) for r in shown]}")


DIMENSIONS = ("normalized_label", "dataset", "manipulation_family", "manipulation_method", "compression")


def composition(rows: DataFrame) -> DataFrame:
    """Long table (dimension, key, n, share): accepted rows by five dimensions, all rows by status and rejection."""
    accepted = F.col("status") == "ACCEPTED"
    value = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("(none)"))
    dims = [(d, d, accepted) for d in DIMENSIONS] + [("status", "status", F.lit(True)), ("rejection_reason", "rejection_reason", F.col("rejection_reason") != "")]
    cells = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("dimension"), value(c).alias("key"))) for name, c, cond in dims]))
    counts = rows.select(F.explode(cells).alias("x")).groupBy("x.dimension", "x.key").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("dimension"))))


def corpus_totals(rows: DataFrame) -> DataFrame:
    accepted = F.col("status") == "ACCEPTED"
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), n(accepted).alias("accepted"), F.countDistinct(F.when(accepted, F.col("group_id"))).alias("groups"),
        n(accepted & (F.col("face_count") == 1)).alias("faces_found"), n(accepted & (F.col("face_count") == 0)).alias("faces_none"), n(accepted & (F.col("face_count") > 1)).alias("faces_multiple"),
    )


def groups_per_dataset(rows: DataFrame) -> DataFrame:
    return rows.filter("status = 'ACCEPTED'").groupBy("dataset").agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("n"))


def outputs(rows: DataFrame) -> dict[str, DataFrame]:
    """The five outputs; cache rows first, they are filters of one frame."""
    return {
        "all": rows, "train": rows.filter("split = 'train'"), "validation": rows.filter("split = 'validation'"),
        "sealed": rows.filter("status = 'SEALED'"), "rejected": rows.filter("status = 'REJECTED'"),
    }


def pair_components(pairs: DataFrame) -> DataFrame:
    """(node, component): ids linked by pairs; the label is the smallest id as a string."""
    return connected_components(spanning_links(pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))))


def frame_indices(count: Column, fps: Column, target: int, min_gap: float = 0.0) -> Column:
    """Uniform, centred frame indices; the position is added up step by step in doubles, as the closed form differs."""
    n = count.cast("double")
    step = F.greatest(n / target, F.coalesce(fps, F.lit(0.0)) * min_gap) if min_gap else n / target
    start = F.struct((step / 2).alias("at"), F.array().cast("array<int>").alias("out"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(target)), start,
        lambda acc, _: F.struct((acc["at"] + step).alias("at"), F.when(acc["at"] < n, F.array_append(acc["out"], F.floor(acc["at"]).cast("int"))).otherwise(acc["out"]).alias("out")),
    )["out"]
    few = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(count <= target, few).otherwise(F.array_sort(F.array_distinct(walk)))


def expand_frames(videos: DataFrame, target: int, min_gap: float = 0.0) -> DataFrame:
    """Parents first re-statused, then one child for each sampled frame with the parent's label, method and group."""
    bad = F.col("frame_count") <= 0
    parents = videos.withColumns({
        "frame_index": F.lit(-1), "timestamp": F.lit(-1.0), "status": F.when(bad, "REJECTED").otherwise(F.col("status")),
        "rejection_reason": F.when(bad, "INVALID_DURATION").otherwise(F.col("rejection_reason")),
    })
    children = videos.filter(~bad).withColumn("frame_index", F.explode(frame_indices(F.col("frame_count"), F.col("fps"), target, min_gap))).withColumns({
        "sample_id": stable_id(F.col("dataset"), F.col("source_path"), F.col("frame_index")), "timestamp": F.bround(F.col("frame_index") / F.col("fps"), 3),
        "status": F.lit("PENDING"), "rejection_reason": F.lit(""),
    })
    return parents.unionByName(children)


def dataset_build(rows: DataFrame, seal: Seal, fraction: float = 0.2, seed: int = 42, near_bits: int | None = NEAR_BITS) -> DataFrame:
    """Duplicates -> seal -> guard -> split -> guards; the order is fixed and no guard can be skipped."""
    exact = cut(exact_duplicate_sets(rows))
    near = near_duplicate_keepers(rows, near_bits) if near_bits is not None and "phash" in rows.columns else None
    sealed = cut(seal_partition(assign_duplicate_status(rows, exact, near), seal))
    assert_clean(sealed.filter("status = 'ACCEPTED'"), seal)
    built = cut(group_split(sealed, fraction, seed))
    assert_no_leaks(built, exact)
    return built


def balance_caps(rows: DataFrame, per_group: int = 40, method_share: float = 0.4, source_share: float = 0.5, seed: int = 42) -> DataFrame:
    """A balanced training set by stated caps: rows per group, then shares per method and source, then fake rows up to real rows.

    Quotas grow with the table, so rows are numbered in hash cells; the cap of a group is a constant, which Spark pushes
    below the exchange.
    """
    first = F.row_number().over(Window.partitionBy("group_id").orderBy("_o"))
    capped = rows.withColumn("_o", seeded(seed, F.col("sample_id"))).withColumn("_r", first).filter(F.col("_r") <= per_group)
    for column, share in (("manipulation_method", method_share), ("dataset", source_share)):
        total = capped.groupBy("normalized_label").agg(F.count(F.lit(1)).alias("_t"))
        named = numbered_by(capped.join(total, "normalized_label"), ["normalized_label", column], "_o", "_r")
        free = (F.col("normalized_label") == "REAL") if column == "manipulation_method" else F.lit(False)
        capped = named.filter(free | (F.col("_r") <= F.floor(share * F.col("_t")))).drop("_t")
    real = capped.agg(F.sum(F.when(F.col("normalized_label") == "REAL", 1).otherwise(0)).alias("_real"))
    return numbered_by(capped.crossJoin(F.broadcast(real)), ["normalized_label"], "_o", "_r").filter((F.col("normalized_label") == "REAL") | (F.col("_r") <= F.col("_real"))).drop("_o", "_r", "_real")


def image_quality_filters(rows: DataFrame, blur_percentile: float = 0.05, max_yaw: float = 60.0, luma: tuple[float, float] = (30.0, 225.0), aspect: float = 3.0) -> DataFrame:
    """rows plus quality_reason from measured features: blur under its dataset's percentile, yaw, luma, aspect. A null dataset is one of its own."""
    ratio_ = F.greatest("width", "height") / F.nullif(F.least("width", "height"), F.lit(0))
    reason = (
        F.when(F.col("blur") < F.col("_cut"), "blurred").when(F.abs("yaw") > max_yaw, "yaw")
        .when((F.col("luma") < luma[0]) | (F.col("luma") > luma[1]), "luma").when(ratio_ > aspect, "aspect")
    )
    return with_percentiles(rows, rows, "blur", {"_cut": ("cont", blur_percentile)}, ["dataset"]).withColumn("quality_reason", reason).drop("_cut")

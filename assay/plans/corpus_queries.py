"""Queries of corpus preparation: labels, seal, duplicates, split, graph, adapters, jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.operators import adapters as ad
from assay.operators import corpus as c
from assay.plans.registry import query
from assay.plans.views import duck, table, view
from assay.session import shared_dir
from assay.sources import files as fl

MAN = duck("manifest")


def _case(expr: str, mapping: dict[str, str], other: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {other} END"


_LAB = _case("lower(trim(coalesce(original_label, '')))", c.LABELS, "'UNKNOWN'")
_VIA = "CASE WHEN lower(trim(coalesce(manipulation_method, ''))) <> '' THEN lower(trim(manipulation_method)) ELSE lower(trim(coalesce(original_label, ''))) END"
_FAM = f"CASE WHEN {_LAB} = 'REAL' THEN 'REAL' WHEN {_LAB} = 'FAKE' THEN {_case('(' + _VIA + ')', c.FAMILIES, chr(39) + 'UNKNOWN_FAKE' + chr(39))} ELSE 'UNKNOWN_FAKE' END"
FULL = f"SELECT *, {_LAB} AS normalized_label, {_FAM} AS manipulation_family FROM ({MAN})"


def manifest(spark, sf):
    df = view(spark, sf, "manifest")
    label, family = c.normalise_label(F.col("original_label"), F.col("manipulation_method"))
    return df.withColumns({"normalized_label": label, "manipulation_family": family})


def seal(spark, sf):
    groups = table(spark, sf, "documents").filter("source IN ('src3', 'src7')").select(F.col("source").alias("group_id"))
    return c.Seal(datasets=("es",), withheld="deepfakes-none", groups=groups)


_REASON = "CASE WHEN lower(dataset) LIKE 'es%' THEN concat('sealed dataset: ', lower(dataset)) WHEN group_id IN ('src3', 'src7') THEN concat('sealed group: ', group_id) END"


@query("b1_normalise_label", f"SELECT sample_id, original_label, normalized_label, manipulation_family FROM ({FULL})")
def _(spark, sf):
    return manifest(spark, sf).select("sample_id", "original_label", "normalized_label", "manipulation_family")


@query("b2_stable_id", "SELECT doc_id, concat(lang, '_', substr(sha1(concat_ws('|', lang, source, CAST(doc_id AS VARCHAR))), 1, 16)) AS sample_id FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", c.stable_id(F.col("lang"), F.col("source"), F.col("doc_id")).alias("sample_id"))


@query("b3_seal_reason", f"SELECT sample_id, {_REASON} AS seal_reason FROM ({MAN})")
def _(spark, sf):
    return seal(spark, sf).reasons(view(spark, sf, "manifest")).select("sample_id", "seal_reason")


@query("b4_seal_partition", f"SELECT sample_id, CASE WHEN r IS NULL THEN status ELSE 'SEALED' END AS status, rejection_reason, coalesce(r, '') AS notes FROM (SELECT *, {_REASON} AS r FROM ({MAN}))")
def _(spark, sf):
    return c.seal_partition(view(spark, sf, "manifest"), seal(spark, sf)).select("sample_id", "status", "rejection_reason", "notes")


@query("g2_seal_violations", f"SELECT sample_id, {_REASON} AS seal_reason FROM ({MAN}) WHERE status = 'ACCEPTED' AND {_REASON} IS NOT NULL")
def _(spark, sf):
    return c.seal_violations(view(spark, sf, "manifest").filter("status = 'ACCEPTED'"), seal(spark, sf))


@query("b15_label_mapping_gap", f"SELECT sample_id, concat('unmapped label ', original_label) AS notes FROM ({MAN}) WHERE original_label = 'mystery'")
def _(spark, sf):
    return c.label_gaps(view(spark, sf, "manifest")).select("sample_id", "notes")


_PATHS = """SELECT concat('root/', lang, '/', CAST(doc_id AS STRING), '.jpg') AS path, CASE doc_id % 4 WHEN 0 THEN 'real' WHEN 1 THEN 'Deepfakes' WHEN 2 THEN 'odd' ELSE 'fake' END AS label,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS grp, CASE WHEN doc_id % 4 = 3 THEN 'StyleGAN' ELSE '' END AS method, CASE WHEN doc_id % 3 = 0 THEN 'c23' ELSE '' END AS compression, lang AS subject FROM documents"""


@query("a2_manifest_round_trip", f"SELECT sample_id, dataset, normalized_label, status, face_count, face_count > 0 AS face_found FROM ({FULL})")
def _(spark, sf):
    """All 31 columns written by status in the shared folder and read back; no row is lost."""
    full = manifest(spark, sf)
    rows = full.select(*[(F.col(n) if n in full.columns else F.lit(None)).cast("string").alias(n) for n in fl.MANIFEST]).withColumn("face_found", (F.col("face_count").cast("int") > 0).cast("int").cast("string"))
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    fl.manifest_write(fl.typed_manifest(rows), path)
    return spark.read.parquet(path).select("sample_id", "dataset", "normalized_label", "status", "face_count", "face_found")


@query("a5_inventory", """SELECT concat('demo_', substr(sha1(concat_ws('|', 'demo', path, '-1')), 1, 16)) AS sample_id, path AS source_path, label AS original_label,
  CASE label WHEN 'real' THEN 'REAL' WHEN 'odd' THEN 'UNKNOWN' ELSE 'FAKE' END AS normalized_label, CASE label WHEN 'real' THEN 'REAL' WHEN 'odd' THEN 'UNKNOWN_FAKE' WHEN 'fake' THEN 'GAN' ELSE 'FACE_SWAP' END AS manipulation_family,
  coalesce(nullif(compression, ''), 'unknown') AS compression, coalesce(grp, '') AS group_id, CASE WHEN label = 'odd' OR grp IS NULL THEN 'REJECTED' ELSE 'PENDING' END AS status,
  CASE WHEN label = 'odd' THEN 'INVALID_LABEL' WHEN grp IS NULL THEN 'UNSAFE_GROUP' ELSE '' END AS rejection_reason FROM ({})""".format(_PATHS))
def _(spark, sf):
    paths = spark.sql(_PATHS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf, "documents"))
    return c.inventory(paths, "demo").select("sample_id", "source_path", "original_label", "normalized_label", "manipulation_family", "compression", "group_id", "status", "rejection_reason")


_FACES = """SELECT event_id, event_id % 13 <> 0 AS readable, CASE WHEN event_id % 2 = 0 THEN 'video' ELSE 'image' END AS media_type, CAST(event_id % 97 AS INT) AS width, CAST(20 + event_id % 89 AS INT) AS height,
  event_id % 7 <> 0 AS face_found, CAST(event_id % 4 AS INT) AS face_count, CAST(40 + event_id % 83 AS INT) AS face_side, CAST(event_id % 11 AS DOUBLE) / CAST(10 AS DOUBLE) - CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END AS face_score FROM events"""


@query("b5_face_quality_status", f"""SELECT event_id, CASE WHEN r = '' THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, r AS rejection_reason FROM (SELECT event_id, CASE WHEN NOT readable THEN CASE media_type WHEN 'video' THEN 'UNREADABLE_VIDEO' ELSE 'CORRUPT_FILE' END
  WHEN least(width, height) < 32 THEN 'INVALID_DIMENSIONS' WHEN NOT face_found THEN 'NO_FACE' WHEN face_side < 64 THEN 'FACE_TOO_SMALL' WHEN face_score >= 0 AND face_score < 0.6e0 THEN 'LOW_DETECTION_SCORE' WHEN face_count > 1 THEN 'MULTIPLE_FACE_POLICY' ELSE '' END AS r FROM ({_FACES}))""")
def _(spark, sf):
    rows = spark.sql(_FACES.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))
    return c.face_quality_status(rows, reject_multiple=True).select("event_id", "status", "rejection_reason")


_EXACT = f"SELECT sha256, list(sample_id ORDER BY ord) AS ids, count(DISTINCT group_id) AS n_groups FROM ({MAN}) WHERE status IN ('ACCEPTED', 'SEALED') AND sha256 <> '' GROUP BY sha256 HAVING count(*) > 1"


@query("d20_exact_duplicate_sets", f"SELECT sha256, len(ids) AS n, n_groups, ids[1] AS first_id, array_to_string(ids[:20], ',') AS ids FROM ({_EXACT})")
def _(spark, sf):
    return c.exact_duplicate_sets(view(spark, sf, "manifest")).withColumn("ids", F.array_join("ids", ",")).drop("first_ord")


def hashed(spark, sf):
    return view(spark, sf, "hash").withColumn("phash", F.conv("signs", 2, -10).cast("bigint")).drop("signs")


_NEAR = "SELECT x.group_id, x.sample_id AS a, y.sample_id AS b, hamming(x.signs, y.signs) AS bits FROM h x JOIN h y ON x.group_id = y.group_id AND x.sample_id < y.sample_id AND hamming(x.signs, y.signs) <= 22"


@query("c10_near_pairs", f"WITH h AS ({duck('hash')}) {_NEAR}")
def _(spark, sf):
    return c.near_pairs(hashed(spark, sf), 22)


_FIRST = f"SELECT group_id, signs, min(sample_id) AS sample_id FROM ({duck('hash')}) GROUP BY group_id, signs"


@query("c10_near_classes", f"WITH h AS ({_FIRST}) {_NEAR}")
def _(spark, sf):
    """Pairs between the first rows of the distinct hashes."""
    return c.near_classes(hashed(spark, sf), 22)[0]


@query("c10_class_members", f"SELECT group_id, h.sample_id, f.sample_id AS first FROM ({duck('hash')}) h JOIN ({_FIRST}) f USING (group_id, signs)")
def _(spark, sf):
    return c.near_classes(hashed(spark, sf), 22)[1]


@query("e1_near_duplicate_keepers", f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sample_id) AS rn FROM ({duck('hash')})),
  walk AS (SELECT DISTINCT group_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id BIGINT, signs VARCHAR)[]) AS kept, CAST(NULL AS BIGINT) AS keeper, CAST(NULL AS BIGINT) AS dropped FROM h
    UNION ALL SELECT group_id, rn, CASE WHEN near = [] THEN list_append(kept, {{'id': sample_id, 'signs': signs}}) ELSE kept END, CASE WHEN near <> [] THEN near[1].id END, CASE WHEN near <> [] THEN sample_id END
    FROM (SELECT h.group_id, h.rn, h.sample_id, h.signs, w.kept, list_filter(w.kept, lambda k: hamming(k.signs, h.signs) <= 22) AS near FROM walk w JOIN h ON h.group_id = w.group_id AND h.rn = w.rn + 1))
  SELECT keeper, dropped FROM walk WHERE dropped IS NOT NULL""")
def _(spark, sf):
    return c.near_duplicate_keepers(hashed(spark, sf), 22)


_E2 = f"""WITH m AS ({MAN}), e AS ({_EXACT}), marks AS (SELECT unnest(ids) AS id, 0 AS p FROM e WHERE n_groups > 1 UNION ALL SELECT unnest(ids[2:]), 1 FROM e), best AS (SELECT id, min(p) AS p FROM marks GROUP BY id)
  SELECT sample_id, CASE WHEN p IS NOT NULL AND status = 'ACCEPTED' THEN 'REJECTED' ELSE status END AS status,
  CASE WHEN p IS NOT NULL AND status = 'ACCEPTED' THEN CASE p WHEN 0 THEN 'UNSAFE_GROUP' ELSE 'EXACT_DUPLICATE' END ELSE rejection_reason END AS rejection_reason FROM m LEFT JOIN best ON id = sample_id"""


@query("e2_assign_duplicate_status", _E2)
def _(spark, sf):
    rows = view(spark, sf, "manifest")
    return c.assign_duplicate_status(rows, c.exact_duplicate_sets(rows)).select("sample_id", "status", "rejection_reason")


_SPLIT = """SELECT group_id, CASE WHEN sum(n) OVER (ORDER BY md5(concat('42', group_id))) - n < 0.2e0 * sum(n) OVER () THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT group_id, count(*) AS n FROM m WHERE status = 'ACCEPTED' GROUP BY group_id)"""


@query("e3_group_split", f"WITH m AS ({MAN}), s AS ({_SPLIT}) SELECT sample_id, s.split FROM m LEFT JOIN s ON m.group_id = s.group_id AND m.status = 'ACCEPTED'")
def _(spark, sf):
    return c.group_split(view(spark, sf, "manifest")).select("sample_id", "split")


@query("e3_split_share", f"WITH m AS ({MAN}), s AS ({_SPLIT}) SELECT split, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups, count(*) / sum(count(*)) OVER () AS share FROM m JOIN s USING (group_id) WHERE status = 'ACCEPTED' GROUP BY split", ("share",))
def _(spark, sf):
    return c.split_share(c.group_split(view(spark, sf, "manifest")))


_GROUPS = "SELECT l_suppkey AS group_id, count(*) FILTER (WHERE l_returnflag = 'R') AS n_fake, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 40) AS n_real FROM lineitem GROUP BY l_suppkey"


@query("e4_two_quota_holdout", f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42', CAST(group_id AS VARCHAR)))) AS rn FROM ({_GROUPS}) WHERE n_fake > 0 OR n_real > 0),
  walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS took
    UNION ALL SELECT g.rn, f + CASE WHEN help THEN n_fake ELSE 0 END, r + CASE WHEN help THEN n_real ELSE 0 END, CASE WHEN help THEN group_id END
    FROM (SELECT w.f, w.r, g.rn, g.group_id, g.n_fake, g.n_real, (w.f < 4000 AND g.n_fake > 0) OR (w.r < 1500 AND g.n_real > 0) AS help FROM walk w JOIN g ON g.rn = w.rn + 1) g)
  SELECT g.group_id, g.n_fake, g.n_real FROM walk JOIN g ON g.group_id = walk.took""")
def _(spark, sf):
    groups = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("group_id")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n_fake"), F.count_if((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40)).alias("n_real"))
    return c.two_quota_holdout(groups, 4000, 1500)


def _halves(spark, sf):
    docs = table(spark, sf, "documents").withColumn("path", F.sha2("text", 256))
    return docs.filter("doc_id % 3 <> 0").select("path"), docs.filter("doc_id % 3 = 0").select("path", F.col("lang").alias("holdout"))


@query("c6_path_leakage", """SELECT h.holdout, count(DISTINCT CASE WHEN path IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 <> 0) THEN path END) AS shared
  FROM (SELECT sha256(text) AS path, lang AS holdout FROM documents WHERE doc_id % 3 = 0) h GROUP BY h.holdout""")
def _(spark, sf):
    return c.path_leakage(*_halves(spark, sf))


_DIRTY = f"SELECT *, CASE WHEN status <> 'ACCEPTED' THEN NULL WHEN ord % 11 = 0 AND group_id = 'src1' THEN 'validation' WHEN group_id IN ('src2', 'src4') THEN 'validation' ELSE 'train' END AS split, CASE WHEN group_id = 'src4' AND ord % 13 = 0 THEN 'SEALED' ELSE status END AS st FROM ({MAN})"


def dirty(spark, sf):
    split = F.expr("CASE WHEN status <> 'ACCEPTED' THEN NULL WHEN ord % 11 = 0 AND group_id = 'src1' THEN 'validation' WHEN group_id IN ('src2', 'src4') THEN 'validation' ELSE 'train' END")
    return view(spark, sf, "manifest").withColumn("split", split).withColumn("status", F.expr("CASE WHEN group_id = 'src4' AND ord % 13 = 0 THEN 'SEALED' ELSE status END"))


@query("c7_group_leakage", f"""SELECT group_id, string_agg(DISTINCT side, ',' ORDER BY side) AS sides FROM (SELECT group_id, CASE WHEN st = 'SEALED' THEN 'sealed' ELSE split END AS side FROM ({_DIRTY}))
  WHERE side IS NOT NULL GROUP BY group_id HAVING count(DISTINCT side) > 1""")
def _(spark, sf):
    return c.group_leakage(dirty(spark, sf))


@query("c8_duplicate_leakage", f"""WITH d AS ({_DIRTY}), e AS (SELECT sha256, list(sample_id) AS ids, count(DISTINCT group_id) AS n_groups FROM d WHERE st IN ('ACCEPTED', 'SEALED') GROUP BY sha256 HAVING count(*) > 1)
  SELECT sha256, CASE WHEN sides > 1 THEN 'two sides' ELSE 'survivor of a cross-group set' END AS problem FROM (SELECT e.sha256, count(DISTINCT split) AS sides, bool_or(n_groups > 1 AND st = 'ACCEPTED') AS survivor
  FROM (SELECT sha256, n_groups, unnest(ids) AS id FROM e) e JOIN d ON d.sample_id = e.id GROUP BY e.sha256) WHERE sides > 1 OR survivor""")
def _(spark, sf):
    rows = dirty(spark, sf)
    return c.duplicate_leakage(c.exact_duplicate_sets(rows), rows)


def _dims(rows: str) -> str:
    parts = [f"SELECT '{d}' AS dimension, coalesce(nullif({d}, ''), '(none)') AS key, count(*) AS n FROM ({rows}) WHERE status = 'ACCEPTED' GROUP BY 2" for d in c.DIMENSIONS]
    parts += [f"SELECT 'status', status, count(*) FROM ({rows}) GROUP BY 2", f"SELECT 'rejection_reason', rejection_reason, count(*) FROM ({rows}) WHERE rejection_reason <> '' GROUP BY 2"]
    return "SELECT dimension, key, n, n / sum(n) OVER (PARTITION BY dimension) AS share FROM (" + " UNION ALL ".join(parts) + ")"


@query("d18_composition", _dims(FULL), ("share",))
def _(spark, sf):
    return c.composition(manifest(spark, sf))


@query("d18_corpus_totals", f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ACCEPTED') AS accepted, count(DISTINCT group_id) FILTER (WHERE status = 'ACCEPTED') AS groups, count(*) FILTER (WHERE status = 'ACCEPTED' AND face_count = 1) AS faces_found,
  count(*) FILTER (WHERE status = 'ACCEPTED' AND face_count = 0) AS faces_none, count(*) FILTER (WHERE status = 'ACCEPTED' AND face_count > 1) AS faces_multiple FROM ({MAN})""")
def _(spark, sf):
    return c.corpus_totals(view(spark, sf, "manifest"))


@query("d18_groups_per_dataset", f"SELECT dataset, count(DISTINCT group_id) AS groups, count(*) AS n FROM ({MAN}) WHERE status = 'ACCEPTED' GROUP BY dataset")
def _(spark, sf):
    return c.groups_per_dataset(view(spark, sf, "manifest"))


_G1 = f"WITH m AS ({MAN}), s AS ({_SPLIT}), r AS (SELECT m.status, s.split FROM m LEFT JOIN s ON m.group_id = s.group_id AND m.status = 'ACCEPTED')"


@query("g1_split_outputs", f"""{_G1} SELECT 'all' AS output, count(*) AS n FROM r UNION ALL SELECT 'train', count(*) FROM r WHERE split = 'train' UNION ALL SELECT 'validation', count(*) FROM r WHERE split = 'validation'
  UNION ALL SELECT 'sealed', count(*) FROM r WHERE status = 'SEALED' UNION ALL SELECT 'rejected', count(*) FROM r WHERE status = 'REJECTED'""")
def _(spark, sf):
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("output"), "n") for k, df in c.outputs(c.group_split(view(spark, sf, "manifest"))).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("g3_additive_union", "SELECT DISTINCT group_id FROM (SELECT source AS group_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT concat(source, ':', lang) FROM documents WHERE doc_id % 5 = 0)")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    old = docs.filter("doc_id % 2 = 0").select(F.col("source").alias("group_id"))
    new = docs.filter("doc_id % 5 = 0").select(F.concat_ws(":", "source", "lang").alias("group_id"))
    return old.union(new).distinct()


@query("g4_shared_ids", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def _(spark, sf):
    items = table(spark, sf, "lineitem")
    return items.filter("l_quantity > 45").select(F.col("l_partkey").alias("id")).intersect(items.filter("l_discount > 0.08").select("l_partkey")).orderBy("id")


_H1 = f"""WITH RECURSIVE e AS ({duck('edges')}), links AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
  cc(node, component) USING KEY (node) AS (SELECT DISTINCT x, x FROM links
    UNION SELECT l.y, min(c.component) FROM cc c JOIN links l ON l.x = c.node JOIN recurring.cc r ON r.node = l.y WHERE c.component < r.component GROUP BY l.y)
  SELECT node, component FROM cc"""


@query("h1_pair_components", _H1)
def _(spark, sf):
    """The view's links as they lie in the table, repeats included: thinned out before anything is shuffled."""
    return c.pair_components(table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")))


_VIDEOS = "SELECT lang AS dataset, concat('v/', CAST(doc_id AS STRING), '.mp4') AS source_path, source AS group_id, CAST(n_chars % 97 AS INT) AS frame_count, CAST(5 + doc_id % 26 AS DOUBLE) AS fps FROM documents"


def videos(spark, sf):
    df = spark.sql(_VIDEOS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf, "documents"))
    return df.withColumns({"sample_id": c.stable_id(F.col("dataset"), F.col("source_path"), F.lit(-1)), "frame_index": F.lit(-1), "timestamp": F.lit(-1.0), "status": F.lit("PENDING"), "rejection_reason": F.lit("")})


_FRAMES = f"""WITH RECURSIVE v AS ({_VIDEOS}), walk AS (SELECT source_path, frame_count, CAST(frame_count AS DOUBLE) / 8e0 AS step, CAST(frame_count AS DOUBLE) / 8e0 / 2e0 AS pos, 1 AS i FROM v WHERE frame_count > 8
    UNION ALL SELECT source_path, frame_count, step, pos + step, i + 1 FROM walk WHERE i < 8),
  idx AS (SELECT DISTINCT source_path, CAST(floor(pos) AS INT) AS frame_index FROM walk WHERE pos < frame_count UNION ALL SELECT source_path, unnest(range(frame_count))::INT FROM v WHERE frame_count > 0 AND frame_count <= 8)
  SELECT concat(dataset, '_', substr(sha1(concat_ws('|', dataset, source_path, CAST(frame_index AS VARCHAR))), 1, 16)) AS sample_id, source_path, group_id, frame_index, 'PENDING' AS status, '' AS rejection_reason FROM v JOIN idx USING (source_path)
  UNION ALL SELECT concat(dataset, '_', substr(sha1(concat_ws('|', dataset, source_path, '-1')), 1, 16)), source_path, group_id, -1, CASE WHEN frame_count <= 0 THEN 'REJECTED' ELSE 'PENDING' END, CASE WHEN frame_count <= 0 THEN 'INVALID_DURATION' ELSE '' END FROM v"""


@query("h2_expand_frames", _FRAMES)
def _(spark, sf):
    return c.expand_frames(videos(spark, sf), 8).select("sample_id", "source_path", "group_id", "frame_index", "status", "rejection_reason")


@query("j5_expand_frames_udtf", _FRAMES.split("SELECT concat(dataset")[0] + "SELECT source_path, frame_index FROM idx")
def _(spark, sf):
    from pyspark.sql.functions import udtf

    @udtf(returnType="frame_index int")
    class SampledFrames:
        """The lateral-SQL twin of the column form."""

        def eval(self, count: int, target: int):
            if count <= 0 or target <= 0:
                return
            if count <= target:
                yield from ((i,) for i in range(count))
                return
            step, seen = count / target, set()
            at = step / 2
            for _ in range(target):
                if at < count and int(at) not in seen:
                    seen.add(int(at))
                    yield (int(at),)
                at += step

    spark.udtf.register("sampled_frames", SampledFrames)
    return spark.sql("SELECT v.source_path, f.frame_index FROM {v} v, LATERAL sampled_frames(v.frame_count, 8) f", v=videos(spark, sf))


@query("h5_hamming", """WITH d AS (SELECT doc_id, md5(text)[1:16] AS a, md5(concat(text, 'x'))[1:CASE WHEN doc_id % 9 = 0 THEN 12 ELSE 16 END] AS b FROM documents)
  SELECT doc_id, CASE WHEN length(a) <> length(b) THEN 64 ELSE bit_count(xor(CAST(concat('0x', a) AS UBIGINT), CAST(concat('0x', b) AS UBIGINT))) END AS bits FROM d""")
def _(spark, sf):
    a = F.substring(F.md5(F.col("text").cast("binary")), 1, 16)
    b = F.substring(F.md5(F.concat("text", F.lit("x")).cast("binary")), 1, 16)
    short = F.when(F.col("doc_id") % 9 == 0, F.substring(b, 1, 12)).otherwise(b)
    return table(spark, sf, "documents").select("doc_id", c.hamming_hex(a, short).alias("bits"))


_NAMED = "SELECT doc_id, concat('root/', lang, '/', CASE WHEN doc_id % 4 = 0 THEN concat('Ann_Lee_', CAST(doc_id % 30 AS STRING)) ELSE concat('p', CAST(doc_id % 50 AS STRING)) END, CASE WHEN doc_id % 3 = 0 THEN '__cond-phone' ELSE '' END, '.jpg') AS path FROM documents"
_STEM = "regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')"


def _named(spark, sf):
    return spark.sql(_NAMED.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf, "documents"))


@query("h6_group_from_path", f"SELECT doc_id, split_part({_STEM}, '__cond-', 1) AS grp FROM ({_NAMED})")
def _(spark, sf):
    return _named(spark, sf).select("doc_id", ad.group_from_path(F.col("path")).alias("grp"))


@query("h7_person_from_filename", f"SELECT doc_id, regexp_replace(split_part({_STEM}, '__', 1), '_\\d+$', '') AS person FROM ({_NAMED})")
def _(spark, sf):
    return _named(spark, sf).select("doc_id", ad.person_from_filename(F.col("path")).alias("person"))


# ---- adapters: paths made from table keys
_FF = """SELECT concat('ff/', CASE WHEN l_linenumber % 3 = 0 THEN 'original_sequences/youtube/raw/' WHEN l_linenumber % 3 = 1 THEN 'manipulated_sequences/Deepfakes/c23/' ELSE 'manipulated_sequences/NeuralTextures/c40/' END,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_partkey AS STRING) ELSE concat(CAST(l_partkey AS STRING), '_', CAST(l_suppkey + 100000 AS STRING)) END, '.mp4') AS path FROM lineitem"""
_FF_SQL = f"""WITH RECURSIVE p AS (SELECT DISTINCT path, {_STEM} AS stem FROM ({_FF})), e AS (SELECT split_part(stem, '_', 1) AS a, split_part(stem, '_', 2) AS b FROM p WHERE stem LIKE '%\\_%' ESCAPE '\\'),
  links AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
  cc(node, component) USING KEY (node) AS (SELECT DISTINCT x, x FROM links
    UNION SELECT l.y, min(c.component) FROM cc c JOIN links l ON l.x = c.node JOIN recurring.cc r ON r.node = l.y WHERE c.component < r.component GROUP BY l.y),
  comp AS (SELECT node, component AS c FROM cc)
  SELECT path, CASE WHEN path LIKE '%manipulated%' THEN 'fake' ELSE 'real' END AS label, concat('ffpp:', coalesce(c, split_part(stem, '_', 1))) AS grp,
  CASE WHEN path LIKE '%/Deepfakes/%' THEN 'deepfakes' WHEN path LIKE '%NeuralTextures%' THEN 'neuraltextures' ELSE '' END AS method, CASE WHEN path LIKE '%/raw/%' THEN 'raw' WHEN path LIKE '%/c23/%' THEN 'c23' ELSE 'c40' END AS compression, '' AS subject
  FROM p LEFT JOIN comp ON comp.node = split_part(stem, '_', 1)"""


def _sql(spark, sf, text, name):
    return spark.sql(text.replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf, name))


@query("j1_1_adapter_ffpp", _FF_SQL)
def _(spark, sf):
    return ad.adapt("ffpp", _sql(spark, sf, _FF, "lineitem"), once=True)


_CLIPS = "SELECT concat('clip', CAST(event_id AS STRING), '.mp4') AS clip, CASE WHEN event_id % 2 = 0 THEN 'fake' ELSE 'real' END AS label, CASE WHEN event_id % 2 = 0 THEN concat('clip', CAST(user_id AS STRING), '.mp4') ELSE concat('clip', CAST(event_id AS STRING), '.mp4') END AS original FROM events WHERE event_id % 5 <> 0"


@query("j1_2_adapter_dfdc", f"""SELECT e.path, coalesce(c.label, '') AS label, concat('dfdc:', regexp_replace(original, '\\.[^.]*$', '')) AS grp, CASE WHEN c.label = 'fake' THEN 'dfdc' ELSE '' END AS method, 'unknown' AS compression, '' AS subject
  FROM (SELECT concat('dfdc/part/clip', CAST(event_id AS VARCHAR), '.mp4') AS path, concat('clip', CAST(event_id AS VARCHAR), '.mp4') AS name FROM events) e LEFT JOIN ({_CLIPS}) c ON c.clip = e.name""".replace("concat('dfdc:', regexp", "'dfdc:' || (regexp"))
def _(spark, sf):
    paths = table(spark, sf, "events").select(F.concat(F.lit("dfdc/part/clip"), F.col("event_id").cast("string"), F.lit(".mp4")).alias("path"))
    return ad.adapt("dfdc", paths, clips=_sql(spark, sf, _CLIPS, "events"))


_CELEB = """SELECT concat('celeb/', CASE WHEN l_linenumber % 4 = 0 THEN 'Celeb-real/id' WHEN l_linenumber % 4 = 3 THEN 'YouTube-real/' ELSE 'Celeb-synthesis/id' END,
  CASE WHEN l_linenumber % 4 = 0 THEN concat(CAST(l_partkey AS STRING), '_0001') WHEN l_linenumber % 4 = 3 THEN concat('x', CAST(l_orderkey AS STRING)) ELSE concat(CAST(l_partkey AS STRING), '_id', CAST(l_suppkey + 100000 AS STRING), '_0002') END, '.mp4') AS path FROM lineitem"""


@query("j1_3_adapter_celebdf", f"""WITH RECURSIVE p AS (SELECT DISTINCT path, {_STEM} AS stem FROM ({_CELEB})), i AS (SELECT *, nullif(regexp_extract(stem, '^id(\\d+)_', 1), '') AS a, nullif(regexp_extract(stem, '^id\\d+_id(\\d+)_\\d+$', 1), '') AS b FROM p),
  links AS (SELECT a AS x, b AS y FROM i WHERE b IS NOT NULL UNION SELECT b, a FROM i WHERE b IS NOT NULL),
  cc(node, component) USING KEY (node) AS (SELECT DISTINCT x, x FROM links
    UNION SELECT l.y, min(c.component) FROM cc c JOIN links l ON l.x = c.node JOIN recurring.cc r ON r.node = l.y WHERE c.component < r.component GROUP BY l.y),
  comp AS (SELECT node, component AS c FROM cc)
  SELECT path, CASE WHEN path LIKE '%synthesis/%' THEN 'celeb-synthesis' ELSE 'real' END AS label, CASE WHEN a IS NOT NULL THEN 'celebdf:' || coalesce(c, a) ELSE 'celebdf:youtube:' || stem END AS grp,
  CASE WHEN path LIKE '%synthesis%' THEN 'celeb-synthesis' ELSE '' END AS method, 'unknown' AS compression, '' AS subject FROM i LEFT JOIN comp ON comp.node = a""")
def _(spark, sf):
    return ad.adapt("celebdf", _sql(spark, sf, _CELEB, "lineitem"), once=True)


_DEEPER = "SELECT concat('df/', CASE WHEN doc_id % 3 = 0 THEN 'source_videos/' WHEN doc_id % 3 = 1 THEN 'manipulated_videos/end_to_end/' ELSE 'misc/' END, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE concat(CASE WHEN doc_id % 2 = 0 THEN 'm' ELSE 'W' END, lpad(CAST(doc_id % 100 AS STRING), 3, '0')) END, '_', CAST(doc_id AS STRING), '.mp4') AS path FROM documents"
_ACTOR = "upper(nullif(regexp_extract(path, '(?i)(?:^|[_/])([MW]\\d{3})', 1), ''))"


@query("j1_4_adapter_deeperforensics", f"""SELECT path, CASE WHEN path LIKE '%manipulated%' THEN 'fake' WHEN path LIKE '%source%' THEN 'real' ELSE '' END AS label, 'deeperforensics:' || {_ACTOR} AS grp,
  CASE WHEN path LIKE '%manipulated%' THEN 'deeperforensics' ELSE '' END AS method, 'unknown' AS compression, coalesce({_ACTOR}, '') AS subject FROM ({_DEEPER})""")
def _(spark, sf):
    return ad.adapt("deeperforensics", _sql(spark, sf, _DEEPER, "documents"))


_PHONE = "SELECT concat('phone/', CAST(doc_id AS STRING), '.jpg') AS path FROM documents"
_SIDE = "SELECT concat('old/', CAST(doc_id AS STRING), '.jpg') AS path, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS grp FROM documents WHERE doc_id % 3 = 0"


@query("j1_5_adapter_phone", f"""SELECT p.path, 'real' AS label, 'phone:' || nullif(s.grp, '') AS grp, '' AS method, 'jpeg' AS compression, '' AS subject FROM ({_PHONE}) p LEFT JOIN ({_SIDE}) s ON string_split(s.path, '/')[-1] = string_split(p.path, '/')[-1]""")
def _(spark, sf):
    return ad.adapt("phone", _sql(spark, sf, _PHONE, "documents"), groups=_sql(spark, sf, _SIDE, "documents").withColumnRenamed("grp", "group"))


_GEN = "SELECT concat('gen/', CASE doc_id % 4 WHEN 0 THEN 'StyleGAN2/' WHEN 1 THEN 'stylegan/' WHEN 2 THEN 'stable-diffusion/' ELSE 'other/' END, CAST(doc_id AS STRING), '.png') AS path FROM documents"


@query("j1_6_adapter_generated", f"SELECT path, 'fake' AS label, 'generated:' || {_STEM} AS grp, CASE WHEN path LIKE '%GAN2%' THEN 'stylegan2' WHEN path LIKE '%stylegan%' THEN 'stylegan' WHEN path LIKE '%diffusion%' THEN 'diffusion' ELSE '' END AS method, 'jpeg' AS compression, '' AS subject FROM ({_GEN})")
def _(spark, sf):
    return ad.adapt("generated", _sql(spark, sf, _GEN, "documents"))


@query("j1_7_adapter_lfw", f"SELECT path, 'real' AS label, 'lfw:' || regexp_replace(split_part({_STEM}, '__', 1), '_\\d+$', '') AS grp, '' AS method, 'jpeg' AS compression, regexp_replace(split_part({_STEM}, '__', 1), '_\\d+$', '') AS subject FROM ({_NAMED})")
def _(spark, sf):
    return ad.adapt("lfw", _named(spark, sf).select("path"))


_LOCAL = "SELECT concat('clips/', CASE doc_id % 3 WHEN 0 THEN 'authentic_' WHEN 1 THEN 'Synthetic_' ELSE 'clip_' END, CAST(doc_id AS STRING), '.mp4') AS path FROM documents"


@query("j1_8_adapter_local_clips", f"SELECT path, CASE WHEN path LIKE '%authentic%' THEN 'real' WHEN path LIKE '%Synthetic%' THEN 'fake' ELSE '' END AS label, 'local_clips:' || {_STEM} AS grp, CASE WHEN path LIKE '%Synthetic%' THEN 'stylegan2' ELSE '' END AS method, 'unknown' AS compression, '' AS subject FROM ({_LOCAL})")
def _(spark, sf):
    return ad.adapt("local_clips", _sql(spark, sf, _LOCAL, "documents"))


_LISTED = "CASE WHEN group_id IN ('src3', 'src7') THEN concat('sealed group: ', group_id) END"


def build(spark, sf):
    """Sealed by whole groups: a seal that cut through groups would be refused by the last guard."""
    rows = manifest(spark, sf).withColumn("split", F.lit(None).cast("string"))
    return c.dataset_build(rows, c.Seal(datasets=(), withheld="", groups=seal(spark, sf).groups))


@query("j6_dataset_build", f"""WITH e2 AS ({_E2}), m AS (SELECT a.sample_id, a.ord, a.dataset, a.group_id, a.r, CASE WHEN a.r IS NULL THEN e2.status ELSE 'SEALED' END AS status, e2.rejection_reason FROM (SELECT *, {_LISTED} AS r FROM ({MAN})) a JOIN e2 USING (sample_id)), s AS ({_SPLIT})
  SELECT m.sample_id, m.status, m.rejection_reason, coalesce(m.r, '') AS notes, s.split FROM m LEFT JOIN s ON m.group_id = s.group_id AND m.status = 'ACCEPTED'""")
def _(spark, sf):
    return build(spark, sf).select("sample_id", "status", "rejection_reason", "notes", "split")


@query("j8_dataset_build_report", _dims(FULL.replace("SELECT *,", "SELECT * REPLACE (e2_status AS status, e2_reason AS rejection_reason),", 1).replace(f"FROM ({MAN})", f"FROM (SELECT x.*, e.status AS e2_status, e.rejection_reason AS e2_reason FROM ({MAN}) x JOIN ({_E2}) e USING (sample_id))")), ("share",))
def _(spark, sf):
    rows = manifest(spark, sf)
    return c.composition(c.assign_duplicate_status(rows, c.exact_duplicate_sets(rows)))


def _order(x: str = "sample_id") -> str:
    return f"md5(concat('42', {x}))"


@query("k2_balance_caps", f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {_order()}) AS r FROM ({FULL}) WHERE status = 'ACCEPTED'), b AS (SELECT * FROM a WHERE r <= 40),
  c AS (SELECT *, count(*) OVER (PARTITION BY normalized_label) AS t, row_number() OVER (PARTITION BY normalized_label, manipulation_method ORDER BY {_order()}) AS r2 FROM b),
  d AS (SELECT * FROM c WHERE normalized_label = 'REAL' OR r2 <= floor(0.4e0 * t)), e AS (SELECT *, count(*) OVER (PARTITION BY normalized_label) AS t2, row_number() OVER (PARTITION BY normalized_label, dataset ORDER BY {_order()}) AS r3 FROM d),
  f AS (SELECT * FROM e WHERE r3 <= floor(0.5e0 * t2)), g AS (SELECT *, count(*) FILTER (WHERE normalized_label = 'REAL') OVER () AS n_real, row_number() OVER (PARTITION BY normalized_label ORDER BY {_order()}) AS r4 FROM f)
  SELECT sample_id, normalized_label, group_id, dataset, manipulation_method FROM g WHERE normalized_label = 'REAL' OR r4 <= n_real""")
def _(spark, sf):
    return c.balance_caps(manifest(spark, sf).filter("status = 'ACCEPTED'")).select("sample_id", "normalized_label", "group_id", "dataset", "manipulation_method")


_MEASURED = "SELECT doc_id, lang AS dataset, CAST(n_chars % 101 AS DOUBLE) AS blur, CAST(doc_id % 180 - 90 AS DOUBLE) AS yaw, CAST(n_chars % 256 AS DOUBLE) AS luma, CAST(1 + doc_id % 37 AS INT) AS width, CAST(1 + n_chars % 29 AS INT) AS height FROM documents"


@query("k3_image_quality_filters", f"""WITH m AS ({_MEASURED}), q AS (SELECT dataset, quantile_cont(blur, 0.05) AS cut FROM m GROUP BY dataset)
  SELECT doc_id, CASE WHEN blur < cut THEN 'blurred' WHEN abs(yaw) > 60 THEN 'yaw' WHEN luma < 30 OR luma > 225 THEN 'luma' WHEN greatest(width, height)::DOUBLE / least(width, height) > 3 THEN 'aspect' END AS quality_reason FROM m JOIN q USING (dataset)""")
def _(spark, sf):
    return c.image_quality_filters(_sql(spark, sf, _MEASURED, "documents")).select("doc_id", "quality_reason")



"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import ann, langid, lm, toxicity
from assay.llm.common import LOWER, UPPER, held_out, read
from assay.llm.decontamination import contamination
from assay.llm.lexical import rank_documents
from assay.llm.linededup import dedup_lines
from assay.llm.merkle import tamper_check
from assay.llm.mixing import mix
from assay.llm.sharding import shard_rows
from assay.llm.simhash import components
from assay.llm.tokencount import section_tokens
from assay.llm.vectordup import near_duplicates

SHARDS = 24


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    return mix(docs, text="text_hash").select(
        "doc_id", "source", "weight", "phase", "block", "slot", "release", "deadline", "mix_position"
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 10, 0)
    docs = read(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    model = lm.fit(docs.filter("NOT held_out"))
    return lm.score(docs, model)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return report.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_rows(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.filter(~held))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from documents whose crc32(doc_id) mod 5 is not 0."""
    labels = read(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 5, 0))
    return toxicity.fit(docs, labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, docs, sf_dir)
    scored = toxicity.score(docs.withColumn("held_out", held_out(F.col("doc_id"), 5, 0)), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(read(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 10)


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"), 0.93)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_check(read(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_ann": op5_ann,
    "op6_sharding": op6_sharding,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_BITS = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
_CRC = f"xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: {_BITS}, CAST(4294967295 AS BIGINT)), 4294967295)"
ORACLES: dict[str, str] = {
    "op11_lexical_search": rf"""
WITH word AS (
  SELECT r, doc_id, w, count(*) AS tf
  FROM (SELECT r, doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w
        FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents))
  GROUP BY r, doc_id, w),
size AS (SELECT r, doc_id, CAST(sum(tf) AS BIGINT) AS n FROM word GROUP BY r, doc_id),
every AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM size),
m AS (SELECT r, 25 + (75 * n * docs) // l AS m FROM size, every),
ask AS (
  SELECT item_id, w, count(*) AS q
  FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark)
  GROUP BY item_id, w),
gain AS (
  SELECT w, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS g
  FROM (SELECT w, count(*) AS df FROM word GROUP BY w), every),
scored AS (
  SELECT item_id, doc_id, word.r, CAST(sum(q * g * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM ask JOIN word USING (w) JOIN gain USING (w) JOIN m ON m.r = word.r GROUP BY item_id, doc_id, word.r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10""",
    "op12_vector_dedup": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low ON a = vec_id""",
    "op13_merkle_manifest": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, {_LEAF.format(text="text")} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
  FROM documents),
node AS (
  SELECT lang, 0 AS k, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM d
  UNION ALL
  SELECT lang, k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM node WHERE n > 1 GROUP BY lang, k, i // 8),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (
  SELECT 0 AS k, i, h, n FROM sub
  UNION ALL
  SELECT k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY k, i // 8),
met AS (
  SELECT d.doc_id, s.k AS step, s.i, s.h, d.i // CAST(8 ** s.k AS BIGINT) AS own
  FROM d JOIN node s ON d.lang IS NOT DISTINCT FROM s.lang AND s.i // 8 = d.i // CAST(8 ** (s.k + 1) AS BIGINT) WHERE s.n > 1
  UNION ALL
  SELECT d.doc_id, 1000 + s.k, s.i, s.h, sub.i // CAST(8 ** s.k AS BIGINT)
  FROM d JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang JOIN top s ON s.i // 8 = sub.i // CAST(8 ** (s.k + 1) AS BIGINT) WHERE s.n > 1),
step AS (
  SELECT doc_id, step, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i < own), '') AS l, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i > own), '') AS r
  FROM met GROUP BY doc_id, step),
way AS (SELECT doc_id, list({{'l': l, 'r': r}} ORDER BY step) AS steps, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM step GROUP BY doc_id)
SELECT doc_id, leaf, sub.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (
  SELECT d.*, proof, (SELECT h FROM top WHERE n = 1) AS root,
    list_reduce(list_prepend({{'l': coalesce(tampered, leaf), 'r': ''}}, coalesce(steps, [])), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
  FROM d LEFT JOIN way USING (doc_id)) x JOIN sub ON x.lang IS NOT DISTINCT FROM sub.lang""",
    "op3_decontamination": rf"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(doc.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op10_line_dedup": rf"""
WITH line AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
common AS (
  SELECT k, max(doc_id) AS top_doc FROM line WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, c.top_doc IS NOT NULL AND c.top_doc <> l.doc_id AS gone FROM line l LEFT JOIN common c USING (k))
GROUP BY doc_id""",
}

"""Benchmark decontamination by word windows (DataFrame functions only).

Texts are lower-cased (A-Z) and cut into words. Every run of `width` words of a benchmark item is a window; an item
of fewer words, but not none, is one window by itself. One pass over the documents' words looks for windows:

* the hash of the up to ANCHOR words from each position is tested against those of the windows, which few positions pass;
* there the hash of the whole window is looked up in the set of window hashes;
* a hit is verified word by word before anything is kept of it.

The hash set is broadcast where the measured bytes of the windows allow it (BROADCAST_BYTES). Where they do not, the
positions travel to the windows by a shuffle, as (text, position, hash) without the words, and the few that meet a hash
go back to their text to be verified. The items of a window are joined to hits only, so a window that many items
share costs one entry in the set.

A null text has no words; an empty benchmark hits nothing; repeated rows each get the same result; very long
texts are taken whole. Null item ids hit, but are not listed. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import ascii_lower, columns, text_key

WIDTH, ANCHOR = 10, 3
#: Bytes of distinct windows that may be broadcast.
BROADCAST_BYTES = 48 << 20
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def run_hash(w: Column, at: Column, n: int) -> Column:
    """The hash of n words from position `at`."""
    return F.xxhash64(*[F.get(w, at + i) for i in range(n)])


def item_windows(benchmark: DataFrame, width: int = WIDTH, item: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's windows: window, n, item as a string."""
    w = F.col("_w")
    runs = F.when(
        F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.slice(w, i, width))
    ).otherwise(F.array(w))
    return (
        benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("_w"))
        .filter(F.size("_w") > 0)
        .select("item", F.explode(runs).alias("window"))
        .select("window", F.size("window").alias("n"), "item")
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", item: str = "item_id",
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document text with a hit: __id, __k1, __k2, __spans (sorted structs of start, n), __items (sorted)."""
    listed = item_windows(benchmark, width, item)
    windows = listed.select("window", "n").distinct()
    sizes = {r["n"]: r["b"] for r in windows.groupBy("n").agg(F.sum(F.octet_length(F.concat_ws(" ", "window")) + 8 * F.col("n")).alias("b")).collect()}
    small = sum(sizes.values()) <= broadcast_bytes
    lens = sorted(sizes) or [width]
    at, w = F.col("_at"), F.col("_w")
    tokens = docs.select(F.col(key).alias("__id"), *text_key(docs, text), words(F.col(text)).alias("_w")).filter(F.size("_w") >= lens[0])
    spots = tokens.select("__id", "__k1", "__k2", "_w", F.posexplode("_w").alias("_at", "_x"))
    # windows shorter than ANCHOR have anchors of their own length
    anchors = sorted({min(n, ANCHOR) for n in lens})
    firsts = windows.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.when(F.least("n", F.lit(ANCHOR)) == a, run_hash(F.col("window"), F.lit(0), a)).alias("h")) for a in anchors
    ])).alias("x")).select("x.a", "x.h").filter("h IS NOT NULL").distinct()
    found = None
    for a in anchors:
        own = [n for n in lens if min(n, ANCHOR) == a]
        these = firsts.filter(F.col("a") == a).select(F.col("h").alias("_anchor"))
        near = spots.filter(F.size("_w") - at >= a).withColumn("_anchor", run_hash(w, at, a)).join(F.broadcast(these) if small else these, "_anchor", "left_semi")
        full = F.array(*[F.struct(F.lit(n).alias("n"), F.when(F.size("_w") - at >= n, run_hash(w, at, n)).alias("h")) for n in own])
        if not small:  # the test by anchors needs the set; positions travel without the words
            near = spots.filter(F.size("_w") - at >= a)
        tried = near.select("__id", "__k1", "__k2", *(["_w"] if small else []), "_at", F.explode(full).alias("_f")).filter("_f.h IS NOT NULL")
        tried = tried.select(*[c for c in tried.columns if c != "_f"], F.col("_f.n").alias("n"), F.col("_f.h").alias("_h"))
        found = tried if found is None else found.unionByName(tried)
    hashed = windows.select("n", "window", hash_of(lens).alias("_h"))
    if small:
        hit = found.join(F.broadcast(hashed), ["n", "_h"]).filter(F.slice("_w", at + 1, F.col("n")) == F.col("window"))
    else:
        met = found.join(hashed, ["n", "_h"]).groupBy("__id", "__k1", "__k2").agg(F.collect_set(F.struct("_at", "n", "window")).alias("_met"))
        same = tokens["__id"].eqNullSafe(met["__id"]) & (tokens["__k1"] == met["__k1"]) & (tokens["__k2"] == met["__k2"])
        once = tokens.dropDuplicates(["__id", "__k1", "__k2"])
        back = once.join(met.select(F.col("__id").alias("_i"), F.col("__k1").alias("_a"), F.col("__k2").alias("_b"), "_met"),
                         once["__id"].eqNullSafe(F.col("_i")) & (once["__k1"] == F.col("_a")) & (once["__k2"] == F.col("_b")))
        hit = back.select("__id", "__k1", "__k2", "_w", F.inline("_met")).filter(F.slice("_w", at + 1, F.col("n")) == F.col("window"))
    hit = hit.select("__id", "__k1", "__k2", F.struct(at.alias("start"), "n").alias("span"), "window")
    per_window = hit.groupBy("__id", "__k1", "__k2", "window").agg(F.collect_set("span").alias("spans"))
    items = listed.groupBy("window").agg(F.collect_set("item").alias("items"))
    return (
        per_window.join(items, "window").groupBy("__id", "__k1", "__k2")
        .agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("__spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    )


def hash_of(lens: list[int]) -> Column:
    """The hash of a whole window, as run_hash gives it."""
    out = F.lit(None).cast("bigint")
    for n in lens:
        out = F.when(F.col("n") == n, run_hash(F.col("window"), F.lit(0), n)).otherwise(out)
    return out


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))
    def step(acc: Column, x: Column) -> Column:
        stop = x["start"] + x["n"]
        fresh = F.greatest(F.lit(0), stop - F.greatest(acc["end"], x["start"]))
        return F.struct((acc["sum"] + fresh).alias("sum"), F.greatest(acc["end"], stop).alias("end"))
    return F.aggregate(spans, zero, step)["sum"]


def _with_hits(docs: DataFrame, hits: DataFrame, key: str, how: str = "left") -> DataFrame:
    """docs joined with the hits of their texts; docs needs the columns of text_key."""
    hits = hits.withColumnsRenamed({"__id": "__hit", "__k1": "__h1", "__k2": "__h2"})
    same = docs[key].eqNullSafe(hits["__hit"]) & (docs["__k1"] == hits["__h1"]) & (docs["__k2"] == hits["__h2"])
    return docs.join(hits, same, how).drop("__hit", "__h1", "__h2", "__k1", "__k2")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **opts) -> DataFrame:
    """A report row for each document row: key, n_words, n_hit, n_items, items, spans, contaminated. Texts are not shuffled."""
    hits = find_hits(docs, benchmark, key=key, text=text, **opts)
    counted = docs.select(F.col(key), *text_key(docs, text), F.size(words(F.col(text))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return _with_hits(counted, hits, key).select(
        key,
        "n_words",
        F.coalesce(covered(F.col("__spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("__items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("__items", none).alias("items"),
        F.col("__spans").alias("spans"),
        F.col("__spans").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **opts) -> DataFrame:
    """The documents without a hit, with their own columns."""
    hits = find_hits(docs, benchmark, key=key, text=text, **opts).select("__id", "__k1", "__k2")
    return _with_hits(docs.select("*", *text_key(docs, text)), hits, key, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **opts) -> DataFrame:
    """All documents with their own columns; hit words go, each with the gap after it."""
    hits = find_hits(docs, benchmark, key=key, text=text, **opts)
    marked = _with_hits(docs.select("*", *text_key(docs, text)), hits, key)
    own, gaps = F.regexp_extract_all(F.col(text), F.lit(f"({ANY_CASE_WORD})"), F.lit(1)), F.split(F.col(text), ANY_CASE_WORD)
    hit = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), hit)
    rest = F.array_join(F.transform(left, lambda i: F.concat(F.get(own, i), F.get(gaps, i + 1))), "")
    cleaned = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.concat(F.get(gaps, F.lit(0)), rest))
    return marked.withColumn(text, cleaned).select(*columns(docs.columns))

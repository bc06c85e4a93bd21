"""Joins, sessions and moving frames over event time, for keys of any size.

All work in slices of time (`slices`): rows of a key are shuffled by key and slice, and what a row needs from earlier
slices is carried over their borders as one row for each key and slice. Times are timestamps; rows without a time have no
place in time and get nulls (as-of join, frames) or no session. Null keys are a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.slices import borders, slice_of


def seconds(at: Column) -> Column:
    """A timestamp as exact microseconds."""
    return F.unix_micros(at.cast("timestamp"))


def _key(by: list[str]) -> Column:
    """The key as one value without nulls."""
    return F.struct(F.lit(0).alias("_"), *[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("v")).alias(f"k{i}") for i, c in enumerate(by)])


def asof_join(left: DataFrame, right: DataFrame, by: list[str], take: dict[str, str], at: tuple[str, str] = ("at", "at"), order: list[str] | None = None,
              within: float | None = None, strict: bool = False, most: int | None = None) -> DataFrame:
    """left plus, for each row, the columns of the latest row of right with equal keys at or before its time.

    take: names of right's columns -> names in the result. Of right rows at one time the last by `order` counts.
    `strict`: before its time only. `within` (seconds): older rows do not count. Rows of left without a match, or without a
    time, get nulls; right rows without a time match nothing; null keys match null keys.

    Both sides are one stream of marked rows, ordered by time; the latest right row is the last one that is not null.
    Inside a slice a window finds it; across slices the last right row of each key and slice is carried on.
    """
    mine = left.withColumns({"_key": _key(by), "_t": seconds(F.col(at[0]))})
    theirs = right.select(_key(by).alias("_key"), seconds(F.col(at[1])).alias("_t"), F.struct(*[F.col(c).alias(n) for c, n in take.items()]).alias("_right"),
                          F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order or list(take))]).alias("_order")).filter("_t IS NOT NULL")
    ends = borders(mine.select("_t").unionByName(theirs.select("_t")), "_t", most)
    cut_ = lambda df: df.withColumn("_slice", slice_of(F.col("_t"), ends))
    mine, theirs = cut_(mine), cut_(theirs)
    last = theirs.groupBy("_key", "_slice").agg(F.max_by(F.struct("_right", "_t"), F.struct("_t", "_order")).alias("_last"))
    # the carried row of a slice is the last one of the slices before: one row a key and slice that either side touches
    touched = mine.select("_key", "_slice").distinct()
    spots = touched.join(last, ["_key", "_slice"], "full")
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select("_key", "_slice", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    # right rows come before left rows of the same time, or after them if strict
    side = F.lit(1 if strict else -1)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(left.columns)])
    stream = mine.select("_key", "_slice", "_t", F.lit(0).alias("_side"), row.alias("_row"), F.lit(None).cast(theirs.schema["_right"].dataType).alias("_right"), F.lit(None).cast(theirs.schema["_order"].dataType).alias("_order"))
    stream = stream.unionByName(theirs.select("_key", "_slice", "_t", side.alias("_side"), F.lit(None).cast(stream.schema["_row"].dataType).alias("_row"), "_right", "_order"))
    so_far = Window.partitionBy("_key", "_slice").orderBy("_t", "_side", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = stream.withColumn("_found", F.last(F.when(F.col("_side") != 0, F.struct("_right", "_t")), ignorenulls=True).over(so_far)).filter("_side = 0")
    out = seen.join(carried, ["_key", "_slice"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    fits = F.col("_t").isNotNull()
    if within is not None:
        fits = fits & (F.col("_t") - F.col("_found._t") <= int(within * 1_000_000))
    names = {n: F.when(fits, F.col(f"_found._right.{n}")) for n in take.values()}
    return out.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(left.columns) if c not in names], *[c.alias(n) for n, c in names.items()])


def with_sessions(events: DataFrame, by: list[str], gap: float, at: str = "at", tie: list[str] | None = None, most: int | None = None) -> DataFrame:
    """events plus session (1, 2, ... for each key by time): a new one begins when `gap` seconds or more have passed since the
    key's event before. `tie` makes the order of simultaneous events definite; it does not change sessions.

    Inside a slice lag and a running sum find the gaps; the first event of a slice looks at the last time of the key's
    earlier slices, and the sessions begun in those are added.
    """
    rows = events.filter(F.col(at).isNotNull()).withColumns({"_key": _key(by), "_t": seconds(F.col(at))})
    rows = rows.withColumn("_slice", slice_of(F.col("_t"), borders(rows, "_t", most)))
    ordered = Window.partitionBy("_key", "_slice").orderBy("_t", *(tie or []))
    across = Window.partitionBy("_key").orderBy("_slice")
    opens = lambda before: F.when(before.isNull() | (F.col("_t") - before >= int(gap * 1_000_000)), 1).otherwise(0)
    ends = rows.groupBy("_key", "_slice").agg(F.max("_t").alias("_end"))
    ends = ends.select("_key", "_slice", F.lag("_end").over(across).alias("_before"))
    local = rows.withColumn("_lag", F.lag("_t").over(ordered))
    flagged = local.join(ends, ["_key", "_slice"]).withColumn("_opens", opens(F.coalesce("_lag", "_before")))
    begun = flagged.groupBy("_key", "_slice").agg(F.sum("_opens").alias("_n"))
    ahead = begun.select("_key", "_slice", (F.sum("_n").over(across) - F.col("_n")).alias("_ahead"))
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = flagged.withColumn("_upto", F.sum("_opens").over(upto)).join(ahead, ["_key", "_slice"])
    return numbered.withColumn("session", (F.col("_ahead") + F.col("_upto")).cast("long")).drop("_key", "_t", "_slice", "_lag", "_before", "_opens", "_upto", "_ahead")


def session_summary(events: DataFrame, by: list[str], gap: float, measures: dict[str, Column] | None = None, at: str = "at", most: int | None = None) -> DataFrame:
    """by, session, session_start, session_end (last event plus gap), events and the measures (aggregates) of each session."""
    numbered = with_sessions(events, by, gap, at, most=most)
    found = numbered.groupBy(*by, "session").agg(F.min(at).alias("session_start"), F.max(at).alias("_end"), F.count(F.lit(1)).alias("events"), *[c.alias(n) for n, c in (measures or {}).items()])
    end = F.timestamp_micros(seconds(F.col("_end")) + int(gap * 1_000_000))
    return found.withColumn("session_end", end).drop("_end")


#: Aggregates whose parts can be put together: of two parts, and of a column.
PARTS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "count": (F.count, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))),
    "sum": (F.sum, lambda x, y: F.coalesce(x + y, x, y)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def range_frames(rows: DataFrame, by: list[str], span: float, measures: dict[str, Column | tuple[str, Column]], at: str = "at", most: int | None = None) -> DataFrame:
    """rows plus the measures over the key's rows of the last `span` seconds, own time and ties included.

    A measure is (one of PARTS, column), or any aggregate. Each row costs the same in the first form, however many rows a frame
    holds; an aggregate is computed anew over each frame, so its cost grows with the square of the rows in a span of time.
    """
    parts = {n: m for n, m in measures.items() if isinstance(m, tuple)}
    others = {n: m for n, m in measures.items() if n not in parts}
    width = int(span * 1_000_000)
    if not parts or width < 1:
        return _frames(rows, by, width, others | {n: PARTS[kind][0](c) for n, (kind, c) in parts.items()}, at, most)
    out = _frames_of_parts(rows, by, width, parts, at)
    out = _frames(out, by, width, others, at, most) if others else out
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c not in measures], *measures)


def _frames_of_parts(rows: DataFrame, by: list[str], width: int, measures: dict[str, tuple[str, Column]], at: str) -> DataFrame:
    """Time is cut into spells as wide as the frame: a frame is the end of one spell and the beginning of the next.

    Two running aggregates, one forward and one backward, tell both; the row asks for the second where its frame begins, by
    a row of its own there.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)])
    own = rows.select(row.alias("_row"), _key(by).alias("_key"), seconds(F.col(at)).alias("_t"), *[c.alias(f"_v{i}") for i, (_, c) in enumerate(measures.values())])
    own = own.withColumn("_spell", F.col("_t") - F.pmod("_t", F.lit(width)))
    kinds = [PARTS[kind] for kind, _ in measures.values()]
    of_key = Window.partitionBy("_key", "_spell")
    forward = of_key.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    backward = of_key.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    timed = F.col("_t").isNotNull()
    begun = own.select("_row", "_key", "_t", "_spell", *[F.when(timed, whole(f"_v{i}").over(forward)).alias(f"_p{i}") for i, (whole, _) in enumerate(kinds)])
    asked = begun.withColumns({"_t": F.col("_t") - width, "_spell": F.col("_spell") - width})
    both = asked.unionByName(own.filter(timed).drop("_row"), allowMissingColumns=True)
    seen = both.select("_row", "_t", *[f"_p{i}" for i in range(len(kinds))], *[whole(f"_v{i}").over(backward).alias(f"_q{i}") for i, (whole, _) in enumerate(kinds)]).filter("_row IS NOT NULL")
    found = [F.when(timed, put(F.col(f"_p{i}"), F.col(f"_q{i}"))).cast(seen.schema[f"_p{i}"].dataType).alias(n) for i, (n, (_, put)) in enumerate(zip(measures, kinds, strict=True))]
    return seen.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(rows.columns) if c not in measures], *found)


def _frames(rows: DataFrame, by: list[str], width: int, measures: dict[str, Column], at: str, most: int | None) -> DataFrame:
    """Any aggregates over frames: a slice is at least as wide as the frame, so the frame of a row touches its own slice and
    the one before. Each row also goes, as a halo, to the next slice if the frame of a row there can reach it: nothing else
    is copied.
    """
    marked = rows.withColumns({"_key": _key(by), "_t": seconds(F.col(at))})
    ends = borders(marked, "_t", most, apart=float(width))
    own = marked.withColumns({"_slice": slice_of(F.col("_t"), ends), "_halo": F.lit(False)})
    reach = slice_of(F.col("_t") + width, ends)
    halo = own.filter(reach > F.col("_slice")).withColumns({"_slice": F.col("_slice") + 1, "_halo": F.lit(True)})
    frame = Window.partitionBy("_key", "_slice").orderBy("_t").rangeBetween(-width, Window.currentRow)
    timed = F.col("_t").isNotNull()
    framed = own.unionByName(halo).withColumns({n: F.when(timed, c.over(frame)) for n, c in measures.items()})
    return framed.filter(~F.col("_halo")).drop("_key", "_t", "_slice", "_halo")

"""Slices of an ordered column: the same number of rows in each, whatever the distribution.

A window over one key is one task. Cut by slices of its order, a key with a third of all rows spreads over many tasks, as no
slice holds more than about `most` rows of the whole table (rows of one value stay together); what a slice needs from
earlier ones travels as one row for each key and slice.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one slice, and slices at most: beyond LIMIT * MOST rows slices grow, so that the borders stay a small array.
MOST, LIMIT = 100_000, 16_384
#: Borders compared at once when a row looks for its slice.
FINE = 128


def borders(df: DataFrame, value: str, most: int | None = None, apart: float = 0.0) -> list[float]:
    """Ascending lower ends of all slices but the first, by approximate quantiles (their errors only make slices uneven).

    With `apart` no slice (but the last) is narrower than that. Nulls do not count.
    """
    n = df.filter(F.col(value).isNotNull()).count()
    slices = min(LIMIT, -(-n // (most or MOST)))
    if slices < 2:
        return []
    ends = df.select(F.percentile_approx(F.col(value).cast("double"), [i / slices for i in range(1, slices)], 10 * slices)).first()[0]
    out: list[float] = []
    for x in sorted(set(ends)):
        if not out or x - out[-1] >= apart:
            out.append(x)
    return out


def slice_of(value: Column, ends: list[float]) -> Column:
    """The slice of a value: how many borders are at or below it. Nulls are in slice 0."""
    if not ends:
        return F.lit(0)
    value = value.cast("double")
    count = lambda xs: F.size(F.filter(xs, lambda x: x <= value))
    blocks = [ends[i : i + FINE] for i in range(0, len(ends), FINE)]
    literal = lambda xs: F.array(*map(F.lit, xs))
    if len(blocks) == 1:
        found = count(literal(ends))
    else:  # first the block by its first border, then the border
        block = count(literal([b[0] for b in blocks]))
        table = F.array(*map(literal, blocks))
        found = F.when(block == 0, 0).otherwise((block - 1) * FINE + count(F.get(table, block - 1)))
    return F.coalesce(F.when(value.isNotNull(), found), F.lit(0)).cast("int")


def place_of(value: float, ends: list[float]) -> int:
    """slice_of for one number on the driver."""
    return bisect_left(ends, value) + (value in ends)

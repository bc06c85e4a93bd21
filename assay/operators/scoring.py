"""Batch scoring with a caller's model, and user hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.session import ship


def score_batch(rows: DataFrame, load: Callable[[], Callable[[list], list[float]]], key: str, inputs: str, chunk: int = 8) -> DataFrame:
    """key, p_fake, error for every row. `load` makes the scorer once for each task; it takes up to `chunk` inputs.

    A chunk that fails is scored row by row, and a row that fails is recorded with its error.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for b in batches:
            out = []
            for at in range(0, len(b), chunk):
                part = b.iloc[at : at + chunk]
                try:
                    out += [(k, float(p), None) for k, p in zip(part[key], scorer(part[inputs].tolist()), strict=True)]
                except Exception:
                    for k, x in zip(part[key], part[inputs], strict=True):
                        try:
                            out.append((k, float(scorer([x])[0]), None))
                        except Exception as failure:
                            out.append((k, None, type(failure).__name__))
            yield pd.DataFrame(out, columns=[key, "p_fake", "error"])

    ship(rows.sparkSession)
    return rows.select(key, inputs).mapInPandas(run, f"`{key}` {kind}, p_fake double, error string")


def apply_hooks(paths: DataFrame, hooks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Caller's column functions of the path: label, grp, method, compression, subject; a missing one gives NULL.

    A hook is an expression, so Catalyst sees it; a pandas_udf is accepted as well.
    """
    names = ("label", "grp", "method", "compression", "subject")
    return paths.select("path", *[(hooks[n](F.col("path")) if n in hooks else F.lit(None).cast("string")).alias(n) for n in names])

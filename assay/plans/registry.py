"""Every registered query of the library with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, rounded: tuple[str, ...] = (), digits: int = 9) -> Callable[[Query], Query]:
    """Register a query; `oracle` is its DuckDB text. Sums of doubles depend on their order, so the columns named in
    `rounded` are compared at `digits` decimals on both sides."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(c, digits) for c in rounded}) if rounded else df

        QUERIES[name] = run
        if oracle:
            fixed = ", ".join(f"round({c}, {digits}) AS {c}" for c in rounded)
            ORACLES[name] = f"SELECT * REPLACE ({fixed}) FROM ({oracle})" if rounded else oracle
        return f

    return add


from assay.plans import (  # noqa: E402,F401  the modules register their queries
    benchmark_queries,
    corpus_queries,
    distribution_queries,
    evaluation_queries,
    frame_queries,
    ingest_queries,
    source_queries,
    store_queries,
    temporal_queries,
)

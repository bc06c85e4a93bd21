"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

Every stage keeps whole rows: toxicity drops what its model rejects, near-dedup keeps one document of each group,
decontamination drops documents with a benchmark window, mixing writes all rows in the order of the mix, sharding places
them and numbers each shard's slots in the order of the files that it reads, by file names and row numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assay.llm import decontamination, mixing, sharding, simhash, toxicity
from assay.llm.common import columns, read
from assay.llm.queries import SHARDS, toxicity_model
from assay.session import shared_dir, ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity_model(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8."""
    ship(spark)
    return simhash.keep_one(docs, **simhash.SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files and rows follow mix_position."""
    return mixing.mix(docs).sort("mix_position").select(*columns(docs.columns))


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The slots of each shard follow the mix: names and row numbers of the files tell the order that was written."""
    return sharding.shards_in_order(docs, SHARDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: The learned and hashed stages have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

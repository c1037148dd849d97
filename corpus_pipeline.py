"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token output.

Each stage takes the documents that its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkwright.llm import decontaminate, near_dedup, repetition, source_mix, storage, token_planes
from sparkwright.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.resample(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_planes.round_trip(docs, token_planes.Params(tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", token_output),
]

#: entropy balancing and tokenization can't be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again; in the end only the last one's table is left there."""
    with storage.temporary(spark) as stays:
        docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
        for name, stage in STAGES:
            docs = storage.keep(stage(spark, docs, sf_dir), "-".join(["stage", *name.split()]))
            if before is not None:
                storage.drop(before)  # what read it is written
            before = docs
        stays.append(docs)
    return docs

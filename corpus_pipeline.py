"""Five stages from raw documents to packed training sequences.

Every stage takes an empty table, null values in any column and further columns. Null text counts as
empty: the classifier scores it by the sample's statistics, exact dedup makes null and empty texts one
group, near dedup links them with nothing, mixing takes no row without words, packing makes it one token.
Rows with a null id are rows like others; rows that repeat an id and text are one document to both dedup
stages. Ties: the larger id stays in exact dedup, the smaller in near dedup. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwright.llm import exact_dedup, mixing, near_dedup, packing, quality
from tillwright.session import materialize, release, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine doesn't reject (score of at least 0.5)."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z, the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, similarity of 0.8 or more."""
    return near_dedup.drop_near_copies(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows are left out or repeated."""
    return mixing.mix_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Stages 1, 3 and 5 (a trained model, set similarity, byte-pair ids) can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, keep=1)  # what this stage read is no longer needed
    return docs

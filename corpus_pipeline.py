"""A training corpus from raw documents: toxic ones and copies go, benchmarks are kept out, sources are mixed and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import decontamination, minhash, mixing, sharding, toxicity
from proofline.llm.common import whole_row, written


def _beside(docs: DataFrame) -> DataFrame:
    """What the operators read, and the whole row as a struct: no column of ``docs`` can clash with theirs."""
    return docs.select("doc_id", "text", "source", whole_row(docs).alias("__row"))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go; the model is fitted on the labelled documents that are left in training.

    Null and empty texts have the score of examples without terms; columns may have any names.
    """
    labels = toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, toxicity.fit(docs.select("doc_id", "text"), labels))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, and all rows without an id or words; columns may have any names."""
    return minhash.drop_near_duplicates(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item (or all of a shorter one) go; null and wordless texts stay, columns may have any names."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the weights 5, 2, 1 takes it; null is a source of its own, columns may have any names."""
    return mixing.repeat_rows(mixing.mix(_beside(docs))).select("__row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard (0 to 39) and slot that hold them; columns of these two names are replaced, others may have any names."""
    placed = sharding.shard_rows(_beside(docs))
    return placed.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")), "shard", "slot")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Nearest neighbours, sketches and knapsacks have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written as Parquet to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

"""A corpus from raw documents to training order, as a list of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asklens.llm import decontaminate, mixing, simhash, toxicity, training_order
from asklens.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the classifier learns from the labelled documents among ``docs``."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="_score").where("_score < 0.5").drop("_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (three-word SimHash, 2 bits at most) stays, that of the smallest id."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if at least one word in twenty is in a passage of the benchmark; others keep their text."""
    found = decontaminate.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="_found")
    return found.where(~decontaminate.contaminated("_found")).drop("_found")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and epoch that the mix takes of, with the words it takes."""
    return mixing.mixed_documents(docs)


def order_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride token sequences at their global slots, sorted within shards."""
    return training_order.materialise(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("training_order", order_tokens),
]

# Fitted weights, keyed permutations and merges of a vocabulary have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

"""The stored retrieval corpus: examples with skeletons, vectors and their search cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(corpus: DataFrame, path: str, files_per_cell: int | None = None) -> None:
    """Write a corpus with an integer ``cell`` column as Parquet partitioned by that cell.

    Rows of a cell are spread over ``files_per_cell`` tasks, so a cell that holds much of the
    corpus is not written by one task; without it every task writes its own rows as they are.
    """
    if files_per_cell:
        spread = F.pmod(F.xxhash64("id"), F.lit(files_per_cell))
        corpus = corpus.withColumn("_s", spread).repartition("cell", "_s").drop("_s")
    corpus.write.mode("errorifexists").partitionBy("cell").parquet(path)


def append_index(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("cell").parquet(path)


def read_index(spark: SparkSession, path: str, cells: list[int] | None = None) -> DataFrame:
    """Read a stored corpus; ``cells`` prunes to those partitions. An empty corpus is an error."""
    corpus = spark.read.parquet(path)
    if corpus.isEmpty():
        raise ValueError(f"retrieval corpus at {path} is empty")
    return corpus.where(F.col("cell").isin(cells)) if cells is not None else corpus

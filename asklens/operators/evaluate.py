"""Evaluation totals per database and overall, merging of partial totals, log combination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTALS = ["total", "correct", "valid", "executed", "errors", "total_time"]


def total_columns() -> list[Column]:
    ran = F.col("error").isNull()
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(ran & F.col("is_correct")).alias("correct"),
        F.count_if(F.col("valid")).alias("valid"),
        F.count_if(ran).alias("executed"),
        F.count_if(~ran).alias("errors"),
        F.sum(F.coalesce("execution_time", F.lit(0.0))).alias("total_time"),
    ]


def per(part: str, whole: str) -> Column:
    """A ratio whose divisor is at least one, so empty groups give 0."""
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def with_ratios(totals: DataFrame) -> DataFrame:
    return totals.withColumns({
        "accuracy": per("correct", "executed"),
        "validation_success_rate": per("valid", "total"),
        "average_execution_time": per("total_time", "total"),
    })


def stats_by_database(records: DataFrame) -> DataFrame:
    """One row per db_id.

    ``executed`` counts every attempt that reached execution (no ``error``); a record whose
    database was missing counts in ``total`` and ``errors`` only.
    """
    return with_ratios(records.groupBy("db_id").agg(*total_columns()))


def stats_overall(records: DataFrame) -> DataFrame:
    """One row over all records; a global aggregate, so only partial rows are shuffled."""
    return with_ratios(records.agg(*total_columns()).withColumn(
        "total_time", F.coalesce("total_time", F.lit(0.0))))


def stats_rollup(records: DataFrame) -> DataFrame:
    """Per-database rows and the overall row from one shuffle; ``level`` tells them apart."""
    rolled = records.rollup("db_id").agg(F.grouping("db_id").alias("g"), *total_columns())
    level = F.when(F.col("g") == 1, "overall").otherwise("database")
    return with_ratios(rolled.withColumn("level", level).drop("g"))


def merge_stats(partials: list[DataFrame] | DataFrame) -> DataFrame:
    """Sum partial per-database totals (one table per shard, or all shards in one) and redo ratios."""
    if isinstance(partials, DataFrame):
        partials = [partials]
    stacked = reduce(
        lambda a, b: a.unionByName(b), [p.select("db_id", *TOTALS) for p in partials])
    return with_ratios(stacked.groupBy("db_id").agg(*[F.sum(c).alias(c) for c in TOTALS]))


def combine_logs(parts: list[DataFrame], questions: DataFrame, key: str = "question_id",
                 position: str = "position") -> DataFrame:
    """Stack per-worker logs and attach each record's place in the question list.

    ``questions`` holds ``key`` and ``position``; ids are compared as text. The result is
    sorted by place, then id; an unknown id has no place (NULL) and sorts last.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # A question listed twice keeps its last place, as a dictionary built in order would.
    places = questions.groupBy(F.col(key).cast("string").alias("_id")).agg(
        F.max(position).alias("_place"))
    return (
        stacked.withColumn("_id", F.col(key).cast("string"))
        .join(places, "_id", "left")
        .withColumn(position, F.col("_place").cast("bigint"))
        .drop("_id", "_place")
        .orderBy(F.col(position).asc_nulls_last(), key)
    )

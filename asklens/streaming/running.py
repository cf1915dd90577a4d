"""Running totals and a growing corpus as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asklens.operators.evaluate import TOTALS, total_columns, with_ratios


def running_stats(stream: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Keep per-database totals as evaluation records arrive.

    State is one row of sums per database. Each trigger writes the changed rows under its own
    batch number, and a repeated batch overwrites itself, so a restart neither loses nor doubles
    anything. Read the result with :func:`current_stats`.
    """
    totals = stream.groupBy("db_id").agg(*total_columns())

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:012d}")

    writer = totals.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_stats(spark: SparkSession, out: str) -> DataFrame:
    """The latest totals of every database with their ratios."""
    changes = spark.read.parquet(out)
    latest = changes.groupBy("db_id").agg(F.max_by(F.struct(*TOTALS), "batch").alias("t"))
    return with_ratios(latest.select("db_id", "t.*"))


def stream_examples(stream: DataFrame, out: str, checkpoint: str, once: bool = True,
                    event_time: str | None = None, delay: str = "1 hour"):
    """Append examples whose (question, sql) has not been seen before.

    The key is a 256-bit hash, so the state holds no texts. Without an event time it keeps every key it has
    seen; with one, keys are forgotten
    after ``delay`` and late duplicates beyond it may pass, by Spark's watermark rules.
    """
    keyed = stream.withColumn("_key", F.sha2(F.to_json(F.struct("question", "sql")), 256))
    if event_time:
        unique = keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"])
    else:
        unique = keyed.dropDuplicates(["_key"])
    writer = unique.drop("_key").writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

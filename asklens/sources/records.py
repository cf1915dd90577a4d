"""Evaluation records, question logs, report tables and schema-linking output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asklens.schemas import LINKING_FILE, RECORD

def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Evaluation records from JSON documents: a list, or an object whose ``results`` or
    ``detailed_results`` is a list; ``results`` wins when both are.

    List items that are not objects are ignored, and so are objects without either list. A
    document is parsed by one task; with ``lines=True`` the files are JSON lines of records,
    which Spark splits.
    """
    if lines:
        return spark.read.schema(RECORD).json(path)
    text = spark.read.text(path, wholetext=True).select(F.btrim("value", F.lit(" \t\r\n")).alias("v"))
    whole = F.from_json("v", "results array<string>, detailed_results array<string>")
    # Items are kept as texts first, so that one odd item does not spoil the others.
    items = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(
        F.coalesce(whole["results"], whole["detailed_results"]))
    rows = text.select(F.explode_outer(items).alias("item")).where(F.col("item").startswith("{"))
    return rows.select(F.from_json("item", RECORD).alias("r")).select("r.*")


def read_linking(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Schema-linking output keyed by question id: (question_id as text, db_id, schema_linking).

    A file is one document, or with ``lines=True`` one document per line.
    """
    files = spark.read.schema(LINKING_FILE).json(path, multiLine=not lines)
    rows = files.select(F.explode("by_question_id").alias("question_id", "r"))
    return rows.select("question_id", F.col("r.db_id").alias("db_id"), F.col("r.schema_linking").alias("schema_linking"))


def linking_file(linked: DataFrame) -> DataFrame:
    """Rows (question_id, db_id, schema_linking) as single-entry ``by_question_id`` documents."""
    record = F.struct(
        F.col("question_id").cast("string").alias("question_id"), "db_id", "schema_linking")
    return linked.select(F.create_map(F.col("question_id").cast("string"), record).alias("by_question_id"))


def question_logs(flat: DataFrame) -> DataFrame:
    """Nested question logs from flat evaluation rows.

    The answer counts as generated and valid when it is not blank, whatever the validity flags
    say; metrics, row-count difference and the single alternative follow from the flat columns.
    """
    answer = F.col("generated_sql")
    has_sql = F.length(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s", "")) > 0
    one = has_sql.cast("int")
    failed = F.length(F.coalesce("execution_error", F.lit(""))) > 0
    times = F.when(F.col("execution_time").isNull(), F.array().cast("array<double>")).otherwise(F.array("execution_time"))
    alternative = F.struct(
        answer.alias("sql"), F.lit(1.0).alias("confidence"), F.lit(1).alias("count"),
        F.array_min(times).alias("best_exec_time"), F.array(answer).alias("all_sqls_in_group"))
    return flat.select(
        "question_id", "question", "db_id",
        F.coalesce(F.nullif(F.col("difficulty"), F.lit("")), F.lit("unknown")).alias("difficulty"),
        F.coalesce("evidence", F.lit("")).alias("evidence"), "gold_sql", "round_1_sql", "round_2_sql", "generated_sql",
        "is_correct", F.when(has_sql, 1.0).otherwise(0.0).alias("winner_confidence"),
        times.alias("execution_times"),
        F.struct(
            "generated_row_count", "ground_truth_row_count",
            (F.col("generated_row_count") - F.col("ground_truth_row_count")).alias("row_count_difference"),
        ).alias("execution_difference"),
        "execution_error",
        F.struct(
            F.lit(1).alias("generated"), F.when(failed, 1).otherwise(0).alias("execution_errors"),
            one.alias("valid_generations"), one.alias("unique_valid_sqls")).alias("metrics"),
        F.when(has_sql, F.array(alternative)).otherwise(F.array().cast(
            "array<struct<sql:string,confidence:double,count:int,best_exec_time:double,"
            "all_sqls_in_group:array<string>>>")).alias("alternatives"))


def write_logs(logs: DataFrame, path: str) -> None:
    """Append-only JSON lines; one file per task instead of one rewritten array."""
    logs.write.mode("append").json(path)


def write_report(block: DataFrame, path: str) -> None:
    """A report block as JSON; blocks have one row, or one per group."""
    block.write.mode("overwrite").json(path)

"""Benchmark report blocks over nested evaluation records (schemas.RECORD)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asklens.functions.quantile import exact_median
from asklens.functions.text import strip


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(0.0)


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def is_right() -> Column:
    """Either flag may mark a record as correct; NULL is not correct."""
    return _true("execution_match") | _true("is_correct")


def _group(name: str, fallback: str) -> Column:
    """The grouping key with NULL and empty text replaced."""
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(fallback))


GROUP_FALLBACK = {"difficulty": "Unknown", "db_id": "unknown"}


def report_overall(records: DataFrame) -> DataFrame:
    totals = records.agg(F.count(F.lit(1)).alias("total_questions"), F.count_if(is_right()).alias("correct"))
    return totals.select(
        "total_questions", "correct",
        (F.col("total_questions") - F.col("correct")).alias("incorrect"),
        pct(F.col("correct"), F.col("total_questions")).alias("accuracy"))


def execution_times() -> Column:
    """Seconds of a record: the list without NULLs, or the single value where the list gives nothing."""
    listed = F.filter(F.coalesce("execution_times", F.array().cast("array<double>")), lambda t: t.isNotNull())
    single = F.when(F.col("execution_time").isNotNull(), F.array("execution_time")).otherwise(
        F.array().cast("array<double>"))
    return F.when(F.size(listed) > 0, listed).otherwise(single)


def report_times(records: DataFrame, approximate: bool = False) -> DataFrame:
    """Execution-time statistics in milliseconds; ``approximate=True`` takes the median from a sketch."""
    seconds = records.select(F.explode_outer(execution_times()).alias("s")).where(F.col("s").isNotNull())
    ms = seconds.select((F.col("s") * 1000.0).alias("ms"))
    middle = F.percentile_approx("ms", 0.5, 10000) if approximate else F.lit(exact_median(ms, "ms")).cast("double")
    return ms.agg(
        F.count("ms").alias("total_queries_executed"),
        F.avg("ms").alias("mean_ms"), middle.alias("median_ms"),
        F.stddev_pop("ms").alias("std_dev_ms"),
        F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def sql_variations() -> Column:
    """Distinct SQL texts of a record, trimmed, blanks dropped, in first-seen order."""
    none = F.array().cast("array<string>")
    alternatives = F.coalesce(
        F.flatten(F.transform(
            F.filter("high_confidence_alternatives", lambda a: a.isNotNull()),
            lambda a: F.concat(F.array(a["sql"]), F.coalesce(a["all_sqls_in_group"], none)))),
        none)
    texts = F.concat(
        F.array("round_1_sql", "round_2_sql", "generated_sql", "winner_sql", F.col("selection.selected_sql")),
        alternatives)
    stripped = F.transform(texts, lambda t: strip(t))
    return F.array_distinct(F.filter(stripped, lambda t: F.length(t) > 0))


def with_variations(records: DataFrame) -> DataFrame:
    return records.withColumn("variations", sql_variations())


def generation_counts(records: DataFrame) -> DataFrame:
    """Per record: generated, valid and failed counts.

    The logged metrics win when all three are present; otherwise they are derived from the
    variations, the validity flag and the error texts.
    """
    m = F.col("metrics")
    logged = m["generated"].isNotNull() & m["valid_generations"].isNotNull() & m["execution_errors"].isNotNull()
    n = F.size("variations")
    ok = F.when(F.coalesce("valid", _true("final_valid")), 1).otherwise(0)
    failed = (F.length(F.coalesce("validation_error", F.lit(""))) > 0) | (
        F.length(F.coalesce("execution_error", F.lit(""))) > 0)
    return with_variations(records).withColumns({
        "generated": F.when(logged, m["generated"]).otherwise(n),
        "valid_count": F.when(logged, m["valid_generations"]).otherwise(ok),
        "error_count": F.when(logged, m["execution_errors"]).otherwise(
            F.when(failed, 1).otherwise(F.greatest(n - ok, F.lit(0)))),
    })


def report_generation(records: DataFrame, approximate: bool = False) -> DataFrame:
    """Totals over all records plus the number of distinct SQL texts.

    Counts and distinct texts are two aggregates over the same projection. The exact distinct
    count shuffles texts by value after a map-side combine; ``approximate=True`` uses a sketch.
    """
    counted = generation_counts(records)
    totals = counted.agg(
        F.coalesce(F.sum("generated"), F.lit(0)).alias("total_sql_generated"),
        F.coalesce(F.sum("valid_count"), F.lit(0)).alias("valid_executions"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("execution_errors"),
        F.coalesce(F.avg(F.size("variations")), F.lit(0.0)).alias("avg_unique_sql_variations_per_question"))
    texts = counted.select(F.explode_outer("variations").alias("t")).where(F.col("t").isNotNull())
    if approximate:
        unique = texts.agg(F.approx_count_distinct("t").alias("unique_sql_variations"))
    else:
        unique = texts.groupBy("t").count().agg(F.count(F.lit(1)).alias("unique_sql_variations"))
    at_least_one = F.greatest(F.col("total_sql_generated"), F.lit(1))
    # Two one-row tables are merged by stacking them, which needs no join.
    both = totals.unionByName(unique, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(
        "total_sql_generated", "valid_executions", "execution_errors",
        pct(F.col("valid_executions"), at_least_one).alias("validation_success_rate"),
        pct(F.col("execution_errors"), at_least_one).alias("execution_error_rate"),
        "unique_sql_variations", "avg_unique_sql_variations_per_question")


def confidence_value() -> Column:
    return F.coalesce("winner_confidence", "confidence", F.col("selection.confidence"))


def report_confidence(records: DataFrame, approximate: bool = False) -> DataFrame:
    values = records.select(confidence_value().alias("c")).where(F.col("c").isNotNull())
    middle = F.percentile_approx("c", 0.5, 10000) if approximate else F.lit(exact_median(values, "c")).cast("double")
    stats = values.agg(
        F.count("c").alias("count"), F.avg("c").alias("mean_confidence"), middle.alias("median_confidence"),
        F.count_if(F.col("c") > 0.5).alias("high_confidence_count"),
        F.count_if(F.col("c") < 0.2).alias("low_confidence_count"))
    return stats.withColumns({
        "high_confidence_rate": pct(F.col("high_confidence_count"), F.greatest("count", F.lit(1))),
        "low_confidence_rate": pct(F.col("low_confidence_count"), F.greatest("count", F.lit(1))),
    })


def _accuracy(grouped) -> DataFrame:
    out = grouped.agg(F.count_if(is_right()).alias("correct"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("accuracy", pct(F.col("correct"), F.col("total")))


def report_by(records: DataFrame, key: str) -> DataFrame:
    """Accuracy per group: difficulties in name order, databases best first and then by name."""
    fallback = GROUP_FALLBACK.get(key, "Unknown")
    out = _accuracy(records.withColumn(key, _group(key, fallback)).groupBy(key))
    return out.orderBy(F.desc("accuracy"), key) if key == "db_id" else out.orderBy(key)


def report_selection(records: DataFrame) -> DataFrame:
    def given(name: str) -> Column:
        return F.length(F.coalesce(F.col(name), F.lit(""))) > 0

    counts = records.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(given("generated_sql") | given("winner_sql")).alias("selection_made"),
        F.count_if(F.col("selection.candidates_count") > 1).alias("majority_vote_used"))
    return counts.select(
        "selection_made", pct(F.col("selection_made"), F.col("total_questions")).alias("selection_rate"),
        "majority_vote_used",
        pct(F.col("majority_vote_used"), F.col("total_questions")).alias("majority_vote_rate"))


def report_cube(records: DataFrame) -> DataFrame:
    """Difficulty, database and total accuracy in one shuffle through grouping sets."""
    keyed = records.select(
        _group("difficulty", GROUP_FALLBACK["difficulty"]).alias("difficulty"),
        _group("db_id", GROUP_FALLBACK["db_id"]).alias("db_id"),
        "execution_match", "is_correct")
    sets = keyed.groupingSets([["difficulty"], ["db_id"], []], "difficulty", "db_id").agg(
        F.grouping_id("difficulty", "db_id").alias("g"),
        F.count_if(is_right()).alias("correct"), F.count(F.lit(1)).alias("total"))
    block = F.when(F.col("g") == 1, "difficulty").when(F.col("g") == 2, "database").otherwise("overall")
    return sets.select(
        block.alias("block"),
        F.coalesce("difficulty", "db_id", F.lit("all")).alias("key"),
        "correct", "total", pct(F.col("correct"), F.col("total")).alias("accuracy"))

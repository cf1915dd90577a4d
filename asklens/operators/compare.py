"""Comparison of generated and expected result sets, and of predicted and true schema links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GENERATED, GOLD = "generated", "gold"


def compare_results(rows: DataFrame, questions: DataFrame, key: str = "question_id",
                    side: str = "side", failures: DataFrame | None = None) -> DataFrame:
    """For every question: is the set of generated rows the set of gold rows?

    ``rows`` is the long table (key, side, value columns...). Duplicates and order do not
    matter, and a question without rows on either side is equal. NULLs compare as equal.
    ``failures`` (key, side) lists SQL texts that did not run: by default they count as empty
    results; when given, a question with a failed side is never equal.

    Shuffles are on (key, value columns), so a question with a huge result is spread over all
    tasks, and the per-question step only sees map-side combined counts.
    """
    values = [c for c in rows.columns if c not in (key, side)]
    flags = rows.groupBy(key, *values).agg(
        F.max(F.col(side) == GENERATED).alias("in_generated"),
        F.max(F.col(side) == GOLD).alias("in_gold"),
    )
    per_question = flags.groupBy(key).agg(
        F.count_if("in_generated").alias("generated_distinct"),
        F.count_if("in_gold").alias("gold_distinct"),
        F.count_if(F.col("in_generated") & F.col("in_gold")).alias("shared_distinct"),
    )
    counts = ["generated_distinct", "gold_distinct", "shared_distinct"]
    out = questions.select(key).dropDuplicates().join(per_question, key, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in counts})
    equal = (F.col("shared_distinct") == F.col("generated_distinct")) & (
        F.col("shared_distinct") == F.col("gold_distinct"))
    if failures is not None:
        failed = failures.select(key).dropDuplicates().withColumn("_failed", F.lit(True))
        out = out.join(failed, key, "left")
        equal = equal & F.col("_failed").isNull()
    return out.withColumn("execution_match", equal).drop("_failed")


def results_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One pair of result tables as sets: one row with the two difference counts and the verdict."""
    sides = left.withColumn("_l", F.lit(True)).unionByName(right.withColumn("_l", F.lit(False)))
    rows = sides.groupBy(*left.columns).agg(F.max("_l").alias("in_left"), F.max(~F.col("_l")).alias("in_right"))
    return rows.agg(
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("only_left"),
        F.count_if(F.col("in_right") & ~F.col("in_left")).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def count_difference(rows: DataFrame, questions: DataFrame, key: str = "question_id",
                     side: str = "side") -> DataFrame:
    """Generated and gold row counts (duplicates included) and their difference per question."""
    counts = rows.groupBy(key).agg(
        F.count_if(F.col(side) == GENERATED).alias("generated_row_count"),
        F.count_if(F.col(side) == GOLD).alias("ground_truth_row_count"),
    )
    out = questions.select(key).dropDuplicates().join(counts, key, "left").withColumns({
        c: F.coalesce(c, F.lit(0)) for c in ("generated_row_count", "ground_truth_row_count")})
    return out.withColumn(
        "row_count_difference", F.col("generated_row_count") - F.col("ground_truth_row_count"))


def linking_scores(predicted: DataFrame, truth: DataFrame, key: str = "question_id") -> DataFrame:
    """Precision, recall and F1 of predicted schema items (key, kind, item) per question and kind.

    Both sides are reduced to distinct items in one aggregation; no join is needed. A side with
    nothing to find or nothing predicted scores 0 unless both are empty.
    """
    tagged = predicted.select(key, "kind", "item", F.lit(True).alias("p")).unionByName(
        truth.select(key, "kind", "item", F.lit(False).alias("p")))
    items = tagged.groupBy(key, "kind", "item").agg(
        F.max("p").alias("is_predicted"), F.max(~F.col("p")).alias("is_true"))
    scores = items.groupBy(key, "kind").agg(
        F.count_if("is_predicted").alias("n_predicted"),
        F.count_if("is_true").alias("n_true"),
        F.count_if(F.col("is_predicted") & F.col("is_true")).alias("n_hit"),
    )
    return _with_scores(scores)


def linking_scores_overall(scores: DataFrame) -> DataFrame:
    """Micro-averaged scores over all questions, per kind."""
    return _with_scores(scores.groupBy("kind").agg(
        *[F.sum(c).alias(c) for c in ("n_predicted", "n_true", "n_hit")]))


def _with_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "precision": F.col("n_hit") / F.greatest("n_predicted", F.lit(1)),
        "recall": F.col("n_hit") / F.greatest("n_true", F.lit(1)),
        "f1": F.lit(2.0) * F.col("n_hit") / F.greatest(
            F.col("n_predicted") + F.col("n_true"), F.lit(1)),
    })

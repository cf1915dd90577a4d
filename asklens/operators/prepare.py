"""Preparation of example sets: usable rows, validation, merging, recombination, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asklens.session import written


def usable_examples(examples: DataFrame, catalog: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, (reason, n) of the skipped ones).

    A row is skipped for the first of: no question or SQL text, no schema for its database,
    no labels. ``labels`` lists the example_ids whose SQL gave at least one table or column.
    """
    dbs = catalog.select("db_id").dropDuplicates().withColumn("_schema", F.lit(True))
    labelled = labels.select("example_id").dropDuplicates().withColumn("_labels", F.lit(True))
    blank = (F.coalesce("question", F.lit("")) == "") | (F.coalesce("sql", F.lit("")) == "")
    reason = F.when(blank, "missing question or sql").when(
        F.col("_schema").isNull(), "no schema for database").when(F.col("_labels").isNull(), "no labels")
    judged = examples.join(dbs, "db_id", "left").join(labelled, "example_id", "left").select(
        *examples.columns, reason.alias("_reason"))
    skipped = judged.where(F.col("_reason").isNotNull()).groupBy(F.col("_reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))
    return judged.where(F.col("_reason").isNull()).drop("_reason"), skipped


def validation_report(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row total / valid / invalid, one row per missing field with a message).

    The counts come from one pass; the messages are a table, not a growing list.
    """
    lacks = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("question", "sql")]
    missing = F.filter(F.array(*lacks), lambda c: c.isNotNull())
    counts = examples.select(F.size(missing).alias("m")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("m") == 0).alias("valid"),
        F.count_if(F.col("m") > 0).alias("invalid"))
    errors = examples.select("example_id", F.explode(missing).alias("field")).select(
        "example_id", "field",
        F.concat(F.lit("Example "), "example_id", F.lit(": Missing '"), "field", F.lit("' field")).alias("message"))
    return counts, errors


def _unseen(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Each (question, sql) of ``new`` that ``existing`` lacks, the first one by id.

    New rows are reduced by an aggregation that combines on the map side, so one text repeated in
    a third of the rows costs nothing extra, and both sides of the match are distinct. NULLs
    match NULLs.
    """
    rest = [c for c in new.columns if c not in ("question", "sql", "example_id")]
    firsts = new.groupBy("question", "sql").agg(
        F.min(F.struct("example_id", *rest)).alias("r")).select("question", "sql", "r.*")
    seen = existing.select(F.col("question").alias("_q"), F.col("sql").alias("_s")).dropDuplicates()
    return firsts.join(
        seen, F.col("question").eqNullSafe(F.col("_q")) & F.col("sql").eqNullSafe(F.col("_s")), "left_anti")


def merge_examples(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All existing rows, duplicates included, plus the unseen ones of ``new``."""
    return existing.unionByName(_unseen(existing, new), allowMissingColumns=True)


def example_key(question: str = "question", sql: str = "sql") -> Column:
    """128 bits that tell (question, sql) apart, NULL from empty text included."""
    parts = F.to_json(F.struct(F.col(question).alias("q"), F.col(sql).alias("s")))
    return F.unhex(F.md5(parts))


def stored_keys(index: DataFrame, batch: DataFrame) -> DataFrame:
    """The keys of ``batch`` that the stored corpus has; of the corpus, only its column ``key`` is read."""
    return index.select("key").join(batch.select("key"), "key", "left_semi")


def append_examples(index: DataFrame, new: DataFrame, derive, replace: DataFrame | None = None) -> DataFrame:
    """Rows to append to a stored corpus: unseen (question, sql) with derived columns.

    ``derive(df)`` adds the corpus columns (skeleton, vector, cell) and runs on the unseen rows
    only; what is stored is not computed again. An index with a column ``key`` (``example_key``) is asked by that column
    alone: the batch's keys, which are few, are matched with the scan of the stored ones, so neither texts nor the corpus
    are shuffled; the rows get their ``key`` too. Without the column the texts are compared. ``replace`` takes
    the place of the stored corpus for this call: its rows, repeats left out, are derived and nothing stored is looked at.
    """
    keyed = "key" in index.columns
    if replace is not None:
        index, new = index.limit(0), replace
    if not keyed:
        return derive(written(_unseen(index, new).select("example_id", "question", "sql", "db_id"), "unseen"))
    rows = new.select("example_id", "question", "sql", "db_id", example_key().alias("key"))
    batch = written(rows.groupBy("key").agg(
        F.min(F.struct("example_id", "question", "sql", "db_id")).alias("r")).select("r.*", "key"), "batch")
    unseen = written(batch.join(stored_keys(index, batch), "key", "left_anti"), "unseen")
    derived = derive(unseen.drop("key"))
    return derived.withColumn("key", example_key())


VARIATION = T.StructType([T.StructField(c, T.StringType()) for c in ("q1", "reasoning1", "q2", "reasoning2")])


def merge_generated(inputs: DataFrame, good: DataFrame, bad: DataFrame, key: str = "example_id") -> DataFrame:
    """Inputs with a question joined to their generated output by id.

    ``good`` holds the variation fields and ``bad`` (error, raw_response); a row gets one or the
    other. Missing variation fields are empty text.
    """
    named = inputs.where(F.coalesce("question", F.lit("")) != "")
    out = named.join(good.select(key, F.lit(True).alias("_got"), *VARIATION.names), key, "left").join(
        bad.select(key, "error", "raw_response"), key, "left")
    return out.withColumns({
        c: F.when(F.col("_got"), F.coalesce(c, F.lit(""))) for c in VARIATION.names}).drop("_got")


def variants_long(enhanced: DataFrame, key: str = "example_id") -> tuple[DataFrame, DataFrame]:
    """((key, variant, question, reasoning, sql, db_id), rows that carry an error)."""
    ok = enhanced.where(F.col("error").isNull())
    pairs = F.array(*[
        F.struct(F.lit(i).alias("variant"), F.col(f"q{i}").alias("question"), F.col(f"reasoning{i}").alias("reasoning"))
        for i in (1, 2)])
    rows = ok.select(key, "sql", "db_id", F.explode(pairs).alias("v")).select(
        key, "v.variant", "v.question", "v.reasoning", "sql", "db_id")
    return rows.where(F.coalesce("question", F.lit("")) != ""), enhanced.where(F.col("error").isNotNull()).select(
        key, "error", "raw_response")

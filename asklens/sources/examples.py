"""Example corpora and training pairs: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asklens.schemas import PAIR
from asklens.sources.json_ranges import json_entries

_OBJECT = "map<string,string>"


def _objects(spark: SparkSession, path: str, lines: bool, split_bytes: int | None = None) -> DataFrame:
    """Each JSON object as a case-sensitive map ``o``, with ``file`` and ``pos`` in the file.

    A JSON array is one document and is parsed by one task per file, unless ``split_bytes`` has it read by ranges of that size.
    JSON lines (``lines=True``) are split by Spark.
    """
    if split_bytes and not lines:
        entries = json_entries(spark, path, split_bytes)
        # Unfolded, so that filters on its keys do not parse each entry again.
        return entries.select(F.explode_outer(F.array(F.from_json("value", _OBJECT))).alias("o"), "file", "pos")
    if lines:
        text = spark.read.text(path).where(F.trim("value") != "")
        return text.select(
            F.from_json("value", _OBJECT).alias("o"),
            F.col("_metadata.file_path").alias("file"), F.lit(None).cast("int").alias("pos"))
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return text.select("file", F.posexplode(F.from_json("value", f"array<{_OBJECT}>")).alias("pos", "o"))


def _number(*content: Column) -> Column:
    """The entry's number; without one, a number from its own id text, or else from its content, so equal entries share it."""
    given = F.col("o")["example_id"]
    made = F.when(given.isNotNull(), F.xxhash64(given)).otherwise(F.xxhash64(*content))
    return F.coalesce(F.expr("try_cast(o['example_id'] AS bigint)"), made).alias("example_id")


def _first(objects: DataFrame, limit: int | None, lines: bool) -> DataFrame:
    """The first entries by path and place; lines of a split file have no place."""
    if limit is None:
        return objects
    if lines:
        raise ValueError("limit needs a place in the file, which JSON lines do not have")
    return objects.orderBy("file", "pos").limit(limit)


def _field(*names: str) -> Column:
    return F.coalesce(*[F.col("o")[n] for n in names])


def read_examples(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False,
                  strict: bool = False, split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Example corpus from JSON; ``Question``/``SQL`` are accepted for ``question``/``sql``.

    Returns (good, bad): rows lacking either required key go to ``bad`` with the keys they have.
    ``strict=True`` raises when there is any. ``limit`` keeps the first rows by path and place (not for ``lines``).
    ``split_bytes`` reads large arrays by ranges of that size, from local paths or addresses that Arrow opens.
    """
    objects = _first(_objects(spark, path, lines, split_bytes), limit, lines)
    question, sql = _field("Question", "question"), _field("SQL", "sql")
    fields = objects.select(
        _number(question, sql, F.col("o")["db_id"]), question.alias("question"), sql.alias("sql"),
        F.col("o")["db_id"].alias("db_id"),
        F.array_sort(F.map_keys("o")).alias("found_keys"))
    complete = F.col("question").isNotNull() & F.col("sql").isNotNull()
    good, bad = fields.where(complete).drop("found_keys"), fields.where(~complete)
    if strict:
        first = bad.take(1)
        if first:
            raise ValueError(f"entry without 'question' or 'sql'; keys found: {first[0]['found_keys']}")
    return good, bad


def read_spider(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Spider train file: ``query`` becomes ``sql`` and missing fields become empty text.

    ``limit`` keeps the first rows by file and place.
    """
    objects = _first(_objects(spark, path, lines), limit or None, lines)
    empty = F.lit("")
    return objects.select(
        _number(F.col("o")["question"], F.col("o")["query"], F.col("o")["db_id"]),
        F.coalesce(F.col("o")["question"], empty).alias("question"),
        F.coalesce(F.col("o")["query"], empty).alias("sql"),
        F.coalesce(F.col("o")["db_id"], empty).alias("db_id"))


def read_example_dir(spark: SparkSession, path: str, pattern: str = "*.json", split_bytes: int | None = None) -> DataFrame:
    """Examples from a directory of JSON files of mixed shapes.

    A file is a list of examples, or an object holding such a list under ``data`` or
    ``examples``, or one bare example. Files describing a schema are skipped.
    With ``split_bytes``, lists are read by ranges of that size; objects are read whole.
    """
    if split_bytes:
        entries = json_entries(spark, path, split_bytes, pattern)
        files = entries.where("NOT listed").select(F.regexp_replace("value", r"^\s+", "").alias("v"))
        return _example_rows(_file_entries(files).unionByName(
            entries.where("listed").select(F.from_json("value", _OBJECT).alias("o"))))
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(
        F.regexp_replace("value", r"^\s+", "").alias("v"))
    return _example_rows(_file_entries(files))


def _file_entries(files: DataFrame) -> DataFrame:
    """The examples ``o`` in whole documents ``v``."""
    whole = F.from_json("v", _OBJECT)
    listed = F.col("v").startswith("[")
    # "examples" counts only without "data"; an empty list leaves the object itself.
    wrapped = F.coalesce(whole["data"], whole["examples"], F.lit("[]"))
    is_list = F.regexp_replace(wrapped, r"\s", "") != "[]"
    entries = (
        F.when(listed, F.from_json("v", f"array<{_OBJECT}>"))
        .when(is_list, F.from_json(wrapped, f"array<{_OBJECT}>"))
        .when(whole["table_names_original"].isNotNull(), F.array().cast(f"array<{_OBJECT}>"))
        .otherwise(F.array(whole)))
    return files.select(F.explode(entries).alias("o"))


def _example_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        _number(F.col("o")["question"], F.coalesce(F.col("o")["query"], F.col("o")["SQL"]), F.col("o")["db_id"]),
        F.coalesce(F.col("o")["question"], F.lit("")).alias("question"),
        F.coalesce(F.col("o")["query"], F.col("o")["SQL"], F.lit("")).alias("sql"),
        F.coalesce(F.col("o")["db_id"], F.lit("")).alias("db_id"))


def write_examples(df: DataFrame, path: str) -> None:
    df.select("example_id", "question", "sql", "db_id").write.json(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Training pairs as JSON lines with exactly the keys input, output and db_id."""
    pairs.select("input", "output", F.coalesce("db_id", F.lit("")).alias("db_id")).write.json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Training pairs from JSON lines; blank lines are skipped."""
    return spark.read.schema(PAIR).json(path).where(
        F.col("input").isNotNull() | F.col("output").isNotNull())

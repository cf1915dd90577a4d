"""Two rounds of answers for a whole table of questions at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asklens.functions.batch_score import batch_score
from asklens.functions.text import clean_sql
from asklens.operators import edit, log, masking, prompts, responses, schema, similarity
from asklens.session import written

ANSWER = T.StructType([T.StructField("sql", T.StringType()), T.StructField("reasoning", T.StringType())])


def parsed_answers(scored: DataFrame) -> DataFrame:
    """(question_id, sql, reasoning, error): answers out of responses; text that is no JSON object is the SQL.

    ``error`` is that of the model call, NULL for a call that went well.
    """
    good, bad = responses.extract_json(scored.select("question_id", "response"), "response", ANSWER)
    both = good.unionByName(bad.select("question_id", F.col("raw_response").alias("sql"), F.lit("").alias("reasoning")))
    failed = scored.where("error IS NOT NULL").select("question_id", "error")
    return both.join(failed, "question_id", "left").select(
        "question_id", "error", clean_sql(F.col("sql")).alias("sql"), F.trim(F.coalesce("reasoning", F.lit(""))).alias("reasoning"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def question_vectors(questions: DataFrame, examples: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of the question templates of both tables, masked and weighted together:
    (query_id, embedding) and (id, embedding)."""
    def keyed(df: DataFrame, key: str, asks: bool) -> DataFrame:
        return df.select(F.struct(F.lit(asks).alias("q"), F.col(key).alias("k")).alias("example_id"), "question", "db_id")

    both = keyed(questions, "question_id", True).unionByName(keyed(examples, "example_id", False))
    masked = masking.question_skeletons(both, catalog)
    vectors = written(
        masking.text_vectors(masked, "question_skeleton").select("example_id.q", "example_id.k", "embedding"), "vectors")
    return (vectors.where("q").select(F.col("k").alias("query_id"), "embedding"),
            vectors.where("NOT q").select(F.col("k").alias("id"), "embedding"))


@dataclass(frozen=True)
class StoredCorpus:
    """Examples with SQL templates and question vectors, and what makes the vectors of new questions alike."""

    rows: DataFrame  # example_id, question, sql, db_id, skeleton, embedding
    words: DataFrame
    weights: PipelineModel

    def vectors(self, questions: DataFrame, catalog: DataFrame) -> DataFrame:
        """(query_id, embedding) of questions (question_id, db_id, question), by the corpus's words and weights."""
        masked = masking.question_skeletons(
            questions.select(F.col("question_id").alias("example_id"), "question", "db_id"), catalog, words=self.words)
        return masking.text_vectors(masked, "question_skeleton", weights=self.weights).select(
            F.col("example_id").alias("query_id"), "embedding")


def write_corpus(examples: DataFrame, catalog: DataFrame, path: str, dim: int = 384) -> None:
    """Store examples (example_id, question, sql, db_id) ready for ``generate_answers``: templates, vectors, word counts, weights.

    The folder must not exist. Rows come last, so one without ``rows`` is unfinished.
    """
    spark = examples.sparkSession
    masking.word_counts(examples).write.parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    masked = written(masking.question_skeletons(examples, catalog, words=words), "masked")
    weights = masking.fit_vectors(masked, "question_skeleton", dim)
    weights.save(f"{path}/weights")
    vectors = masking.text_vectors(masked, "question_skeleton", weights=weights).drop("question_skeleton")
    log.sql_skeletons(vectors).select(
        "example_id", "question", "sql", "db_id", "skeleton", "embedding").write.parquet(f"{path}/rows")


def read_corpus(spark: SparkSession, path: str) -> StoredCorpus:
    return StoredCorpus(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/words"), PipelineModel.load(f"{path}/weights"))


def _others(search: Callable[[int], DataFrame], n: int, own: DataFrame | None) -> DataFrame:
    """The n best hits (query_id, id, rank, ...) that are not a question's own examples, ranked anew.

    ``search(m)`` gives the m best; as many more are asked for as any question owns.
    """
    if own is None:
        return search(n)
    pairs = own.select(F.col("question_id").alias("query_id"), F.col("example_id").alias("id")).distinct()
    most = pairs.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    rest = search(n + most).join(pairs, ["query_id", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return rest.withColumn("rank", place).where(F.col("rank") <= n)


def generate_answers(questions: DataFrame, examples: DataFrame | StoredCorpus, catalog: DataFrame, make_fn: Callable,
                     linking: DataFrame | None = None, n: int = 3, batch_size: int = 16,
                     partitions: int | None = None, run_dir: str | None = None,
                     own: DataFrame | None = None) -> DataFrame:
    """Final answers of ``questions`` (question_id, db_id, question, evidence).

    Round 1 shows the n examples (example_id, question, sql, db_id) with the most similar question
    templates; round 2 shows those whose SQL templates are closest to the draft's. Responses are
    written after each round, so nothing that follows repeats a model call. ``linking`` is
    (question_id as text, schema_json); other questions see their database's whole schema.

    Beside the final answer a row has both rounds' texts, reasoning and validity, the number of examples shown
    and ``error``, that of the last failed model call: an outage is told from a bad answer. ``partitions`` spreads the model calls.
    With a ``run_dir`` the responses of both rounds are kept there beside a hash of their prompts, and a repeated run asks only for
    questions that have none without error to the same prompt.

    With a ``StoredCorpus`` the stored vectors and templates are read as they are, and only the questions are masked and weighted.
    ``own`` (question_id, example_id) names examples not to be shown for a question, such as the one it was taken from.
    """
    texts = schema.schema_json(schema.schema_text_rows(schema.schema_text(catalog, "typed")))
    if linking is None:
        linking = questions.sparkSession.createDataFrame([], "question_id string, schema_json string")
    full = written(schema.schema_for_question(questions, linking, texts), "questions")
    ids = full.select(F.col("question_id").alias("query_id"))

    def prompted(rows: DataFrame, context: DataFrame, template: str) -> DataFrame:
        shown = rows.join(context.withColumnRenamed("query_id", "question_id"), "question_id")
        return shown.select("question_id", prompts.filled(template).alias("prompt"))

    def answered(rows: DataFrame, label: str) -> DataFrame:
        spark = rows.sparkSession
        if run_dir is None:
            return written(parsed_answers(written(batch_score(rows, make_fn, batch_size, partitions=partitions), label)), label + "-parsed")
        kind = rows.schema["question_id"].dataType
        layout = T.StructType([T.StructField("question_id", kind)] + [
            T.StructField(c, T.StringType()) for c in ("asked", "response", "error")])
        hashes = rows.select("question_id", F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("asked"))
        kept = spark.read.schema(layout).parquet(f"{run_dir}/{label}") if _exists(spark, f"{run_dir}/{label}") \
            else spark.createDataFrame([], layout)
        done = kept.where("error IS NULL").join(hashes, ["question_id", "asked"], "left_semi").select("question_id").distinct()
        new = batch_score(rows, make_fn, batch_size, done=done, partitions=partitions)
        new.join(hashes, "question_id").select(*layout.names).write.mode("append").parquet(f"{run_dir}/{label}")
        every = spark.read.schema(layout).parquet(f"{run_dir}/{label}")
        # The successful response of a question that was asked again is the one that counts.
        last = every.join(hashes, ["question_id", "asked"], "left_semi").groupBy("question_id").agg(F.min_by(
            F.struct("response", "error"), F.struct(F.col("error").isNotNull(), F.xxhash64("response"))).alias("r"))
        return written(parsed_answers(last.select("question_id", "r.response", "r.error")), label + "-parsed")

    if isinstance(examples, StoredCorpus):
        corpus = examples.rows
        asked, known = written(examples.vectors(full, catalog), "asked"), corpus.select(F.col("example_id").alias("id"), "embedding")
        examples = corpus
    else:
        corpus = None
        asked, known = question_vectors(full, examples, catalog)
    near = written(_others(lambda m: similarity.knn_exact(asked, known, m), n, own), "near")
    similar = prompts.fewshot_context(near, examples, n, questions=ids)
    first = answered(prompted(full, similar, prompts.DRAFT_TEMPLATE), "round1")

    valid = responses.validate_answers(first.withColumnRenamed("sql", "raw"), "raw")
    draft = valid.select("question_id", F.coalesce(F.nullif("sql", F.lit("")), "raw").alias("sql"))
    draft = log.sql_skeletons(full.select("question_id", "db_id").join(draft, "question_id"))
    draft = written(draft.select("question_id", F.col("sql").alias("round_1_sql"), "skeleton"), "skeletons")
    if corpus is None:
        corpus = written(log.sql_skeletons(examples), "corpus")
    drafts = draft.select(F.col("question_id").alias("query_id"), "skeleton")
    shapes = corpus.select(F.col("example_id").alias("id"), "skeleton")
    hits = written(_others(lambda m: edit.edit_top_n(drafts, shapes, m), n, own), "hits")
    structural = prompts.fewshot_context(hits, corpus, n, with_skeleton=True, questions=ids)
    second = answered(prompted(full.join(draft, "question_id"), structural, prompts.REFINE_TEMPLATE), "round2")
    def told(answers: DataFrame, i: int) -> DataFrame:
        return responses.validate_answers(answers.withColumnRenamed("sql", "raw"), "raw").select(
            "question_id", F.col("raw").alias(f"round_{i}_text"), F.col("reasoning").alias(f"round_{i}_reasoning"),
            F.col("valid").alias(f"round_{i}_valid"), F.col("error").alias(f"_error_{i}"))

    def shown_count(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy(F.col("query_id").alias("question_id")).agg(F.count("*").alias(name))

    rounds = told(first, 1).join(told(second, 2), "question_id", "full")
    counts = shown_count(near, "n_similar").join(shown_count(hits, "n_structural"), "question_id", "full")
    final = responses.choose_answer(first.drop("error"), second.drop("error"))
    return final.join(rounds, "question_id").join(counts, "question_id", "left").withColumn(
        "error", F.coalesce("_error_2", "_error_1")).drop("_error_1", "_error_2")

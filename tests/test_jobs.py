"""Preparation, evaluation, reports, prompts, streaming and batched scoring."""

import json

import pytest
from pyspark.sql import functions as F

from asklens.functions.batch_score import batch_score
from asklens.functions.quantile import exact_median
from asklens.operators import compare, evaluate, masking, prepare, prompts, report, schema
from asklens.operators.log import query_lineage
from asklens.schemas import RECORD
from asklens.session import fresh_path, shared_dir
from asklens.streaming import running


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_usable_examples_first_reason_wins(spark, catalog):
    rows = spark.createDataFrame(
        [(1, "q", "s", "archive"), (2, "", "s", "nowhere"), (3, "q", None, "archive"), (4, "q", "s", "nowhere"),
         (5, "q", "s", "archive"), (6, "q", "s", None)], "example_id int, question string, sql string, db_id string")
    labels = spark.createDataFrame([(1,), (2,), (1,)], "example_id int")
    ok, skipped = prepare.usable_examples(rows, catalog, labels)
    assert [r.example_id for r in ok.collect()] == [1]
    assert {r.reason: r.n for r in skipped.collect()} == {
        "missing question or sql": 2, "no schema for database": 2, "no labels": 1}


def test_merge_examples(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, None, "y")], "example_id int, question string, sql string")
    new = spark.createDataFrame(
        [(9, "b", "z"), (8, "b", "z"), (7, "a", "x"), (6, None, "y"), (5, None, "z")], "example_id int, question string, sql string")
    out = sorted(r.example_id for r in prepare.merge_examples(old, new).collect())
    assert out == [1, 2, 3, 5, 8]
    merged = prepare.merge_examples(old, new)
    assert prepare.merge_examples(merged, new).count() == merged.count()


def test_compare_results(spark):
    rows = spark.createDataFrame([
        (1, "gold", 1, "a"), (1, "gold", 1, "a"), (1, "generated", 1, "a"),
        (2, "gold", 1, "a"), (2, "generated", 1, "b"), (3, "gold", None, None), (3, "generated", None, None),
        (4, "generated", 1, "a"), (6, "gold", 1, "a"), (6, "gold", 2, "a"), (6, "generated", 1, "a")],
        "question_id int, side string, k int, v string")
    questions = spark.createDataFrame([(i,) for i in range(1, 7)], "question_id int")
    out = {r.question_id: r.execution_match for r in compare.compare_results(rows, questions).collect()}
    assert out == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}
    # Which side is which does not matter.
    swapped = rows.withColumn("side", F.when(F.col("side") == "gold", "generated").otherwise("gold"))
    assert {r.question_id: r.execution_match for r in compare.compare_results(swapped, questions).collect()} == out
    failed = spark.createDataFrame([(5, "generated")], "question_id int, side string")
    strict = {r.question_id: r.execution_match for r in compare.compare_results(rows, questions, failures=failed).collect()}
    assert strict == out | {5: False}
    counts = {r.question_id: r.row_count_difference for r in compare.count_difference(rows, questions).collect()}
    assert counts == {1: -1, 2: 0, 3: 0, 4: 1, 5: 0, 6: -1}


def eval_rows(spark):
    return spark.createDataFrame([
        (1, "a", True, True, 1.0, None), (2, "a", False, True, 3.0, None), (3, "a", False, False, None, "Missing database file"),
        (4, "b", False, False, 2.0, "boom"), (5, "c", True, False, 0.5, None)],
        "question_id int, db_id string, is_correct boolean, valid boolean, execution_time double, error string")


def test_stats_and_merging(spark):
    rows = eval_rows(spark)
    by_db = {r.db_id: r.asDict() for r in evaluate.stats_by_database(rows).collect()}
    assert by_db["a"] == {
        "db_id": "a", "total": 3, "correct": 1, "valid": 2, "executed": 2, "errors": 1, "total_time": 4.0,
        "accuracy": 0.5, "validation_success_rate": 2 / 3, "average_execution_time": 4 / 3}
    assert by_db["b"]["accuracy"] == 0.0 and by_db["b"]["executed"] == 0
    overall = evaluate.stats_overall(rows).first()
    assert (overall.total, overall.correct, overall.executed, overall.errors) == (5, 2, 3, 2)
    assert evaluate.stats_overall(rows.where("false")).first().accuracy == 0.0
    parts = [evaluate.stats_by_database(rows.where(f"question_id % 2 = {i}")) for i in (0, 1)]
    merged = {r.db_id: r.asDict() for r in evaluate.merge_stats(parts).select(*evaluate.stats_by_database(rows).columns).collect()}
    assert merged == by_db


def test_combine_logs_orders_unknown_last(spark):
    a = spark.createDataFrame([(5, "x"), (1, "y")], "question_id int, v string")
    b = spark.createDataFrame([(9, "z"), (3, "w")], "question_id int, v string")
    order = spark.createDataFrame([("3", 0), ("5", 1), ("1", 2)], "question_id string, position int")
    assert [r.question_id for r in evaluate.combine_logs([a, b], order).collect()] == [3, 5, 1, 9]


def record(**fields):
    return {**{n: None for n in RECORD.names}, **fields}


@pytest.fixture(scope="module")
def nested(spark):
    alt = [{"sql": " A ", "all_sqls_in_group": ["B", "", None, "A"]}, {"sql": None, "all_sqls_in_group": None}, None]
    rows = [
        record(question_id=1, db_id="d1", difficulty="easy", is_correct=True, execution_times=[0.1, None, 0.3], execution_time=9.0,
               winner_confidence=0.9, generated_sql="A", metrics={"generated": 4, "execution_errors": 1, "valid_generations": 3, "unique_valid_sqls": 1}),
        record(question_id=2, db_id="", difficulty="", execution_match=False, is_correct=True, execution_times=[], execution_time=0.2,
               confidence=0.1, round_1_sql="A", round_2_sql="B", high_confidence_alternatives=alt, valid=True,
               selection={"selected_sql": "C", "confidence": 0.3, "candidates_count": 2}),
        record(question_id=3, db_id="d1", difficulty=None, execution_match=False, selection={"selected_sql": " ", "confidence": 0.5, "candidates_count": 1},
               round_1_sql="A", round_2_sql="D", final_valid=True, validation_error="", execution_error="x",
               metrics={"generated": 4, "execution_errors": None, "valid_generations": 3, "unique_valid_sqls": 1}),
    ]
    return spark.createDataFrame([tuple(r[n] for n in RECORD.names) for r in rows], RECORD)


def test_report_blocks(spark, nested):
    assert tuple(report.report_overall(nested).first()) == (3, 2, 1, 2 / 3 * 100)
    times = report.report_times(nested).first()
    assert times.total_queries_executed == 3 and times.median_ms == pytest.approx(200) and times.std_dev_ms == pytest.approx(81.6496580927726)
    texts = {r.question_id: r.variations for r in report.with_variations(nested).collect()}
    assert texts == {1: ["A"], 2: ["A", "B", "C"], 3: ["A", "D"]}
    g = report.report_generation(nested).first()
    # Row 1 from its metrics (4, 3, 1); row 2 derived (3, 1, 2); row 3 has an error (2, 1, 1).
    assert (g.total_sql_generated, g.valid_executions, g.execution_errors, g.unique_sql_variations) == (9, 5, 4, 4)
    c = report.report_confidence(nested).first()
    assert (c["count"], c.median_confidence, c.high_confidence_count, c.low_confidence_count) == (3, 0.5, 1, 1)
    assert [(r.difficulty, r.total) for r in report.report_by(nested, "difficulty").collect()] == [("Unknown", 2), ("easy", 1)]
    assert [(r.db_id, r.accuracy) for r in report.report_by(nested, "db_id").collect()] == [("unknown", 100.0), ("d1", 50.0)]
    s = report.report_selection(nested).first()
    assert (s.selection_made, s.majority_vote_used) == (1, 1)
    cube = {(r.block, r.key): (r.correct, r.total) for r in report.report_cube(nested).collect()}
    assert cube == {("overall", "all"): (2, 3), ("difficulty", "Unknown"): (1, 2), ("difficulty", "easy"): (1, 1),
                    ("database", "unknown"): (1, 1), ("database", "d1"): (1, 2)}


def test_report_of_nothing(spark, nested):
    none = nested.where("false")
    assert report.report_overall(none).first().accuracy == 0.0
    times = report.report_times(none).first()
    assert times.total_queries_executed == 0 and times.median_ms is None and times.std_dev_ms is None
    assert report.report_generation(none).first().avg_unique_sql_variations_per_question == 0.0
    assert report.report_confidence(none).first()["count"] == 0


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [5.0] * 7 + [1.0], [1.0, 1.0, 2.0, 9.0], list(map(float, range(1000)))])
def test_exact_median(spark, values):
    import statistics

    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert exact_median(df, "v") == statistics.median(values)


def test_split_is_exact_and_seeded(spark):
    rows = spark.range(1003).withColumnRenamed("id", "example_id")
    out = prompts.split_pairs(rows, 0.1, 7)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": int(1003 * (1 - 0.1)), "validation": 1003 - int(1003 * (1 - 0.1))}
    again = prompts.split_pairs(rows.repartition(5), 0.1, 7)
    assert out.exceptAll(again).count() == 0
    assert prompts.split_pairs(rows, 0.1, 8).exceptAll(out).count() > 0


def test_split_keeps_rows_without_a_key(spark):
    rows = spark.createDataFrame([(None,), (None,), (1,), (2,)], "example_id int")
    counts = {r.split: r["count"] for r in prompts.split_pairs(rows, 0.5).groupBy("split").count().collect()}
    assert counts == {"train": 2, "validation": 2}


def test_split_of_many_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(prompts, "_RANKED", 50)
    monkeypatch.setattr(prompts, "_COPIES", 1000)
    # Nine in ten rows have the key 7; of these, half are equal throughout and the rest differ elsewhere.
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("example_id"),
        F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-1).alias("x"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    for ratio in (0.0, 0.1, 0.5, 1.0):
        out = prompts.split_pairs(rows, ratio)
        counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
        want = int(20_000 * (1 - ratio))
        assert counts.get("train", 0) == want and counts.get("validation", 0) == 20_000 - want
        flat = "example_id", "x"
        assert out.select(*flat).exceptAll(rows.select(*flat)).count() == 0
        # Along the order of the hashes, the training part ends where the other begins.
        ends = {r.split: (r.lo, r.hi) for r in out.withColumn("h", F.expr("md5(concat('42:', example_id))")).groupBy("split").agg(
            F.min("h").alias("lo"), F.max("h").alias("hi")).collect()}
        assert len(ends) == 1 or ends["train"][1] <= ends["validation"][0]
    assert prompts.split_pairs(rows.limit(0)).count() == 0


def test_split_compares_with_the_cut_alone(spark):
    plan = prompts.split_pairs(spark.range(100_000).withColumnRenamed("id", "example_id"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_append_asks_the_stored_keys_alone(spark, tmp_path):
    fields = "example_id int, question string, sql string, db_id string"
    old = spark.createDataFrame([(1, "q", "s", "d"), (2, None, "s", "d"), (3, "", "s", "d"), (3, "", "s", "d")], fields)
    path = str(tmp_path / "index")
    old.withColumn("key", prepare.example_key()).withColumn("cell", F.lit(0)).write.parquet(path)
    index = spark.read.parquet(path)
    new = spark.createDataFrame([(9, "q", "s", "x"), (8, "q", "S", "d"), (7, "q", "S", "d"), (6, None, None, "d"),
                                 (5, None, "s", "d"), (4, "qs", "", "d")], fields)
    calls = []

    def derive(rows):
        calls.append(rows)
        return rows.withColumn("cell", F.lit(1))

    out = prepare.append_examples(index, new, derive)
    assert sorted((r.example_id, r.question, r.sql) for r in out.collect()) == [(4, "qs", ""), (6, None, None), (7, "q", "S")]
    assert sorted(out.columns) == ["cell", "db_id", "example_id", "key", "question", "sql"]
    plain = prepare.append_examples(index.drop("key"), new, derive)
    assert sorted(r.example_id for r in plain.collect()) == [4, 6, 7]
    out.select(*index.columns).write.mode("append").parquet(path)
    assert prepare.append_examples(spark.read.parquet(path), new, derive).count() == 0
    assert prepare.append_examples(index, new.limit(0), derive).count() == 0
    # A corpus for one call stands alone.
    other = prepare.append_examples(index, new, derive, replace=old)
    assert sorted(r.example_id for r in other.collect()) == [1, 2, 3]
    # The match reads the key column of the corpus and nothing else of it.
    seen = prepare.stored_keys(index, new.withColumn("key", prepare.example_key()))
    assert "ReadSchema: struct<key:binary>" in seen._jdf.queryExecution().executedPlan().toString()


def test_training_pairs(spark, sample, catalog):
    lineage, _ = query_lineage(sample, key="example_id")
    pairs = {r.example_id: r for r in prompts.training_pairs(
        sample, lineage.drop("db_id"), schema.schema_text(catalog)).collect()}
    # The weather database has no schema.
    assert set(pairs) == set(range(12)) - {10}
    question = "Which ferries were built before 1990?"
    assert json.loads(pairs[0].output) == {
        "tables": [{"name": "Ferry", "reason": f"Used in the query to answer the question: {question}"}],
        "columns": [{"name": f"Ferry.{c}", "reason": f"Referenced in the query to answer: {question}"} for c in ("built", "label")]}
    assert question in pairs[0].input and "Ferry(id, label, built)" in pairs[0].input
    box = json.loads(pairs[5].output)
    assert box["columns"] == [] and box["tables"][0]["name"] == "Box"
    short = {r.example_id: r for r in prompts.training_pairs(
        sample, lineage.drop("db_id"), schema.schema_text(catalog), quoted=7).collect()}
    assert json.loads(short[0].output)["tables"][0]["reason"].endswith("question: Which f")


def test_prompt_round_trip(spark):
    questions = spark.createDataFrame([(1, "a", "How\nmany?", ""), (2, "b", "Why?", "e")], "question_id int, db_id string, question string, evidence string")
    schemas = spark.createDataFrame([("a", "S1"), ("b", "S2")], "db_id string, schema_json string")
    contexts = spark.createDataFrame([(1, "c1")], "query_id int, context string")
    table = prompts.prompt_table(questions, schemas, contexts)
    back = prompts.split_prompt(table.select("question_id", "prompt"), prompts.DRAFT_TEMPLATE, ["question", "schema_json", "context", "evidence"])
    got = {r.question_id: (r.question, r.schema_json, r.context, r.evidence) for r in back.collect()}
    none = prompts.NOTHING
    assert got == {1: ("How\nmany?", "S1", "c1", none), 2: ("Why?", "S2", none, "e")}


def test_fewshot_context(spark):
    hits = spark.createDataFrame([(1, 20, 2), (1, 10, 1), (1, 30, 3), (1, 40, 4)], "query_id int, id int, rank int")
    ex = spark.createDataFrame([(i, f"q{i}", f"s{i}", f"k{i}") for i in (10, 20, 30, 40)], "example_id int, question string, sql string, skeleton string")
    questions = spark.createDataFrame([(1,), (2,)], "query_id int")
    out = {r.query_id: r.context for r in prompts.fewshot_context(hits, ex, 2, True, questions).collect()}
    assert out == {1: "Question: q10\nSQL: s10\nSQL Skeleton: k10\n\nQuestion: q20\nSQL: s20\nSQL Skeleton: k20", 2: "(none provided)"}


def test_question_skeletons(spark, catalog):
    rows = spark.createDataFrame([
        (1, 'How many Ferry rows have depth over 20?', "harbour"), (2, "How many rows have zebra's   label 'Bob'?", "harbour"),
        (3, "How many rows have 3,500.5 depth?", "none")], "example_id int, question string, db_id string")
    out = {r.example_id: r.question_skeleton for r in masking.question_skeletons(rows, catalog).collect()}
    assert out == {
        1: "How many [ENTITY] rows have [ATTRIBUTE] [ENTITY] [VALUE]?",
        2: "How many rows have [ENTITY] [ATTRIBUTE] [VALUE]?",
        3: "How many rows have [VALUE] depth?"}


def test_words_by_frequency(spark, catalog):
    rows = spark.createDataFrame([(i, f"the same old word{i} pair{i // 2}", "none") for i in range(9)], "example_id int, question string, db_id string")
    out = {r.question_skeleton for r in masking.question_skeletons(rows, catalog).collect()}
    assert out == {"the same old [ENTITY] pair0", "the same old [ENTITY] pair1", "the same old [ENTITY] pair2",
                   "the same old [ENTITY] pair3", "the same old [ENTITY] [ENTITY]"}
    out = {r.question_skeleton for r in masking.question_skeletons(rows, catalog, min_df=3).collect()}
    assert out == {"the same old [ENTITY] [ENTITY]"}

def test_text_vectors_are_unit_length(spark):
    rows = spark.createDataFrame([(1, "how many [ENTITY] are there"), (2, "list all [ENTITY] by [ATTRIBUTE]"), (3, "how many [ENTITY] are there")], "id int, t string")
    out = {r.id: r.embedding for r in masking.text_vectors(rows, "t", 64).collect()}
    assert len(out[1]) == 64 and sum(v * v for v in out[1]) == pytest.approx(1.0, abs=1e-5)
    assert out[1] == out[3] != out[2]


def test_vectors_of_old_rows_do_not_change(spark, tmp_path):
    old = spark.createDataFrame([(1, "how many [ENTITY] are there"), (2, "list all [ENTITY]"), (3, "list many")], "id int, t string")
    masking.fit_vectors(old, "t", 64).save(str(tmp_path / "weights"))
    from pyspark.ml import PipelineModel

    weights = PipelineModel.load(str(tmp_path / "weights"))
    more = old.unionByName(spark.createDataFrame([(4, "list list how"), (5, None)], "id int, t string"))
    before = {r.id: r.embedding for r in masking.text_vectors(old, "t", 64).collect()}
    after = {r.id: r.embedding for r in masking.text_vectors(more, "t", weights=weights).collect()}
    assert set(after) == {1, 2, 3, 4} and all(after[i] == before[i] for i in before)


def test_two_rounds_on_a_stored_corpus(spark, sample, catalog, tmp_path):
    from asklens.operators import rounds

    path, run = str(tmp_path / "corpus"), str(tmp_path / "run")
    rounds.write_corpus(sample, catalog, path, 64)
    stored = rounds.read_corpus(spark, path)

    def model():
        import re

        def fn(texts):
            # The SQL texts shown, as one answer.
            return [json.dumps({"sql": "SELECT '" + "|".join(sorted(re.findall(r"(?m)^SQL: (.*)$", t))).replace("'", "") + "'", "reasoning": ""})
                    for t in texts]

        return fn

    questions = sample.select(F.col("example_id").alias("question_id"), "db_id", "question", F.lit("").alias("evidence"))
    own = questions.select("question_id", F.col("question_id").alias("example_id"))
    out = {r.question_id: r for r in rounds.generate_answers(questions, stored, catalog, model, run_dir=run, own=own).collect()}
    sqls = {r.example_id: r.sql.replace("'", "") for r in sample.collect()}
    assert len(out) == 12
    for key, r in out.items():
        for text in (r.round_1_text, r.round_2_text):
            shown = text[len("SELECT '"):-1].split("|")
            assert len(shown) == 3 and sqls[key] not in shown and set(shown) <= set(sqls.values())
    # The first round shows the nearest by the stored vectors.
    asked = stored.vectors(questions, catalog)
    vec = {r.query_id: r.embedding for r in asked.collect()}
    kept = {r.example_id: r.embedding for r in stored.rows.collect()}
    assert all(vec[i] == pytest.approx(kept[i]) for i in kept)
    best = sorted(((sum((a - b) ** 2 for a, b in zip(vec[0], kept[i], strict=True)), i) for i in kept if i != 0))[:3]
    assert out[0].round_1_text[len("SELECT '"):-1] == "|".join(sorted(sqls[i] for _, i in best))
    # With its own example allowed, a question is shown it first; a changed prompt is asked again.
    again = {r.question_id: r for r in rounds.generate_answers(questions, stored, catalog, model, run_dir=run).collect()}
    assert all(sqls[k] in r.round_1_text for k, r in again.items())
    assert spark.read.parquet(run + "/round1").count() == 24


def test_linking_scores(spark):
    p = spark.createDataFrame([(1, "table", "A"), (1, "table", "A"), (1, "table", "B")], "question_id int, kind string, item string")
    t = spark.createDataFrame([(1, "table", "A"), (1, "column", "A.x")], "question_id int, kind string, item string")
    scores = compare.linking_scores(p, t)
    out = {r.kind: (r.precision, r.recall, r.f1) for r in scores.collect()}
    assert out == {"table": (0.5, 1.0, 2 / 3), "column": (0.0, 0.0, 0.0)}
    assert {r.kind: r.n_hit for r in compare.linking_scores_overall(scores).collect()} == {"table": 1, "column": 0}


def test_batch_score_isolates_failures_and_skips_done(spark):
    def make():
        def fn(texts):
            assert len(texts) <= 4
            if "bad" in texts:
                raise ValueError("bad prompt")
            return [t.upper() for t in texts]
        return fn

    rows = spark.createDataFrame([(i, "bad" if i == 5 else f"p{i}") for i in range(20)], "question_id int, prompt string")
    out = {r.question_id: (r.response, r.error) for r in batch_score(rows, make, 4).collect()}
    assert out[5] == (None, "bad prompt") and all(out[i] == (f"P{i}", None) for i in range(20) if i != 5)
    done = rows.where("question_id < 15").select("question_id")
    assert batch_score(rows, make, 4, done=done, partitions=3).count() == 5


def test_running_stats_over_restarts(spark):
    rows = eval_rows(spark)
    base = fresh_path(spark, "stream-test")
    schema_ = rows.schema
    for i in range(3):
        rows.where(f"question_id % 3 = {i}").coalesce(1).write.mode("append").parquet(base + "/in")
        stream = spark.readStream.schema(schema_).parquet(base + "/in")
        running.running_stats(stream, base + "/out", base + "/state").awaitTermination()
    expected = {r.db_id: r.asDict() for r in evaluate.stats_by_database(rows).collect()}
    assert {r.db_id: r.asDict() for r in running.current_stats(spark, base + "/out").collect()} == expected


def test_stream_examples_drops_repeats_across_batches(spark):
    base = fresh_path(spark, "growth-test")
    for part in ([("a", "x"), ("a", "x"), ("b", "y")], [("b", "y"), ("c", "z")]):
        spark.createDataFrame(part, "question string, sql string").coalesce(1).write.mode("append").parquet(base + "/in")
        stream = spark.readStream.schema("question string, sql string").parquet(base + "/in")
        running.stream_examples(stream, base + "/out", base + "/state").awaitTermination()
    out = spark.read.schema("question string, sql string").parquet(base + "/out")
    assert sorted(map(tuple, out.collect())) == [("a", "x"), ("b", "y"), ("c", "z")]


def test_a_repeated_run_asks_only_what_failed(spark, sample, catalog, tmp_path):
    from asklens.operators import rounds

    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def model(broken):
        def make():
            import os
            import uuid

            def answer(texts):
                if broken and any("deepest berth?" in t[:90] for t in texts):
                    raise ValueError("down")
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as file:
                    file.write(texts[0][:90])
                return ["SELECT 1" for _ in texts]
            return answer
        return make

    questions = sample.select(F.col("example_id").alias("question_id"), "db_id", "question", F.lit("").alias("evidence"))
    run = str(tmp_path / "run")
    first = rounds.generate_answers(questions, sample, catalog, model(True), run_dir=run, batch_size=1)
    assert {r.question_id for r in first.where("error IS NOT NULL").collect()} == {1}
    before = len(list(calls.iterdir()))
    second = rounds.generate_answers(questions, sample, catalog, model(False), run_dir=run, batch_size=1)
    assert second.where("error IS NOT NULL").count() == 0 and second.where("final_sql = 'SELECT 1'").count() == 12
    assert len(list(calls.iterdir())) == before + 2


def test_entries_without_numbers_get_stable_ones(spark, tmp_path):
    from asklens.sources import examples as src

    (tmp_path / "a.json").write_text(json.dumps([
        {"question": "q1", "sql": "s1"}, {"question": "q2", "sql": "s2"}, {"question": "q1", "sql": "s1"},
        {"example_id": "x-7", "question": "q3", "sql": "s3"}, {"example_id": 5, "question": "q4", "sql": "s4"}]))
    ids = [{r.question: r.example_id for r in src.read_examples(spark, str(tmp_path / "a.json"))[0].collect()} for _ in range(2)]
    assert ids[0] == ids[1] and None not in ids[0].values() and len(set(ids[0].values())) == 4 and ids[0]["q4"] == 5
    (tmp_path / "l.json").write_text('{"question": "q", "sql": "s"}\n')
    with pytest.raises(ValueError):
        src.read_examples(spark, str(tmp_path / "l.json"), limit=1, lines=True)


def test_intermediates_have_a_place_on_any_session(spark):
    from asklens import session

    class Plain:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return {"spark.sql.warehouse.dir": "file:/shared/warehouse", "spark.master": master}.get(key, default)

    master = "local[2]"
    assert session.shared_dir(Plain) == "file:/shared/warehouse/_asklens"
    # On several machines the warehouse may be a local disk, so a folder has to be named.
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_dir(Plain)
    kept = session.written(spark.range(3), "kept")
    assert kept.count() == 3

"""Comparison, evaluation and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asklens.operators import compare, evaluate, report
from asklens.plans import joined, query, rounded
from asklens.plans.staging import documents
from asklens.session import fresh_path
from asklens.sources import records as rec
from asklens.streaming import running
from asklens.views import view


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The flat record view as nested records (schemas.RECORD)."""
    flat = view(spark, sf, "v_records_flat")
    empty = F.array().cast("array<double>")
    # Rows with has_times and no time carry an empty list; a NULL between two times is kept.
    times = F.when(F.col("time_2").isNotNull(), F.array("time_1", F.lit(None), "time_2")).when(
        F.col("time_1").isNotNull(), F.array("time_1")).when(F.col("has_times"), empty)
    selection = F.when(F.col("has_selection"), F.struct(
        "selected_sql", F.col("selection_confidence").alias("confidence"), "candidates_count"))
    alternatives = F.when(F.col("has_alternatives"), F.array(F.struct(
        F.col("alternative_sql").alias("sql"),
        F.array("alternative_sql", F.lit(" SELECT 1 "), F.lit("")).alias("all_sqls_in_group"))))
    metrics = F.when(F.col("has_metrics"), F.struct(
        F.col("m_generated").alias("generated"), F.col("m_errors").alias("execution_errors"),
        F.col("m_valid").alias("valid_generations"), F.lit(1).alias("unique_valid_sqls")))
    return flat.select(
        "question_id", F.concat(F.lit("question "), "question_id").alias("question"), "db_id", "difficulty",
        F.lit("").alias("evidence"), F.lit("SELECT 1").alias("gold_sql"),
        "round_1_sql", "round_2_sql", "generated_sql", "winner_sql",
        "execution_match", "is_correct", "valid", "final_valid", "validation_error", "execution_error",
        "winner_confidence", "confidence", "execution_time", times.alias("execution_times"),
        selection.alias("selection"), alternatives.alias("high_confidence_alternatives"), metrics.alias("metrics"))


COMPARE_CHECK = """
WITH s AS (SELECT question_id, k, amt, bool_or(side = 'generated') AS g, bool_or(side = 'gold') AS e
           FROM v_results GROUP BY question_id, k, amt),
p AS (SELECT question_id, count(*) FILTER (g) AS gd, count(*) FILTER (e) AS ed, count(*) FILTER (g AND e) AS bd
      FROM s GROUP BY question_id)
SELECT q.question_id, coalesce(gd, 0) AS generated_distinct, coalesce(ed, 0) AS gold_distinct,
       coalesce(bd, 0) AS shared_distinct, coalesce(gd = bd AND ed = bd, true) AS execution_match
FROM v_questions q LEFT JOIN p ON p.question_id = q.question_id
"""


@query("u2_compare_results", COMPARE_CHECK)
def u2(spark, sf):
    return compare.compare_results(view(spark, sf, "v_results"), view(spark, sf, "v_questions"))


@query("u2_compare_results_require_success", """
WITH s AS (SELECT question_id, k, amt, bool_or(side = 'generated') AS g, bool_or(side = 'gold') AS e
           FROM v_results GROUP BY question_id, k, amt),
p AS (SELECT question_id, bool_and(g AND e) AS ok FROM s GROUP BY question_id)
SELECT q.question_id, coalesce(ok, true) AND q.db_no <> 3 AS execution_match
FROM v_questions q LEFT JOIN p ON p.question_id = q.question_id
""")
def u2_strict(spark, sf):
    questions = view(spark, sf, "v_questions")
    failures = questions.where("db_no = 3").select("question_id", F.lit("generated").alias("side"))
    out = compare.compare_results(view(spark, sf, "v_results"), questions, failures=failures)
    return out.select("question_id", "execution_match")


@query("u2_results_equal", """
WITH g AS (SELECT DISTINCT k, amt FROM v_results WHERE side = 'generated'),
e AS (SELECT DISTINCT k, amt FROM v_results WHERE side = 'gold'),
x AS (SELECT (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM e)) AS only_left,
             (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM g)) AS only_right)
SELECT only_left, only_right, only_left = 0 AND only_right = 0 AS equal FROM x
""")
def u2_pair(spark, sf):
    rows = view(spark, sf, "v_results")
    sides = {s: rows.where(F.col("side") == s).select("k", "amt") for s in ("generated", "gold")}
    return compare.results_equal(sides["generated"], sides["gold"])


@query("u3_count_difference", """
SELECT q.question_id, count(*) FILTER (side = 'generated') AS generated_row_count,
       count(*) FILTER (side = 'gold') AS ground_truth_row_count,
       count(*) FILTER (side = 'generated') - count(*) FILTER (side = 'gold') AS row_count_difference
FROM v_questions q LEFT JOIN v_results r ON r.question_id = q.question_id GROUP BY q.question_id
""")
def u3(spark, sf):
    return compare.count_difference(view(spark, sf, "v_results"), view(spark, sf, "v_questions"))


_TOTALS = """count(*) AS total, count(*) FILTER (error IS NULL AND is_correct) AS correct, count(*) FILTER (valid) AS valid,
count(*) FILTER (error IS NULL) AS executed, count(*) FILTER (error IS NOT NULL) AS errors, sum(execution_time) AS total_time"""
_RATIOS = """total, correct, valid, executed, errors, round(total_time, 6) AS total_time,
round(correct / greatest(executed, 1), 6) AS accuracy, round(valid / greatest(total, 1), 6) AS validation_success_rate,
round(total_time / greatest(total, 1), 6) AS average_execution_time"""
BY_DB_CHECK = f"SELECT db_id, {_RATIOS} FROM (SELECT db_id, {_TOTALS} FROM v_eval GROUP BY db_id)"


@query("a3_stats_by_database", BY_DB_CHECK)
def a3(spark, sf):
    return rounded(evaluate.stats_by_database(view(spark, sf, "v_eval")))


@query("a4_stats_overall", f"SELECT {_RATIOS} FROM (SELECT {_TOTALS} FROM v_eval)")
def a4(spark, sf):
    return rounded(evaluate.stats_overall(view(spark, sf, "v_eval")))


@query("a4_stats_rollup", f"""
SELECT CASE WHEN g = 1 THEN 'overall' ELSE 'database' END AS level, db_id, {_RATIOS}
FROM (SELECT db_id, grouping(db_id) AS g, {_TOTALS} FROM v_eval GROUP BY ROLLUP (db_id))
""")
def a4_rollup(spark, sf):
    return rounded(evaluate.stats_rollup(view(spark, sf, "v_eval")))


@query("a5_merge_stats", BY_DB_CHECK)
def a5(spark, sf):
    # Partial totals per shard and database, as four workers would leave them.
    shards = view(spark, sf, "v_eval").withColumn("shard", F.pmod("question_id", F.lit(4)))
    partials = shards.groupBy("shard", "db_id").agg(*evaluate.total_columns())
    return rounded(evaluate.merge_stats(partials))


@query("a6_report_overall", """
WITH x AS (SELECT count(*) AS n, count(*) FILTER (coalesce(execution_match, false) OR coalesce(is_correct, false)) AS c
           FROM v_records_flat)
SELECT n AS total_questions, c AS correct, n - c AS incorrect, round(c / n * 100, 6) AS accuracy FROM x
""")
def a6(spark, sf):
    return rounded(report.report_overall(records(spark, sf)))


_TIMES = """
t AS (SELECT time_1 * 1000 AS ms FROM v_records_flat WHERE time_1 IS NOT NULL
      UNION ALL SELECT time_2 * 1000 FROM v_records_flat WHERE time_2 IS NOT NULL
      UNION ALL SELECT execution_time * 1000 FROM v_records_flat WHERE time_1 IS NULL AND execution_time IS NOT NULL)"""


@query("a7_report_times", f"""
WITH {_TIMES.strip()}
SELECT count(ms) AS total_queries_executed, round(avg(ms), 3) AS mean_ms, round(median(ms), 3) AS median_ms,
       round(stddev_pop(ms), 3) AS std_dev_ms, round(min(ms), 3) AS min_ms, round(max(ms), 3) AS max_ms FROM t
""")
def a7(spark, sf):
    return rounded(report.report_times(records(spark, sf)), 3)


_VARIATIONS = """
texts AS (
  SELECT question_id, 1 AS p, round_1_sql AS s FROM v_records_flat UNION ALL SELECT question_id, 2, round_2_sql FROM v_records_flat
  UNION ALL SELECT question_id, 3, generated_sql FROM v_records_flat UNION ALL SELECT question_id, 4, winner_sql FROM v_records_flat
  UNION ALL SELECT question_id, 5, selected_sql FROM v_records_flat WHERE has_selection
  UNION ALL SELECT question_id, 6, alternative_sql FROM v_records_flat WHERE has_alternatives
  UNION ALL SELECT question_id, 7, ' SELECT 1 ' FROM v_records_flat WHERE has_alternatives),
firsts AS (SELECT question_id, trim(s) AS s, min(p) AS p FROM texts WHERE trim(s) <> '' GROUP BY question_id, trim(s)),
counted AS (SELECT f.question_id, cast(count(v.s) AS int) AS n, coalesce(string_agg(v.s, '|' ORDER BY v.p), '') AS variations
            FROM v_records_flat f LEFT JOIN firsts v ON v.question_id = f.question_id GROUP BY f.question_id)"""


@query("f11_sql_variations", f"WITH {_VARIATIONS.strip()} SELECT question_id, variations, n FROM counted")
def f11(spark, sf):
    out = report.with_variations(records(spark, sf))
    return out.select("question_id", joined("variations").alias("variations"), F.size("variations").alias("n"))


@query("a8_report_generation", f"""
WITH {_VARIATIONS.strip()},
x AS (SELECT r.*, c.n, has_metrics AND m_valid IS NOT NULL AS logged,
             CASE WHEN coalesce(valid, final_valid) THEN 1 ELSE 0 END AS ok,
             coalesce(validation_error, '') <> '' OR coalesce(execution_error, '') <> '' AS failed
      FROM v_records_flat r JOIN counted c ON c.question_id = r.question_id),
y AS (SELECT CASE WHEN logged THEN m_generated ELSE n END AS g, CASE WHEN logged THEN m_valid ELSE ok END AS v,
             CASE WHEN logged THEN m_errors WHEN failed THEN 1 ELSE greatest(n - ok, 0) END AS e, n FROM x),
z AS (SELECT cast(sum(g) AS bigint) AS g, cast(sum(v) AS bigint) AS v, cast(sum(e) AS bigint) AS e, avg(n) AS a FROM y)
SELECT g AS total_sql_generated, v AS valid_executions, e AS execution_errors,
       round(v / greatest(g, 1) * 100, 6) AS validation_success_rate, round(e / greatest(g, 1) * 100, 6) AS execution_error_rate,
       (SELECT count(DISTINCT s) FROM firsts) AS unique_sql_variations,
       round(a, 6) AS avg_unique_sql_variations_per_question
FROM z
""")
def a8(spark, sf):
    return rounded(report.report_generation(records(spark, sf)))


@query("a9_report_confidence", """
WITH c AS (SELECT coalesce(winner_confidence, confidence, CASE WHEN has_selection THEN selection_confidence END) AS c
           FROM v_records_flat),
x AS (SELECT count(c) AS n, avg(c) AS a, median(c) AS m, count(*) FILTER (c > 0.5) AS h, count(*) FILTER (c < 0.2) AS l FROM c)
SELECT n AS count, round(a, 6) AS mean_confidence, round(m, 6) AS median_confidence, h AS high_confidence_count,
       l AS low_confidence_count, round(h / greatest(n, 1) * 100, 6) AS high_confidence_rate,
       round(l / greatest(n, 1) * 100, 6) AS low_confidence_rate FROM x
""")
def a9(spark, sf):
    return rounded(report.report_confidence(records(spark, sf)))


_RIGHT = "count(*) FILTER (coalesce(execution_match, false) OR coalesce(is_correct, false))"
_DIFF = "coalesce(nullif(difficulty, ''), 'Unknown')"
_DB = "coalesce(nullif(db_id, ''), 'unknown')"


@query("a10_report_by_difficulty", f"""
SELECT difficulty, c AS correct, n AS total, round(c / n * 100, 6) AS accuracy
FROM (SELECT {_DIFF} AS difficulty, {_RIGHT} AS c, count(*) AS n FROM v_records_flat GROUP BY 1) ORDER BY 1
""")
def a10(spark, sf):
    return rounded(report.report_by(records(spark, sf), "difficulty"))


@query("a11_report_by_database", f"""
SELECT db_id, c AS correct, n AS total, round(c / n * 100, 6) AS accuracy
FROM (SELECT {_DB} AS db_id, {_RIGHT} AS c, count(*) AS n FROM v_records_flat GROUP BY 1) ORDER BY accuracy DESC, db_id
""")
def a11(spark, sf):
    return rounded(report.report_by(records(spark, sf), "db_id"))


@query("a12_report_selection", """
WITH x AS (SELECT count(*) AS n, count(*) FILTER (coalesce(generated_sql, '') <> '' OR coalesce(winner_sql, '') <> '') AS s,
                  count(*) FILTER (has_selection AND candidates_count > 1) AS m FROM v_records_flat)
SELECT s AS selection_made, round(s / n * 100, 6) AS selection_rate, m AS majority_vote_used,
       round(m / n * 100, 6) AS majority_vote_rate FROM x
""")
def a12(spark, sf):
    return rounded(report.report_selection(records(spark, sf)))


@query("a13_report_cube", f"""
WITH k AS (SELECT {_DIFF} AS difficulty, {_DB} AS db_id, execution_match, is_correct FROM v_records_flat),
u AS (SELECT 'difficulty' AS block, difficulty AS key, {_RIGHT} AS c, count(*) AS n FROM k GROUP BY difficulty
      UNION ALL SELECT 'database', db_id, {_RIGHT}, count(*) FROM k GROUP BY db_id
      UNION ALL SELECT 'overall', 'all', {_RIGHT}, count(*) FROM k)
SELECT block, key, c AS correct, n AS total, round(c / n * 100, 6) AS accuracy FROM u
""")
def a13(spark, sf):
    return rounded(report.report_cube(records(spark, sf)))


@query("u5_combine_logs", """
SELECT e.question_id, e.db_id, CASE WHEN e.error IS NULL THEN 'done' ELSE 'failed' END AS status,
       l.doc_id * 2000000000 AS position
FROM v_eval e LEFT JOIN labels l ON l.doc_id = e.question_id ORDER BY position, question_id
""")
def u5(spark, sf):
    log = view(spark, sf, "v_eval").select("question_id", "db_id", "error")
    parts = [log.where("error IS NULL").select("question_id", "db_id", F.lit("done").alias("status")),
             log.where("error IS NOT NULL").select("question_id", "db_id", F.lit("failed").alias("status"))]
    # The question list knows only the labelled ids.
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    order = labels.select(F.col("doc_id").alias("question_id"), (F.col("doc_id") * 2_000_000_000).alias("position"))
    return evaluate.combine_logs(parts, order)


_RECORD_CHECK = """
SELECT question_id, difficulty, execution_match, round(winner_confidence, 6) AS winner_confidence,
       CASE WHEN has_selection THEN candidates_count END AS candidates_count, round(time_1, 6) AS first_time,
       CASE WHEN has_metrics THEN m_errors END AS m_errors FROM v_records_flat
"""


@query("s7_read_records", _RECORD_CHECK)
def s7(spark, sf):
    path = fresh_path(spark, "records")
    nested = records(spark, sf)
    # JSON lines, a list, and both wrapped layouts.
    kinds = ("difficulty IS NULL", "difficulty = ''", "difficulty = 'click'", "difficulty NOT IN ('', 'click')")
    parts = [nested.where(kind) for kind in kinds]
    record = F.struct(*nested.columns)
    parts[0].write.json(path + "/lines")
    documents(parts[1], record, path + "/list")
    documents(parts[2], record, path + "/results", '{"overall": {}, "results": %s}')
    documents(parts[3], record, path + "/detailed", '{"detailed_results": %s}')
    back = rec.read_records(spark, path + "/lines", lines=True)
    for part in ("/list", "/results", "/detailed"):
        back = back.unionByName(rec.read_records(spark, path + part))
    return rounded(back.select(
        "question_id", "difficulty", "execution_match", "winner_confidence",
        F.col("selection.candidates_count").alias("candidates_count"),
        F.get("execution_times", F.lit(0)).alias("first_time"), F.col("metrics.execution_errors").alias("m_errors")))


@query("s11_write_logs", """
SELECT question_id, coalesce(nullif(difficulty, ''), 'unknown') AS difficulty,
       cast(CASE WHEN coalesce(generated_sql, '') <> '' THEN 1 ELSE 0 END AS double) AS winner_confidence,
       round(execution_time, 6) AS best_time, 0 - 7 AS row_count_difference,
       CASE WHEN coalesce(execution_error, '') <> '' THEN 1 ELSE 0 END AS execution_errors,
       CASE WHEN coalesce(generated_sql, '') <> '' THEN 1 ELSE 0 END AS valid_generations,
       CASE WHEN coalesce(generated_sql, '') <> '' THEN generated_sql END AS alternative
FROM v_records_flat
""")
def s11(spark, sf):
    flat = records(spark, sf).withColumns({
        "generated_row_count": F.lit(3), "ground_truth_row_count": F.lit(10)})
    logs = rec.question_logs(flat)
    path = fresh_path(spark, "logs")
    rec.write_logs(logs, path)
    back = spark.read.schema(logs.schema).json(path)
    return rounded(back.select(
        "question_id", "difficulty", "winner_confidence", F.get("execution_times", F.lit(0)).alias("best_time"),
        F.col("execution_difference.row_count_difference").alias("row_count_difference"),
        F.col("metrics.execution_errors").alias("execution_errors"),
        F.col("metrics.valid_generations").alias("valid_generations"),
        F.get("alternatives", F.lit(0))["sql"].alias("alternative")))


@query("s11_write_report", f"""
SELECT db_id, c AS correct, n AS total, round(c / n * 100, 6) AS accuracy
FROM (SELECT {_DB} AS db_id, {_RIGHT} AS c, count(*) AS n FROM v_records_flat GROUP BY 1)
""")
def s11_report(spark, sf):
    block = report.report_by(records(spark, sf), "db_id")
    path = fresh_path(spark, "report")
    rec.write_report(block, path)
    return rounded(spark.read.schema(block.schema).json(path))


@query("x1_running_stats", BY_DB_CHECK)
def x1(spark, sf):
    # The records arrive as files of a folder, several per trigger.
    arrived = view(spark, sf, "v_eval").repartition(6, "question_id")
    folder = fresh_path(spark, "stream")
    arrived.write.parquet(folder + "/in")
    stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 3).parquet(folder + "/in")
    running.running_stats(stream, folder + "/out", folder + "/state").awaitTermination()
    return rounded(running.current_stats(spark, folder + "/out"))


@query("u2_a3_execution_accuracy", f"""
WITH s AS (SELECT question_id, k, amt, bool_or(side = 'generated') AS g, bool_or(side = 'gold') AS e
           FROM v_results GROUP BY question_id, k, amt),
p AS (SELECT question_id, bool_and(g AND e) AS ok, count(*) FILTER (g) AS n FROM s GROUP BY question_id),
r AS (SELECT 'nation' || cast(q.db_no AS string) AS db_id, coalesce(ok, true) AS is_correct, coalesce(n, 0) > 0 AS valid,
             cast(coalesce(n, 0) AS double) / 8 AS execution_time, cast(NULL AS string) AS error
      FROM v_questions q LEFT JOIN p ON p.question_id = q.question_id)
SELECT CASE WHEN g = 1 THEN 'overall' ELSE 'database' END AS level, db_id, {_RATIOS}
FROM (SELECT db_id, grouping(db_id) AS g, {_TOTALS} FROM r GROUP BY ROLLUP (db_id))
""")
def accuracy(spark, sf):
    """Generated results against gold results, then accuracy per database and overall."""
    questions = view(spark, sf, "v_questions")
    compared = compare.compare_results(view(spark, sf, "v_results"), questions)
    outcome = compared.join(questions, "question_id").select(
        "question_id", F.concat(F.lit("nation"), "db_no").alias("db_id"), F.col("execution_match").alias("is_correct"),
        (F.col("generated_distinct") > 0).alias("valid"),
        (F.col("generated_distinct") / 8.0).alias("execution_time"), F.lit(None).cast("string").alias("error"))
    return rounded(evaluate.stats_rollup(outcome))

from pyspark.sql import functions as F

from asklens.operators import log


def skeletons(spark, catalog, *sqls, db="harbour"):
    rows = spark.createDataFrame([(db, i, s) for i, s in enumerate(sqls)], "db_id string, qid int, sql string")
    return [r.skeleton for r in log.sql_skeletons(rows).orderBy("qid").collect()]


def lineage(spark, catalog, sql, db="harbour"):
    rows = spark.createDataFrame([(db, 0, sql)], "db_id string, qid int, sql string")
    found, bad = log.query_lineage(rows, catalog)
    items = found.collect()
    return ({r.item for r in items if r.kind == "table"}, {r.item for r in items if r.kind == "column"}, bad.count())


def test_skeletons(spark, catalog):
    assert skeletons(
        spark, catalog, "SELECT MAX(depth) FROM Berth WHERE pier <> 7",
        "select a.x  c from Ferry a, Berth where a.x != -1.5e3 and y is not null;",
        "SELECT \"my col\" FROM Ferry -- WHERE 1\nWHERE label = 'it''s -- (' LIMIT 3",
        "WITH t AS (SELECT id FROM Ferry) SELECT CAST(id AS INTEGER) FROM t",
    ) == [
        "SELECT MAX([COLUMN]) FROM [TABLE] WHERE [COLUMN] <> [VALUE]",
        "SELECT a.[COLUMN] AS c FROM [TABLE] AS a, [TABLE] WHERE a.[COLUMN] <> -[VALUE] AND [COLUMN] IS NOT [VALUE]",
        "SELECT [COLUMN] FROM [TABLE] WHERE [COLUMN] = [VALUE] LIMIT [VALUE]",
        "WITH t AS (SELECT [COLUMN] FROM [TABLE]) SELECT CAST([COLUMN] AS INTEGER) FROM [TABLE]",
    ]


def test_unparsable_text_stays(spark, catalog):
    odd = ["not sql at all", "SELECT (a FROM t", "SELECT 'open FROM t", "", None]
    rows = spark.createDataFrame([("x", i, s) for i, s in enumerate(odd)], "db_id string, qid int, sql string")
    out = log.sql_skeletons(rows).orderBy("qid").collect()
    assert [r.skeleton for r in out] == odd
    assert not any(r.parsable for r in out)


def test_no_literal_text_survives(spark, catalog, sample):
    texts = [r.skeleton for r in log.sql_skeletons(sample).collect()]
    assert len(texts) == 12
    assert not any(w in t for t in texts for w in ("1990", "12", "Petrel", "45", "80", "90"))


def test_null_database_keeps_rows(spark, catalog):
    rows = spark.createDataFrame([(None, 1, "SELECT a FROM b")], "db_id string, qid int, sql string")
    assert log.sql_skeletons(rows).collect()[0].skeleton == "SELECT [COLUMN] FROM [TABLE]"


def test_lineage(spark, catalog):
    assert lineage(spark, catalog, "SELECT AVG(fare) FROM Sailing WHERE departs > 6") == (
        {"Sailing"}, {"Sailing.fare", "Sailing.departs"}, 0)
    tables, columns, _ = lineage(
        spark, catalog, "SELECT F.label, B.pier FROM Ferry AS F JOIN Landing L ON F.id = L.ferry_id "
        "JOIN Berth AS B ON L.berth_id = B.id WHERE opened > 2000")
    assert tables == {"Ferry", "Landing", "Berth"}
    assert columns == {"Ferry.label", "Berth.pier", "Ferry.id", "Landing.ferry_id", "Landing.berth_id", "Berth.id", "?.opened"}


def test_lineage_of_subqueries_and_names(spark, catalog):
    tables, columns, _ = lineage(
        spark, catalog, "WITH x AS (SELECT id FROM Ferry) SELECT x.id FROM x WHERE id IN (SELECT berth_id FROM Landing)")
    assert tables == {"Ferry", "x", "Landing"}
    assert columns == {"x.id", "?.id", "?.berth_id"}
    # A qualifier that is no alias is kept as it is.
    assert lineage(spark, catalog, "SELECT q.a FROM Ferry AS s")[1] == {"q.a"}
    assert lineage(spark, catalog, "no statement (") == (set(), set(), 1)


def test_the_catalog_settles_columns(spark, catalog):
    def columns(sql, db="harbour"):
        return lineage(spark, catalog, sql, db)[1]

    join = "FROM ferry AS F JOIN Landing L ON F.id = L.ferry_id"
    assert lineage(spark, None, f"SELECT Built, berth_id {join}")[1] >= {"?.Built", "?.berth_id"}
    # Names meet in any case and keep that of the text; ferry_id is held by two tables of the catalog, but one of the query.
    assert columns(f"SELECT Built, berth_id, ferry_id {join}") == {
        "ferry.Built", "Landing.berth_id", "Landing.ferry_id", "ferry.id", "Landing.ferry_id"}
    assert columns("SELECT ferry_id, fare FROM Sailing, Landing") == {"?.ferry_id", "Sailing.fare"}
    assert columns(f"SELECT unheard {join}") >= {"?.unheard"}
    # A table joined with itself is one table.
    assert columns("SELECT fare FROM Sailing a JOIN Sailing b ON a.no = b.no") == {"Sailing.fare", "Sailing.no"}
    # Tables unknown to the catalog, of another database, or defined by the text may hold the column as well.
    assert columns("SELECT fare FROM Sailing, Weather") == {"?.fare"}
    assert columns("SELECT fare FROM Sailing, Landing", db="orchard") == {"?.fare"}
    assert columns("WITH Landing AS (SELECT fare AS built FROM Sailing) SELECT built FROM Ferry, Landing") == {"?.fare", "?.built"}


def test_a_catalog_with_repeats_and_nulls(spark):
    rows = spark.createDataFrame([("d", "SELECT x, y FROM a, b"), (None, "SELECT x, y FROM a, b")], "db_id string, sql string").withColumn(
        "qid", F.lit(1))
    held = spark.createDataFrame(
        [("d", "a", "x"), ("d", "A", "X"), ("d", "b", None), ("d", None, "y"), (None, "a", "x"), (None, "b", "y"), (None, "b", "y")],
        "db_id string, table_name string, col_name string")
    found = log.query_lineage(rows, held)[0].where("kind = 'column'").collect()
    assert sorted((str(r.db_id), r.item) for r in found) == [("None", "a.x"), ("None", "b.y"), ("d", "?.y"), ("d", "a.x")]
    nothing = log.query_lineage(rows, held.limit(0))[0].where("kind = 'column'").collect()
    assert {r.item for r in nothing} == {"?.x", "?.y"} and len(nothing) == 4


def test_tokens_compat_and_strict(spark):
    one = spark.range(1)

    def tokens(text, mode):
        return one.select(log.template_tokens(F.lit(text), mode).alias("t")).collect()[0].t

    assert tokens("SELECT T1.a FROM x ORDER BY 1", "compat") == ["SELECT", "T", "A", "FROM", "X", "OR", "DER", "BY"]
    assert tokens("a INTERSECT b", "compat") == ["A", "IN", "TERSECT", "B"]
    assert tokens("SELECT T1.a ORDER BY b INTERSECT c", "strict") == [
        "SELECT", "T1", "A", "ORDER BY", "B", "INTERSECT", "C"]


def test_template_counts_merge_literals(spark, catalog):
    rows = spark.createDataFrame(
        [("clinic", f"SELECT ward FROM Visit WHERE cost > {i}", 2) for i in range(50)]
        + [("clinic", "free text one", 1), ("clinic", "free text two", 1)], "db_id string, sql string, n int")
    out = {r.skeleton: (r.n, r.sample_sql) for r in log.template_counts(rows, weight="n").collect()}
    assert out["SELECT [COLUMN] FROM [TABLE] WHERE [COLUMN] > [VALUE]"] == (100, "SELECT ward FROM Visit WHERE cost > 0")
    assert out["free text one"][0] == out["free text two"][0] == 1


def test_sketches_of_templates_merge_and_keep_their_bound(spark):
    # Some 20,000 templates that occur once each, and ten that make up most of the rows.
    rows = spark.range(60_000).select(
        F.floor(F.col("id") / 10_000).alias("day"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("hot "), F.col("id") % 10)).otherwise(F.concat(F.lit("rare "), "id")).alias("skeleton"))
    exact = {r.skeleton: r.n for r in rows.groupBy("skeleton").agg(F.count("*").alias("n")).collect()}
    parts = log.template_sketches(rows.where("day < 4"), ["day"], 500).unionByName(log.template_sketches(rows.where("day >= 4"), ["day"], 800))
    out = log.heavy_templates(parts, 10, most=500).collect()
    assert {r.skeleton for r in out} == {f"hot {k}" for k in range(10)}
    assert all(r.most_wrong == 315 and abs(r.n - exact[r.skeleton]) <= r.most_wrong for r in out)
    daily = log.heavy_templates(parts, 2, ["day"], most=500).groupBy("day").count().collect()
    assert sorted((r.day, r["count"]) for r in daily) == [(d, 2) for d in range(6)]
    # NULL templates do not count; no rows give no templates.
    none = log.template_sketches(spark.createDataFrame([(1, None)], "day int, skeleton string"), ["day"])
    assert none.count() == 0 and log.heavy_templates(none, 3).count() == 0


def test_a_shape_is_worked_out_once_for_all_databases(spark):
    rows = [(f"db{k}", k, f"SELECT a FROM t WHERE b = {k}.5e3  AND c < .{k}") for k in range(1, 9)] + [("db1", 90, "why 5?"), ("db1", 91, "why 6?"), ("db1", 92, None)]
    given = spark.createDataFrame(rows, "db_id string, qid int, sql string")
    shapes = log._distinct_shapes(log._with_shapes(given)).collect()
    assert [r["_shape"] for r in shapes] == ["SELECT a FROM t WHERE b = [VALUE] AND c < [VALUE]"]
    counts = {(r["db_id"], r["skeleton"], r["n"]) for r in log.template_counts(given).collect()}
    assert {c[1:] for c in counts if c[0] == "db1"} == {
        ("SELECT [COLUMN] FROM [TABLE] WHERE [COLUMN] = [VALUE] AND [COLUMN] < [VALUE]", 1), ("why 5?", 1), ("why 6?", 1), (None, 1)}
    lineage, bad = log.query_lineage(given)
    assert lineage.where("kind = 'table'").count() == 8
    assert sorted(r["qid"] for r in bad.collect()) == [90, 91, 92]

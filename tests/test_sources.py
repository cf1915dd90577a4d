import json
from pathlib import Path

import pytest

from asklens.operators import schema
from asklens.sources import catalog as cat
from asklens.sources import corpus_store, examples, records


def put(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content, indent=2), encoding="utf-8")
    return str(folder / name)


def test_read_examples_spellings_and_bad_rows(spark, tmp_path):
    path = put(tmp_path, "e.json", [
        {"question": "q1", "sql": "s1", "db_id": "a"}, {"Question": "q2", "SQL": "s2"}, {"Question": "q3", "sql": "s3"},
        {"question": "only"}, {"query": "x", "question": "q5"}])
    good, bad = examples.read_examples(spark, path)
    assert [(r.question, r.sql) for r in good.orderBy("question").collect()] == [("q1", "s1"), ("q2", "s2"), ("q3", "s3")]
    assert sorted(r.found_keys for r in bad.collect()) == [["query", "question"], ["question"]]
    with pytest.raises(ValueError, match="question"):
        examples.read_examples(spark, path, strict=True)
    assert examples.read_examples(spark, path, limit=2)[0].count() == 2


def test_read_spider(spark, tmp_path):
    path = put(tmp_path, "train.json", [
        {"db_id": "d", "question": "q", "query": "SELECT 1", "query_toks": ["SELECT", "1"]}, {"question": "r"}, {}])
    rows = [(r.question, r.sql, r.db_id) for r in examples.read_spider(spark, path).collect()]
    assert rows == [("q", "SELECT 1", "d"), ("r", "", ""), ("", "", "")]
    assert [r.question for r in examples.read_spider(spark, path, limit=2).collect()] == ["q", "r"]


def test_read_example_dir(spark, tmp_path):
    put(tmp_path, "a.json", [{"question": "1", "query": "s"}])
    put(tmp_path, "b.json", {"data": [{"question": "2", "SQL": "s"}]})
    put(tmp_path, "c.json", {"name": "x", "examples": [{"question": "3", "query": "s", "db_id": "d"}]})
    put(tmp_path, "d.json", {"question": "4", "query": "s"})
    put(tmp_path, "e.json", {"table_names_original": ["T"], "column_names_original": [[-1, "*"]]})
    put(tmp_path, "f.txt", "not json")
    put(tmp_path, "g.json", {"data": [], "question": "5", "query": "t"})
    rows = sorted((r.question, r.sql, r.db_id) for r in examples.read_example_dir(spark, str(tmp_path)).collect())
    assert rows == [("1", "s", ""), ("2", "s", ""), ("3", "s", "d"), ("4", "s", ""), ("5", "t", "")]


SPIDER = {
    "table_names_original": ["Kiln", "Glaze", "Empty"],
    "column_names_original": [[-1, "*"], [0, "id"], [0, "maker"], [1, "code"], [9, "lost"], [1, "shade"]],
    "column_types": ["text", "number", "text", "number", "x"],
    "column_descriptions": ["", "key", ""],
}


def test_read_catalog_folder_and_combined(spark, tmp_path):
    put(tmp_path / "dir", "pottery.json", SPIDER)
    put(tmp_path / "dir", "named.json", SPIDER | {"db_id": "other"})
    put(tmp_path / "dir", "train.json", [{"question": "q"}])
    rows = cat.read_catalog(spark, str(tmp_path / "dir"))
    one = [tuple(r)[1:] for r in rows.where("db_id = 'pottery'").orderBy("table_idx", "col_idx").collect()]
    assert one == [
        (0, "Kiln", 0, "id", "number", "key"), (0, "Kiln", 1, "maker", "text", None),
        (1, "Glaze", 0, "code", "number", None), (1, "Glaze", 1, "shade", None, None), (2, "Empty", None, None, None, None)]
    assert rows.where("db_id = 'other'").count() == 5
    combined = put(tmp_path / "all", "database.json", [SPIDER | {"db_id": "x"}, SPIDER | {"db_id": "y"}])
    assert cat.read_catalog(spark, combined, combined=True).groupBy("db_id").count().collect() is not None
    texts = {r.db_id: r.schema_text for r in schema.schema_text(rows).collect()}
    assert texts["pottery"] == "Kiln(id, maker)\nGlaze(code, shade)\nEmpty()"
    detailed = {r.db_id: r.schema_text for r in schema.schema_text(rows, "detailed").collect()}
    assert detailed["pottery"] == 'Kiln(id number "key", maker text)\nGlaze(code number, shade)\nEmpty()'


def test_catalog_from_tables_skips_broken_ones(spark, tmp_path):
    spark.range(3).selectExpr("id", "cast(id as string) as name").write.parquet(str(tmp_path / "b"))
    put(tmp_path / "a", "x.parquet", "broken")
    rows = cat.catalog_from_tables(spark, {"b": str(tmp_path / "b"), "a": str(tmp_path / "a"), "c": "/nowhere"}, "db")
    assert [(r.table_name, r.col_name, r.col_type) for r in rows.orderBy("col_idx").collect()] == [
        ("b", "id", "BIGINT"), ("b", "name", "TEXT")]
    merged = cat.first_of_each_db([rows, rows.withColumnRenamed("x", "y")])
    assert merged.count() == 2


def test_footers_are_read_by_tasks_in_one_job(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({
        "u": pa.array([1], pa.uint32()), "d": pa.array(["x"]).dictionary_encode(), "t": pa.array([0], pa.timestamp("us", "UTC")),
        "l": pa.array([[1.5]], pa.list_(pa.float64()))}), str(tmp_path / "one.parquet"))
    (tmp_path / "bad.parquet").write_text("broken")
    (tmp_path / "empty").mkdir()
    odd = [("bad", str(tmp_path / "bad.parquet")), ("empty", str(tmp_path / "empty")), ("gone", "/nowhere"),
           ("none", None), ("web", "what://ever")]
    paths = spark.createDataFrame([(f"t{k:04d}", str(tmp_path / "one.parquet")) for k in range(1000)] + odd, "table_name string, path string")
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("footers", "footers")
    rows = cat.table_footers(paths, 8).collect()
    context.setJobGroup("rest", "rest")
    # Adaptive execution counts the shuffle of the paths as a job of its own.
    assert len(tracker.getJobIdsForGroup("footers")) <= 2
    assert len(rows) == 4005 and {r.table_name for r in rows if r.reason} == {name for name, _ in odd}
    assert all(r.col_name is None for r in rows if r.reason)
    assert [(r.col_name, r.type) for r in sorted((r for r in rows if r.table_name == "t0007"), key=lambda r: r.col_idx)] == [
        ("u", "bigint"), ("d", "string"), ("t", "timestamp"), ("l", "array<double>")]
    found = cat.catalog_of_footers(cat.table_footers(paths, 8), "db").where("table_idx = 7").orderBy("col_idx").collect()
    assert [(r.table_name, r.col_type) for r in found] == [
        ("t0007", "BIGINT"), ("t0007", "TEXT"), ("t0007", "TIMESTAMP"), ("t0007", "ARRAY<DOUBLE>")]
    assert cat.catalog_from_tables(spark, {}, "db").count() == 0


def test_read_descriptions(spark, tmp_path):
    put(tmp_path, "b.csv", "column_name,data_type,description\nid,INT,\"the \"\"key\"\", unique\"\n,TEXT,no name\nname,,\n")
    put(tmp_path, "a.csv", "Type,Column,Extra\r\nINT,x,1\r\n\r\n,y,\r\n")
    put(tmp_path, "d.csv", 'description,column_name\n"two\nlines, one cell",x\n')
    put(tmp_path, "c.csv", "COLUMN_NAME,DATA_TYPE,COMMENT\n")
    rows = cat.read_descriptions(spark, str(tmp_path))
    texts = {r.table_name: r.description for r in cat.description_text(rows).collect()}
    assert texts == {"a": "Table: a\n  - x (INT)\n  - y", "d": "Table: d\n  - x: two\nlines, one cell", "b": 'Table: b\n  - id (INT): the "key", unique\n  - name'}


def test_read_records_layouts(spark, tmp_path):
    one, two = {"question_id": 1, "is_correct": True}, {"question_id": 2, "metrics": {"generated": 3}}
    listed = put(tmp_path, "list.json", [one, two, 5, "x", None])
    results = put(tmp_path, "r.json", {"results": [one], "detailed_results": [two]})
    detailed = put(tmp_path, "d.json", {"overall": {}, "detailed_results": [one, two, 7]})
    assert [records.read_records(spark, p).count() for p in (listed, results, detailed)] == [2, 1, 2]
    assert records.read_records(spark, results).first().question_id == 1


def test_read_linking(spark, tmp_path):
    path = put(tmp_path, "l.json", {"count": 1, "by_question_id": {"7": {"question_id": 7, "schema_linking": {
        "tables": ["A"], "columns": {"A": ["x"]}, "join_relationships": ["j"], "question_intent": "i"}}}})
    rows = records.read_linking(spark, path)
    out = schema.linking_to_schema(rows).first()
    assert out.question_id == "7"
    assert json.loads(out.schema_json) == {
        "tables": [{"name": "A", "columns": [{"name": "x"}]}], "joins": ["j"], "filters": [], "intent": "i"}
    summary = schema.linking_summary(rows).first().schema_summary
    assert summary == "Relevant Tables:\n- A\n\nRelevant Columns:\n- A: x\n\nJoin Relationships:\n- j\n\nQuestion Intent:\n- i"


def test_index_round_trip_and_empty(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "cast(id % 4 as int) as cell")
    corpus_store.write_index(rows, str(tmp_path / "i"), files_per_cell=2)
    assert corpus_store.read_index(spark, str(tmp_path / "i")).count() == 100
    pruned = corpus_store.read_index(spark, str(tmp_path / "i"), cells=[1, 2])
    assert pruned.count() == 50
    corpus_store.write_index(rows.where("id < 0"), str(tmp_path / "e"))
    with pytest.raises(Exception):
        corpus_store.read_index(spark, str(tmp_path / "e"))


def test_pairs_skip_blank_lines(spark, tmp_path):
    put(tmp_path, "p.jsonl", '{"input": "a", "output": "b", "db_id": "d"}\n\n{"input": "é\\n", "output": "c", "db_id": ""}\n')
    assert [(r.input, r.output) for r in examples.read_pairs(spark, str(tmp_path / "p.jsonl")).collect()] == [
        ("a", "b"), ("é\n", "c")]


def test_many_databases_need_few_files(spark, tmp_path, monkeypatch):
    """The staged schemas and descriptions of s4 and s6 are far fewer files than databases."""
    from asklens import plans, session

    plans.load_all()
    monkeypatch.setattr(session, "_MADE", [])
    for name in ("s4_read_catalog", "s6_read_descriptions"):
        session._MADE.clear()
        rows = plans.QUERIES[name](spark, "/root/testdata/sf0.1")
        files = [f for p in session._MADE for f in Path(p.removeprefix("file:")).rglob("part-*")]
        assert 0 < len(files) <= 100 and rows.select(rows.columns[0]).distinct().count() == 1000

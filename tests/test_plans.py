"""The shape of the physical plans, which is what decides how a query behaves on large tables."""

import re

import pytest

from asklens import plans

SF = "/root/testdata/sf0.001"
plans.load_all()

# Queries whose operator needs arithmetic on arrays of vectors or tokens, or a user's function.
PYTHON = {"g1", "j5", "w2", "w3", "w4", "w5"}


def plan(spark, name):
    return plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in plans.QUERIES if not n.startswith(("x", "s", "w3", "w4", "w5", "u4"))))
def test_no_pairwise_joins_and_no_row_functions(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "EvalPython" not in text
    if name.split("_")[0] not in PYTHON:
        assert "InPandas" not in text


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "u3_count_difference")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and not any("o_orderdate" in s or "o_orderkey" in s for s in schemas)


def test_ranking_prunes_before_the_shuffle(spark):
    text = plan(spark, "w1_top_n")
    assert text.count("WindowGroupLimit") == 2


def test_rollup_and_cube_shuffle_once(spark):
    assert plan(spark, "a13_report_cube").count("Exchange hashpartitioning") == 1
    assert plan(spark, "a4_stats_rollup").count("Exchange hashpartitioning") == 1


def test_text_work_needs_no_shuffle(spark):
    for name in ("f11_sql_variations", "f2_extract_json"):
        assert "Exchange" not in plan(spark, name)


def test_cells_prune_stored_partitions(spark, tmp_path):
    from asklens.sources.corpus_store import read_index, write_index

    write_index(spark.range(100).selectExpr("id", "cast(id % 4 as int) as cell"), str(tmp_path / "i"))
    text = read_index(spark, str(tmp_path / "i"), cells=[1])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*cell", text)

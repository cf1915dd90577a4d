"""Registered queries of the folder against their SQL."""

import pytest

import corpus_pipeline
from asklens.llm import queries
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, queries.QUERIES[name], queries.CHECKS[name], SF)
    assert ok, message


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "training_order"]

import numpy as np
import pytest

from asklens.operators import codes, similarity


def _frame(spark, x, name="id"):
    rows = [(k, None if v is None else [float(y) for y in v]) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>")


def _rows(found):
    return [(r["query_id"], r["rank"], r["id"], round(r["distance"], 5)) for r in found.orderBy("query_id", "rank").collect()]


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(4)
    return (draw.normal(size=(600, 8)) + 3 * draw.normal(size=(9, 8))[draw.integers(0, 9, 600)]).round(3)


def test_all_cells_and_all_rows_equal_the_exact_search(spark, points):
    corpus, queries = _frame(spark, [*points, None]).repartition(3), _frame(spark, [*points[::50], None], "query_id")
    centres, books = points[:7], np.zeros((4, 2, 2)) + np.arange(2)[None, :, None]
    index = codes.encode_vectors(corpus, centres, books)
    assert _rows(codes.knn_codes(queries, index, 5, centres, books, 7, 600)) == _rows(similarity.knn_exact(queries, corpus, 5))


def test_few_rows_compared_and_packs_of_queries(spark, points, monkeypatch):
    corpus, queries = _frame(spark, points).repartition(3), _frame(spark, points[::10], "query_id")
    centres = similarity.train_cells(corpus, 9)
    books = codes.train_books(corpus, centres, 4)
    index = codes.encode_vectors(corpus, centres, books).cache()
    found = codes.knn_codes(queries, index, 5, centres, books, 4, 40)
    assert similarity.recall(found, similarity.knn_exact(queries, corpus, 5)).first()[0] >= 0.95
    monkeypatch.setattr(codes, "HELD", 40 * 7)  # seven queries in a pack
    assert _rows(codes.knn_codes(queries, index, 5, centres, books, 4, 40)) == _rows(found)


def test_trained_books_fit_better_than_given_ones(spark, points):
    corpus, centres = _frame(spark, points), points[:5].astype(float)
    left = codes.residuals(points, centres)[1]

    def error(books):
        code = codes.part_codes(left, books)
        near = np.stack([books[p, code[:, p]] for p in range(len(books))], axis=1).reshape(len(left), -1)
        return ((left - near) ** 2).sum()

    assert error(codes.train_books(corpus, centres, 4)) < 0.9 * error(codes.train_books(corpus, centres, 4, rounds=0))


def test_empty_sides(spark, points):
    some, none = _frame(spark, points[:3]), _frame(spark, [])
    centres, books = points[:2], np.zeros((4, 1, 2))
    assert codes.knn_codes(some.withColumnRenamed("id", "query_id"), codes.encode_vectors(none, centres, books), 2, centres, books, 1, 5).count() == 0
    assert codes.knn_codes(none.withColumnRenamed("id", "query_id"), codes.encode_vectors(some, centres, books), 2, centres, books, 1, 5).count() == 0


def test_the_scan_reads_codes_only(spark, points, tmp_path):
    path = str(tmp_path / "index")
    centres, books = points[:2], np.zeros((4, 1, 2))
    codes.encode_vectors(_frame(spark, points), centres, books).write.parquet(path)
    plan = spark.read.parquet(path).select("id", "cell", "code")._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan


def test_of_equal_codes_the_smaller_ids_are_compared(spark):
    centres, books = np.zeros((3, 2)) + [[0], [9], [18]], np.zeros((1, 1, 2))
    x = [[0.1, 0.001 * k] for k in range(60)] + [[9.0, 9.0]] * 5
    corpus = _frame(spark, x).orderBy("id", ascending=False).coalesce(1)
    found = codes.knn_codes(_frame(spark, x[:1], "query_id"), codes.encode_vectors(corpus, centres, books), 3, centres, books, 1, 4)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [0, 1, 2]

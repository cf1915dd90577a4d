import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from asklens.functions import quantile


def _median(spark, values):
    return quantile.exact_median(spark.createDataFrame([(v,) for v in values], "x double"), "x")


@pytest.mark.parametrize("bins", [2, 1024])
def test_against_all_values(spark, monkeypatch, bins):
    monkeypatch.setattr(quantile, "BINS", bins)
    random.seed(5)
    for values in ([1.0], [1.0, 2.0], [3.0] * 9, [0.0, -0.0, 5.0], [-1e308, 1e308], [1e-300, 2e-300, 3e-300, 1e300],
                   [random.gauss(0, 1) for _ in range(501)], [float(random.randrange(4)) for _ in range(400)],
                   [0.0] * 300 + [1.0] * 300, [1.0, 1.0, 2.0, 2.0]):
        assert _median(spark, values + [None]) == median(values)
    assert _median(spark, [None]) is None


def test_a_million_distinct_values_in_one_bracket(spark, monkeypatch):
    monkeypatch.setattr(quantile, "ACCURACY", 5)  # the sketch brackets nearly everything
    rows = spark.range(1_000_001).select((F.col("id") * 0.5 + 3).alias("x"))
    assert quantile.exact_median(rows, "x") == 250_003.0
    whole = spark.range(1_000_000).select("id")
    assert quantile.exact_median(whole, "id") == 499_999.5

"""An exact median whose state stays bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 100_000
BINS = 1024  # pieces that a bracket is cut into, of which the driver sees the counts


def exact_median(df: DataFrame, column: str) -> float | None:
    """Median (mean of the middle two) of finite numbers without ranking values in one task.

    A quantile sketch brackets the median to a few hundred-thousandths of the rows. The bracket is cut into equal pieces and the
    rows of each piece are counted; the piece with the median is the next bracket, until it is one value. Its ends are
    values that occur, so every round leaves some out; a round reads the rows and hands the driver at most
    ``BINS`` + 1 counts. Nulls do not count, a column without values gives None.
    """
    margin = 2.0 / ACCURACY
    bounds = df.agg(
        F.count(column).alias("n"),
        F.percentile_approx(column, [0.5 - margin, 0.5 + margin], ACCURACY).alias("q")).first()
    if not bounds["n"]:
        return None
    (low, high), value = bounds["q"], F.col(column)
    first, second = (bounds["n"] - 1) // 2, bounds["n"] // 2
    while True:
        start, end = float(low), float(high)
        # Halves, as the distance of two large numbers may be no number.
        place = (value.cast("double") / 2 - start / 2) / (end / 2 - start / 2) if end > start else F.lit(0.0)
        piece = F.when(value < low, -1).otherwise(F.least(F.floor(place * BINS), F.lit(BINS - 1)).cast("int"))
        pieces = df.where(value <= high).groupBy(piece.alias("piece")).agg(
            F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy("piece").collect()
        upto, found = 0, []
        for p in pieces:
            found += [p for rank in (first, second) if upto <= rank < upto + p["n"]]
            upto += p["n"]
        a, b = found
        if a["piece"] != b["piece"]:  # the last value of one piece and the first of the next one
            return (a["high"] + b["low"]) / 2.0
        if a["low"] == a["high"]:
            return (a["low"] + a["low"]) / 2.0
        low, high = a["low"], a["high"]

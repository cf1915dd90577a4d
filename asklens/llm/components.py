"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asklens.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node long, root long): one row per node of ``edges`` (a, b), one root per component.

    Every round each node points to the neighbour (or itself) of smallest keyed hash, and the edges
    are drawn anew between what their ends point to. A round keeps a part of the nodes only, so the
    number of rounds grows with the logarithm of the longest chain. Hubs are reduced by a map-side
    minimum; each round is a written table, so a lost executor repeats no earlier round. Self loops
    and repeated edges are harmless, an empty table gives an empty result, null ends are dropped.
    """
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    spark = edges.sparkSession
    maps: list[DataFrame] = []
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        salt = F.lit(len(maps))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", salt).alias("h"), "b")).alias("m"))
        own = F.struct(F.xxhash64("a", salt).alias("h"), F.col("a").alias("b"))
        point = written(best.select(F.col("a").alias("node"), F.least("m", own)["b"].alias("next")), "points")
        if point.isEmpty():
            break
        maps.append(point)
        left = point.select(F.col("node").alias("a"), F.col("next").alias("x"))
        right = point.select(F.col("node").alias("b"), F.col("next").alias("y"))
        drawn = pairs.join(left, "a").join(right, "b").where("x <> y")
        drawn = drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = written(drawn, "edges")
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    found = maps[0].withColumnRenamed("next", "root")
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), "next")
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found

"""Which labelled rows a classifier may learn from, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for rows kept for testing: crc32 of the id as text leaves 0 modulo 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % 5 == 0,
                      F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, text, label int): at most ``most`` labelled documents that are not held out.

    They are the ones of smallest id hash. Rows whose label is not 0 or 1 or differs between repeats of an
    id are left out. The chosen ids are bounded by ``most``, so they are broadcast to the documents; of documents
    that repeat an id the one of smallest text hash counts, so the bound holds for rows.
    """
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(
        F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    chosen = usable.orderBy(F.xxhash64(id_col), id_col).limit(most).select(
        F.col(id_col).alias("id"), F.col("label").cast("int").alias("label"))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = slim.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("best"))
    return once.select("id", F.col("best.text").alias("text"), "label")


def logistic(values: np.ndarray, labels: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights (bias last) of a logistic model over a few dense columns, by Newton steps."""
    x = np.column_stack([values, np.ones(len(labels))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) + ridge * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w

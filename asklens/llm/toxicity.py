"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from asklens.llm.learning import training_rows
from asklens.llm.shipping import Shipped
from asklens.session import written

SIZES = (3, 4, 5)        # characters of an n-gram
BITS = 20                # 2 ** BITS hashed features
MOST_ROWS = 8_000        # labelled documents that the classifier is fitted on
MOST_FEATURES = 16_384   # n-grams of largest ratio that get a weight
SMOOTHING = 5.0          # documents added to the counts, dealt by the share of the classes
LEAST_DOCS = 3           # documents of the sample that must hold a feature
SURE = 3.0               # standard errors that a log ratio must lie away from 0
_PIECE = 1_000_000


@dataclass(frozen=True)
class Model:
    """Weights of hashed n-grams (others weigh nothing) and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = SIZES
    bits: int = BITS


def grams(text: str, sizes: tuple[int, ...] = SIZES, bits: int = BITS, last: np.ndarray | None = None) -> np.ndarray:
    """The distinct hashed character n-grams of the whole text, lower-cased, with a blank at either end.

    ``last`` is a reusable table of 2 ** bits positions. Long texts go through in overlapping pieces.
    """
    last = np.empty(1 << bits, np.int32) if last is None else last
    whole = f" {text.lower()} "
    found = []
    for start in range(0, len(whole), _PIECE):
        codes = np.frombuffer(whole[start:start + _PIECE + max(sizes) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in sizes:
            if len(codes) < n:
                continue
            mixed = np.full(len(codes) - n + 1, n, np.uint32)
            for k in range(n):
                mixed = mixed * np.uint32(0x01000193) + codes[k:len(codes) - n + 1 + k] * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            found.append(mixed >> np.uint32(32 - bits))
    if not found:
        return np.zeros(0, np.uint32)
    slots = np.concatenate(found)
    order = np.arange(len(slots), dtype=np.int32)
    last[slots] = order  # the last of several equal slots stays, which tells one of them
    return slots[last[slots] == order]


def _features(rows: DataFrame, sizes: tuple[int, ...], bits: int) -> DataFrame:
    """(label int, slots binary): the distinct n-grams of each training row."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty(1 << bits, np.int32)
        for batch in batches:
            slots = [np.sort(grams(x.as_py(), sizes, bits, last)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.binary())], names=["label", "slots"])

    return rows.select("label", "text").mapInArrow(made, "label int, slots binary")


def _counts(made: DataFrame, bits: int) -> DataFrame:
    """(slot int, toxic long, n long): documents of either kind by n-gram, combined inside each task first."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for label, slots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(slots, np.uint32)
                seen[own] += 1
                toxic[own] += label
        slot = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(toxic[slot]), pa.array(seen[slot])],
                                         names=["slot", "toxic", "n"])

    partial = made.mapInArrow(summed, "slot int, toxic long, n long")
    return partial.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def _train(columns: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, rounds: int, ridge: float):
    """Logistic weights on binary features scaled by their ratios, by full-batch steps (Adam); the bias last."""
    doc = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    feature = np.concatenate(columns) if columns else np.zeros(0, int)
    scale, n = ratios[feature], max(1, len(labels))
    w, b = np.zeros(len(ratios)), 0.0
    m, v, mb, vb = np.zeros(len(ratios)), np.zeros(len(ratios)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(doc, scale * w[feature], minlength=len(labels)) + b
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.bincount(feature, scale * gap[doc], minlength=len(ratios)) / n + ridge * w
        gb = gap.sum() / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 if t <= rounds // 2 else 0.01
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = MOST_ROWS,
        most_features: int = MOST_FEATURES, rounds: int = 150, ridge: float = 1e-6, sizes: tuple[int, ...] = SIZES,
        bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``most_rows`` labelled documents outside the held-out fifth.

    Each n-gram is scaled by r = log((p + a) / A) - log((q + b) / B), with p and q its toxic and other
    documents; a logistic model over these scaled, binary features gives the weights. N-grams in fewer than
    three sampled documents or with a ratio within three standard errors of 0 get none. The sample bounds the rows, ``most_features``
    the numbers per row and the model. Without labels of both kinds every score is the share of label 1
    (0.5 if there is no label).
    """
    spark = docs.sparkSession
    made = written(_features(training_rows(docs, labels, label, most_rows, id_col, text_col), sizes, bits), "grams")
    totals = made.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    if toxic in (0, n):
        share = (toxic + 1) / (n + 2)
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(share / (1 - share))), sizes, bits)
    add, other = SMOOTHING * toxic / n, SMOOTHING * (n - toxic) / n
    ratio = F.log((F.col("toxic") + add) / (toxic + SMOOTHING)) - F.log((F.col("n") - F.col("toxic") + other) / (n - toxic + SMOOTHING))
    plain = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (n - toxic + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("n") - F.col("toxic") + 0.5))
    kept = _counts(made, bits).where((F.col("n") >= LEAST_DOCS) & (F.abs(plain) > SURE * error))
    kept = kept.select("slot", ratio.alias("ratio")).orderBy(F.abs("ratio").desc(), "slot").limit(most_features).collect()
    slots = np.array([r["slot"] for r in kept], np.int64)
    order = np.argsort(slots)
    slots, ratios = slots[order], np.array([r["ratio"] for r in kept], float)[order]
    place = np.full(1 << bits, -1, np.int32)
    place[slots] = np.arange(len(slots), dtype=np.int32)
    known = Shipped(spark, place)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [known.value[np.frombuffer(x, np.uint32)] for x in batch.column(1).to_pylist()]
            own = [np.sort(x[x >= 0]).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["label", "slots"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((y, x) for batch in batches for y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if not rows:
            return
        w, b = _train([np.frombuffer(x, np.int32) for _, x in rows], np.array([y for y, _ in rows], float), ratios, rounds, ridge)
        yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([(w * ratios).astype(np.float32).tobytes()], pa.binary())],
                                         names=["bias", "weights"])

    # The sample is bounded by two parameters, so one task can fit it.
    slim = written(made.mapInArrow(chosen, "label int, slots binary"), "chosen")
    found = slim.coalesce(1).mapInArrow(trained, "bias double, weights binary").first()
    known.unpersist()
    return Model(slots, np.frombuffer(found["weights"], np.float32), found["bias"], sizes, bits)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` (double, 0 to 1): how likely label 1 is, from the whole text alone.

    Null and empty texts get the score of no n-gram. A column of the same name is replaced; no shuffle.
    """
    sent = Shipped(docs.sparkSession, model)
    fields = [f for f in docs.drop(out).schema.fields]
    place = [f.name for f in fields].index(text_col)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table, last = np.zeros(1 << m.bits, np.float32), np.empty(1 << m.bits, np.int32)
        table[m.features] = m.weights
        for batch in batches:
            z = np.array([m.bias + float(table[grams(x.as_py() or "", m.sizes, m.bits, last)].sum(dtype=np.float64))
                          for x in batch.column(place)], float)
            scores = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

    return docs.drop(out).mapInArrow(made, StructType([*fields, StructField(out, DoubleType())]))

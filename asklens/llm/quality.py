"""Quality by compression: dictionaries of good and of bad text, and the difference in compressed size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from asklens.llm.learning import logistic, training_rows
from asklens.llm.shipping import Shipped
from asklens.session import written

MOST_ROWS = 8_000        # labelled documents of the sample
MOST_PIECES = 4_000      # pieces of text that a dictionary is built from
DICTIONARY = 112_640     # bytes of a dictionary at most
PIECE = 2_048            # bytes that are compressed at a time, so that a dictionary matters in long texts too
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the weights of the calibration; without dictionaries the score is the bias's."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    piece: int = PIECE
    level: int = LEVEL


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    """The whole text in pieces of ``size`` bytes."""
    return [text[k:k + size] for k in range(0, len(text), size)]


def dictionary(samples: list[bytes], size: int = DICTIONARY, level: int = LEVEL) -> bytes:
    """A zstandard dictionary; of too few samples to train on, the samples themselves."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b" " * 8


class Measure:
    """The size of a text compressed by the bad dictionary less that by the good one, over the larger of the two."""

    def __init__(self, model: Model):
        self.size, self.by = model.piece, []
        for raw in (model.bad, model.good):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=model.level)
            self.by.append(zstandard.ZstdCompressor(level=model.level, dict_data=d))

    def __call__(self, text: bytes) -> float:
        bad, good = (sum(len(c.compress(piece)) for piece in pieces(text, self.size)) for c in self.by)
        return (bad - good) / max(1, bad, good)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, most_pieces: int = MOST_PIECES,
        size: int = DICTIONARY, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Dictionaries and calibration from at most ``most_rows`` labelled documents outside the held-out fifth.

    Half of the sample (by crc32 of the id) gives the dictionaries, ``most_pieces`` pieces of smallest hash for
    each label; the other half calibrates the score by a logistic model on the size difference alone.
    So the driver holds two bounded samples of pieces and a number per row. Without both labels in both halves every score is the share of label 1 (0.5 without any label).
    """
    spark = docs.sparkSession
    rows = written(training_rows(docs, labels, label, most_rows, id_col, text_col), "labelled")
    half = F.crc32(F.col("id").cast("string")) % 5 <= 2
    built, tuned = rows.where(half), rows.where(~half)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = pieces(text.encode())
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(own), pa.int32()), pa.array(own, pa.binary())],
                                                 names=["label", "piece"])

    cuts = built.select("label", "text").mapInArrow(cut, "label int, piece binary")
    samples = {y: [bytes(r["piece"]) for r in cuts.where(F.col("label") == y).orderBy(F.xxhash64("piece"), "piece")
                   .limit(most_pieces).collect()] for y in (1, 0)}
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    flat = Model(b"", b"", (0.0, float(np.log(share / (1 - share)))))
    if not samples[0] or not samples[1]:
        return flat
    model = Model(dictionary(samples[1], size), dictionary(samples[0], size), (0.0, 0.0))
    sent = Shipped(spark, model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Measure(sent.value)
        for batch in batches:
            found = [of(x.encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["label", "difference"])

    found = tuned.select("label", "text").mapInArrow(measured, "label int, difference double").collect()
    sent.unpersist()
    table = np.array(sorted((r["difference"], r["label"]) for r in found), float).reshape(-1, 2)
    if len(np.unique(table[:, 1])) < 2:
        return flat
    return Model(model.good, model.bad, tuple(float(w) for w in logistic(table[:, :1], table[:, 1])))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` (double, 0 to 1): how likely label 1 is, from the whole text alone.

    Null and empty texts have difference 0; an empty table gives no rows, repeated rows the same score. A column of the same name is replaced; no shuffle.
    """
    sent = Shipped(docs.sparkSession, model)
    fields = docs.drop(out).schema.fields
    place = [f.name for f in fields].index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Measure(sent.value) if sent.value.good else None
        w = np.array(sent.value.weights)
        for batch in batches:
            found = np.array([of((x.as_py() or "").encode()) if of else 0 for x in batch.column(place)], float)
            made = 1 / (1 + np.exp(-np.clip(found * w[0] + w[1], -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, out])

    return docs.drop(out).mapInArrow(rows, StructType([*fields, StructField(out, DoubleType())]))

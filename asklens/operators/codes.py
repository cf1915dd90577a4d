"""Approximate neighbours by residual codes: many cells are scanned as short codes, the best few rows are compared exactly.

A vector is stored as its cell and, for each of its parts, the number of the codebook entry nearest to what
the cell's centre leaves over. The scan reads codes only; vectors are read for the rows it hands on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asklens.operators.similarity import ASKED_BYTES, _cheapest, _scanned, _with_score
from asklens.session import written

ENTRIES = 16              # of a part's codebook
SAMPLE = 65_536           # vectors, of smallest id hash, that codebooks are trained on
ROUNDS = 12               # of training
HELD = 4_000_000          # (query, row) pairs that a task keeps at a time
_BATCH = 4096             # rows that are encoded together


def residuals(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, what is left): the nearest centre of each vector (the first of equally near ones), and the way from it."""
    apart = (vectors ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None, :] - 2.0 * (vectors @ centres.T)
    cell = apart.argmin(1)
    return cell, vectors - centres[cell]


def part_codes(left: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest entry of each part's codebook (parts, entries, width); the lower number wins a tie."""
    parts, _, width = books.shape
    cut = left.reshape(len(left), parts, width)
    return np.stack([((cut[:, p, None, :] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], axis=1).astype(np.uint8)


def train_books(corpus: DataFrame, centres: np.ndarray, parts: int, entries: int = ENTRIES, sample: int = SAMPLE,
                rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) by Lloyd rounds over the residuals of at most ``sample`` vectors.

    Training sees the sample, the index every row. The first entries are evenly spaced rows of the sample.
    """
    rows = corpus.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()
    left = residuals(np.array([r["embedding"] for r in rows], float), centres)[1]
    cut = left.reshape(len(left), parts, -1).transpose(1, 0, 2)
    books = cut[:, np.linspace(0, len(left) - 1, entries).astype(int)].copy()
    for _ in range(rounds):
        code = part_codes(left, books)
        for p in range(parts):
            n = np.bincount(code[:, p], minlength=entries)
            total = np.stack([np.bincount(code[:, p], cut[p, :, k], entries) for k in range(cut.shape[2])], axis=1)
            books[p] = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], books[p])
    return books


def encode_vectors(corpus: DataFrame, centres: np.ndarray, books: np.ndarray) -> DataFrame:
    """``corpus`` (id, embedding) with ``cell`` and ``code`` (a byte per part), by cell within each task; rows without id or vector are left out."""
    if books.shape[1] > 256:
        raise ValueError("a byte tells 256 entries apart")
    rows = corpus.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", "embedding")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), _BATCH):
                piece = batch.slice(start, _BATCH)
                cell, left = residuals(np.array(piece.column(1).to_pylist(), float), centres)
                codes = part_codes(left, books)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["id", "embedding", "cell", "code"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(coded, f"{kinds}, cell int, code binary").sortWithinPartitions("cell")


def knn_codes(queries: DataFrame, index: DataFrame, n: int, centres: np.ndarray, books: np.ndarray, probes: int,
              compared: int) -> DataFrame:
    """The ``n`` nearest of those ``compared`` rows whose codes are nearest, in the ``probes`` nearest cells of each query.

    ``index`` is (id, embedding, cell, code) from :func:`encode_vectors`, usually stored. Same columns as
    :func:`knn_exact`. Packs of queries of a checked size go to the index, which is not shuffled: the first pass reads cells and codes and keeps the best
    ``compared`` rows per task and query, the second reads the vectors of the rows that are left. A code stands for one vector, its cell's centre
    and the entries it names, so the scan is a product of matrices; of equally near codes those of the smaller ids are kept.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("payload"))

    def decode(codes: pa.Array, cell: np.ndarray) -> np.ndarray:
        numbers = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), len(books))
        return centres[cell] + books[np.arange(len(books)), numbers].reshape(len(codes), -1)

    rows = index.select("id", F.col("code").alias("payload"), "cell")
    bytes_held = max(1, HELD // compared) * (8 * (centres.shape[1] + 3 * compared) + len(centres))
    chosen = _scanned(asked, rows, compared, False, min(ASKED_BYTES, bytes_held), centres, probes, decode).select("query_id", "id")
    given = queries.select("query_id", F.col("embedding").alias("x"))
    near_rows = written(chosen, "near-codes").join(index.select("id", F.col("embedding").alias("y")), "id").join(given, "query_id")
    square = F.aggregate(F.zip_with("x", "y", lambda p, q: (p.cast("double") - q.cast("double")) ** 2), F.lit(0.0), lambda s, v: s + v)
    return _with_score(_cheapest(near_rows.select("query_id", "id", square.alias("cost")).distinct(), n))

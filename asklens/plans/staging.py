"""Staging of JSON documents for the queries that read such files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters per staged document; a document is parsed by one task, and each is a file, so small ones would be too many files.
DOCUMENT_CHARS = 8 << 20


def documents(rows: DataFrame, entry: Column, path: str, wrap: str = "%s") -> None:
    """Write rows as text files that each hold one JSON document with a list of ``entry``.

    Every task writes documents of its own rows as they come, without a shuffle.
    """
    before, after = wrap.split("%s")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def document() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{before}[{joint.join(held)}]{after}"])], names=["value"])

        joint, held, size = ",\n", [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text)
                size += len(text)
                if size >= DOCUMENT_CHARS:
                    yield document()
                    held, size = [], 0
        if held:
            yield document()

    lists = rows.select(F.to_json(entry).alias("e")).mapInArrow(listed, "value string")
    lists.write.option("maxRecordsPerFile", 1).text(path)

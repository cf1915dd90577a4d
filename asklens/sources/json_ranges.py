"""Entries of large JSON arrays, read by byte ranges so that one document is many tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asklens.session import written

# Where a range may begin: outside of strings, inside of one, or behind its backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
# Bytes read first behind a range.
TAIL_BYTES = 4096
_STRING_REST = re.compile(rb'(?s)(?:[^"\\]++|\\.)*+')
_TOP_MARK = re.compile(rb'["\[\]{},]')
_DEEP_MARK = re.compile(rb'["\[\]{}]')


# Bytes that decide: quotes, backslashes (with the zeros put for what they escape), brackets that open or close, commas.
_QUOTE, _SLASH, _OPENS, _CLOSES, _COMMA = 1, 2, 3, 4, 5
_KINDS = np.zeros(256, np.int8)
for _kind, _bytes in ((_QUOTE, b'"'), (_SLASH, b"\\\0"), (_OPENS, b"[{"), (_CLOSES, b"]}"), (_COMMA, b",")):
    _KINDS[list(_bytes)] = _kind


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions and kinds of the bytes that decide, taking every backslash as inside of a string, and whether the last one is open."""
    if b"\\" in data:
        data = data.replace(b"\\\\", b"\0\0").replace(b'\\"', b"\0\0")
    kinds = _KINDS[np.frombuffer(data, np.uint8)]
    at = np.flatnonzero(kinds)
    return at, kinds[at], data.endswith(b"\\")


def _outside(marks: tuple, state: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """State behind the marks, and positions and kinds of those outside of strings; none where one of these is a backslash."""
    at, kinds, open_end = marks
    inside = (np.cumsum(kinds == _QUOTE) + (state != OUTSIDE)) % 2 == 1
    last = bool(inside[-1]) if len(at) else state != OUTSIDE
    out = ~inside & (kinds != _QUOTE)
    if (kinds[out] == _SLASH).any():
        return None
    return (ESCAPED if open_end else INSIDE) if last else OUTSIDE, at[out], kinds[out]


def _deeper(kinds: np.ndarray) -> np.ndarray:
    return np.cumsum((kinds == _OPENS).astype(np.int64) - (kinds == _CLOSES))


def ends(data: bytes) -> list[tuple[int, int] | None]:
    """For each state that ``data`` may begin in, the state behind it and by how much deeper it is.

    There is none for a state in which a backslash would lie outside of strings; no document that parses is ever in it, and :func:`scan`
    judges the others.
    """
    marks = _marks(data)
    found = [_outside(marks, OUTSIDE), _outside(marks, INSIDE)]
    # Behind a backslash the first byte is skipped, which tells only if it is a quote or a backslash.
    found.append(_outside(_marks(data[1:]), INSIDE) if data[:1] in (b'"', b"\\") else found[INSIDE])
    return [None if f is None else (f[0], int(_deeper(f[2])[-1]) if len(f[2]) else 0) for f in found]


def scan(data: bytes, state: int, depth: int) -> tuple[int, int, list[tuple[int, bool, bool]]]:
    """State and depth behind ``data``, and the places in it at which an entry of the outermost array ends or begins.

    A place is (position behind the mark, an entry ends before the mark, one begins behind it).
    """
    skipped = 1 if state == ESCAPED and data else 0
    found = _outside(_marks(data[skipped:]), INSIDE if skipped else state) if data else None
    if found is None:
        return _walk(data, state, depth)
    state, at, kinds = found
    deep = depth + _deeper(kinds)
    first = (kinds == _OPENS) & (deep == 1)
    last = (kinds == _CLOSES) & (deep == 0)
    which = np.flatnonzero(first | last | ((kinds == _COMMA) & (deep == 1)))
    places = zip((at[which] + 1 + skipped).tolist(), (~first[which]).tolist(), (~last[which]).tolist(), strict=True)
    return state, int(deep[-1]) if len(deep) else depth, list(places)


def _walk(data: bytes, state: int, depth: int) -> tuple[int, int, list[tuple[int, bool, bool]]]:
    """As :func:`scan`, mark by mark, for any text."""
    places, at, size = [], 0, len(data)
    if state == ESCAPED and size:
        state, at = INSIDE, 1
    while at < size:
        if state == INSIDE:
            at = _STRING_REST.match(data, at).end()
            if at < size:
                state = OUTSIDE if data[at] == 0x22 else ESCAPED
                at += 1
            continue
        found = (_TOP_MARK if depth == 1 else _DEEP_MARK).search(data, at)
        if found is None:
            break
        mark, at = found[0], found.end()
        if mark == b'"':
            state = INSIDE
        elif mark in b"[{":
            depth += 1
            if depth == 1:
                places.append((at, False, True))
        elif mark in b"]}":
            depth -= 1
            if depth == 0:
                places.append((at, True, False))
        else:
            places.append((at, True, True))
    return state, depth, places


def _open(path: str):
    """A file at a local path or at an address that Arrow opens."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    place, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return place.open_input_file(name)


def json_entries(spark: SparkSession, path: str, split_bytes: int, pattern: str = "*") -> DataFrame:
    """(file, pos, listed, value): the text of each entry of the files that hold a JSON array, and of each other document as a whole.

    ``pos`` is the entry's byte in the file, ``listed`` is false for a document that is no array. A first pass over ranges of ``split_bytes`` finds
    how each range would end for every state it may begin in; these small rows are chained per file, and a second pass
    cuts out the entries that begin in each range, reading on behind it to the end of the last. Empty arrays and blank files give no entry. A
    document whose strings or brackets do not close gives none either, as a document that cannot be parsed does.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    step = F.lit(split_bytes).cast("bigint")
    ranges = files.where("length > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, step)).alias("start"))
    tasks = spark.sparkContext.defaultParallelism * 4
    ranges = ranges.repartition(tasks, "path", "start")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(name) as file:
                    file.seek(start)
                    data = file.read(split_bytes)
                known = [e or (None, None) for e in ends(data)]
                head = data.removeprefix(b"\xef\xbb\xbf").lstrip() if start == 0 else b""
                rows.append((name, start, [e[0] for e in known], [e[1] for e in known], head[:1].decode("latin-1")))
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else
                                             [pa.array([], k) for k in kinds], names=["path", "start", "ends", "deeper", "head"])

    def chained(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("start")
        state, depth, begun = OUTSIDE, 0, []
        for name, start, after, deeper in zip(table["path"], table["start"], table["ends"], table["deeper"], strict=True):
            begun.append((state, depth))
            # Numbers with gaps come as floats.
            if after[state] is None or after[state] != after[state]:
                with _open(name) as file:
                    file.seek(start)
                    state, depth, _ = scan(file.read(split_bytes), state, depth)
            else:
                state, depth = int(after[state]), depth + int(deeper[state])
        head = table["head"].iloc[0] if state == OUTSIDE and depth == 0 else ""
        return pd.DataFrame({"path": table["path"], "start": table["start"], "state": [b[0] for b in begun],
                             "depth": [b[1] for b in begun], "head": head})

    found = ranges.mapInArrow(summaries, "path string, start long, ends array<int>, deeper array<long>, head string")
    known = written(found.groupBy("path").applyInPandas(chained, "path string, start long, state int, depth long, head string"), "ranges")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in cut(batches):
            rows.append(row)
            held += len(row[3])
            if len(rows) == 4096 or held >= split_bytes:
                yield packed(rows)
                rows, held = [], 0
        yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = pa.string(), pa.int64(), pa.bool_(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=["file", "pos", "listed", "value"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, str]]:
        for batch in batches:
            for name, start, state, depth, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(name) as file:
                    if head != "[":
                        text = file.read() if head and start == 0 else b""
                        if text:
                            yield name, 0, False, text.removeprefix(b"\xef\xbb\xbf").decode(errors="replace")
                        continue
                    file.seek(start)
                    base, began, parts, done, size = start, None, [], False, split_bytes
                    while not done:
                        data = file.read(size)
                        if not data:
                            break
                        state, depth, places = scan(data, state, depth)
                        last = 0
                        for at, ends, begins in places:
                            if began is not None and ends:
                                text = b"".join([*parts, data[last:at - 1]]).strip()
                                if text:
                                    yield name, began, True, text.decode(errors="replace")
                            began, parts, last = base + at if begins and base == start else None, [], at
                            if base > start:
                                done = True
                                break
                        if began is None and base + len(data) >= start + split_bytes:
                            done = True
                        parts.append(data[last:])
                        base += len(data)
                        # What is left of the last entry is short as a rule.
                        size = min(split_bytes, TAIL_BYTES if base == start + split_bytes else 2 * size)

    return known.repartition(tasks, "path", "start").mapInArrow(entries, "file string, pos long, listed boolean, value string")

"""Benchmark passages in documents, found through an FM-index over each shard of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from asklens.llm.fmindex import FMIndex
from asklens.llm.shipping import Shipped
from asklens.session import written

WINDOW = 13             # consecutive words of an item that make a test phrase
PACK_WORDS = 2_000_000  # benchmark words that are broadcast and searched at a time
SHARD_WORDS = 4_000_000 # document words that share an index; a longer document has its own
SHARE = 20              # contaminated where at least one word in so many is hit
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_PIECE = 4_000_000
_HASH = "_asklens_hash"
_BLANKS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
                for b in range(256))
_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(65, 91)}
RESULT = "struct<n_words: bigint, n_hit: bigint, items: array<string>, hits: array<struct<from: bigint, to: bigint>>>"


def words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text piece by piece: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    start = 0
    while start < len(text):
        end = min(len(text), start + _PIECE)
        while end < len(text) and _BLANKS[text[end]] != 0x20:
            end += 1
        yield text[start:end].translate(_BLANKS).split()
        start = end


class Phrases:
    """The test phrases of a pack of items: numbered words, windows by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for part in words((text or "").encode()) for w in part]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[k:k + window]), set()).add(item)
        self.windows: dict[int, np.ndarray] = {}
        self.owners: dict[int, list[list[str]]] = {}
        for width in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == width]
            self.windows[width] = np.array(own, np.int64)
            self.owners[width] = [sorted(owners[w]) for w in own]
        self.shortest = min(self.windows, default=0)


def _numbers(text: bytes, number: dict[bytes, int]) -> np.ndarray:
    parts = [np.fromiter(map(number.get, part, repeat(0)), np.int32, len(part)) for part in words(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def occurrences(shard: list[np.ndarray], phrases: Phrases):
    """(document, first word, width, window) of every occurrence of a test phrase in the shard, as arrays.

    The index's alphabet is the words of the test phrases; all other words are its separator. Runs
    between separators that are shorter than the shortest phrase hold none and stay out of the index.
    """
    # Two zeros close each document, so that no run goes over an end.
    flat = np.concatenate([x for ids in shard for x in (ids, np.zeros(1, np.int32))])
    begins = np.concatenate([[0], np.cumsum([len(ids) + 1 for ids in shard])])[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flat != 0, [False]]).astype(np.int8)))
    first, past = edge[::2], edge[1::2]
    long = past - first >= phrases.shortest
    first, past = first[long], past[long]
    none = np.zeros(0, np.int64)
    if len(first) == 0 or not phrases.windows:
        return none, none, none, none
    sizes = past - first + 1  # each run with the separator behind it
    offsets = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    place = np.repeat(first - offsets, sizes) + np.arange(sizes.sum())
    index = FMIndex(flat[place])
    found = []
    for width, windows in phrases.windows.items():
        low, high = index.search(windows)
        hit = np.flatnonzero(high > low)
        count = high[hit] - low[hit]
        window = np.repeat(hit, count)
        rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
        at = place[index.locate(rows)] if len(rows) else none
        doc = np.searchsorted(begins, at, side="right") - 1
        found.append((doc, at - begins[doc], np.full(len(at), width), window))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pack_words: int = PACK_WORDS,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  out: str = "contamination") -> DataFrame:
    """``docs`` with the struct ``out``: n_words, n_hit, items (ids in string order), hits (word ranges, merged).

    A test phrase is ``window`` consecutive words of an item, or a shorter item as a whole. Every task builds an
    FM-index over its documents, shard by shard, and searches all phrases in it. The rows of the benchmark are dealt by
    hash into packs of about ``pack_words`` words. One pack takes no shuffle. With more, each pass writes the hits of the
    texts that have any and its broadcast is released before the next pack is collected, so one pack is held at a
    time; the merged hits meet the documents by the hash of their text. Null texts have no words, items without id or
    words are no items, repeated items count once, a column named like ``out`` is replaced.
    """
    spark = docs.sparkSession
    slim = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    slim = slim.where("id IS NOT NULL AND text IS NOT NULL").distinct()
    total = slim.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    packs = max(1, -(-total // pack_words))
    blank = docs.withColumn(out, F.lit(None).cast(RESULT))
    if packs == 1:
        return _pass(blank, Shipped(spark, _phrases(slim, window)), text_col, out)
    slim, texts, found = written(slim, "items"), blank.select(text_col, out), []
    for pack in range(packs):
        sent = Shipped(spark, _phrases(slim.where(F.pmod(F.xxhash64("id", "text"), F.lit(packs)) == pack), window))
        hit = _pass(texts, sent, text_col, out).where(F.col(f"{out}.n_hit") > 0)
        found.append(written(hit.select(F.sha2(text_col, 256).alias("hash"), F.col(f"{out}.items").alias("items"),
                                        F.col(f"{out}.hits").alias("hits")).dropDuplicates(["hash"]), "hits"))
        sent.unpersist()
    every = reduce(DataFrame.unionByName, found).groupBy("hash").agg(
        F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("hits")).alias("hits"))
    known = every.select(F.col("hash").alias(_HASH), F.struct(
        F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), "items", "hits").cast(RESULT).alias(out))
    joined = docs.drop(out).withColumn(_HASH, F.sha2(text_col, 256)).join(known, _HASH, "left").select(*blank.columns)
    # No phrases: counts the words and merges what the passes have found.
    return _pass(joined, Shipped(spark, Phrases([], window)), text_col, out)


def _phrases(items: DataFrame, window: int) -> Phrases:
    return Phrases([(r["id"], r["text"]) for r in items.collect()], window)


def _pass(docs: DataFrame, sent, text_col: str, out: str) -> DataFrame:
    names = docs.columns
    text_at, out_at = names.index(text_col), names.index(out)
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                      ("hits", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])

    def results(shard: list[np.ndarray], before: list[dict | None]) -> list[dict]:
        phrases = sent.value
        doc, at, width, window = occurrences(shard, phrases) if shard else ([], [], [], [])
        items: dict[int, set[str]] = {}
        hits: dict[int, set[tuple[int, int]]] = {}
        for d, a, w, k in zip(*(np.asarray(x).tolist() for x in (doc, at, width, window)), strict=True):
            items.setdefault(d, set()).update(phrases.owners[w][k])
            hits.setdefault(d, set()).add((a, a + w))
        made = []
        for d, ids in enumerate(shard):
            old = before[d] or {"items": [], "hits": []}
            ranges = _merged([(x["from"], x["to"]) for x in old["hits"]] + list(hits.get(d, ())))
            made.append({"n_words": len(ids), "n_hit": sum(b - a for a, b in ranges),
                         "items": sorted(items.get(d, set()) | set(old["items"])),
                         "hits": [{"from": a, "to": b} for a, b in ranges]})
        return made

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.number
        for batch in batches:
            before = batch.column(out_at).to_pylist()
            made, shard, held = [], [], 0
            for text in batch.column(text_at):
                shard.append(_numbers((text.as_py() or "").encode(), number))
                held += len(shard[-1])
                if held >= SHARD_WORDS:
                    made += results(shard, before[len(made):])
                    shard, held = [], 0
            made += results(shard, before[len(made):])
            columns = batch.columns
            columns[out_at] = pa.array(made, kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(rows, docs.schema)


def contaminated(found: str = "contamination", share: int = SHARE) -> Column:
    """True where a word is hit and at least one word in ``share`` is."""
    return (F.col(f"{found}.n_hit") > 0) & (F.col(f"{found}.n_hit") * share >= F.col(f"{found}.n_words"))


def removal_spans(text: str | None, hits: list | None) -> list[tuple[int, int]]:
    """Word ranges as code point spans (start, end) of the text."""
    if not text or not hits:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [(at[h["from"]][0], at[h["to"] - 1][1]) for h in hits]


def cut_passages(docs: DataFrame, text_col: str = "text", found: str = "contamination", out: str = "text_cut") -> DataFrame:
    """``docs`` (with the column ``found``) and the text without its benchmark passages in ``out``."""
    fields = docs.drop(out).schema.fields
    names = [f.name for f in fields]
    text_at, found_at = names.index(text_col), names.index(found)

    def cut(text, result):
        spans, kept, at = removal_spans(text, (result or {}).get("hits")), [], 0
        for a, b in spans:
            kept.append(text[at:a])
            at = b
        return None if text is None else "".join([*kept, text[at:]])

    def rows(batches):
        for batch in batches:
            texts = [cut(t, r) for t, r in zip(batch.column(text_at).to_pylist(), batch.column(found_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, out])

    return docs.drop(out).mapInArrow(rows, StructType([*fields, StructField(out, docs.schema[text_col].dataType)]))

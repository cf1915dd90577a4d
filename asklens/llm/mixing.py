"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from asklens.llm.feistel import permuted
from asklens.llm.shipping import Shipped
from asklens.session import written

WEIGHTS = (3.0, 1.0, 2.0)  # of the sources in turn
SHARE = 1.5                # of all words, that the mix takes
MOST_EPOCHS = 2            # times that a word may be taken
BLOCK_WORDS = 1024
SHARDS = 64
BUCKETS = 1024             # groups of documents in which a source is laid out
MOST_SOURCES = 100_000     # more sources are refused, as their quotas are broadcast
WORDS = "[^ \\t-\\r]+"
_WORD = re.compile("[^ \t-\r]+")
PIECES = "array<struct<epoch: int, shard: int, rank: bigint, start: bigint, stop: bigint>>"


def word_count(text: str) -> Column:
    """Runs without ASCII white space in a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_EPOCHS) -> list[float]:
    """Shares of ``total`` by weight; one above ``most`` times its size stops there, its excess is shared anew by weight."""
    found, left, free = [0.0] * len(sizes), float(total), list(range(len(sizes)))
    while free:
        weight = sum(weights[k] for k in free)
        over = {k for k in free if left * weights[k] / weight > most * sizes[k]}
        for k in free:
            found[k] = float(most * sizes[k]) if k in over else left * weights[k] / weight
        if not over:
            break
        left -= sum(found[k] for k in over)
        free = [k for k in free if k not in over]
    return found


@dataclass(frozen=True)
class Quota:
    """What the mix takes of a source: places of its permuted blocks, epoch after epoch."""

    size: int
    target: float
    blocks: int  # in one epoch
    places: int  # taken in all epochs
    cut: int     # words of the last place that are taken


def epoch_key(key: int, number: int, epoch: int) -> str:
    """The name of the permutation of one epoch of one source."""
    return f"{key}/{number}/{epoch}"


def quota(number: int, size: int, target: float, key: int, block: int) -> Quota:
    """Places whose words add up to the rounded target; the last block of a line may be short."""
    blocks = -(-size // block)
    words = min(round(target), MOST_EPOCHS * size)
    if words == 0:
        return Quota(size, target, blocks, 0, 0)
    epochs, rest = divmod(words - 1, size)
    rest += 1
    short = size - (blocks - 1) * block
    at = int(permuted([blocks - 1], blocks, epoch_key(key, number, epochs))[0])  # place of the short block
    if rest <= at * block:
        places = -(-rest // block)
        cut = rest - (places - 1) * block
    elif rest <= at * block + short:
        places, cut = at + 1, rest - at * block
    else:
        behind = rest - at * block - short
        places = at + 1 - (-behind // block)
        cut = behind - (places - at - 2) * block
    return Quota(size, target, blocks, epochs * blocks + places, cut)


def splitting_tree(counts: np.ndarray, shards: int, key: int) -> np.ndarray:
    """Places of each source (columns) in each shard (rows).

    The places of a node are dealt to its two halves by a multivariate-hypergeometric draw: as if all
    were shuffled and cut at the share of the half. Each node draws with a generator keyed by its range, so a
    shard's counts can be found from the root without the others.
    """
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, counts.astype(np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
            continue
        middle = (a + b) // 2
        draw = np.random.Generator(np.random.Philox(key=[key, (a << 32) | b]))
        left = _drawn(draw, have, int(have.sum()) * (middle - a) // (b - a))
        todo += [(a, middle, left), (middle, b, have - left)]
    return out


def _drawn(draw: np.random.Generator, have: np.ndarray, size: int, most: int = 500_000_000) -> np.ndarray:
    """A draw of ``size`` from the counts ``have``; the generator's range makes large ones come in portions."""
    left, rest = np.zeros_like(have), have.copy()
    portions = int(have.sum()) // most + 1
    for k in range(portions):
        part = rest // (portions - k)
        take = size * (k + 1) // portions - size * k // portions
        take = size - int(left.sum()) if k == portions - 1 else min(take, int(part.sum()))
        left += draw.multivariate_hypergeometric(part, take, method="marginals")
        rest -= part
    return left


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK_WORDS,
        shards: int = SHARDS, key: int = 1, carry: bool = False, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc, source, size, source_size, target, taken, pieces): a row per document; ``carry`` adds its columns as ``row``.

    ``pieces`` lists what the mix takes of the document: words start .. stop (of the document, stop
    exclusive) in an epoch, the output shard and the rank that orders the shard. Each source (null is one) lays out
    its documents by a hash of id and text as one line of words, cut into blocks of ``block`` words; a
    block's pieces stay together. The quota of a source is a number of blocks, taken in the order of a keyed
    permutation, a second epoch in one of its own. The splitting tree gives every shard its count of each
    source's places, dealt in order, so shards are disjoint. The last place is cut so that the
    words taken equal the rounded target.

    The driver sees a row per source (at most ``MOST_SOURCES``) and the tree's counts. A line is laid out in
    ``BUCKETS`` groups, so no window holds a whole source. Repeated rows are laid out one by one, null and
    empty texts have no words and are never taken, an empty table gives no rows. Reruns agree.
    """
    spark = docs.sparkSession
    whole = [F.struct(*docs.columns).alias("row")] if carry else []
    sized = docs.select(
        F.col(id_col).alias("doc"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        F.xxhash64(F.lit(key), id_col, text_col).alias("hash"), *whole)
    sized = sized.withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int"))
    if not carry:  # texts are rather counted twice than written once more
        sized = written(sized, "sized")
    groups = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    groups = written(groups, "groups")
    totals = groups.groupBy("source").agg(F.sum("words").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # by code point, null last
    sizes = [r["size"] for r in totals]
    wanted = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share * sum(sizes))
    quotas = [quota(k, s, t, key, block) for k, (s, t) in enumerate(zip(sizes, wanted, strict=True))]
    ends = splitting_tree(np.array([q.places for q in quotas], np.int64), shards, key).cumsum(axis=0)
    sent = Shipped(spark, (quotas, ends))
    kind = docs.schema[source_col].dataType.simpleString()
    numbers = spark.createDataFrame([(r["source"], k) for k, r in enumerate(totals)], f"own {kind}, number int")

    # A row for each source and bucket; the base of a bucket on its source's line.
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("source", "bucket", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("base"))
    bases = bases.join(F.broadcast(numbers), bases["source"].eqNullSafe(numbers["own"])).select(
        "own", F.col("bucket").alias("group"), "base", "number")
    line = Window.partitionBy("source", "bucket").orderBy("hash", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
    placed = placed.join(bases, placed["source"].eqNullSafe(bases["own"]) & (placed["bucket"] == bases["group"]))
    placed = placed.select("doc", "source", "size", *(["row"] if carry else []), "number", (F.col("base") + F.col("before")).alias("at"))
    given = [f for f in placed.schema.fields if f.name not in ("number", "at")]
    columns = [f.name for f in given]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotas, ends = sent.value
        for batch in batches:
            size, number, at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("size", "number", "at"))
            first, last = at // block, (at + size - 1) // block
            count = np.where(size > 0, last - first + 1, 0)
            row = np.repeat(np.arange(len(size)), count)
            own = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            parts = []
            for s in np.unique(number[row]):
                q = quotas[s]
                rows = np.flatnonzero(number[row] == s)
                for epoch in range(-(-q.places // q.blocks) if q.blocks else 0):
                    place = epoch * q.blocks + permuted(own[rows], q.blocks, epoch_key(key, s, epoch))
                    took = place < q.places
                    r, b, place = row[rows[took]], own[rows[took]], place[took]
                    start = np.maximum(b * block, at[r])
                    stop = np.minimum(np.where(place == q.places - 1, b * block + q.cut, (b + 1) * block), at[r] + size[r])
                    some = stop > start
                    shard = np.searchsorted(ends[:, s], place, side="right")
                    rank = permuted(place, max(1, q.places), f"{key}/{s}/rank")
                    parts.append([x[some] for x in (r, np.full(len(r), epoch), shard, rank, start - at[r], stop - at[r])])
            r, epoch, shard, rank, start, stop = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)) \
                if parts else (np.zeros(0, np.int64),) * 6
            order = np.lexsort((start, epoch, r))
            r, epoch, shard, rank, start, stop = (x[order] for x in (r, epoch, shard, rank, start, stop))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(size)))]).astype(np.int32)
            items = pa.StructArray.from_arrays(
                [pa.array(epoch, pa.int32()), pa.array(shard, pa.int32()), pa.array(rank), pa.array(start), pa.array(stop)],
                names=["epoch", "shard", "rank", "start", "stop"])
            of = [quotas[s] for s in number]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in columns]
                + [pa.array([q.size for q in of], pa.int64()), pa.array([q.target for q in of], pa.float64()),
                   pa.array(np.bincount(r, stop - start, len(size)).astype(np.int64)), pa.ListArray.from_arrays(offsets, items)],
                names=[*columns, "source_size", "target", "taken", "pieces"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given)
    return placed.mapInArrow(dealt, f"{kinds}, source_size long, target double, taken long, pieces {PIECES}")


def words_by_shard(pieces: str) -> Column:
    """What each output shard takes of a document, as shard:words in order of shards, comma-joined."""
    shards = F.array_sort(F.array_distinct(F.transform(F.col(pieces), lambda p: p["shard"])))
    words = lambda s: F.aggregate(
        F.filter(F.col(pieces), lambda p: p["shard"] == s), F.lit(0).cast("long"), lambda n, p: n + p["stop"] - p["start"])
    return F.array_join(F.transform(shards, lambda s: F.concat_ws(":", s, words(s))), ",")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, key: int = 1, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", size_col: str | None = "n_chars", **other) -> DataFrame:
    """The documents of the mix with their columns: a row for each document and epoch that the mix takes of.

    Partition k holds output shard k, shuffled by rank; a document goes where its first piece of the epoch goes.
    A document taken as a whole keeps its text; of one taken in part the row has the taken runs of words, each with its
    own white space, joined by line ends. ``size_col`` gets the characters of that text. Documents not
    taken are left out: that is the mix's decision.
    """
    dealt = mix(docs, shards=shards, key=key, carry=True, id_col=id_col, text_col=text_col, source_col=source_col, **other)
    names, text_at = docs.columns, docs.columns.index(text_col)
    size_at = names.index(size_col) if size_col in names else None

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            at, texts, places = [], [], []
            for k, (text, size, pieces) in enumerate(zip(columns[text_at].to_pylist(), batch.column(1).to_pylist(),
                                                         batch.column(2).to_pylist(), strict=True)):
                for place, runs in _runs(pieces):
                    at.append(k)
                    places.append(place)
                    texts.append(text if runs == [(0, size)] else _cut(text, runs))
            out = [c.take(pa.array(at, pa.int64())) for c in columns]
            out[text_at] = pa.array(texts, pa.string())
            if size_at is not None:
                out[size_at] = pa.array([len(t) for t in texts], out[size_at].type)
            out += [pa.array([p[k] for p in places], t) for k, t in ((0, pa.int32()), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "_mix_shard", "_mix_rank"])

    schema = StructType([*docs.schema.fields, StructField("_mix_shard", IntegerType()), StructField("_mix_rank", LongType())])
    rows = dealt.where("taken > 0").select("row", "size", "pieces").mapInArrow(made, schema)
    # Shards are dealt to partitions and shuffled locally, by rank.
    return rows.repartitionById(shards, "_mix_shard").sortWithinPartitions("_mix_rank").drop("_mix_shard", "_mix_rank")


def _runs(pieces: list[dict]) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """For each epoch, in order, its first piece's shard and rank and the runs of words that its pieces make together."""
    epochs: dict[int, tuple[tuple[int, int], list[tuple[int, int]]]] = {}
    for p in sorted(pieces, key=lambda p: (p["epoch"], p["start"])):
        runs = epochs.setdefault(p["epoch"], ((p["shard"], p["rank"]), []))[1]
        if runs and runs[-1][1] == p["start"]:
            runs[-1] = (runs[-1][0], p["stop"])
        else:
            runs.append((p["start"], p["stop"]))
    return list(epochs.values())


def _cut(text: str, runs: list[tuple[int, int]]) -> str:
    """The runs of words of a text, joined by line ends."""
    at = [m.span() for m in _WORD.finditer(text)]
    return "\n".join(text[at[a][0]:at[b - 1][1]] for a, b in runs)

"""Near-duplicates by SimHash fingerprints, joined exactly through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asklens.llm.components import components
from asklens.session import written

SHINGLE = 3
SEED = 42
RADIUS = 2
SHARD_SIZE = 16_384     # fingerprints that a leaf of the shared tree aims at
MOST_LEAVES = 4_096     # leaves of the shared tree; each leaf goes on with a tree of its own
PER_LEAF = 16           # sampled fingerprints per leaf: the sample holds at most 65,536 numbers
BLOCK = 262_144         # fingerprints of one leaf that a task holds at a time
_PIECE = 65_536
_PLAIN = 1_024


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a UTF-8 text, unsigned.

    A-Z are lower-cased, words are runs without ASCII white space, features are runs of ``shingle``
    words joined by a space, repeats included; fewer words are one feature, no word gives 0. Long
    texts are hashed piece by piece, so memory follows the words and not the features.
    """
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    ones, total = np.zeros(64, np.int64), len(words) - shingle + 1
    for start in range(0, total, _PIECE):
        part = words[start:start + _PIECE + shingle - 1]
        runs = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key long, fp long): a row per document; ``key`` hashes id and text, ``fp`` is the signed fingerprint.

    A null text counts as empty. Other columns are not read.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))],
                                             names=["id", "key", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"),
                       F.encode(F.col(text_col), "UTF-8").alias("text"))
    return slim.mapInArrow(rows, f"id {docs.schema[id_col].dataType.simpleString()}, key long, fp long")


def distances(v: int, values: np.ndarray) -> np.ndarray:
    """Hamming distances of ``values`` (uint64) to ``v``."""
    return np.bitwise_count(values ^ np.uint64(v))


def fit_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """A vantage-point tree in heap order: (vantage, limit) of every inner node.

    The vantage point is a fingerprint of the node, the limit the median distance of the node's part
    of the sample. A node without sample takes the limit 32 around a fixed number.
    """
    nodes: list[tuple[int, int]] = [(0x9E3779B97F4A7C15, 32)] * (2 ** depth - 1)
    parts = {0: sample}
    for node in range(len(nodes)):
        part = parts.pop(node, sample[:0])
        if len(part) == 0:
            continue
        v = int(part[len(part) // 2])
        d = distances(v, part)
        limit = int(np.median(d))
        nodes[node] = (v, limit)
        parts[2 * node + 1], parts[2 * node + 2] = part[d <= limit], part[d > limit]
    return nodes


def route(values: np.ndarray, nodes: list[tuple[int, int]], radius: int = RADIUS):
    """(leaf, index, home): the leaves that each fingerprint belongs to or has to visit.

    A fingerprint is at home in one leaf. By the triangle inequality two fingerprints within
    ``radius`` differ by as much at most in their distance to a vantage point, so inside points near
    a node's limit also visit its outer side, and visitors go wherever a partner may be. Each pair
    thus meets in exactly one leaf, at the home of one of the two.
    """
    found, todo = [], [(0, np.arange(len(values)), np.ones(len(values), bool))]
    while todo:
        node, index, home = todo.pop()
        if len(index) == 0:
            continue
        if node >= len(nodes):
            found.append((np.full(len(index), node - len(nodes)), index, home))
            continue
        v, limit = nodes[node]
        d = distances(v, values[index]).astype(int)
        inside = d <= limit
        # An outer home never visits the inner side: the inner partner visits it.
        inner = np.where(home, inside, d - radius <= limit)
        outer = np.where(home, ~inside, d + radius > limit)
        guest = home & inside & (d + radius > limit)
        todo.append((2 * node + 1, index[inner], home[inner]))
        todo.append((2 * node + 2, np.concatenate([index[outer], index[guest]]),
                     np.concatenate([home[outer], np.zeros(guest.sum(), bool)])))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index in the component of each of ``n`` local points, by edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Links:
    """Links between local points, reduced to one star per component whenever they get many."""

    def __init__(self, n: int, most: int = 2_000_000):
        self.n, self.most, self.a, self.b, self.held = n, most, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.held += len(a)
            if self.held > self.most:
                self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.zeros(0, int), np.zeros(0, int)
        label = _smallest(np.concatenate(self.a), np.concatenate(self.b), self.n)
        points = np.flatnonzero(label != np.arange(self.n))
        self.a, self.b, self.held = [points], [label[points]], len(points)
        return points, label[points]


def _plain(values, left, right, same: bool, radius: int, links: _Links) -> None:
    """Compare the points ``left`` with ``right``; ``same``: with each other, each pair once."""
    step = max(1, 1_000_000 // max(1, len(right)))
    for start in range(0, len(left), step):
        part = left[start:start + step]
        other = right[start:] if same else right
        i, j = np.nonzero(np.bitwise_count(values[part][:, None] ^ values[other][None, :]) <= radius)
        if same:
            i, j = i[j > i], j[j > i]
        links.add(part[i], other[j])


def local_links(values: np.ndarray, homes: np.ndarray, guests: np.ndarray, radius: int, links: _Links) -> None:
    """All links of ``homes`` among themselves and with ``guests``, by a vantage-point tree in memory."""
    todo = [(homes, guests)]
    while todo:
        homes, guests = todo.pop()
        if len(homes) == 0:
            continue
        if len(homes) > _PLAIN:
            v = int(values[homes[len(homes) // 2]])
            d, g = distances(v, values[homes]).astype(int), distances(v, values[guests]).astype(int)
            limit = int(np.median(d))
            inside = d <= limit
            near = homes[inside & (d + radius > limit)]
            inner = (homes[inside], guests[g - radius <= limit])
            outer = (homes[~inside], np.concatenate([guests[g + radius > limit], near]))
            before = len(homes) * (len(homes) / 2 + len(guests))
            after = sum(len(h) * (len(h) / 2 + len(x)) for h, x in (inner, outer))
            if after < 0.9 * before:  # a tight group: the bounds prune nothing there
                todo += [inner, outer]
                continue
        _plain(values, homes, homes, True, radius, links)
        if len(guests):
            _plain(values, homes, guests, False, radius, links)


def near_pairs(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(a long, b long): edges that join exactly the fingerprints within ``radius`` bits, as stars.

    ``distinct`` (fp long) holds each fingerprint once. The shared tree is fitted on the at most
    ``MOST_LEAVES * PER_LEAF`` fingerprints of smallest hash; every fingerprint is routed. A leaf of
    more than ``BLOCK`` homes or guests is dealt out in blocks, of which each pair is a task's work,
    so no task holds more than four blocks. Each task reduces what it links to one star per local
    component: links inside a group are never emitted as pairs, and the components stay the same.
    """
    spark = distinct.sparkSession
    count = distinct.count()
    depth = 0
    while 2 ** depth * shard_size < count and 2 ** depth < MOST_LEAVES:
        depth += 1
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(PER_LEAF * 2 ** depth).collect() if depth else []
    nodes = fit_tree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), depth) if depth else []
    tree = spark.sparkContext.broadcast(nodes)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            leaf, index, home = route(values, tree.value, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int32()), pa.array(values[index].view(np.int64)), pa.array(home)],
                names=["leaf", "fp", "home"])

    sent = distinct.select("fp").mapInArrow(routed, "leaf int, fp long, home boolean")
    # At most two rows for each leaf, so small whatever the input.
    sizes = {(r["leaf"], r["home"]): -(-r["n"] // BLOCK)
             for r in sent.groupBy("leaf", "home").agg(F.count("*").alias("n")).collect()}
    leaves = [(leaf, n, sizes.get((leaf, False), 0)) for (leaf, home), n in sizes.items() if home]
    plan = spark.createDataFrame(leaves, "leaf int, homes int, guests int")
    deal = F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    # Columns of a leaf's grid: home blocks, then guest blocks; rows: home blocks. Home pairs meet once, i <= j.
    meets = F.when(F.col("home"), F.concat(
        F.transform(F.sequence(F.lit(0), F.col("homes") + F.col("guests") - 1),
                    lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j"),
                                       F.lit(0).alias("side"))))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("homes") - 1),
                    lambda i: F.struct(i.alias("i"), (F.col("homes") + F.col("block")).alias("j"), F.lit(1).alias("side"))))
    dealt = sent.join(F.broadcast(plan), "leaf").withColumn("block", deal)
    dealt = dealt.select("leaf", "fp", "home", "block", F.explode(meets).alias("m"))
    dealt = dealt.select("leaf", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "fp", "home", "block")

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        values = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        block = table.column("block").to_numpy()
        order = np.argsort(values, kind="stable")  # the same work however rows arrive
        values, home, block = values[order], home[order], block[order]
        links = _Links(len(values))
        if i == j:
            local_links(values, np.flatnonzero(home), np.zeros(0, int), radius, links)
        else:
            rows = np.flatnonzero(home & (block == i))
            others = np.flatnonzero(~(home & (block == i)))
            local_links_between(values, rows, others, radius, links)
        a, b = links.reduce()
        return pa.table({"a": pa.array(values[a].view(np.int64)), "b": pa.array(values[b].view(np.int64))})

    return dealt.groupBy("leaf", "i", "j").applyInArrow(joined, "a long, b long")


def local_links_between(values, left, right, radius: int, links: _Links) -> None:
    """All links between ``left`` and ``right``, by a vantage-point tree in memory."""
    todo = [(left, right)]
    while todo:
        left, right = todo.pop()
        if len(left) == 0 or len(right) == 0:
            continue
        if len(left) > _PLAIN:
            v = int(values[left[len(left) // 2]])
            d, g = distances(v, values[left]).astype(int), distances(v, values[right]).astype(int)
            limit = int(np.median(d))
            parts = [(left[d <= limit], right[g - radius <= limit]), (left[d > limit], right[g + radius > limit])]
            if sum(len(a) * len(b) for a, b in parts) < 0.9 * len(left) * len(right):
                todo += parts
                continue
        _plain(values, left, right, False, radius, links)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp, component_id, first_key): the class of every document.

    Documents link where their fingerprints differ in ``radius`` bits or fewer; a class is what
    links reach. ``component_id`` is its smallest id, null where no member has one; ``first_key``
    is the smallest key among the rows of that id, so that exactly one row can be kept. Copies share
    a fingerprint and are reduced to it before anything is compared. Repeated rows, null ids, null
    and empty texts (fingerprint 0) are rows like any other; an empty table gives no rows.
    """
    marks = written(fingerprints(docs, id_col, text_col), "marks")
    distinct = written(marks.groupBy("fp").agg(smallest().alias("first")), "fps")
    return classes(marks, distinct, written(near_pairs(distinct, radius), "links"))


def smallest() -> Column:
    """The row of smallest id, then key, as a struct; rows without id come last."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key"))


def classes(marks: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(id, key, fp, component_id, first_key) from rows (id, key, fp), (fp, first) and the edges (a, b) between fp."""
    roots = components(links)
    linked = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "first")
    best = linked.groupBy("root").agg(F.min("first").alias("best"))
    linked = linked.join(best, "root").select("fp", "best")
    # Written, so that the last join has two plain inputs and a fingerprint with very many copies can be split.
    known = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("best", "first").alias("best")), "classes")
    return marks.join(known, "fp").select("id", "key", "fp", F.col("best.id").alias("component_id"),
                                          F.col("best.key").alias("first_key"))


def keep_first(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, that of the smallest id; all its columns."""
    return kept_rows(docs, near_duplicates(docs, radius, id_col, text_col), id_col, text_col)


def kept_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first row of each class of ``found``, as :func:`near_duplicates` gives them."""
    own, key = "_asklens_id", "_asklens_key"
    kept = found.where("id <=> component_id AND key = first_key").select(F.col("id").alias(own), F.col("key").alias(key))
    hashed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    once = hashed.join(kept, (hashed[key] == kept[key]) & hashed[id_col].eqNullSafe(kept[own]), "left_semi")
    # Rows that repeat a kept row in id and text are dropped; a key of 64 bits decides only between rows of one id.
    return once.dropDuplicates([key, id_col]).drop(key)

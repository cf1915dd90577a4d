"""Codes of vectors from one codebook per part, trained by Lloyd rounds over trees of both parts and entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from asklens.llm.shipping import Shipped
from asklens.session import written

SCALE = 4096       # a component x becomes the integer floor(SCALE * x)
PARTS = 8          # equal consecutive parts of a vector, each with a codebook of its own
ENTRIES = 16       # of a codebook
ROUNDS = 6
BLOCK = 8192       # vectors of a block, over which trees are built
LEAF = 16          # parts of a tree's leaf, at most
MOST = 1 << 26     # largest component that distances in 64 bits allow
BLOCKS = "n int, ids array<{0}>, labels array<{1}>, points binary, place binary"


@dataclass(frozen=True)
class Shape:
    parts: int
    width: int  # components of a part

    @property
    def size(self) -> int:
        return self.parts * self.width


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(x.isNotNull() & finite)


def integers(vector_col: str, scale: int = SCALE):
    """The components of a vector column as integers."""
    return F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * scale))


def levels_of(n: int, leaf: int = LEAF) -> int:
    """Levels below the root of the tree over ``n`` parts; every node of a level covers nearly as many."""
    return max(0, int(np.ceil(np.log2(n / leaf)))) if n > leaf else 0


def starts_of(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin in tree order."""
    return (np.arange(1 << level, dtype=np.int64) * n) >> level


def tree_order(points: np.ndarray) -> np.ndarray:
    """The order of ``points`` (parts, n, width) in the tree of each part: nodes are halved along their widest side."""
    parts, n, width = points.shape
    order = np.tile(np.arange(n), (parts, 1))
    for level in range(levels_of(n)):
        starts = starts_of(n, level)
        sorted_points = np.take_along_axis(points, order[:, :, None], axis=1)
        spread = np.maximum.reduceat(sorted_points, starts, axis=1) - np.minimum.reduceat(sorted_points, starts, axis=1)
        counts = np.diff([*starts, n])
        side = np.repeat(spread.argmax(axis=2), counts, axis=1)
        values = np.take_along_axis(sorted_points, side[:, :, None], axis=2)[:, :, 0]
        node = np.repeat(np.arange(len(starts)), counts)
        for p in range(parts):
            order[p] = order[p][np.lexsort((values[p], node))]
    return order


@dataclass
class Tree:
    """Nodes of one level: boxes, sums and counts by part and node."""

    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    counts: np.ndarray


def tree_levels(points: np.ndarray) -> list[Tree]:
    """Levels from the root down over ``points`` (parts, n, width), which are in tree order."""
    n, deepest = points.shape[1], levels_of(points.shape[1])
    starts = starts_of(n, deepest)
    made = [Tree(np.minimum.reduceat(points, starts, axis=1), np.maximum.reduceat(points, starts, axis=1),
                 np.add.reduceat(points, starts, axis=1), np.diff([*starts, n]))]
    for _ in range(deepest):
        t = made[-1]
        made.append(Tree(np.minimum(t.low[:, ::2], t.low[:, 1::2]), np.maximum(t.high[:, ::2], t.high[:, 1::2]),
                         t.sums[:, ::2] + t.sums[:, 1::2], t.counts[::2] + t.counts[1::2]))
    return made[::-1]


@dataclass
class Entries:
    """A tree over the entries of every codebook: members in tree order, and boxes by level."""

    order: np.ndarray  # (parts, k)
    levels: list[tuple[np.ndarray, np.ndarray]]  # low and high by part and node
    books: np.ndarray

    @classmethod
    def over(cls, books: np.ndarray) -> Entries:
        parts, k, _ = books.shape
        order, deepest = np.tile(np.arange(k), (parts, 1)), int(np.ceil(np.log2(k))) if k > 1 else 0
        for level in range(deepest):
            starts = starts_of(k, level)
            for p in range(parts):
                for a, b in zip(starts, [*starts[1:], k], strict=True):
                    own = order[p, a:b]
                    if len(own) > 1:
                        side = np.ptp(books[p, own], axis=0).argmax()
                        order[p, a:b] = own[np.argsort(books[p, own, side], kind="stable")]
        inside = np.take_along_axis(books, order[:, :, None], axis=1)
        levels = []
        for level in range(deepest + 1):
            starts = starts_of(k, level)
            # A node without a member (k is no power of two) gets its neighbour's box and is left out when it is met.
            levels.append((np.minimum.reduceat(inside, starts, axis=1), np.maximum.reduceat(inside, starts, axis=1)))
        return cls(order, levels, books)

    def of(self, part: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The entry of nodes of the finest level."""
        return self.order[part, starts_of(self.order.shape[1], len(self.levels) - 1)[node]]

    def members(self, level: int) -> np.ndarray:
        k = self.order.shape[1]
        return np.diff([*starts_of(k, level), k])


def assign(points: np.ndarray, tree: list[Tree], entries: Entries, codes: bool = False):
    """(counts, sums) by part and entry; with ``codes`` also the entry of each point, in tree order.

    Both trees are walked together, level by level: for a node of points, an entry node goes if even its nearest corner is
    farther than the farthest corner of another one. A node left with one entry is assigned whole by its cached count and sum.
    What is left in the leaves is compared point by point in integers; the lower index wins a tie.
    """
    parts, n, width = points.shape
    k, deepest, finest = entries.books.shape[1], len(tree) - 1, len(entries.levels) - 1
    counts, sums = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
    found = np.zeros((parts, n), np.uint8 if k <= 256 else np.int64) if codes else None
    part = np.arange(parts)
    node, entry, level, fine = np.zeros(parts, np.int64), np.zeros(parts, np.int64), 0, 0
    while True:
        low, high = entries.levels[fine]
        a, b = tree[level].low[part, node], tree[level].high[part, node]
        c, d = low[part, entry], high[part, entry]
        gap = np.maximum(np.maximum(c - b, a - d), 0)
        near = np.einsum("ij,ij->i", gap, gap)
        reach = np.maximum(d - a, b - c)
        far = np.einsum("ij,ij->i", reach, reach)
        # Pairs of one node of points are neighbours in the arrays.
        heads = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (node[1:] != node[:-1])]) if len(part) else np.zeros(0, np.int64)
        sizes = np.diff([*heads, len(part)])
        keep = near <= np.repeat(np.minimum.reduceat(far, heads), sizes) if len(part) else np.zeros(0, bool)
        part, node, entry = part[keep], node[keep], entry[keep]
        if fine == finest and len(part):
            group = np.repeat(np.arange(len(heads)), sizes)[keep]
            alone = np.bincount(group, minlength=len(heads))[group] == 1
            if alone.any():
                p, x, e = part[alone], node[alone], entries.of(part[alone], entry[alone])
                np.add.at(counts, p * k + e, tree[level].counts[x])
                np.add.at(sums, p * k + e, tree[level].sums[p, x])
                if codes:
                    starts = np.r_[starts_of(n, level), n]
                    for q, s, t, v in zip(p.tolist(), starts[x].tolist(), starts[x + 1].tolist(), e.tolist(), strict=True):
                        found[q, s:t] = v
                part, node, entry = part[~alone], node[~alone], entry[~alone]
        if not len(part) or (level == deepest and fine == finest):
            break
        # One level down in both trees, entries first in the order of pairs so that a node's pairs stay together.
        if fine < finest:
            some = entries.members(fine + 1)
            part, node = np.repeat(part, 2), np.repeat(node, 2)
            entry = np.repeat(entry * 2, 2) + np.tile([0, 1], len(entry))
            there = some[entry] > 0
            part, node, entry = part[there], node[there], entry[there]
            fine += 1
        if level < deepest:
            heads = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (node[1:] != node[:-1])])
            sizes = np.diff([*heads, len(part)])
            # Each group of pairs follows itself once more, first for the left child and then for the right one.
            within = np.arange(2 * len(part)) - np.repeat(2 * heads, 2 * sizes)
            right = within >= np.repeat(sizes, 2 * sizes)
            of = np.repeat(heads, 2 * sizes) + within - np.where(right, np.repeat(sizes, 2 * sizes), 0)
            part, entry, node = part[of], entry[of], node[of] * 2 + right
            level += 1
    if len(part):
        _leaves(points, entries, part, node, entries.of(part, entry), starts_of(n, deepest), counts, sums, found)
    return counts.reshape(parts, k), sums.reshape(parts, k, width), found


def _leaves(points, entries, part, node, entry, starts, counts, sums, found) -> None:
    """Uncertain leaves: squared distances of their points to the entries left, in integers."""
    n, k = points.shape[1], entries.books.shape[1]
    ends = np.r_[starts[1:], n]
    size = ends[node] - starts[node]
    for length in np.unique(size):  # two lengths at most
        own = size == length
        p, x, e = part[own], node[own], entry[own]
        at = starts[x][:, None] + np.arange(length)
        apart = points[p[:, None], at] - entries.books[p, e][:, None, :]
        key = np.einsum("ijk,ijk->ij", apart, apart) * k + e[:, None]
        heads = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (x[1:] != x[:-1])])
        best = np.minimum.reduceat(key, heads, axis=0) % k
        q, at = p[heads], at[heads]
        slot = (q[:, None] * k + best).ravel()
        counts += np.bincount(slot, minlength=len(counts))
        np.add.at(sums, slot, points[q[:, None], at].reshape(-1, points.shape[2]))
        if found is not None:
            found[q[:, None], at] = best


def build_blocks(vectors: DataFrame, shape: Shape, id_col: str, label_col: str, vector_col: str, scale: int = SCALE,
                 block: int = BLOCK) -> DataFrame:
    """(n, ids, labels, points, place): blocks of vectors as integers with the tree order of each part, written and read back.

    ``points`` are (parts, n, width) in tree order; ``place`` is where each of them stands in the block. A task cuts what
    it reads into blocks, without a shuffle.
    """
    slim = usable(vectors, vector_col).where(F.size(vector_col) == shape.size).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), integers(vector_col, scale).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for start in range(0, len(batch), block):
                piece = batch.slice(start, block - rows)
                held.append(piece)
                rows += len(piece)
                if rows == block:
                    yield made(held)
                    held, rows = [], 0
                    rest = batch.slice(start + len(piece), block - len(piece))
                    if len(piece) < block and len(rest):
                        held, rows = [rest], len(rest)
        if rows:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        ids, labels = (pa.concat_arrays(whole.column(k).chunks) for k in (0, 1))
        flat = np.concatenate([c.flatten().to_numpy() for c in whole.column(2).chunks])
        n = len(ids)
        if n and max(flat.max(), -flat.min()) > MOST:
            raise ValueError(f"a component beyond {MOST} / {scale}")
        points = flat.reshape(n, shape.parts, shape.width).transpose(1, 0, 2)
        order = tree_order(points)
        points = np.take_along_axis(points, order[:, :, None], axis=1)
        one = np.array([0, n], np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array(one), ids), pa.ListArray.from_arrays(pa.array(one), labels),
             pa.array([points.astype("<i4").tobytes()], pa.binary()), pa.array([order.astype("<i4").tobytes()], pa.binary())],
            names=["n", "ids", "labels", "points", "place"])

    return written(slim.mapInArrow(cut, BLOCKS.format(kinds["id"], kinds["label"])), "vector-blocks")


def _points(row: dict, shape: Shape) -> np.ndarray:
    return np.frombuffer(row["points"], "<i4").reshape(shape.parts, row["n"], shape.width).astype(np.int64)


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry becomes the floored mean of its parts; an unused one stays.

    Tasks hand on one row per part and entry, so the driver sees parts * entries rows whatever the input.
    """
    parts, k, width = books.shape
    shape, sent = Shape(parts, width), Shipped(blocks.sparkSession, Entries.over(books))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for b in range(len(batch)):
                points = _points(batch.slice(b, 1).to_pylist()[0], shape)
                c, s, _ = assign(points, tree_levels(points), sent.value)
                counts, sums = counts + c, sums + s
        slot, n = np.nonzero(counts.ravel())[0], counts.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(slot, width)), pa.array(np.tile(np.arange(width), len(slot))), pa.array(np.repeat(n[slot], width)),
             pa.array(sums.reshape(-1, width)[slot].ravel())], names=["slot", "at", "n", "total"])

    found = blocks.select("n", "points").mapInArrow(added, "slot long, at long, n long, total long")
    out = books.copy().reshape(parts * k, width)
    for r in found.groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["slot"], r["at"]] = r["total"] // r["n"]
    return out.reshape(parts, k, width)


def first_books(vectors: DataFrame, shape: Shape, id_col: str, vector_col: str, entries: int = ENTRIES,
                scale: int = SCALE) -> np.ndarray:
    """The parts of the vectors of the smallest ids (of a repeated id the smallest vector), in the order of ids."""
    kept = usable(vectors, vector_col).where((F.size(vector_col) == shape.size) & F.col(id_col).isNotNull())
    ids = [r[0] for r in kept.select(id_col).distinct().orderBy(id_col).limit(entries).collect()]
    rows = kept.where(F.col(id_col).isin(ids)).groupBy(F.col(id_col).alias("id")).agg(
        F.min(integers(vector_col, scale)).alias("v")).orderBy("id").collect()
    if not rows:
        return np.zeros((shape.parts, 0, shape.width), np.int64)
    whole = np.array([r["v"] for r in rows], np.int64)
    return whole.reshape(len(rows), shape.parts, shape.width).transpose(1, 0, 2).copy()


def shape_of(vectors: DataFrame, vector_col: str, parts: int = PARTS) -> Shape:
    """The commonest length of the usable vectors (the longest of equally common ones) in equal parts; others are left out."""
    sizes = usable(vectors, vector_col).where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("size")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components have no {parts} equal parts")
    return Shape(parts, size // parts)


@dataclass(frozen=True)
class Codebooks:
    books: np.ndarray  # (parts, entries, width)

    @property
    def digest(self) -> str:
        """SHA-256 of all components, written in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def train(blocks: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> Codebooks:
    """``rounds`` Lloyd rounds from the given codebooks; each is one job over the written blocks without a big shuffle."""
    books = start
    for _ in range(rounds if start.shape[1] else 0):
        books = lloyd_round(blocks, books)
    return Codebooks(books)


def encode(blocks: DataFrame, made: Codebooks) -> DataFrame:
    """(id, label, code, error): each part's nearest entry in hex, two digits a part, and the squared distances summed."""
    parts, _, width = made.books.shape
    shape, sent = Shape(parts, width), Shipped(blocks.sparkSession, Entries.over(made.books))
    ids, labels = blocks.schema["ids"].dataType.elementType, blocks.schema["labels"].dataType.elementType

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sent.value
        for batch in batches:
            for b in range(len(batch)):
                one = batch.slice(b, 1)
                row = one.select(["n", "points", "place"]).to_pylist()[0]
                points = _points(row, shape)
                place = np.frombuffer(row["place"], "<i4").reshape(parts, row["n"])
                codes = assign(points, tree_levels(points), entries, codes=True)[2]
                error, digits = np.zeros(row["n"], np.int64), np.zeros((row["n"], parts), np.uint8)
                for p in range(parts):
                    apart = points[p] - entries.books[p, codes[p]]
                    error[place[p]] += np.einsum("ij,ij->i", apart, apart)
                    digits[place[p], p] = codes[p]
                text = digits.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [one.column("ids").flatten(), one.column("labels").flatten(),
                     pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)],
                    names=["id", "label", "code", "error"])

    return blocks.mapInArrow(coded, StructType([StructField("id", ids), StructField("label", labels),
                                                StructField("code", StringType()), StructField("error", LongType())]))


def compress(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, Codebooks]:
    """((id, label, code, error), codebooks): vectors as one code per part, with codebooks trained on all of them.

    Rows without a vector, or with a null, infinite or missing number in it, are left out, and so are vectors whose
    length is not the commonest one. Rows of a null id or label and repeated rows are coded like any other; only the
    codebooks' start takes each id once. Fewer ids than entries make smaller codebooks, an empty table gives no rows.
    Other columns are not looked at. Components beyond ``MOST`` / ``scale`` are refused, as 64 bits could not hold distances.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries at most")
    shape = shape_of(vectors, vector_col, parts)
    start = first_books(vectors, shape, id_col, vector_col, entries, scale)
    blocks = build_blocks(vectors, shape, id_col, label_col, vector_col, scale, block)
    if not start.shape[1]:  # no vector has an id
        blocks = blocks.limit(0)
    made = train(blocks, start, rounds)
    if not start.shape[1]:
        made = Codebooks(np.zeros((parts, 1, shape.width), np.int64))
    return encode(blocks, made), made

"""The trie of conversation prefixes: ROLLUP over the turns of a block of columns, all blocks together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asklens.session import written

WIDTH = 8         # turns in the columns of a block; a longer conversation continues in further blocks
GROUP = 5         # conversations that share the start of the first of them
MOST_SHARED = 9   # less one: turns that are shared at most
SPAN = 1024       # blocks of a conversation that one window runs over
CHUNK = 50_000    # conversation ids in a piece of a list that is hashed


def turn_id(role: Column, text: Column) -> Column:
    """A name of (role, text): 128 bits in hex; the role's length keeps the border between the two."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def marks(depth: Column, turn: Column) -> list[Column]:
    """Two hashes of a turn at a depth; xor over a conversation's first turns gives a prefix its 128-bit name."""
    return [F.xxhash64(F.lit(lane), depth.cast("long"), turn) for lane in (1, 2)]


def ordered_turns(chat: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, part, row, n_bytes, turn_id): every turn in its order, written.

    One range shuffle sorts all turns by conversation, turn (null first), role and text; what is equal in all of these is
    dealt by row, so neither a long conversation nor repeated rows meet in one task. ``part`` is the task, ``row``
    counts up in the sorted order, one by one within a task.
    """
    turns = chat.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"),
                                F.octet_length("text").cast("long").alias("n_bytes"),
                                turn_id(F.col("role"), F.col("text")).alias("turn_id")), "turns")


def _earlier(rows: DataFrame, values: list[str], add, none: Column, down: bool = False) -> DataFrame:
    """``rows`` (conv, block, ...) with ``before_<value>``: ``add`` over the conversation's earlier (``down``: later) blocks.

    A window runs over ``SPAN`` blocks; the totals of whole spans, of conversations that have several, are added by a
    join. So a conversation with a third of all turns is spread over many windows.
    """
    far = F.desc if down else F.asc
    rows = rows.withColumn("span", F.floor(F.col("block") / SPAN).cast("long"))
    inside = Window.partitionBy("conv", "span").orderBy(far("block")).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv", "span").agg(*(add(v).alias(v) for v in values))
    along = Window.partitionBy("conv").orderBy(far("span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    bases = spans.withColumn("several", F.count("*").over(whole) > 1).where("several").select(
        "conv", "span", *(F.coalesce(add(v).over(along), none).alias(f"base_{v}") for v in values))
    out = rows.select("*", *(F.coalesce(add(v).over(inside), none).alias(f"near_{v}") for v in values)).join(
        bases, ["conv", "span"], "left")
    join = (lambda x, y: x.bitwiseXOR(y)) if add is F.bit_xor else (lambda x, y: x + y)
    return out.select(*(c for c in rows.columns if c != "span"), *(
        join(F.col(f"near_{v}"), F.coalesce(F.col(f"base_{v}"), none)).alias(f"before_{v}") for v in values))


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its group, at most."""
    return F.pmod(F.crc32(conv.cast("string")), F.lit(MOST_SHARED)).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs: conv), (rows: conv, depth, turn_id, n_bytes): conversations made anew.

    Conversation c begins with the first h turns of conversation c - c % 5 (all if it has fewer, none if there is none), then
    follow its own turns after its first h; h = crc32(c) % 9.
    """
    base = F.col("conv") - F.col("conv") % GROUP
    chunks = written(turns.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("row").alias("first")), "chunks")
    convs = chunks.groupBy("conv").agg(F.sum("n").alias("n"))
    sizes = convs.select(F.col("conv").alias("base"), F.least("n", F.lit(MOST_SHARED - 1)).alias("there"))
    convs = convs.select("conv", base.alias("base"), shared_turns(F.col("conv")).alias("h")).join(sizes, "base", "left")
    convs = written(convs.select("conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")), "convs")
    # A conversation has one chunk for each task that sorted some of it, so the joins below meet no hot key.
    along = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("base_n", F.coalesce(F.sum("n").over(along), F.lit(0))).join(convs.drop("base"), "conv")
    placed = turns.join(chunks, ["conv", "part"]).select(
        "conv", "h", "taken", (F.col("row") - F.col("first") + F.col("base_n") + 1).alias("nth"), "turn_id", "n_bytes")
    own = placed.where("nth > h").select("conv", (F.col("nth") - F.col("h") + F.col("taken")).alias("depth"), "turn_id", "n_bytes")
    heads = placed.where((F.col("conv") % GROUP == 0) & (F.col("nth") < MOST_SHARED)).select(
        F.col("conv").alias("base"), F.col("nth").alias("depth"), "turn_id", "n_bytes")
    taken = convs.where("taken > 0").join(heads, "base").where("depth <= h")
    return convs.select("conv"), own.unionByName(taken.select("conv", "depth", "turn_id", "n_bytes"))


def blocks_of(convs: DataFrame, rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(conv, block, before_x, before_y, t1 .. , b1 .. , x, y, size): ``width`` turns side by side, written.

    ``before_*`` name the node that the conversation has reached before the block, by the xor of its marks; ``x`` and ``y``
    are the xor of the block's own marks, ``size`` counts its turns. A conversation without turns has one block of nulls.
    """
    x, y = marks(F.col("depth"), F.col("turn_id"))
    slots = rows.select("conv", F.floor((F.col("depth") - 1) / width).alias("block"),
                        ((F.col("depth") - 1) % width).alias("slot"), "turn_id", "n_bytes", x.alias("x"), y.alias("y"))
    root = convs.select("conv", F.lit(0).cast("long").alias("block"))
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("slot", "long"), ("turn_id", "string"), ("n_bytes", "long"), ("x", "long"), ("y", "long"))]
    every = slots.unionByName(root.select("*", *empty)).groupBy("conv", "block").agg(
        *(F.max(F.when(F.col("slot") == k, F.col("turn_id"))).alias(f"t{k + 1}") for k in range(width)),
        *(F.max(F.when(F.col("slot") == k, F.col("n_bytes"))).alias(f"b{k + 1}") for k in range(width)),
        *(F.coalesce(F.bit_xor(c), F.lit(0)).alias(c) for c in ("x", "y")), F.count("slot").alias("size"))
    every = _earlier(every, ["x", "y"], F.bit_xor, F.lit(0).cast("long"))
    return written(every, "trie-blocks")


def _named(width: int, less: int = 0) -> list[Column]:
    """The name of a row's node (``less`` = 1: of its parent), from the turns in its columns up to its level."""
    name = [F.col("before_x"), F.col("before_y")]
    for k in range(1, width + 1):
        pair = marks(F.col("block") * width + F.lit(k), F.col(f"t{k}"))
        name = [n.bitwiseXOR(F.when(F.col("level") - less >= k, m).otherwise(F.lit(0).cast("long"))) for n, m in zip(name, pair, strict=True)]
    return name


def _rolled(blocks: DataFrame, width: int, found: str) -> DataFrame:
    """ROLLUP over the turn columns of every block; ``level`` is how many of them a row has, padding is left out.

    A block's row of no turns is the node before it, which the block before has as its last level; only the root stays.
    """
    turns = [f"t{k + 1}" for k in range(width)]
    level = " ".join(f"WHEN {(1 << (width - k)) - 1} THEN {k}" for k in range(width, -1, -1))
    filled = " AND ".join(f"({k} > level OR t{k} IS NOT NULL)" for k in range(1, width + 1))
    return blocks.sparkSession.sql(f"""
        SELECT * FROM (
          SELECT block, before_x, before_y, {", ".join(turns)}, {found},
                 CASE grouping_id() {level} END AS level
          FROM {{blocks}} GROUP BY block, before_x, before_y, ROLLUP({", ".join(turns)}))
        WHERE {filled} AND (level > 0 OR block = 0)""", blocks=blocks)


def end_digests(ends: DataFrame) -> DataFrame:
    """(x, y, depth, ends_sha256): SHA-256 of the ids ``conv`` of each node in order, comma-joined.

    Ids are sorted by a range shuffle and joined into pieces; a node's pieces then go through one running hash. A node where
    a third of all conversations end is sorted by many tasks, and what is hashed in turn is bytes, a piece at a time.
    """
    import pyarrow as pa

    order = ["x", "y", "depth", "conv"]
    dealt = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(dealt.select(*order, F.monotonically_increasing_id().alias("row")), "ends")
    keys = ["x", "y", "depth"]
    piece = F.floor(F.col("row") / CHUNK)  # rows of a task are numbered one by one, tasks are far apart
    pieces = numbered.groupBy(*keys, piece.alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches):
        import hashlib

        now, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield rows_of(out)
        if now is not None:
            yield rows_of([(*now, digest.hexdigest())])

    def rows_of(out):
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*keys, "ends_sha256"])

    dealt = pieces.repartition(*keys).sortWithinPartitions(*keys, "piece").select(*keys, "ids")
    return dealt.mapInArrow(hashed, "x long, y long, depth long, ends_sha256 string")


def prefix_trie(chat: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                width: int = WIDTH) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see ``rebuilt``), one row each.

    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (nodes
    without children below or at it), saved_tokens (summed below and at it: bytes of the node's last text for each member but
    the first), ends_sha256 (the ids of members that end there).

    Turns are ordered by turn (null first), equal ones by role and text; a null role or text counts as empty. Rows without a
    conversation are left out, repeated rows are turns of their own, an empty table gives no rows, other columns
    are not looked at. A conversation is cut into blocks of ``width`` turns, and one ROLLUP over the turn columns
    of all blocks, each under the name of the node before it, counts every prefix of every depth. What a node has below it is a sum over
    its members too: each node belongs to its smallest member, which carries the sums of its nodes from each depth
    on, so a second ROLLUP finds all subtrees. The number of jobs does not depend on how long conversations are.
    """
    turns = ordered_turns(chat, conv_col, turn_col, role_col, text_col)
    convs, rows = rebuilt(turns)
    blocks = blocks_of(convs, rows, width)

    levels = range(width + 1)
    rolled = _rolled(blocks, width, ", ".join(
        ["count(*) AS n_convs", "min(conv) AS conv", *(f"max(b{k}) AS b{k}" for k in range(1, width + 1))]))
    pick = lambda values: reduce(lambda rest, k: F.when(F.col("level") == k, values[k]).otherwise(rest), levels[1:], values[0])
    zero, (x, y), (up_x, up_y) = F.lit(0).cast("long"), _named(width), _named(width, 1)
    nodes = written(rolled.select(
        x.alias("x"), y.alias("y"), up_x.alias("up_x"), up_y.alias("up_y"), (F.col("block") * width + F.col("level")).alias("depth"),
        "n_convs", "conv", ((F.col("n_convs") - 1) * pick([zero, *(F.col(f"b{k}") for k in levels[1:])])).alias("saved")), "nodes")
    key = ["x", "y", "depth"]
    children = nodes.where("depth > 0").groupBy(
        F.col("up_x").alias("x"), F.col("up_y").alias("y"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # Each node's values go to its smallest member: sums over that conversation's own nodes from each depth on.
    at = F.when(F.col("depth") == 0, 0).otherwise(F.floor((F.col("depth") - 1) / width))
    slot = F.when(F.col("depth") == 0, 0).otherwise((F.col("depth") - 1) % width + 1)
    valued = nodes.where("saved > 0 OR n_children = 0").select(
        "conv", at.cast("long").alias("block"), slot.alias("slot"), "saved", (F.col("n_children") == 0).cast("long").alias("leaves"))
    held = valued.groupBy("conv", "block").agg(
        *(F.coalesce(F.sum(F.when(F.col("slot") >= k, F.col(v))), F.lit(0)).alias(f"{v}{k}") for v in ("saved", "leaves") for k in levels))
    kept = blocks.select("conv", "block", "before_x", "before_y", *(f"t{k}" for k in levels[1:])).join(held, ["conv", "block"], "left")
    kept = kept.select(*blocks.select("conv", "block", "before_x", "before_y", *(f"t{k}" for k in levels[1:])).columns, *(
        F.coalesce(F.col(f"{v}{k}"), F.lit(0)).alias(f"{v}{k}") for v in ("saved", "leaves") for k in levels))
    kept = _earlier(kept, ["saved0", "leaves0"], F.sum, F.lit(0).cast("long"), down=True)
    sums = _rolled(kept, width, ", ".join(
        f"sum({v}{k} + before_{v}0) AS {v}{k}" for v in ("saved", "leaves") for k in levels))
    sums = sums.select(x.alias("x"), y.alias("y"), (F.col("block") * width + F.col("level")).alias("depth"),
                       *(pick([F.col(f"{v}{k}") for k in levels]).alias(o) for v, o in (("saved", "saved_tokens"), ("leaves", "n_leaves"))))

    whole = blocks.groupBy("conv").agg(F.max(F.struct("block", "size", "x", "y", "before_x", "before_y")).alias("e"))
    ends = end_digests(whole.select(F.col("e.x").bitwiseXOR(F.col("e.before_x")).alias("x"), F.col("e.y").bitwiseXOR(F.col("e.before_y")).alias("y"),
                                    (F.col("e.block") * width + F.col("e.size")).alias("depth"), "conv"))
    parents = nodes.where("n_children > 0").select(
        F.col("x").alias("up_x"), F.col("y").alias("up_y"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv_id"))
    return nodes.join(parents, ["up_x", "up_y", "depth"], "left").join(sums, key).join(ends, key, "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))

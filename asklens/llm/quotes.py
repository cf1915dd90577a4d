"""Quotation linking: which message a quote comes from, and conversations in reply order without quotes.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asklens.session import written

# Marks at the start of a line, each with optional blanks before it.
MARKS = "^((?:[ \\t]*>)+)"
BREAK = "\\r?\\n"


def normalised(line: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), "\\s+", " "))


def lines_of(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` with a row per line of their texts: depth and line replace the text.

    The depth is the number of ``>`` at the start of a line, blanks between them or not; the marks and one
    blank after them are cut off. Depth 0 is the message's own text. A null text has no lines.
    """
    # An inner explode would cut each text twice, once for the filter that it implies.
    rows = messages.select(*(c for c in messages.columns if c != text_col),
                           F.explode_outer(F.split(F.col(text_col), BREAK, -1)).alias("line")).where("line IS NOT NULL")
    return rows.withColumn("depth", _depth(F.col("line"))).withColumn(
        "line", F.when(F.col("depth") > 0, F.regexp_replace("line", MARKS + "[ \\t]?", "")).otherwise(F.col("line")))


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def own_text(text: str) -> Column:
    """What a message says itself: its lines of depth 0, white space at the ends cut off; null for null."""
    own = F.filter(F.split(F.col(text), BREAK, -1), lambda s: ~s.rlike(MARKS))
    return F.regexp_replace(F.array_join(own, "\n"), "^\\s+|\\s+$", "")


def count_quotes(text: str) -> Column:
    """How many quoted passages (consecutive lines of one depth) a text has."""
    depths = F.transform(F.split(F.col(text), BREAK, -1), _depth)
    start = F.struct(F.lit(0).alias("before"), F.lit(0).cast("long").alias("n"))
    count = F.aggregate(depths, start, lambda acc, d: F.struct(
        d.alias("before"), (acc["n"] + F.when((d > 0) & (d != acc["before"]), 1).otherwise(0)).alias("n")))["n"]
    return F.coalesce(count, F.lit(0).cast("long"))


def linked_passages(messages: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv, turn, depth, origin, chars): for each quote level of a message, where its lines come from.

    Quoted and own lines are normalised and hashed; a quoted line comes from the first message of the conversation that
    says it itself, if that is an earlier one; only blank lines link nothing. A level's origin is the message with most of its characters, the later one
    of equals; ``chars`` counts them. A line that many messages repeat is reduced to its first message before
    the join, so the join adds no rows. Messages of the same conversation and turn count as one; rows
    without conversation or turn link nothing; levels without a known line have no row.
    """
    keys = messages.select(F.col(conv_col).alias("conv"), F.col(order_col).alias("turn"), F.col(text_col).alias("text"))
    keys = keys.where("conv IS NOT NULL AND turn IS NOT NULL")
    lines = lines_of(keys).select("conv", "turn", "depth", normalised(F.col("line")).alias("line")).where("line <> ''")
    lines = written(lines.groupBy("conv", "turn", "depth", F.sha2("line", 256).alias("hash")).agg(
        F.max(F.length("line")).alias("chars")), "lines")
    said = lines.where("depth = 0").groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    met = lines.where("depth > 0").join(said, ["conv", "hash"]).where("origin < turn")
    votes = met.groupBy("conv", "turn", "depth", "origin").agg(F.sum("chars").alias("chars"))
    best = votes.groupBy("conv", "turn", "depth").agg(F.max(F.struct("chars", "origin")).alias("best"))
    return best.select("conv", "turn", "depth", F.col("best.origin").alias("origin"), F.col("best.chars").alias("chars"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, root, level): the first message and the distance to it, for every (conv, turn, parent).

    One row per (conv, turn); a null parent is a root. Pointers are doubled: every round a message looks as far
    again as it already does, so rounds grow with the logarithm of the longest chain. Each is a written table.
    """
    # up: the farthest ancestor known so far, level: the distance to it, done: whether it is a root.
    found = written(replies.select("conv", "turn", F.coalesce("parent", "turn").alias("up"),
                                   F.col("parent").isNotNull().cast("long").alias("level"),
                                   F.col("parent").isNull().alias("done")), "threads")
    while not found.where("NOT done").isEmpty():
        ends = found.select("conv", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"),
                            F.col("done").alias("there"))
        # Only messages that have not found their root yet are looked up.
        step = found.where("NOT done").join(ends, ["conv", "up"], "left").select(
            "conv", "turn", F.coalesce("next", "up").alias("up"),
            (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), F.coalesce("there", F.lit(True)).alias("done"))
        found = written(found.where("done").union(step), "threads")
    return found.select("conv", "turn", F.col("up").alias("root"), "level")


def conversations(messages: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``messages`` without quotes and in reply order: their columns and n_quotes, reply_to, thread, level, text_own.

    A message replies to the origin of its lowest linked quote level. ``thread`` is the first message of its chain of
    replies and ``level`` the distance to it. The result is sorted by conversation, thread, level and
    turn, so every message follows what it answers; the sort cuts long conversations over many tasks. Messages that quote
    nothing known are first of their own thread. Null or empty texts, repeated rows and rows without conversation
    or turn (each a thread without number) stay; columns named like the new ones are replaced.
    """
    new = ["n_quotes", "reply_to", "thread", "level", "text_own"]
    base = messages.drop(*new)
    links = linked_passages(base, conv_col, order_col, text_col)
    parent = links.groupBy("conv", "turn").agg(F.min_by("origin", "depth").alias("parent"))
    every = base.select(F.col(conv_col).alias("conv"), F.col(order_col).alias("turn")).where(
        "conv IS NOT NULL AND turn IS NOT NULL").distinct()
    replies = every.join(parent, ["conv", "turn"], "left")
    placed = threads(replies)
    known = written(placed.join(parent, ["conv", "turn"], "left").select(
        F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), F.col("parent").alias("reply_to"),
        F.col("root").alias("thread"), "level"), "replies")
    read = base.withColumn("n_quotes", count_quotes(text_col)).withColumn("text_own", own_text(text_col))
    joined = read.join(known, (read[conv_col] == known["_conv"]) & (read[order_col] == known["_turn"]), "left")
    joined = joined.drop("_conv", "_turn").select(*base.columns, *new)
    return joined.orderBy(conv_col, "thread", "level", order_col)

"""Few-shot context, prompt tables, training pairs and the train/validation split."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asklens.functions.text import json_text, strip

# What stands for an absent part, and the phrases that give a label's reason.
NOTHING = "(none provided)"
TABLE_REASON = "Used in the query to answer the question: "
COLUMN_REASON = "Referenced in the query to answer: "


def fewshot_context(hits: DataFrame, examples: DataFrame, limit: int = 3, with_skeleton: bool = False,
                    questions: DataFrame | None = None) -> DataFrame:
    """(query_id, context): the best examples of each query as one text block.

    ``hits`` is (query_id, id, rank) and ``examples`` (example_id, question, sql[, skeleton]). Only
    hits within ``limit`` are joined and collected, so a block has at most that many parts.
    Queries of ``questions`` without hits get "(none provided)".
    """
    kept = hits.where(F.col("rank") <= limit).select("query_id", F.col("id").alias("example_id"), "rank")
    parts = [F.lit("Question: "), "question", F.lit("\nSQL: "), "sql"]
    if with_skeleton:
        parts += [F.lit("\nSQL Skeleton: "), "skeleton"]
    shown = kept.join(examples, "example_id").select("query_id", F.struct("rank", F.concat(*parts).alias("txt")).alias("p"))
    ordered = F.array_sort(F.collect_list("p"))
    blocks = shown.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["txt"]), "\n\n").alias("context"))
    if questions is None:
        return blocks
    return questions.select("query_id").dropDuplicates().join(blocks, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(NOTHING)))


# Default layouts; any text with {column} fields may be given instead.
DRAFT_TEMPLATE = (
    "Question to answer with a single SQLite statement:\n{question}\n\n"
    "Hints that came with it:\n{evidence}\n\n"
    "Solved questions that read alike:\n{context}\n\n"
    "Tables at hand, as JSON:\n{schema_json}\n\n"
    "Return one JSON object: sql holds the statement, reasoning says in short why.\n"
)
REFINE_TEMPLATE = (
    "A first statement was written for this question:\n{question}\n\n"
    "It reads:\n{round_1_sql}\n\n"
    "Its shape without names and values:\n{skeleton}\n\n"
    "Statements of much the same shape:\n{context}\n\n"
    "Hints that came with the question:\n{evidence}\n\n"
    "Tables at hand, as JSON:\n{schema_json}\n\n"
    "Correct it where needed. Return one JSON object: sql holds the statement, reasoning says in short why.\n"
)
LINKING_TEMPLATE = (
    "Question:\n{question}\n\n"
    "Tables with their columns:\n{schema_text}\n\n"
    "List those that a statement for the question has to name.\n"
)
VARIATION_TEMPLATE = (
    "Say this in two other ways:\n{question}\n\n"
    "It is asked of these tables:\n{schema_text}\n\n"
    "Return one JSON object: q1 and q2 hold the wordings, reasoning1 and reasoning2 how each differs.\n"
)


def filled(template: str, optional: tuple[str, ...] = ("evidence", "context")) -> Column:
    """A template as one expression: literal pieces and the columns named in braces.

    Optional fields that are NULL or empty show as "(none provided)", others as empty text.
    """
    pieces = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            pieces.append(F.lit(piece))
        elif piece in optional:
            pieces.append(F.coalesce(F.nullif(F.col(piece), F.lit("")), F.lit(NOTHING)))
        else:
            pieces.append(F.coalesce(F.col(piece), F.lit("")))
    return F.concat(*pieces)


def prompt_table(questions: DataFrame, schemas: DataFrame, contexts: DataFrame | None = None,
                 template: str = DRAFT_TEMPLATE, key: str = "question_id") -> DataFrame:
    """Add ``prompt`` to every question; schemas join by db_id and contexts by the question's key."""
    out = questions.join(schemas, "db_id", "left")
    if contexts is not None:
        out = out.join(contexts.select(F.col("query_id").alias(key), "context"), key, "left")
    return out.withColumn("prompt", filled(template))


def split_prompt(prompts: DataFrame, template: str, fields: list[str], col: str = "prompt") -> DataFrame:
    """The inverse: cut the named fields back out, each between the literal texts around it."""
    pieces = re.split(r"\{(\w+)\}", template)
    out = prompts
    for i in range(1, len(pieces), 2):
        if pieces[i] in fields:
            before, after = pieces[i - 1], pieces[i + 1]
            # The last line of the text before a field is its heading.
            heading = re.escape(before.rstrip("\n").rsplit("\n", 1)[-1])
            closing = re.escape(after) if after.strip() else r"\s*$"
            gap = re.escape(before[len(before.rstrip("\n")):])
            pattern = rf"(?s){heading}{gap}(.*?){closing}"
            out = out.withColumn(pieces[i], strip(F.regexp_extract(col, pattern, 1)))
    return out


def training_pairs(examples: DataFrame, lineage: DataFrame, texts: DataFrame,
                   template: str = LINKING_TEMPLATE, quoted: int | None = None) -> DataFrame:
    """(example_id, db_id, input, output): instruction and expected linking of each example.

    ``lineage`` is (example_id, kind, item). ``output`` lists tables and columns in name order, each
    with a reason quoting the question, or its first ``quoted`` characters if given. Examples without any
    label or schema give no pair.
    """
    def items(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("item"))))

    labels = lineage.groupBy("example_id").agg(items("table").alias("_t"), items("column").alias("_c"))
    start = F.col("question") if quoted is None else F.substring("question", 1, quoted)

    def listed(col: str, phrase: str) -> Column:
        reason = F.concat(F.lit(phrase), start)
        entry = F.transform(col, lambda x: F.concat(
            F.lit('{"name": '), json_text(x), F.lit(', "reason": '), json_text(reason), F.lit("}")))
        return F.concat(F.lit("["), F.array_join(entry, ", "), F.lit("]"))

    output = F.concat(
        F.lit('{"tables": '), listed("_t", TABLE_REASON),
        F.lit(', "columns": '), listed("_c", COLUMN_REASON), F.lit("}"))
    return examples.join(labels, "example_id").join(texts, "db_id").select(
        "example_id", "db_id", filled(template).alias("input"), output.alias("output"))


_DIGITS = 4        # hex digits by which one pass over the rows lengthens the known part of the cut
_HASH = 64         # hex digits of a row's place in the order
_RANKED = 10_000   # rows that are put in order by one task
_COPIES = 100_000  # equal rows made by one step


def split_pairs(df: DataFrame, ratio: float = 0.1, seed: int = 42, key: str = "example_id") -> DataFrame:
    """Add ``split``: a seeded shuffle cut exactly at int(n * (1 - ratio)).

    The order is that of md5(seed:key), then of the md5 of the whole row. The hash that the cut falls on is found digits
    at a time: a pass counts rows by the next digits (at most 65,536 groups) behind those known so far, and by all digits once
    ``_RANKED`` rows or fewer are left. Then each row is told by comparison with that hash, without a shuffle. Rows that
    are equal throughout, if the cut falls between them, are counted and made anew, however many they are. The
    passes run when the function is called.
    """
    own = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    hashed = df.select(row.alias("row"), F.concat(own, F.md5(F.to_json(row))).alias("h"))
    at, bucket, left = "", None, None
    while len(at) < _HASH:
        some = hashed.where(F.col("h").startswith(at)) if at else hashed
        digits = _HASH if bucket is not None and bucket <= _RANKED else len(at) + _DIGITS
        groups = some.groupBy(F.substring("h", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        end = F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        cut = F.lit(left) if left is not None else F.floor(
            F.sum("n").over(Window.partitionBy()).cast("double") * (1 - ratio)).cast("bigint")
        hit = groups.select("b", "n", end.alias("end"), cut.alias("cut")).where("end > cut").orderBy("b").first()
        if hit is None:  # no row lies behind the cut
            return df.withColumn("split", F.lit("train"))
        at, bucket, left = hit["b"], hit["n"], hit["cut"] - (hit["end"] - hit["n"])
    side = F.when(F.col("h") < at, "train").otherwise("validation").alias("split")
    if left == 0:
        return hashed.select("row.*", side)
    equal = hashed.where(F.col("h") == at).groupBy("h").agg(F.any_value("row").alias("row"))
    sides = F.array(*[F.struct(F.lit(name).alias("split"), F.lit(n).cast("bigint").alias("n"))
                      for name, n in (("train", left), ("validation", bucket - left))])
    steps = equal.select("row", F.explode(sides).alias("s")).select("row", "s.*", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("s.n") - 1, F.lit(_COPIES).cast("bigint"))).alias("step"))
    count = F.least(F.lit(_COPIES), F.col("n") - F.col("step")).cast("int")
    made = steps.repartition("step").select("row", "split", F.explode(F.sequence(F.lit(1), count)).alias("copy"))
    return hashed.where(F.col("h") != at).select("row.*", side).unionByName(made.select("row.*", "split"))

"""Generated texts to tables: answers, JSON objects and sectioned notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asklens.functions.text import clean_sql, let, strip

# Why an answer is not usable.
EMPTY_ANSWER = "Empty SQL after cleanup"
WRONG_START = "SQL must start with SELECT or WITH"


def clean_answers(answers: DataFrame, col: str, limit: int | None = None,
                  keep_blank: bool = False) -> DataFrame:
    """Add ``clean_sql`` and ``reason`` (NULL when the answer is usable), judged on the cleaned text.

    With a ``limit`` longer texts are cut, and ``was_cut`` marks them.
    """
    cleaned = answers.withColumn("clean_sql", clean_sql(F.col(col), limit, keep_blank))
    reason = F.when(F.col("clean_sql") == "", EMPTY_ANSWER).when(
        ~F.col("clean_sql").rlike(r"(?i)^(?:SELECT|WITH)"), WRONG_START)
    if limit is not None:
        cleaned = cleaned.withColumn("was_cut", F.length(clean_sql(F.col(col), None, keep_blank)) > limit)
    return cleaned.withColumn("reason", reason)


def validate_answers(answers: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """Add ``sql``, ``valid`` and ``validation_error`` of each answer; see :func:`clean_answers` for ``limit``."""
    checked = clean_answers(answers, col, limit)
    ok = F.col("reason").isNull()
    return checked.withColumns({
        "sql": F.when(ok, F.col("clean_sql")).otherwise(""), "valid": ok,
        "validation_error": F.col("reason")}).drop("clean_sql", "reason")


def reason_counts(checked: DataFrame, reason: str = "reason") -> DataFrame:
    """How many rows per reason; usable rows are counted as "ok"."""
    return checked.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def choose_answer(first: DataFrame, second: DataFrame, key: str = "question_id", limit: int | None = None) -> DataFrame:
    """Final answer of two rounds (key, sql, reasoning): round 2 if valid, else round 1 if valid,
    else round 1 as it is; the reasoning of round 2 unless blank.

    A question that has only one of the rounds keeps what there is.
    """
    def named(df: DataFrame, i: int) -> DataFrame:
        return validate_answers(df.select(key, F.col("sql").alias(f"raw_{i}"), F.col("reasoning").alias(f"why_{i}")),
                                f"raw_{i}", limit).select(key, f"raw_{i}", f"why_{i}", F.col("sql").alias(f"ok_{i}"))

    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    both = named(first, 1).join(named(second, 2), key, "full")
    chosen = both.select(
        key, F.coalesce(filled("ok_2"), filled("ok_1"), "raw_1", F.lit("")).alias("raw"),
        F.coalesce(filled("why_2"), "why_1", F.lit("")).alias("final_reasoning"))
    final = validate_answers(chosen, "raw", limit)
    return final.select(
        key, F.coalesce(F.nullif("sql", F.lit("")), "raw").alias("final_sql"), "final_reasoning",
        F.col("valid").alias("final_valid"), F.col("validation_error").alias("final_validation_error"))


def _without_fence(c: Column) -> Column:
    text = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^```(?:json)?", "")
    return strip(F.regexp_replace(text, r"```$", ""))


def _balanced_object(text: Column) -> Column:
    """The text from the first ``{`` to the ``}`` that closes it, or NULL.

    The text is cut into whole string literals, single braces and runs of anything else, and a
    running depth over these pieces finds the end. Braces inside string literals do not count;
    a quote that is never closed swallows the rest.
    """
    start = F.instr(text, "{")
    body = F.when(start > 0, F.substring(text, start, F.length(text))).otherwise("")
    pieces = F.regexp_extract_all(body, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|$)|[{}]|[^"{}]+'), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        return F.when(state["done"], state).otherwise(F.struct(
            depth.alias("depth"), ((piece == "}") & (depth == 0)).alias("done"),
            (state["n"] + 1).alias("n")))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit(0).alias("n"))
    return let(pieces, lambda p: let(F.aggregate(p, zero, step), lambda end: F.when(
        end["done"], F.array_join(F.slice(p, F.lit(1), end["n"]), ""))))


def extract_json(responses: DataFrame, col: str, schema: T.StructType, mode: str = "balanced") -> tuple[DataFrame, DataFrame]:
    """JSON objects out of fenced or chatty responses: (typed rows, quarantined rows).

    ``balanced`` takes the first object whose braces close; ``greedy`` takes everything from the
    first ``{`` to the last ``}``. Text that is no JSON object goes to quarantine with ``error``
    and ``raw_response``. Typed rows have the schema's fields next to the other input columns.
    """
    fields = set(schema.names)
    keep = [c for c in responses.columns if c != col and c not in fields]
    if mode == "balanced":
        found = _balanced_object(F.col("_text"))
    elif mode == "greedy":
        found = F.nullif(F.regexp_extract("_text", r"(?s)\{.*\}", 0), F.lit(""))
    else:
        raise ValueError("mode must be 'balanced' or 'greedy'")
    parsed = responses.select(*keep, _without_fence(F.col(col)).alias("_text")).withColumn("_json", found)
    # Parsed as the only item of a list, so that text after the object makes it invalid.
    item = F.try_parse_json(F.concat(F.lit("["), "_json", F.lit("]")))
    parsed = parsed.withColumn("_v", item).withColumn("_ok", (
        F.schema_of_variant(F.variant_get("_v", "$[0]", "variant")).startswith("OBJECT")
        & F.variant_get("_v", "$[1]", "variant").isNull())).drop("_v")
    good = parsed.where("_ok").select(*keep, F.from_json("_json", schema).alias("_o")).select(*keep, "_o.*")
    bad = parsed.where(~F.coalesce("_ok", F.lit(False))).select(
        *keep, F.lit("JSON parsing failed").alias("error"), F.col("_text").alias("raw_response"))
    return good, bad


# The headings of a schema-linking note and the section each one opens.
NOTE_SECTIONS = {
    "tables": "relevant tables",
    "columns": "relevant columns",
    "joins": "join relationships",
    "filters": "filters / constraints",
    "intent": "question intent",
}


def _note_text(c: Column) -> Column:
    """The note without a surrounding code fence."""
    text = strip(F.coalesce(c, F.lit("")))
    inner = F.regexp_replace(text, r"^```[^\r\n]*(?:\r\n|\n|\r|$)", "")
    inner = F.regexp_replace(inner, r"(?:^|\r\n|\n|\r)[ \t]*```[ \t]*$", "")
    return F.when(text.startswith("```"), strip(inner)).otherwise(text)


# A line that is no heading, in a text whose lines have no blank ends.
_BODY = r"(?:[^\n]*+(?<!:)\n)*+"


def _section_items(lines: Column, heading: str) -> Column:
    """Items of one section: the lines after its heading up to the next other heading.

    A heading repeated before any other one restarts the section; later ones are ignored.
    """
    head = re.escape(heading) + r"\s*:\n"
    body = F.regexp_extract(lines, rf"(?i)\n(?:{head}{_BODY})*{head}({_BODY})", 1)
    items = F.transform(F.split(body, "\n"), lambda x: F.when(
        x.startswith("-"), strip(F.substring(x, F.lit(2), F.length(x)))).otherwise(x))
    return F.filter(items, lambda x: x != "")


def _sections(notes: DataFrame, col: str) -> DataFrame:
    # Lines without blank ends and without empty ones, each between two line feeds.
    lines = F.concat(F.lit("\n"), F.regexp_replace("raw_output", r"[^\S\r\n]*+[\r\n]\s*+", "\n"), F.lit("\n"))
    out = notes.withColumn("raw_output", _note_text(F.col(col))).withColumn("_lines", lines)
    return out.withColumns({
        name: _section_items(F.col("_lines"), heading) for name, heading in NOTE_SECTIONS.items()}).drop("_lines")


def notes_struct(notes: DataFrame, col: str, key: str = "note_id") -> DataFrame:
    """(key, tables, columns, joins, filters, intent, raw_output) of each sectioned note.

    Column lines need a colon and are split at the first one; of a table listed twice the last
    line counts; the intent is the first item of its section. Everything is computed inside the
    row, so nothing is shuffled.
    """
    s = _sections(notes, col)
    pairs = F.filter(
        F.transform(F.filter("columns", lambda x: x.contains(":")), lambda x: F.struct(
            strip(F.substring_index(x, ":", 1)).alias("k"),
            F.filter(
                F.transform(F.split(F.substring(x, F.instr(x, ":") + 1, F.length(x)), ","), lambda c: strip(c)),
                lambda c: c != "").alias("v"))),
        lambda p: (p["k"] != "") & (F.size(p["v"]) > 0))
    keys = F.array_distinct(F.transform("_p", lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.element_at(
        F.filter("_p", lambda p: p["k"] == k), F.lit(-1))["v"])
    return s.withColumn("_p", pairs).select(
        key, "tables", F.map_from_arrays(keys, last).alias("columns"), "joins", "filters",
        F.coalesce(F.get("intent", F.lit(0)), F.lit("")).alias("intent"), "raw_output")


def notes_long(notes: DataFrame, col: str, key: str = "note_id") -> DataFrame:
    """(key, section, pos, item): every item of the five sections, in order."""
    s = _sections(notes, col)

    def tagged(name: str) -> Column:
        return F.transform(F.col(name), lambda x, i: F.struct(
            F.lit(name).alias("section"), i.alias("pos"), x.alias("item")))

    stacked = F.flatten(F.array(*[tagged(name) for name in NOTE_SECTIONS]))
    # explode() would add a size filter that repeats the whole expression.
    return s.select(key, F.explode_outer(stacked).alias("x")).where(F.col("x").isNotNull()).select(
        key, "x.section", "x.pos", "x.item")

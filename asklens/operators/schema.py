"""Schema text in its renderings, its inverse, and the schema that belongs to a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asklens.functions.text import stripped_lines

STYLES = ("compact", "typed", "detailed", "listing")


def _column_text(style: str) -> Column:
    name, kind, desc = F.col("col_name"), F.col("col_type"), F.col("col_desc")
    if style == "compact":
        return name
    if style == "typed":
        return F.concat(name, F.lit("("), F.coalesce(kind, F.lit("")), F.lit(")"))
    if style == "detailed":
        return F.concat_ws(" ", name, kind, F.concat(F.lit('"'), desc, F.lit('"')))
    if style == "listing":
        return F.concat_ws(" ", name, F.coalesce(kind, F.lit("")))
    raise ValueError(f"style must be one of {STYLES}")


def schema_text(catalog: DataFrame, style: str = "compact") -> DataFrame:
    """(db_id, schema_text): one line per table, tables and columns in catalog order.

    compact ``T(a, b)``; typed ``T(a(INT), b(TEXT))``; detailed ``T(a INT "note")``;
    listing ``Table: T (a INT, b TEXT)``. Columns are folded per table first, so the
    per-database step handles one short row per table.
    """
    pieces = catalog.select("db_id", "table_idx", "table_name", "col_idx", "col_name", _column_text(style).alias("txt"))
    # A table without columns carries one row with a NULL column and renders as T().
    cols = F.array_sort(F.collect_list(F.when(F.col("col_name").isNotNull(), F.struct("col_idx", "txt"))))
    joined = F.array_join(F.transform(cols, lambda c: c["txt"]), ", ")
    opening = (F.lit("Table: "), F.col("table_name"), F.lit(" (")) if style == "listing" else (
        F.col("table_name"), F.lit("("))
    lines = pieces.groupBy("db_id", "table_idx", "table_name").agg(joined.alias("cols")).select(
        "db_id", F.struct("table_idx", F.concat(*opening, "cols", F.lit(")")).alias("line")).alias("l"))
    ordered = F.array_sort(F.collect_list("l"))
    return lines.groupBy("db_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("schema_text"))


def schema_text_rows(texts: DataFrame, key: str = "db_id", col: str = "schema_text",
                     strict: bool = False) -> DataFrame:
    """Typed schema text back to rows (key, table_idx, table_name, col_idx, col_name, col_type).

    By default columns are split at every comma, so ``DECIMAL(10,2)`` becomes ``DECIMAL(10`` and
    its tail is dropped; ``strict=True`` splits at top-level commas only. Columns without a type
    in parentheses are dropped; a table left without columns keeps one row with NULLs.
    """
    lines = F.filter(
        stripped_lines(F.col(col)),
        lambda x: x.contains("(") & x.endswith(")"))
    tables = texts.select(key, F.posexplode(lines).alias("table_idx", "line")).select(
        key, "table_idx",
        F.trim(F.substring_index("line", "(", 1)).alias("table_name"),
        F.regexp_extract("line", r"^[^(]*\((.*)\)$", 1).alias("raw"))
    comma = r",(?![^(]*\))" if strict else ","
    cols = F.filter(F.transform(F.split("raw", comma), lambda x: F.trim(x)), lambda x: x.contains("("))
    rows = tables.select(key, "table_idx", "table_name", F.posexplode_outer(cols).alias("col_idx", "c"))
    kind = F.regexp_extract("c", r"^[^(]*\((.*)$", 1)
    closing = r"\)$" if strict else r"\)+$"
    return rows.select(
        key, "table_idx", "table_name", "col_idx",
        F.trim(F.substring_index("c", "(", 1)).alias("col_name"),
        F.when(F.col("c").isNotNull(), F.trim(F.regexp_replace(kind, closing, ""))).alias("col_type"))


def schema_json(rows: DataFrame, key: str = "db_id") -> DataFrame:
    """Rows of :func:`schema_text_rows` to ``{"tables": [{"name", "columns": [{"name", "type"}]}]}``."""
    column = F.struct("col_idx", F.struct(F.col("col_name").alias("name"), F.col("col_type").alias("type")).alias("c"))
    cols = F.array_sort(F.collect_list(F.when(F.col("col_name").isNotNull(), column)))
    tables = rows.groupBy(key, "table_idx", "table_name").agg(
        F.transform(cols, lambda x: x["c"]).alias("columns"))
    entry = F.struct("table_idx", F.struct(F.col("table_name").alias("name"), "columns").alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"])
    return tables.groupBy(key).agg(F.to_json(F.struct(ordered.alias("tables"))).alias("schema_json"))


def linking_to_schema(linked: DataFrame, col: str = "schema_linking") -> DataFrame:
    """Add ``schema_json``: linked tables in order with their columns, joins, filters and intent.

    Both spellings of the last three fields are read; a table without listed columns gets none.
    """
    s = F.col(col)
    none = F.array().cast("array<string>")

    def names(t: Column) -> Column:
        return F.transform(F.coalesce(F.try_element_at(s["columns"], t), none), lambda c: F.struct(c.alias("name")))

    body = F.struct(
        F.transform(F.coalesce(s["tables"], none), lambda t: F.struct(
            t.alias("name"), names(t).alias("columns"))).alias("tables"),
        F.coalesce(s["joins"], s["join_relationships"], none).alias("joins"),
        F.coalesce(s["filters"], s["filters_constraints"], none).alias("filters"),
        F.coalesce(s["intent"], s["question_intent"], F.lit("")).alias("intent"))
    return linked.withColumn("schema_json", F.to_json(body))


def linking_summary(linked: DataFrame, col: str = "schema_linking") -> DataFrame:
    """Add ``schema_summary``: the linked parts as up to five headed bullet lists.

    A raw note is passed through; nothing linked gives "(no schema predicted)".
    """
    s = F.col(col)
    none = F.array().cast("array<string>")

    def block(heading: str, items: Column) -> Column:
        kept = F.filter(F.coalesce(items, none), lambda i: F.length(i) > 0)
        bullets = F.array_join(F.transform(kept, lambda i: F.concat(F.lit("- "), i)), "\n")
        return F.when(F.size(kept) > 0, F.concat(F.lit(f"{heading}:\n"), bullets))

    columns = F.transform(
        F.filter(F.map_entries(s["columns"]), lambda e: F.size(e["value"]) > 0),
        lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    lists = F.concat_ws(
        "\n\n",
        block("Relevant Tables", s["tables"]), block("Relevant Columns", columns),
        block("Join Relationships", F.coalesce(s["join_relationships"], s["joins"])),
        block("Filters / Constraints", F.coalesce(s["filters_constraints"], s["filters"])),
        block("Question Intent", F.array(F.coalesce(s["question_intent"], s["intent"]))))
    return linked.withColumn("schema_summary", F.coalesce(
        F.nullif(s["raw_output"], F.lit("")), F.nullif(lists, F.lit("")), F.lit("(no schema predicted)")))


def attach_schema(examples: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join the schema text by db_id: (attached, examples whose database has no schema).

    No side is forced to broadcast: the planner does so when the texts are small, and otherwise
    adaptive execution splits the partitions of databases that own many examples.
    """
    return examples.join(texts, "db_id"), examples.join(texts, "db_id", "left_anti")


def resolve_database(questions: DataFrame, inventory: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Locate each question's database among stored files (``inventory(path)``).

    ``<db>/<db>.sqlite`` is preferred to ``<db>.sqlite``. The result has ``db_path`` or an
    ``error``; with ``schemas(db_id, schema_text)`` an empty or absent schema is an error too.
    Paths are looked up once per database, not once per question.
    """
    files = inventory.select("path").dropDuplicates()
    dbs = questions.select("db_id").dropDuplicates()
    nested = files.select(F.col("path").alias("p1"))
    flat = files.select(F.col("path").alias("p2"))
    located = (
        dbs.join(nested, F.concat("db_id", F.lit("/"), "db_id", F.lit(".sqlite")) == F.col("p1"), "left")
        .join(flat, F.concat("db_id", F.lit(".sqlite")) == F.col("p2"), "left")
        .select("db_id", F.coalesce("p1", "p2").alias("db_path")))
    error = F.when(F.col("db_path").isNull(), F.concat(F.lit("Missing database file for "), "db_id"))
    if schemas is not None:
        located = located.join(schemas.select("db_id", "schema_text"), "db_id", "left")
        empty = F.length(F.coalesce("schema_text", F.lit(""))) == 0
        error = error.when(empty, F.concat(F.lit("Schema load failed for "), "db_id"))
    located = located.withColumn("error", error)
    return questions.join(located, "db_id", "left")


def schema_for_question(questions: DataFrame, linking: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked schema of a question where there is one, else its database's full schema.

    ``linking(question_id text, schema_json)`` is matched on the id as text; ``texts`` holds
    (db_id, schema_json). ``schema_linking_used`` tells which one it is.
    """
    linked = linking.select(F.col("question_id").alias("_id"), F.col("schema_json").alias("_linked"))
    full = texts.select("db_id", F.col("schema_json").alias("_full"))
    return (
        questions.withColumn("_id", F.col("question_id").cast("string"))
        .join(linked, "_id", "left").join(full, "db_id", "left")
        .withColumns({
            "schema_json": F.coalesce("_linked", "_full"),
            "schema_linking_used": F.col("_linked").isNotNull()})
        .drop("_id", "_linked", "_full"))

"""Query-log work on token arrays: templates, their tokens and frequencies, and lineage.

Every SQL text is cut into tokens; texts that differ only in literals share a shape. Shapes are
made distinct first, with a map-side combine, and each token of a shape gets a role from its
neighbours and from the list it stands in; lineage may ask a catalog for the owner of a column. The log itself
only meets the written table of shapes again, which is broadcast when it is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asklens.functions.text import let
from asklens.session import written

# The placeholders of a template.
TABLE, COLUMN, VALUE = "[TABLE]", "[COLUMN]", "[VALUE]"

# Words that are never a table, a column or an alias.
KEYWORDS = (
    "ALL AND AS ASC BETWEEN BY CASE CAST COLLATE CROSS CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP "
    "DELETE DESC DISTINCT ELSE END EXCEPT EXISTS FALSE FROM FULL GLOB "
    "GROUP HAVING IN INNER INSERT INTERSECT INTO IS ISNULL JOIN LEFT LIKE LIMIT NATURAL "
    "NOCASE NOT NOTNULL NULL NULLS ON OR ORDER OUTER OVER PARTITION "
    "REGEXP RIGHT SELECT THEN TRUE UNION UPDATE USING WHEN WHERE WITH"
).split()


def _soft_keyword(up: Column, before: Column, after: Column, second: Column, marked: Column) -> Column:
    """Whether a word that is an ordinary name elsewhere is a keyword here, by the tokens around it.

    ``before``, ``after`` and ``second`` (the one behind ``after``) are upper-case tokens, ``marked`` says that the
    token before closes an operand. Behind FROM, JOIN, INTO, UPDATE and AS, and beside a dot, every word is a name.
    """
    value = F.lit(VALUE)
    follows = (
        (up.isin("FIRST", "LAST") & (before == "NULLS"))
        | (up.isin("ROWS", "RANGE") & after.isin("BETWEEN", "UNBOUNDED", "CURRENT", VALUE))
        | ((up == "ROW") & (before == "CURRENT")) | ((up == "CURRENT") & (after == "ROW"))
        | ((up == "UNBOUNDED") & after.isin("PRECEDING", "FOLLOWING"))
        | (up.isin("PRECEDING", "FOLLOWING") & before.isin(VALUE, "UNBOUNDED"))
        | ((up == "MATCH") & marked & (after == value)) | ((up == "ESCAPE") & (after == value))
        | ((up == "FILTER") & (before == ")") & (after == "(")) | ((up == "OFFSET") & (after == value))
        | ((up == "SET") & marked & second.isin("=", ".")) | ((up == "VALUES") & (after == "("))
        | ((up == "WINDOW") & (second == "AS")) | ((up == "RECURSIVE") & (before == "WITH")))
    return follows & ~before.isin("FROM", "JOIN", "INTO", "UPDATE", "AS", ".") & (after != ".")
_CLAUSES = ("SELECT", "FROM", "JOIN", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "ON", "SET", "UNION",
            "INTERSECT", "EXCEPT")
_CONSTANTS = ("NULL", "TRUE", "FALSE")

_TOKEN = (
    r"--[^\r\n]*+|/\*(?s:.*?)\*/"              # comments
    r"|'[^']*+(?:''[^']*+)*+'"                 # strings
    r'|"[^"]*+"|`[^`]*+`|\[[\p{L}_][^\]]*+\]'  # quoted names
    r"|[\p{L}_][\p{L}\p{N}_$]*+"               # words
    r"|\d++(?:\.\d*+)?(?:[eE][+-]?\d++)?|\.\d++"
    r"|<>|<=|>=|!=|==|\|\||\S"
)


def sql_tokens(sql: Column) -> Column:
    """Tokens of a SQL text without comments, with every literal replaced by ``[VALUE]``."""
    raw = F.filter(
        F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^(?:--|/\*)"))
    return F.transform(raw, lambda t: F.when(
        t.rlike(r"^(?:'.|\d|\.\d)"), VALUE).otherwise(t))


def _bare(t: Column) -> Column:
    """A name without its quotes."""
    return F.when(t.rlike(r'^(?:"|`|\[)'), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


# What the quick way of finding literals cannot tell apart from names and comments, and blanks that have to be evened out.
_NEEDS_TOKENS = ('"', "`", "[", "--", "/*")
_UNEVEN = ("  ", "\t", "\n", "\x0b", "\f", "\r")
# A digit is met before what stands in front of it is looked at, as most characters are none.
_LITERAL = (r"'[^']*+(?:''[^']*+)*+'"
            r"|(?:\d(?<![\p{L}\p{N}_$.]\d)\d*+(?:\.\d*+)?|\.(?<![\p{L}\p{N}_$.]\.)\d++)(?:[eE][+-]?\d++)?")
_STATEMENT = r"(?is)^[\s(]*+(?:SELECT|WITH|INSERT|UPDATE|DELETE|VALUES)\b[^']*+$"


def _with_shapes(log: DataFrame) -> DataFrame:
    """Add ``_shape``: the text with literals replaced and blanks evened out.

    Rows only see cheap string functions; texts with quoted names or comments are cut into tokens. Whether a text is a
    statement is asked of its shape, once per distinct one.
    """
    def holds(marks: tuple[str, ...]) -> Column:
        return reduce(Column.__or__, [F.contains(sql, F.lit(m)) for m in marks])

    sql = F.coalesce("sql", F.lit(""))
    quick = F.regexp_replace(sql, _LITERAL, VALUE.replace("[", r"\["))
    shape = F.when(holds(_NEEDS_TOKENS), F.array_join(sql_tokens(sql), " ")).when(
        holds(_UNEVEN), F.regexp_replace(quick, r"\s+", " ")).otherwise(quick)
    # A non-null column: joining on it then adds no null filter, which would repeat the expression on the scan.
    return log.withColumn("_shape", F.coalesce(shape, F.lit("")))


def _is_statement(s: str) -> Column:
    """Whether a shape begins as a statement and has balanced quotes and parentheses."""
    # Parentheses are balanced if their running depth ends at 0 and never falls below. It is walked only
    # for texts with several of them.
    opened = F.length(s) - F.length(F.translate(s, "(", ""))
    closed = F.length(s) - F.length(F.translate(s, ")", ""))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    depth = F.aggregate(F.split(F.regexp_replace(s, "[^()]+", ""), ""), zero, lambda a, t: let(
        a["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0),
        lambda d: F.struct(d.alias("depth"), F.least(a["least"], d).alias("least"))))
    nested = F.when(opened != closed, False).when(opened <= 1, F.instr(s, "(") <= F.instr(s, ")")).otherwise(depth["least"] == 0)
    return F.col(s).rlike(_STATEMENT) & nested


def _distinct_shapes(shaped: DataFrame, *by: str) -> DataFrame:
    """The distinct ``_shape`` of statements: a log of any size and of any number of databases has few of them. With ``by``, per group."""
    # The condition asks for the count as well: a filter on the shape alone would run on every row below the aggregation.
    every = shaped.groupBy(*by, "_shape").agg(F.count(F.lit(1)).alias("_c"))
    return every.where(F.when(F.col("_c") > 0, _is_statement("_shape"))).drop("_c")


def _onto(shaped: DataFrame, found: DataFrame) -> DataFrame:
    """Join what was worked out per shape, or per database and shape, back to the log, with ``parsable``: the row has such a shape.

    The shapes are written first: the planner then knows their size, and sends a small table to the
    log instead of shuffling the log on its hottest shapes.
    """
    right = written(found, "shapes").withColumnRenamed("_shape", "_s").withColumn("parsable", F.lit(True))
    same = F.col("_shape") == F.col("_s")
    if "db_id" in found.columns:
        right, same = right.withColumnRenamed("db_id", "_db"), F.col("db_id").eqNullSafe(F.col("_db")) & same
    return shaped.join(right, same, "left").drop("_db", "_s").withColumn("parsable", F.coalesce("parsable", F.lit(False)))


def _classified(shapes: DataFrame) -> DataFrame:
    """Add ``_t`` to distinct shapes: an array of (tok, up, role).

    Roles: keyword, value, function, qualifier, table, column, alias, implicit (an alias without
    AS), cte, mark.
    """
    base = shapes.withColumn("_raw", sql_tokens(F.col("_shape")))
    # Step 1: what each token is by itself and beside its neighbours, and the clause it stands in.
    def up(i: Column) -> Column:
        return F.coalesce(F.upper(F.get("_raw", i)), F.lit(""))

    def kind(t: Column, i: Column) -> Column:
        marked = up(i - 1).rlike(r'^(?:\[VALUE\]|\)|"|`|[\p{L}_])') & ~up(i - 1).isin(*KEYWORDS)
        return (
            F.when(t == VALUE, "value").when(F.upper(t).isin(*_CONSTANTS), "value")
            .when(F.upper(t).isin(*KEYWORDS), "keyword")
            .when(_soft_keyword(F.upper(t), up(i - 1), up(i + 1), up(i + 2), marked), "keyword")
            .when(t.rlike(r'^(?:"|`|\[|[\p{L}_])'), "word").otherwise("mark"))

    kinds = F.transform("_raw", lambda t, i: F.struct(t.alias("tok"), F.upper(t).alias("up"), kind(t, i).alias("kind")))
    base = base.withColumn("_k", kinds)
    # The last clause word at the token's own depth: a parenthesis opens a list of its own.
    start = F.struct(F.array(F.lit("")).alias("open"), F.array().cast("array<string>").alias("out"))

    def walked(state: Column, x: Column) -> Column:
        open_ = state["open"]
        whole = F.slice(open_, F.lit(1), F.greatest(F.size(open_) - 1, F.lit(1)))
        now = F.when(x["tok"] == "(", F.concat(open_, F.array(F.lit("")))).when(x["tok"] == ")", whole).when(
            x["up"].isin(*_CLAUSES) & (x["kind"] == "keyword"),
            F.concat(F.slice(open_, F.lit(1), F.size(open_) - 1), F.array(x["up"]))).otherwise(open_)
        return F.struct(now.alias("open"), F.concat(state["out"], F.array(F.element_at(now, -1))).alias("out"))

    base = base.withColumn("_c", F.aggregate("_k", start, walked)["out"])

    def at(i: Column, offset: int) -> Column:
        return F.get("_k", i + offset)

    # Step 2: the role follows from the neighbours.
    def role(x: Column, i: Column) -> Column:
        before, after = at(i, -1), at(i, 1)
        opens_table = F.coalesce(before["up"].isin("FROM", "JOIN", "INTO", "UPDATE"), F.lit(False))
        dotted = F.coalesce(before["tok"] == ".", F.lit(False))
        in_list = F.coalesce(F.get("_c", i).isin("FROM", "JOIN", "ON"), F.lit(False))
        dotted_table = dotted & (F.coalesce(at(i, -3)["up"].isin("FROM", "JOIN", "INTO", "UPDATE"), F.lit(False))
                                 | (F.coalesce(at(i, -3)["tok"] == ",", F.lit(False)) & in_list))
        # A word behind a comma of an open FROM list is a table, known to the catalog or not.
        listed = F.coalesce(before["tok"] == ",", F.lit(False)) & in_list & (F.coalesce(after["tok"], F.lit("")) != "(")
        follows_name = F.coalesce(
            before["kind"].isin("word", "value") | (before["tok"] == ")")
            | ((before["up"] == "END") & (before["kind"] == "keyword")), F.lit(False))
        next_tok = F.coalesce(after["tok"], F.lit(""))
        return (
            F.when(x["kind"] != "word", x["kind"])
            .when((F.coalesce(after["up"], F.lit("")) == "AS") & (F.coalesce(at(i, 2)["tok"], F.lit("")) == "(")
                  & F.coalesce(before["up"].isin("WITH", "RECURSIVE", ","), F.lit(False)), "cte")
            .when(F.coalesce(before["up"] == "AS", F.lit(False)), "alias")
            .when(next_tok == ".", "qualifier")
            .when(opens_table | dotted_table | listed, "table")
            .when(next_tok == "(", "function")
            .when(follows_name & ~dotted, "implicit")
            .otherwise("column"))

    roles = F.transform("_k", lambda x, i: F.struct(x["tok"], x["up"], role(x, i).alias("role")))
    return base.withColumn("_t", roles).drop("_raw", "_k", "_c")


def _skeleton() -> Column:
    """The template text: tokens replaced by role and put together with normal spacing."""
    def shown(x: Column) -> Column:
        return (
            F.when(x["role"] == "table", TABLE).when(x["role"] == "column", COLUMN).when(x["role"] == "value", VALUE)
            .when(x["role"].isin("keyword", "function"), x["up"])
            .when(x["role"] == "implicit", F.concat(F.lit("AS "), x["tok"]))
            .when(x["tok"] == "!=", "<>").when(x["tok"] == "==", "=").otherwise(x["tok"]))

    def operand(x: Column) -> Column:
        """Whether a sign after this token is binary."""
        return F.coalesce(~x["role"].isin("keyword", "mark") | (x["tok"] == ")"), F.lit(False))

    def spaced(x: Column, i: Column) -> Column:
        before = F.get("_t", i - 1)
        tight = (
            (i == 0) | x["tok"].isin(",", ")", ".", ";") | before["tok"].isin("(", ".")
            | ((x["tok"] == "(") & ((before["role"] == "function") | before["up"].isin("CAST", "EXISTS")))
            | (before["tok"].isin("-", "+") & ~operand(F.get("_t", i - 2))))
        return F.concat(F.when(tight, "").otherwise(" "), shown(x))

    return F.regexp_replace(F.array_join(F.transform("_t", spaced), ""), r"[\s;]+$", "")


def sql_skeletons(log: DataFrame) -> DataFrame:
    """Add ``skeleton`` to a log (db_id, sql, ...): tables, columns and literals as placeholders.

    Aliases, qualifiers, function names and keywords stay. A text that is no statement or has
    unbalanced quotes or parentheses keeps its own text and has ``parsable`` false.
    """
    shaped = _with_shapes(log)
    found = _classified(_distinct_shapes(shaped)).select("_shape", _skeleton().alias("skeleton"))
    return _onto(shaped, found).withColumn("skeleton", F.coalesce("skeleton", "sql")).drop("_shape")


def template_counts(log: DataFrame, weight: str | None = None) -> DataFrame:
    """(db_id, skeleton, n, sample_sql): how often each template occurs in each database.

    The aggregation combines on the map side; roles are worked out once per shape, whatever databases it occurs in.
    ``weight`` names a column with the number of occurrences of a row.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return sql_skeletons(log).groupBy("db_id", "skeleton").agg(n.alias("n"), F.min("sql").alias("sample_sql"))


def template_sketches(skeletons: DataFrame, by: list[str], most: int = 10_000) -> DataFrame:
    """(by, sketch, n_rows): a sketch of the commonest templates per group, for logs too varied to count exactly.

    ``skeletons`` has ``skeleton`` (NULL does not count). A sketch tracks ``most`` templates whatever the log holds, so a stored table with
    one for each database and day grows with the days alone, and new days are added without reading old logs.
    """
    return skeletons.where(F.col("skeleton").isNotNull()).groupBy(*by).agg(
        F.expr(f"approx_top_k_accumulate(skeleton, {int(most)})").alias("sketch"), F.count(F.lit(1)).alias("n_rows"))


def heavy_templates(sketches: DataFrame, k: int, by: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """(by, skeleton, n, most_wrong): the k commonest templates per group, or over all, out of merged sketches.

    ``n`` is wrong by at most ``most_wrong``: 2.625 times the group's rows over the number of templates tracked, rounded up.
    Equal counts are ordered by template. ``most`` is that of the merged sketch; the parts may track another number.
    A group whose templates all occur less often than ``most_wrong`` may give fewer than k of them.
    """
    groups, most = by or [], int(most)
    # A group by a constant, as no sketches at all have nothing to merge into.
    found = sketches.groupBy(*(groups or [F.lit("all")])).agg(
        F.expr(f"approx_top_k_combine(sketch, {most})").alias("_s"), F.sum("n_rows").alias("_n"),
        F.least(F.min("sketch.maxItemsTracked"), F.lit(most)).alias("_least"))
    wrong = F.ceil(F.col("_n") * 2.625 / F.col("_least")).cast("bigint")
    # All templates that a group tracks, so that ties at place k are cut by name; there are at most ``most``.
    every = found.where("_n > 0").select(
        *groups, F.explode(F.expr(f"approx_top_k_estimate(_s, {most})")).alias("_e"), wrong.alias("most_wrong"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("_e.count"), "_e.item"))
    return every.withColumn("_r", place).where(F.col("_r") <= k).select(
        *groups, F.col("_e.item").alias("skeleton"), F.col("_e.count").alias("n"), "most_wrong")


# The alternatives of the template token pattern, tried in this order, any case,
# without word boundaries (so ORDER BY gives OR, DER, BY).
COMPAT_TOKENS = (
    r"SELECT", r"FROM", r"WHERE", r"JOIN", r"LEFT\s+JOIN", r"RIGHT\s+JOIN", r"INNER\s+JOIN", r"OUTER\s+JOIN",
    r"ON", r"AND", r"OR", r"NOT", r"IN", r"BETWEEN", r"LIKE", r"IS\s+NULL", r"IS\s+NOT\s+NULL",
    r"GROUP\s+BY", r"ORDER\s+BY", r"HAVING", r"LIMIT", r"OFFSET",
    r"COUNT", r"SUM", r"AVG", r"MIN", r"MAX", r"DISTINCT",
    r"UNION", r"UNION\s+ALL", r"INTERSECT", r"EXCEPT",
    r"\[TABLE\]", r"\[COLUMN\]", r"\[VALUE\]",
    r"[=<>!]+", r",", r";", r"\(", r"\)", r"\+", r"-", r"\*", r"/",
    r"[A-Za-z_]+",
)


def token_pattern(mode: str = "compat") -> str:
    if mode == "compat":
        return "(?i)" + "|".join(COMPAT_TOKENS)
    if mode == "strict":
        # Phrases before their first words, and words only as whole words.
        words = [t for t in COMPAT_TOKENS if t[0].isalpha()]
        others = [t for t in COMPAT_TOKENS if not t[0].isalpha() and t != r"[A-Za-z_]+"]
        phrases = sorted(words, key=len, reverse=True)
        return r"(?i)\b(?:" + "|".join(phrases) + r")\b|" + "|".join(others) + r"|[A-Za-z_][A-Za-z0-9_]*"
    raise ValueError("mode must be 'compat' or 'strict'")


def template_tokens(skeleton: Column, mode: str = "compat") -> Column:
    """Upper-cased tokens of a template as an array."""
    found = F.regexp_extract_all(skeleton, F.lit(token_pattern(mode)), F.lit(0))
    return F.transform(found, lambda t: F.upper(t))


def skeleton_tokens(skeletons: DataFrame, key: str = "qid", mode: str = "compat") -> DataFrame:
    """(key, pos, token): the token table of templates."""
    return skeletons.select(
        key, F.posexplode_outer(template_tokens(F.col("skeleton"), mode)).alias("pos", "token")).where(
        F.col("token").isNotNull())


def token_frequencies(skeletons: DataFrame, mode: str = "compat") -> DataFrame:
    """(token, n, n_skeletons): how often and in how many templates each token occurs.

    Equal templates are merged first, so tokens are cut once per distinct template.
    """
    distinct = skeletons.groupBy("skeleton").agg(F.count(F.lit(1)).alias("_w"))
    tokens = distinct.select(
        "_w", F.explode_outer(template_tokens(F.col("skeleton"), mode)).alias("token"), "skeleton").where(
        F.col("token").isNotNull())
    per_template = tokens.groupBy("token", "skeleton").agg(F.sum("_w").alias("_n"), F.max("_w").alias("_w"))
    return per_template.groupBy("token").agg(F.sum("_n").alias("n"), F.sum("_w").alias("n_skeletons"))


def _held_columns(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``_held``, (table, its columns in lower case) for the tables of a shape, and ``_known``: all of them are in the catalog.

    Names meet in any letter case. A table that the text itself defines by WITH is unknown, whatever the catalog has of its name.
    The lists are as long as the text's own tables and their columns.
    """
    stored = catalog.where(F.col("table_name").isNotNull()).groupBy(
        F.col("db_id").alias("_d"), F.lower("table_name").alias("_n")).agg(F.collect_set(F.lower("col_name")).alias("_cols"))
    named = refs.withColumn("_table", F.explode_outer(F.array_distinct(F.transform("_tables", lambda e: e["name"]))))
    same = (F.col("db_id").eqNullSafe(F.col("_d")) & (F.lower("_table") == F.col("_n"))
            & ~F.array_contains("_ctes", F.lower("_table")))
    return named.join(stored, same, "left").groupBy("db_id", "_shape").agg(
        F.first("_tables").alias("_tables"), F.first("_columns").alias("_columns"),
        F.bool_and(F.col("_cols").isNotNull()).alias("_known"),
        F.collect_list(F.struct("_table", "_cols")).alias("_held"))


def query_lineage(log: DataFrame, catalog: DataFrame | None = None, key: str = "qid") -> tuple[DataFrame, DataFrame]:
    """Tables and columns every query uses: ((db_id, key, kind, item), quarantine).

    Aliases are resolved to their tables and ``*`` is skipped. A column without a qualifier belongs
    to the only table of the query, else it is listed as ``?.column``. With a ``catalog`` it belongs to the one table of
    the query that has such a column there, provided that the catalog has all tables of the query; otherwise it
    stays ``?.column``. Letter case is kept and
    names of common table expressions count as tables. Texts that are no statement go to
    the quarantine with a reason.
    """
    shaped = _with_shapes(log)
    # Only the catalog makes the databases differ.
    pairs = None if catalog is None else written(_distinct_shapes(shaped, "db_id"), "database-shapes")
    roles = _classified(_distinct_shapes(shaped) if pairs is None else pairs.select("_shape").distinct())
    # A table and the alias that follows it; without one the table goes by its own name.
    def entry(x: Column, i: Column) -> Column:
        after, second = F.get("_t", i + 1), F.get("_t", i + 2)
        alias = F.when(after["role"] == "implicit", after["tok"]).when(
            (after["up"] == "AS") & (second["role"] == "alias"), second["tok"]).otherwise(x["tok"])
        return F.when(x["role"] == "table", F.struct(_bare(alias).alias("alias"), _bare(x["tok"]).alias("name")))

    def column(x: Column, i: Column) -> Column:
        owner = F.when(F.get("_t", i - 1)["tok"] == ".", _bare(F.get("_t", i - 2)["tok"]))
        return F.when(x["role"] == "column", F.struct(owner.alias("owner"), _bare(x["tok"]).alias("name")))

    ctes = F.transform(F.filter("_t", lambda x: x["role"] == "cte"), lambda x: F.lower(_bare(x["tok"])))
    refs = roles.select(
        "_shape",
        F.filter(F.transform("_t", entry), lambda e: e.isNotNull()).alias("_tables"),
        F.filter(F.transform("_t", column), lambda e: e.isNotNull()).alias("_columns"),
        *([] if catalog is None else [ctes.alias("_ctes")]))
    if catalog is not None:
        refs = _held_columns(pairs.join(written(refs, "roles"), "_shape"), catalog)
    names = F.array_distinct(F.transform("_tables", lambda e: e["alias"]))

    def settled(c: Column) -> Column:
        if catalog is None:
            return F.lit("?")
        held = F.filter("_held", lambda t: F.array_contains(t["_cols"], F.lower(c["name"])))
        return F.when(F.col("_known") & (F.size(held) == 1), F.get(held, F.lit(0))["_table"]).otherwise("?")

    def owner_of(c: Column) -> Column:
        match = F.filter("_tables", lambda e: e["alias"] == c["owner"])
        return F.when(c["owner"].isNull(), F.when(
            F.size(names) == 1, F.element_at("_tables", F.lit(-1))["name"]).otherwise(settled(c))).when(
            F.size(match) > 0, F.element_at(match, F.lit(-1))["name"]).otherwise(c["owner"])

    items = F.concat(
        F.transform(F.array_distinct(F.transform("_tables", lambda e: e["name"])), lambda t: F.struct(
            F.lit("table").alias("kind"), t.alias("item"))),
        F.transform(F.array_distinct(F.transform("_columns", lambda c: F.concat(
            owner_of(c), F.lit("."), c["name"]))), lambda t: F.struct(F.lit("column").alias("kind"), t.alias("item"))))
    per_shape = refs.select(*([] if catalog is None else ["db_id"]), "_shape", items.alias("_items"))
    judged = _onto(shaped.select("db_id", key, "sql", "_shape"), per_shape)
    # explode() would add a size filter that repeats the whole expression below the projections.
    rows = judged.select(
        "db_id", key, F.explode_outer("_items").alias("i")).where(F.col("i").isNotNull()).select(
        "db_id", key, "i.kind", "i.item")
    bad = judged.where(~F.col("parsable")).select(
        "db_id", key, "sql", F.lit("not a complete SQL statement").alias("reason"))
    return rows, bad

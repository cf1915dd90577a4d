"""Query-log queries: templates, tokens, lineage, training pairs, edit-distance neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from asklens.operators import compare, edit, log, prompts, responses, schema
from asklens.plans import query, rounded
from asklens.session import written
from asklens.views import VIEWS, stored_catalog, table, view

# The check's own way: tokens as rows, neighbours by window, names by the stored columns.
_TOKENS = r"""
d AS (SELECT DISTINCT db_id, qid, sql FROM v_query_log),
t AS (SELECT db_id, qid, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i FROM (
        SELECT db_id, qid, regexp_extract_all(sql, '''[^'']*''|[A-Za-z_]+|[0-9]+|[^ ]') AS toks FROM d)),
w AS (SELECT *, lag(tok) OVER o AS before, lag(tok, 2) OVER o AS before2, lead(tok) OVER o AS after FROM t
      WINDOW o AS (PARTITION BY db_id, qid ORDER BY i)),
cols AS (SELECT DISTINCT col_name FROM v_stored),
r AS (SELECT w.*, CASE WHEN tok[1] IN ('''', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9') THEN '[VALUE]'
                  WHEN before IN ('FROM', 'JOIN') AND tok <> '(' THEN '[TABLE]'
                  WHEN c.col_name IS NOT NULL THEN '[COLUMN]' ELSE tok END AS shown
      FROM w LEFT JOIN cols c ON c.col_name = w.tok)"""
_SKELETONS = _TOKENS + r""",
k AS (SELECT db_id, qid, string_agg(CASE WHEN i = 1 OR tok IN (',', ')', '.') OR before IN ('(', '.')
                OR (tok = '(' AND before IN ('COUNT', 'SUM', 'AVG')) THEN '' ELSE ' ' END || shown, '' ORDER BY i) AS skeleton
      FROM r GROUP BY db_id, qid)"""


@query("f6_sql_skeletons", f"WITH {_SKELETONS.strip()} SELECT db_id, qid, skeleton, true AS parsable FROM k")
def f6(spark, sf):
    rows = log.sql_skeletons(view(spark, sf, "v_query_log"))
    return rows.select("db_id", "qid", "skeleton", "parsable")


@query("f6_sql_skeletons_unparsable", """
SELECT example_id, sql NOT LIKE 'no idea%' AS parsable, CASE WHEN sql LIKE 'no idea%' THEN sql ELSE
       'SELECT [COLUMN] FROM [TABLE] WHERE [COLUMN] = [VALUE] AND [COLUMN] = [VALUE]' END AS skeleton FROM v_log_examples
""")
def f6_examples(spark, sf):
    rows = log.sql_skeletons(view(spark, sf, "v_log_examples"))
    return rows.select("example_id", "skeleton", "parsable")


_COMPAT = "'(?i)" + "|".join(log.COMPAT_TOKENS).replace("'", "''") + "'"


@query("f7_token_frequencies", f"""
WITH {_SKELETONS.strip()},
x AS (SELECT qid, db_id, unnest(list_transform(regexp_extract_all(skeleton, {_COMPAT}), lambda y: upper(y))) AS token FROM k)
SELECT token, count(*) AS n, count(DISTINCT db_id || qid) AS n_skeletons FROM x GROUP BY token
""")
def f7(spark, sf):
    return log.token_frequencies(f6(spark, sf))


@query("f7_skeleton_tokens", f"""
WITH {_SKELETONS.strip()},
x AS (SELECT db_id || ':' || qid AS key, list_transform(regexp_extract_all(skeleton, {_COMPAT}), lambda y: upper(y)) AS l FROM k)
SELECT key, cast(unnest(range(0, len(l))) AS int) AS pos, unnest(l) AS token FROM x
""")
def f7_tokens(spark, sf):
    rows = f6(spark, sf).withColumn("key", F.concat_ws(":", "db_id", "qid"))
    return log.skeleton_tokens(rows, key="key")


@query("a14_template_counts", f"""
WITH {_SKELETONS.strip()}
SELECT k.db_id, k.skeleton, cast(sum(l.n) AS bigint) AS n, min(l.sql) AS sample_sql
FROM k JOIN v_query_log l ON l.db_id = k.db_id AND l.qid = k.qid GROUP BY k.db_id, k.skeleton
""")
def a14(spark, sf):
    return log.template_counts(view(spark, sf, "v_query_log"), weight="n")


_LINEAGE = _TOKENS + r""",
tables AS (SELECT DISTINCT db_id, qid, tok AS name FROM r WHERE shown = '[TABLE]'),
aliases AS (SELECT db_id, qid, CASE WHEN after = 'AS' THEN (CASE tok WHEN 'lineitem' THEN 'l' ELSE 'o' END) ELSE tok END AS alias,
                   tok AS name FROM r WHERE shown = '[TABLE]'),
sizes AS (SELECT db_id, qid, count(DISTINCT alias) AS n, max(name) AS name FROM aliases GROUP BY db_id, qid),
refs AS (SELECT db_id, qid, tok AS col, CASE WHEN before = '.' THEN before2 END AS owner FROM r WHERE shown = '[COLUMN]'),
columns AS (SELECT DISTINCT c.db_id, c.qid, CASE WHEN owner IS NULL THEN CASE WHEN s.n = 1 THEN s.name ELSE '?' END
                   ELSE coalesce(a.name, owner) END || '.' || col AS item
            FROM refs c JOIN sizes s ON s.db_id = c.db_id AND s.qid = c.qid
            LEFT JOIN aliases a ON a.db_id = c.db_id AND a.qid = c.qid AND a.alias = c.owner),
lineage AS (SELECT db_id, qid, 'table' AS kind, name AS item FROM tables UNION ALL SELECT db_id, qid, 'column', item FROM columns)"""


@query("j4_query_lineage", f"WITH {_LINEAGE.strip()} SELECT * FROM lineage")
def j4(spark, sf):
    return log.query_lineage(view(spark, sf, "v_query_log"))[0]


# Stored columns have unique names but for those that several tables share; each belongs to the tables the statement names.
@query("j4_catalog_lineage", f"""
WITH {_LINEAGE.strip()},
held AS (SELECT DISTINCT l.db_id, l.qid, l.item AS table_name, s.col_name FROM lineage l
         JOIN v_stored s ON s.db_id = l.db_id AND s.table_name = l.item WHERE l.kind = 'table'),
owners AS (SELECT db_id, qid, col_name, count(*) AS n, max(table_name) AS name FROM held GROUP BY db_id, qid, col_name)
SELECT DISTINCT l.db_id, l.qid, l.kind, CASE WHEN starts_with(l.item, '?.') AND o.n = 1 THEN o.name || '.' || o.col_name ELSE l.item END AS item
FROM lineage l LEFT JOIN owners o ON o.db_id = l.db_id AND o.qid = l.qid AND l.kind = 'column' AND o.col_name = substring(l.item, 3)
""")
def j4_catalog(spark, sf):
    return log.query_lineage(view(spark, sf, "v_query_log"), stored_catalog(spark, sf))[0]


@query("j4_lineage_quarantine", """
SELECT db_id, example_id, sql, 'not a complete SQL statement' AS reason FROM v_log_examples WHERE sql LIKE 'no idea%'
""")
def j4_quarantine(spark, sf):
    return log.query_lineage(view(spark, sf, "v_log_examples"), key="example_id")[1]


_QUESTION = "'What does statement ' || qid || ' of \"' || db_id || '\" return, asked for in more than eighty characters?'"
_PAIR_CHECK = f"""
WITH {_LINEAGE.strip()},
lines AS (SELECT db_id, table_idx, table_name || '(' || string_agg(col_name, ', ' ORDER BY col_idx) || ')' AS line
          FROM v_stored GROUP BY db_id, table_idx, table_name),
texts AS (SELECT db_id, string_agg(line, chr(10) ORDER BY table_idx) AS schema_text FROM lines GROUP BY db_id),
q AS (SELECT db_id, qid, {_QUESTION} AS question FROM v_query_log),
parts AS (SELECT l.db_id, l.qid, kind, string_agg('{{"name": ' || cast(to_json(item) AS string) || ', "reason": '
            || cast(to_json(CASE kind WHEN 'table' THEN 'Used in the query to answer the question: '
                                      ELSE 'Referenced in the query to answer: ' END || {{quoted}}) AS string) || '}}', ', ' ORDER BY item) AS list
          FROM lineage l JOIN q ON q.db_id = l.db_id AND q.qid = l.qid GROUP BY l.db_id, l.qid, kind)
SELECT q.db_id || ':' || q.qid AS example_id, q.db_id,
  md5({{input}}) AS input_md5,
  '{{"tables": [' || coalesce(a.list, '') || '], "columns": [' || coalesce(b.list, '') || ']}}' AS output
FROM q JOIN texts ON texts.db_id = q.db_id
LEFT JOIN parts a ON a.db_id = q.db_id AND a.qid = q.qid AND a.kind = 'table'
LEFT JOIN parts b ON b.db_id = q.db_id AND b.qid = q.qid AND b.kind = 'column'
"""


def sql_text(template: str, **fields: str) -> str:
    """A template as an SQL expression over the given expressions, for the checks."""
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, expression in fields.items():
        out = out.replace("{" + name + "}", f"' || {expression} || '")
    return out


def _pair_check(quoted: str) -> str:
    return _PAIR_CHECK.replace("{quoted}", quoted).replace("{input}", sql_text(
        prompts.LINKING_TEMPLATE, schema_text="schema_text", question="question"))


def _pairs(spark, sf, quoted: int | None):
    rows = view(spark, sf, "v_query_log").withColumn("example_id", F.concat_ws(":", "db_id", "qid"))
    asked = rows.select("example_id", "db_id", "sql", F.concat(
        F.lit("What does statement "), "qid", F.lit(' of "'), "db_id",
        F.lit('" return, asked for in more than eighty characters?')).alias("question"))
    stored = stored_catalog(spark, sf)
    lineage, _ = log.query_lineage(asked, key="example_id")
    pairs = prompts.training_pairs(asked, lineage.drop("db_id"), schema.schema_text(stored), quoted=quoted)
    return pairs.select("example_id", "db_id", F.md5("input").alias("input_md5"), "output")


@query("a2_training_pairs", _pair_check("question"))
def a2(spark, sf):
    return _pairs(spark, sf, None)


@query("a2_training_pairs_short", _pair_check("substring(question, 1, 80)"))
def a2_short(spark, sf):
    return _pairs(spark, sf, 80)


# Tokens as one ASCII character each, so that the engine's byte-wise distance counts tokens.
@query("w5_edit_top_n", f"""
WITH {_SKELETONS.strip()},
s AS (SELECT DISTINCT skeleton FROM k),
x AS (SELECT skeleton, list_transform(regexp_extract_all(skeleton, {_COMPAT}), lambda y: upper(y)) AS l FROM s),
vocabulary AS (SELECT token, chr(cast(32 + row_number() OVER (ORDER BY token) AS int)) AS c FROM (SELECT DISTINCT unnest(l) AS token FROM x)),
flat AS (SELECT skeleton, unnest(l) AS token, unnest(range(0, len(l))) AS i FROM x),
coded AS (SELECT skeleton, string_agg(c, '' ORDER BY i) AS code FROM flat JOIN vocabulary USING (token) GROUP BY skeleton),
templates AS (SELECT DISTINCT db_id || ' ' || skeleton AS id, skeleton FROM k),
scored AS (SELECT a.skeleton AS asked, t.id, 1 - levenshtein(a.code, b.code) / greatest(length(a.code), length(b.code)) AS score
           FROM coded a, coded b JOIN templates t ON t.skeleton = b.skeleton),
ranked AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, id) AS rank FROM scored)
SELECT k.db_id || ':' || k.qid AS query_id, r.id, round(r.score, 6) AS score, cast(r.rank AS int) AS rank
FROM k JOIN ranked r ON r.asked = k.skeleton WHERE r.rank <= 12
""")
def w5(spark, sf):
    found = written(f6(spark, sf).select("db_id", "qid", "skeleton"), "skeletons")
    asked = found.select(F.concat_ws(":", "db_id", "qid").alias("query_id"), "skeleton")
    templates = found.select("db_id", "skeleton").distinct().select(F.concat_ws(" ", "db_id", "skeleton").alias("id"), "skeleton")
    return rounded(edit.edit_top_n(asked, templates, 12))


_TRUTH = """
truth AS (SELECT o_orderkey AS note_id, 'table' AS kind, 'orders' AS item FROM orders
          UNION ALL SELECT o_orderkey, 'table', 'customer' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 1000
          UNION ALL SELECT o_orderkey, 'column', 'orders.o_orderkey' FROM orders
          UNION ALL SELECT o_orderkey, 'column', 'orders.o_totalprice' FROM orders WHERE o_totalprice > 200000)"""
_PREDICTED = """
base AS (SELECT o_orderkey AS note_id, o_orderpriority AS p, c_acctbal > 3000 AS both_tables, lower(c_mktsegment) AS seg
         FROM orders JOIN customer ON c_custkey = o_custkey),
predicted AS (SELECT note_id, 'table' AS kind, 'orders' AS item FROM base
  UNION ALL SELECT note_id, 'table', 'customer' FROM base WHERE both_tables
  UNION ALL SELECT note_id, 'column', 'nation.n_name' FROM base WHERE p = '2-HIGH'
  UNION ALL SELECT note_id, 'column', 'orders.o_totalprice' FROM base WHERE p = '1-URGENT'
  UNION ALL SELECT note_id, 'column', unnest(['orders.o_orderkey', 'orders.o_custkey']) FROM base WHERE p NOT IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT note_id, 'column', unnest(['customer.c_custkey', 'customer.' || seg]) FROM base WHERE both_tables AND p <> '2-HIGH')"""
_SCORES = f"""
WITH {_TRUTH.strip()}, {_PREDICTED.strip()},
m AS (SELECT coalesce(p.note_id, t.note_id) AS note_id, coalesce(p.kind, t.kind) AS kind, p.item IS NOT NULL AS p, t.item IS NOT NULL AS t
      FROM predicted p FULL OUTER JOIN truth t ON t.note_id = p.note_id AND t.kind = p.kind AND t.item = p.item),
c AS (SELECT note_id, kind, count(*) FILTER (p) AS n_predicted, count(*) FILTER (t) AS n_true, count(*) FILTER (p AND t) AS n_hit
      FROM m GROUP BY note_id, kind)"""
_F1 = """round(n_hit / greatest(n_predicted, 1), 6) AS precision, round(n_hit / greatest(n_true, 1), 6) AS recall,
round(2 * n_hit / greatest(n_predicted + n_true, 1), 6) AS f1"""


def _scores(spark, sf):
    notes = responses.notes_struct(view(spark, sf, "v_notes"), "text")
    columns = notes.select("note_id", F.explode_outer("columns").alias("t", "cs")).select(
        "note_id", F.lit("column").alias("kind"), F.explode_outer("cs").alias("c"), "t").where("c IS NOT NULL").select(
        "note_id", "kind", F.concat_ws(".", "t", "c").alias("item"))
    predicted = notes.select("note_id", F.lit("table").alias("kind"), F.explode_outer("tables").alias("item")).where("item IS NOT NULL").unionByName(columns)
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))

    def item(kind, name, condition="true"):
        return F.when(F.expr(condition), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("item")))

    truth = orders.select(F.col("o_orderkey").alias("note_id"), F.explode(F.array(
        item("table", "orders"), item("table", "customer", "c_acctbal > 1000"), item("column", "orders.o_orderkey"),
        item("column", "orders.o_totalprice", "o_totalprice > 200000"))).alias("x")).where(
        F.col("x").isNotNull()).select("note_id", "x.kind", "x.item")
    return compare.linking_scores(predicted, truth, key="note_id")


@query("j7_linking_scores", f"{_SCORES} SELECT note_id, kind, n_predicted, n_true, n_hit, {_F1} FROM c")
def j7(spark, sf):
    return rounded(_scores(spark, sf))


@query("j7_linking_scores_overall", f"""{_SCORES},
o AS (SELECT kind, cast(sum(n_predicted) AS bigint) AS n_predicted, cast(sum(n_true) AS bigint) AS n_true, cast(sum(n_hit) AS bigint) AS n_hit
      FROM c GROUP BY kind)
SELECT kind, n_predicted, n_true, n_hit, {_F1} FROM o
""")
def j7_overall(spark, sf):
    return rounded(compare.linking_scores_overall(_scores(spark, sf)))


# Statements with names that are keywords elsewhere, lists of tables, nesting, quotes and broken texts: the text ({n}
# is a number of the row), its skeleton, its tables and its columns. What is expected is written out for each.
RICH = [
    ("SELECT COUNT(id) FROM Match WHERE goals > {n}", "SELECT COUNT([COLUMN]) FROM [TABLE] WHERE [COLUMN] > [VALUE]",
     "Match", "Match.goals|Match.id"),
    ("SELECT T1.first FROM Match AS T1 JOIN Player AS T2 ON T1.id = T2.last WHERE T2.range = {n}",
     "SELECT T1.[COLUMN] FROM [TABLE] AS T1 JOIN [TABLE] AS T2 ON T1.[COLUMN] = T2.[COLUMN] WHERE T2.[COLUMN] = [VALUE]",
     "Match|Player", "Match.first|Match.id|Player.last|Player.range"),
    ("SELECT row, range, match FROM seats WHERE offset = {n} ORDER BY first",
     "SELECT [COLUMN], [COLUMN], [COLUMN] FROM [TABLE] WHERE [COLUMN] = [VALUE] ORDER BY [COLUMN]",
     "seats", "seats.first|seats.match|seats.offset|seats.range|seats.row"),
    ("SELECT a.x, b.y FROM t1 a, t2 b WHERE a.id = b.id AND a.k = {n}",
     "SELECT a.[COLUMN], b.[COLUMN] FROM [TABLE] AS a, [TABLE] AS b WHERE a.[COLUMN] = b.[COLUMN] AND a.[COLUMN] = [VALUE]",
     "t1|t2", "t1.id|t1.k|t1.x|t2.id|t2.y"),
    ("WITH c AS (SELECT id FROM t1) SELECT c.id FROM t2, c WHERE c.id < {n}",
     "WITH c AS (SELECT [COLUMN] FROM [TABLE]) SELECT c.[COLUMN] FROM [TABLE], [TABLE] WHERE c.[COLUMN] < [VALUE]",
     "c|t1|t2", "?.id|c.id"),
    ("SELECT x.a FROM x WHERE x.b = {n} UNION SELECT y.a FROM y",
     "SELECT x.[COLUMN] FROM [TABLE] WHERE x.[COLUMN] = [VALUE] UNION SELECT y.[COLUMN] FROM [TABLE]", "x|y", "x.a|x.b|y.a"),
    ("SELECT CASE WHEN p > {n} THEN 'high' ELSE 'low' END AS band FROM prices",
     "SELECT CASE WHEN [COLUMN] > [VALUE] THEN [VALUE] ELSE [VALUE] END AS band FROM [TABLE]", "prices", "prices.p"),
    ("SELECT name FROM zoo WHERE id IN (SELECT zoo_id FROM animal WHERE age > (SELECT AVG(age) FROM animal WHERE cage = {n}))",
     "SELECT [COLUMN] FROM [TABLE] WHERE [COLUMN] IN (SELECT [COLUMN] FROM [TABLE] WHERE [COLUMN] > "
     "(SELECT AVG([COLUMN]) FROM [TABLE] WHERE [COLUMN] = [VALUE]))", "animal|zoo", "?.age|?.cage|?.id|?.name|?.zoo_id"),
    ('SELECT "free seats" FROM "my hall" WHERE `row no` = {n}', "SELECT [COLUMN] FROM [TABLE] WHERE [COLUMN] = [VALUE]",
     "my hall", "my hall.free seats|my hall.row no"),
    ("SELECT a -- all of them\nFROM t /* the {n} */ WHERE b = 'x--y'", "SELECT [COLUMN] FROM [TABLE] WHERE [COLUMN] = [VALUE]",
     "t", "t.a|t.b"),
    ("SELECT a FROM t WHERE b IS NOT NULL AND c = TRUE AND d < -{n}",
     "SELECT [COLUMN] FROM [TABLE] WHERE [COLUMN] IS NOT [VALUE] AND [COLUMN] = [VALUE] AND [COLUMN] < -[VALUE]", "t", "t.a|t.b|t.c|t.d"),
    ("SELECT a FROM t ORDER BY a LIMIT {n} OFFSET 20", "SELECT [COLUMN] FROM [TABLE] ORDER BY [COLUMN] LIMIT [VALUE] OFFSET [VALUE]",
     "t", "t.a"),
    ("UPDATE stock SET amount = {n} WHERE item = 'nut'", "UPDATE [TABLE] SET [COLUMN] = [VALUE] WHERE [COLUMN] = [VALUE]",
     "stock", "stock.amount|stock.item"),
    ("SELECT SUM(v) OVER (ORDER BY d ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) AS total FROM flows",
     "SELECT SUM([COLUMN]) OVER (ORDER BY [COLUMN] ROWS BETWEEN [VALUE] PRECEDING AND CURRENT ROW) AS total FROM [TABLE]",
     "flows", "flows.d|flows.v"),
    ("SELECT t.a FROM u JOIN t ON u.id = t.id, w WHERE w.z = {n}",
     "SELECT t.[COLUMN] FROM [TABLE] JOIN [TABLE] ON u.[COLUMN] = t.[COLUMN], [TABLE] WHERE w.[COLUMN] = [VALUE]",
     "t|u|w", "t.a|t.id|u.id|w.z"),
    ("SELECT f.values, f.set FROM filter AS f WHERE f.window = {n}",
     "SELECT f.[COLUMN], f.[COLUMN] FROM [TABLE] AS f WHERE f.[COLUMN] = [VALUE]", "filter", "filter.set|filter.values|filter.window"),
    ("SELECT m.a FROM (SELECT a, b FROM t WHERE b = {n}) AS m, v", "SELECT m.[COLUMN] FROM (SELECT [COLUMN], [COLUMN] FROM [TABLE] "
     "WHERE [COLUMN] = [VALUE]) AS m, [TABLE]", "t|v", "?.a|?.b|m.a"),
    ("SELECT a FROM t WHERE b LIKE '%({n}' AND c <> 'it''s'", "SELECT [COLUMN] FROM [TABLE] WHERE [COLUMN] LIKE [VALUE] AND [COLUMN] <> [VALUE]",
     "t", "t.a|t.b|t.c"),
    ("SELECT )( FROM t WHERE a = {n}", None, None, None),
    ("SELECT (a FROM t WHERE b = {n}", None, None, None),
    ("SELECT 'open FROM t WHERE b = {n}", None, None, None),
    ("what is {n}?", None, None, None),
]


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# Every line item asks one of the statements; numbers repeat, so that the log has many copies of a text.
VIEWS["v_rich_log"] = f"""
SELECT 'db' || cast(l_suppkey % 10 AS string) AS db_id, l_orderkey * 10 + l_linenumber AS qid, k, skeleton, tables, columns,
  replace(text, '{{n}}', cast(l_partkey % 50 AS string)) AS sql
FROM lineitem JOIN ({" UNION ALL ".join(
    f"SELECT {k} AS k, {_literal(text)} AS text, cast({_literal(skeleton)} AS string) AS skeleton, "
    f"cast({_literal(tables)} AS string) AS tables, cast({_literal(columns)} AS string) AS columns"
    for k, (text, skeleton, tables, columns) in enumerate(RICH))}) s
ON s.k = (l_orderkey + l_linenumber * 7 + l_partkey) % {len(RICH)}
"""


@query("f6_sql_skeletons_rich", """
SELECT db_id, qid, k, coalesce(skeleton, sql) AS skeleton, skeleton IS NOT NULL AS parsable FROM v_rich_log
""")
def f6_rich(spark, sf):
    rows = view(spark, sf, "v_rich_log").select("db_id", "qid", "k", "sql")
    return log.sql_skeletons(rows).select("db_id", "qid", "k", "skeleton", "parsable")


@query("j4_query_lineage_rich", """
SELECT db_id, qid, 'table' AS kind, unnest(string_split(tables, '|')) AS item FROM v_rich_log WHERE tables IS NOT NULL
UNION ALL SELECT db_id, qid, 'column', unnest(string_split(columns, '|')) FROM v_rich_log WHERE columns IS NOT NULL
""")
def j4_rich(spark, sf):
    return log.query_lineage(view(spark, sf, "v_rich_log").select("db_id", "qid", "sql"))[0]


@query("a14_template_counts_rich", """
SELECT coalesce(skeleton, sql) AS skeleton, count(*) AS n FROM v_rich_log GROUP BY 1
""")
def a14_rich(spark, sf):
    return log.template_counts(view(spark, sf, "v_rich_log").select("db_id", "sql")).groupBy("skeleton").agg(F.sum("n").alias("n"))


@query("a14_heavy_templates", """
WITH c AS (SELECT db_id, coalesce(skeleton, sql) AS skeleton, count(*) AS n FROM v_rich_log GROUP BY 1, 2),
every AS (SELECT 'all' AS db_id, skeleton, cast(sum(n) AS bigint) AS n FROM c GROUP BY 2 UNION ALL SELECT * FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY n DESC, skeleton) AS place,
             sum(n) OVER (PARTITION BY db_id) AS total FROM every)
SELECT db_id, skeleton, n, cast(ceil(total * 2.625 / 10000) AS bigint) AS most_wrong FROM r WHERE place <= 20
""")
def a14_heavy(spark, sf):
    """The twenty commonest templates per database and of all, out of one stored sketch per database."""
    rows = log.sql_skeletons(view(spark, sf, "v_rich_log").select("db_id", "sql"))
    sketches = written(log.template_sketches(rows, ["db_id"]), "sketches")
    of_all = log.heavy_templates(sketches, 20).withColumn("db_id", F.lit("all"))
    return log.heavy_templates(sketches, 20, ["db_id"]).unionByName(of_all)

"""Input views over the given tables, written in SQL that Spark and DuckDB both read.

Each view covers its whole tables. ``v_*`` texts may use other views; ``with_views`` turns the ones
a query needs into common table expressions for the checking engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part "
    "region supplier"
).split()

FENCE = "'```'"
NL = "chr(10)"

VIEWS: dict[str, str] = {}

# A user turn followed by an assistant turn is a question with its answer text; the others are in v_unanswered.
VIEWS["v_examples"] = """
SELECT q.conv_id * 100000 + q.turn AS example_id, q.text AS question, a.text AS sql,
       'db' || cast(q.conv_id + 5 AS string) AS db_id
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'
"""

VIEWS["v_unanswered"] = """
SELECT q.conv_id, q.turn, q.text AS question FROM conversations q
LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
WHERE q.role = 'user' AND a.conv_id IS NULL
"""

VIEWS["v_query_log"] = """
SELECT db_id, md5(sql) AS qid, sql, count(*) AS n FROM (
  SELECT concat('db', cast(l_suppkey % 10 AS string)) AS db_id,
    CASE (l_orderkey + l_linenumber) % 5
    WHEN 0 THEN concat('SELECT COUNT(*) FROM lineitem WHERE l_partkey > ', cast(l_partkey AS string))
    WHEN 1 THEN concat('SELECT l.l_returnflag, SUM(l.l_extendedprice) FROM lineitem AS l JOIN orders AS o ',
                       'ON l.l_orderkey = o.o_orderkey WHERE l.l_linestatus = ', chr(39), l_linestatus, chr(39),
                       ' AND o.o_custkey > ', cast(l_suppkey AS string), ' GROUP BY l.l_returnflag')
    WHEN 2 THEN concat('SELECT l_orderkey FROM lineitem WHERE l_suppkey = ', cast(l_suppkey AS string),
                       ' ORDER BY l_shipdate DESC LIMIT ', cast(l_linenumber AS string))
    WHEN 3 THEN concat('SELECT DISTINCT o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey ',
                       'FROM customer WHERE c_nationkey = ', cast(l_partkey % 25 AS string), ')')
    ELSE concat('SELECT AVG(l_discount) FROM lineitem WHERE l_partkey BETWEEN ', cast(l_partkey AS string),
                ' AND ', cast(l_partkey + l_linenumber AS string), ' AND l_returnflag = ', chr(39), l_returnflag, chr(39))
    END AS sql
  FROM lineitem) t
GROUP BY db_id, sql
"""

# Questions over the line items: many repeat, some lack a question, a statement or a database.
VIEWS["v_log_examples"] = """
SELECT ((l_orderkey * 1000000 + l_partkey) * 10 + l_linenumber) * 1000 + cast(l_quantity AS bigint) AS example_id,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN '' ELSE
    'Which ' || CASE l_returnflag WHEN 'A' THEN 'orders' WHEN 'N' THEN 'customer rows' ELSE 'lineitem parts' END
    || ' of supplier ' || cast(l_suppkey AS string) || ' have l_linestatus ' || chr(34) || l_linestatus || chr(34)
    || ' on line ' || cast(l_linenumber AS string) || '?' END AS question,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 6 THEN 'no idea (' ELSE
    'SELECT l_orderkey FROM lineitem WHERE l_suppkey = ' || cast(l_suppkey AS string)
    || ' AND l_linenumber = ' || cast(l_linenumber AS string) END AS sql,
  CASE WHEN l_quantity >= 48 THEN 'lost' ELSE 'db' END || cast(l_suppkey AS string) AS db_id,
  l_quantity AS quantity
FROM lineitem
"""

# One database per supplier, one table per line number, one column per part supplied there.
VIEWS["v_catalog"] = """
SELECT DISTINCT 'db' || cast(l_suppkey AS string) AS db_id, l_linenumber AS table_idx,
  'line_' || cast(l_linenumber AS string) AS table_name, cast(l_partkey AS int) AS col_idx,
  'part_' || cast(l_partkey AS string) AS col_name,
  CASE WHEN p_size < 15 THEN 'INTEGER' WHEN p_size < 30 THEN 'TEXT' WHEN p_size < 40 THEN 'DECIMAL(10,2)' END AS col_type,
  CASE WHEN p_size >= 10 THEN p_name END AS col_desc
FROM lineitem JOIN part ON p_partkey = l_partkey
"""

# Files in which databases are stored: in a folder of their own, flat, both ways, or not at all.
VIEWS["v_inventory"] = """
SELECT 'db' || cast(s_suppkey AS string) || '/db' || cast(s_suppkey AS string) || '.sqlite' AS path
FROM supplier WHERE s_acctbal > 2000
UNION ALL
SELECT 'db' || cast(s_suppkey AS string) || '.sqlite' FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000
"""

# What a model answered when asked to rephrase each question.
VIEWS["v_variations"] = """
SELECT example_id, CASE WHEN length(question) % 4 = 0 THEN 'Sorry, {"q1": no'
  WHEN length(question) % 4 = 1 THEN '{"q1": "first ' || md5(question) || '", "reasoning1": "a {b}", "q2": "second ' || md5(question) || '"}'
  ELSE 'Sure: {"q1": "one ' || md5(question) || '", "reasoning1": "x", "q2": "", "reasoning2": "y"} ok' END AS response
FROM v_examples
"""

VIEWS["v_results"] = """
SELECT o_custkey AS question_id, 'gold' AS side, o_orderpriority AS k,
       cast(floor(o_totalprice / 100000) AS bigint) AS amt
FROM orders
UNION ALL
SELECT o_custkey, 'generated', o_orderpriority, cast(floor(o_totalprice / 100000) AS bigint)
FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 250000
"""

VIEWS["v_questions"] = "SELECT c_custkey AS question_id, c_nationkey AS db_no FROM customer"

VIEWS["v_eval"] = """
SELECT d.doc_id AS question_id, d.source AS db_id, d.lang AS difficulty,
       l.quality = 1 AS is_correct, l.toxic = 0 AS valid, cast(d.n_chars AS double) / 1000 AS execution_time,
       CASE WHEN l.doc_id IS NULL THEN 'no result' END AS error
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

# Evaluation records with every optional part present in some rows and absent in others.
VIEWS["v_records_flat"] = """
SELECT event_id AS question_id,
  CASE WHEN user_id % 17 = 0 THEN NULL WHEN user_id % 19 = 0 THEN '' ELSE 'db' || cast(user_id % 10 AS string) END AS db_id,
  CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE event_type END AS difficulty,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value > 50 END AS execution_match,
  CASE WHEN event_id % 2 = 0 THEN value > 100 END AS is_correct,
  CASE WHEN event_id % 5 < 3 THEN value > 10 END AS valid,
  value > 5 AS final_valid,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'bad text' WHEN event_type = 'error' THEN '' END AS validation_error,
  CASE WHEN event_type = 'click' AND value > 120 THEN 'timeout' END AS execution_error,
  CASE WHEN event_id % 7 < 2 THEN value / 400 END AS winner_confidence,
  CASE WHEN event_id % 7 IN (1, 2, 3) THEN value / 500 END AS confidence,
  CASE WHEN event_id % 7 = 4 THEN value / 250 END AS selection_confidence,
  event_id % 7 >= 3 AS has_selection,
  CASE WHEN event_id % 6 < 4 THEN value END AS execution_time,
  CASE WHEN event_id % 4 = 2 THEN value WHEN event_id % 4 = 3 THEN value + 1 END AS time_1,
  CASE WHEN event_id % 4 = 3 THEN value * 2 END AS time_2,
  event_id % 4 > 0 AS has_times,
  CASE WHEN event_id % 9 > 0 THEN 'SELECT ' || event_type END AS round_1_sql,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' SELECT ' || event_type || ' '
       ELSE 'SELECT ' || cast(user_id AS string) END AS round_2_sql,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'SELECT ' || cast(user_id AS string) END AS generated_sql,
  CASE WHEN event_id % 8 = 0 THEN 'SELECT ' || props END AS winner_sql,
  CASE WHEN event_id % 7 = 5 THEN 'SELECT ' || event_type || ' LIMIT 1' END AS selected_sql,
  cast(event_id % 5 AS int) AS candidates_count,
  CASE WHEN event_id % 10 = 1 THEN 'SELECT alt' || cast(user_id AS string) END AS alternative_sql,
  event_id % 10 < 3 AS has_alternatives,
  event_id % 2 = 0 AS has_metrics,
  cast(event_id % 4 AS int) AS m_generated,
  CASE WHEN event_id % 6 > 0 THEN cast(event_id % 3 AS int) END AS m_valid,
  cast(event_id % 2 + event_id % 3 AS int) AS m_errors
FROM events
"""

VIEWS["v_responses"] = f"""
SELECT event_id AS id, CASE event_id % 6
  WHEN 0 THEN {FENCE} || 'json' || {NL} || props || {NL} || {FENCE}
  WHEN 1 THEN {FENCE} || {NL} || props || {NL} || {FENCE}
  WHEN 2 THEN 'Here it is: ' || props || ' as you asked' || {NL} || 'Done.'
  WHEN 3 THEN props
  WHEN 4 THEN 'It is ' || props || ', not {{this}}'
  ELSE substring(props, 1, length(props) - 1) END AS response
FROM events
"""

# Generated answers in the forms a model writes them, one per logged statement.
VIEWS["v_answers"] = f"""
SELECT db_id || ':' || qid AS answer_id, CASE ascii(qid) % 8
  WHEN 0 THEN sql
  WHEN 1 THEN '  sql: ' || sql || ';'
  WHEN 2 THEN {FENCE} || 'sql' || {NL} || sql || ';' || {NL} || {FENCE}
  WHEN 3 THEN 'Answer: Here it is' || {NL} || '-- a note' || {NL} || {NL} || '  ' || sql || '; SELECT 1;'
  WHEN 4 THEN CASE WHEN n > 1 THEN 'select ...' ELSE 'WITH ...;' END
  WHEN 5 THEN CASE WHEN n > 1 THEN '   ' END
  WHEN 6 THEN '# with a comment' || {NL} || sql || {NL} || '-- the end'
  ELSE CASE WHEN n > 1 THEN 'I cannot say; sorry' ELSE 'SELECT ' || repeat('l_orderkey, ', 400) || sql END END AS answer
FROM v_query_log
"""

# Five-section notes per order; sections are dropped, repeated or cut short by the order's fields.
VIEWS["v_notes"] = f"""
SELECT o_orderkey AS note_id,
  CASE WHEN o_orderstatus = 'F' THEN {FENCE} || {NL} ELSE '' END
  || 'Relevant Tables:' || {NL} || '- orders' || {NL}
  || CASE WHEN c_acctbal > 3000 THEN '- customer' || {NL} ELSE '' END || {NL}
  || 'RELEVANT columns:' || {NL} || '- orders: o_orderkey, o_custkey' || {NL}
  || CASE WHEN c_acctbal > 3000 THEN '- customer: c_custkey, , ' || lower(c_mktsegment) || {NL} ELSE '' END
  || CASE WHEN o_orderpriority = '1-URGENT' THEN '- orders: o_totalprice' || {NL} || '- no colon here' || {NL} ELSE '' END
  || CASE WHEN o_orderpriority = '2-HIGH' THEN 'Relevant Columns:' || {NL} || 'nation: n_name' || {NL} ELSE '' END
  || CASE WHEN c_acctbal > 3000 THEN 'Join Relationships:' || {NL} || '- orders.o_custkey = customer.c_custkey' || {NL} ELSE '' END
  || CASE WHEN o_orderstatus = 'P' THEN 'Thoughts:' || {NL} || '- nothing' || {NL} ELSE '' END
  || 'Filters / Constraints:' || {NL}
  || CASE WHEN o_orderstatus <> 'O' THEN '- o_orderstatus = ' || o_orderstatus || {NL} || '-' || {NL} ELSE '' END
  || 'Question Intent:' || {NL} || '-  find ' || o_orderpriority || ' orders ' || {NL} || 'of ' || c_name
  || CASE WHEN o_orderstatus = 'F' THEN {NL} || {FENCE} ELSE '' END AS text
FROM orders JOIN customer ON c_custkey = o_custkey
"""

VIEWS["v_scored"] = "SELECT user_id AS query_id, event_id AS id, value AS score FROM events"

# The stored tables' own columns, repeated for the databases db0..db8; db9 has no schema.
STORED_DBS = 9
CHECK_TYPES = {"BIGINT": "BIGINT", "INTEGER": "INTEGER", "VARCHAR": "TEXT", "DOUBLE": "REAL", "TIMESTAMP": "TIMESTAMP"}
STORED_CHECK = (
    "SELECT 'db' || cast(g.i AS string) AS db_id, t.* FROM (SELECT cast(dense_rank() OVER (ORDER BY table_name) - 1 AS int) "
    "AS table_idx, table_name, cast(ordinal_position - 1 AS int) AS col_idx, column_name AS col_name, CASE data_type "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CHECK_TYPES.items())
    + " ELSE 'ARRAY<FLOAT>' END AS col_type FROM information_schema.columns WHERE table_name IN ("
    + ", ".join(f"'{t}'" for t in TABLES)
    + f")) t, (SELECT unnest(range({STORED_DBS})) AS i) g"
)


def _needs(sql: str) -> list[str]:
    """Views named in ``sql``, dependencies first."""
    found: list[str] = []
    for name in re.findall(r"\bv_\w+", sql):
        if name == "v_stored":
            text = STORED_CHECK
        elif name in VIEWS:
            text = VIEWS[name]
        else:
            continue
        for dep in _needs(text) + [name]:
            if dep not in found:
                found.append(dep)
    return found


def with_views(sql: str) -> str:
    """``sql`` with the views it uses in front of it as common table expressions."""
    parts = [f"{v} AS ({(STORED_CHECK if v == 'v_stored' else VIEWS[v]).strip()})" for v in _needs(sql)]
    body = sql.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables in ``sf``."""
    sql = VIEWS[name]
    for used in set(re.findall(r"\b\w+\b", sql)):
        if used in VIEWS and used != name:
            view(spark, sf, used).createOrReplaceTempView(used)
        elif used in TABLES:
            table(spark, sf, used).createOrReplaceTempView(used)
    return spark.sql(sql)


def stored_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The view ``v_stored``: catalog rows read from the tables' file footers, per database."""
    from asklens.sources.catalog import catalog_from_tables

    rows = catalog_from_tables(spark, {t: f"{sf}/{t}.parquet" for t in TABLES}, "stored")
    dbs = F.transform(F.sequence(F.lit(0), F.lit(STORED_DBS - 1)), lambda i: F.concat(F.lit("db"), i))
    return rows.withColumn("db_id", F.explode(dbs))

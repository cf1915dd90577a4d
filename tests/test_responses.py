import pytest
from pyspark.sql import types as T

from asklens.operators import responses

FENCE = "```"


def cleaned(spark, texts, **kw):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, r string")
    return [r.clean_sql for r in responses.clean_answers(rows, "r", **kw).orderBy("i").collect()]


def test_clean_answers(spark):
    cases = {
        "SELECT a FROM b": "SELECT a FROM b",
        "  Answer:  select 1 ; select 2": "select 1 ;",
        "sql: SQL: SELECT 1": "SELECT 1",
        f"{FENCE}sql\nSELECT a\n\n  FROM b;\n{FENCE}": "SELECT a FROM b;",
        f"{FENCE}SQL\nSELECT 1\n{FENCE}": "SELECT 1",
        "Sure, here:\n# SELECT in a comment\n-- gone\n# gone too\nFROM t": "SELECT in a comment FROM t",
        "This is WITHIN reach SELECT 1": "WITHIN reach SELECT 1",
        "select ...": "", "WITH ...;": "", "With ...": "", "WITH ???": "WITH ???", "Select ???;": "",
        "": "", "   ": "", "no statement": "no statement", "a; b": "a;",
    }
    assert cleaned(spark, list(cases)) == list(cases.values())
    assert cleaned(spark, [None]) == [""]


def test_clean_answers_cuts_long_texts(spark):
    long = "SELECT " + "a, " * 2000
    (text,) = cleaned(spark, [long], limit=4000)
    assert text == long[:4000].rstrip() + ";"
    assert cleaned(spark, [long]) == [long.strip()]
    short = "SELECT " + "x" * 3993
    assert cleaned(spark, [short]) == [short]


def test_old_form_keeps_blank_lines(spark):
    assert cleaned(spark, ["SELECT a\n\nFROM b"], limit=None, keep_blank=True) == ["SELECT a  FROM b"]
    assert cleaned(spark, ["SELECT a\n\nFROM b"]) == ["SELECT a FROM b"]


def test_validation_and_choice(spark):
    rows = spark.createDataFrame([(1, "SELECT 1"), (2, "hello"), (3, "SELECT ...")], "question_id int, sql string")
    out = {r.question_id: (r.valid, r.validation_error) for r in responses.validate_answers(rows, "sql").collect()}
    assert out == {1: (True, None), 2: (False, responses.WRONG_START), 3: (False, responses.EMPTY_ANSWER)}
    first = spark.createDataFrame(
        [(1, "SELECT 1", "r1"), (2, "SELECT 2", "r2"), (3, "bad", "r3"), (4, "SELECT 4", "r4")],
        "question_id int, sql string, reasoning string")
    second = spark.createDataFrame(
        [(1, "SELECT 10", ""), (2, "oops", "s2"), (3, "", "s3"), (5, "SELECT 5", "s5")],
        "question_id int, sql string, reasoning string")
    got = {r.question_id: (r.final_sql, r.final_reasoning, r.final_valid)
           for r in responses.choose_answer(first, second).collect()}
    assert got == {1: ("SELECT 10", "r1", True), 2: ("SELECT 2", "s2", True), 3: ("bad", "s3", False),
                   4: ("SELECT 4", "r4", True), 5: ("SELECT 5", "s5", True)}


@pytest.mark.parametrize("mode", ["balanced", "greedy"])
def test_extract_json(spark, mode):
    texts = {
        "plain": '{"sql": "SELECT 1", "n": 1}',
        "fenced": FENCE + 'json\n{"sql": "a"}\n' + FENCE,
        "prose": 'Here: {"sql": "a } b", "o": {"x": [1, {"y": 2}]}} done',
        "quotes": r'{"sql": "say \"{\" and \\"} end',
        "two": '{"sql": "first"} and {"sql": "second"}',
        "after": '{"sql": "first"} as {asked}',
        "cut": '{"sql": "a"', "open": '{"sql": "a}', "list": "[1, 2]", "none": "nothing", "bad": "{sql: 1}", "null": None,
    }
    rows = spark.createDataFrame(list(texts.items()), "k string, r string")
    good, bad = responses.extract_json(rows, "r", T.StructType([T.StructField("sql", T.StringType())]), mode)
    got = {r.k: r.sql for r in good.collect()}
    expected = {"plain": "SELECT 1", "fenced": "a", "prose": "a } b", "quotes": 'say "{" and \\'}
    if mode == "balanced":
        expected |= {"two": "first", "after": "first"}
    assert got == expected
    assert {r.k for r in bad.collect()} == set(texts) - set(expected)


NOTE = """
Relevant Tables:
- Ferry
-
* Berth

RELEVANT COLUMNS :
- Ferry: id, , label
- Berth: ,
- no colon
- Ferry: built
  Sailing : fare
Join Relationships:
- Ferry.id = Landing.ferry_id
Join Relationships:
- only: this
Other:
- lost
Filters / Constraints:
Join Relationships:
- ignored
Question Intent:
-  list old ferries
- second
"""


def note_rows(spark):
    return spark.createDataFrame([(1, NOTE), (2, f"{FENCE}text\n{NOTE.strip()}\n{FENCE}"), (3, ""), (4, None)],
                                 "note_id int, text string")


def test_notes_struct(spark):
    rows = {r.note_id: r for r in responses.notes_struct(note_rows(spark), "text").collect()}
    for i in (1, 2):
        r = rows[i]
        assert r.tables == ["Ferry", "* Berth"]
        assert r.columns == {"Ferry": ["built"], "Sailing": ["fare"]}
        assert r.joins == ["only: this"] and r.filters == [] and r.intent == "list old ferries"
        assert r.raw_output == NOTE.strip()
    assert rows[3].tables == [] and rows[3].columns == {} and rows[3].intent == ""
    assert rows[4].raw_output == ""


def test_notes_long(spark):
    rows = responses.notes_long(note_rows(spark).where("note_id = 1"), "text").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.section, r.pos)):
        got.setdefault(r.section, []).append(r["item"])
    assert got == {
        "tables": ["Ferry", "* Berth"], "joins": ["only: this"], "intent": ["list old ferries", "second"],
        "columns": ["Ferry: id, , label", "Berth: ,", "no colon", "Ferry: built", "Sailing : fare"]}


def test_a_bullet_ending_in_a_colon_is_a_heading(spark):
    rows = spark.createDataFrame([(1, "Relevant Tables:\n- A\n- B:\n- C")], "note_id int, text string")
    assert responses.notes_struct(rows, "text").first().tables == ["A"]


def test_long_texts_are_read_whole(spark):
    lines = "\n".join(f"- table_{i}" for i in range(20000))
    long = "x" * 50000 + r"\"" * 5000
    rows = spark.createDataFrame(
        [(1, f"Relevant Tables:\n{lines}\nQuestion Intent:\n- done", '{"sql": "' + long + '"}')], "note_id int, text string, r string")
    note = responses.notes_struct(rows, "text").first()
    assert len(note.tables) == 20000 and note.intent == "done"
    good, _ = responses.extract_json(rows.select("note_id", "r"), "r", T.StructType([T.StructField("sql", T.StringType())]))
    assert len(good.first().sql) == 55000

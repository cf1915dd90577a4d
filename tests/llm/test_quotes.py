from asklens.llm import quotes

MESSAGES = [
    (1, 0, "How do I sort a large table?\nIt does not fit in memory."),
    (1, 1, "> How do I sort a large table?\nUse an external sort, then merge."),
    (1, 2, "> > How do I sort a large table?\n> Use an external sort, then merge.\nThanks, that works well."),
    (1, 3, ">> how do i  SORT a large table?\nNo, a hash partition is enough here."),
    (1, 4, "> nothing anyone has said before\nA new question about joins."),
    (1, 5, "> Thanks, that works well.\n> No, a hash partition is enough here.\nBoth of you are right."),
    (2, 1, "> How do I sort a large table?\nOther conversations are not looked at."),
]


def _rows(spark, rows, extra=""):
    df = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string" + extra))
    return [r.asDict() for r in df.collect()]


def test_links_threads_and_order(spark):
    rows = _rows(spark, MESSAGES)
    by = {(r["conv_id"], r["turn"]): r for r in rows}
    assert {k: r["reply_to"] for k, r in by.items()} == {
        (1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): None, (1, 5): 3, (2, 1): None}
    assert {k[1]: (r["thread"], r["level"]) for k, r in by.items() if k[0] == 1} == {
        0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (0, 1), 4: (4, 0), 5: (0, 2)}
    assert [r["turn"] for r in rows if r["conv_id"] == 1] == [0, 1, 3, 2, 5, 4]
    assert by[1, 2]["text_own"] == "Thanks, that works well." and by[1, 2]["n_quotes"] == 2
    assert by[1, 5]["n_quotes"] == 1


def test_long_chain_and_repeated_line(spark):
    said = [f"statement number {k} of the chain" for k in range(70)]
    rows = [(9, k, (f"> {said[k - 1]}\n" if k else "") + said[k] + "\nthe same signature everywhere") for k in range(70)]
    found = {r["turn"]: r for r in _rows(spark, rows)}
    assert all(found[k]["reply_to"] == k - 1 and found[k]["level"] == k and found[k]["thread"] == 0 for k in range(1, 70))


def test_awkward_rows_stay(spark):
    rows = [(None, 1, "> a quoted line here\nown"), (1, None, "text"), (1, 1, None), (1, 2, ""), (1, 2, ""), (1, 3, ">\n>> \n>"),
            (None, None, None)]
    rows = [(*r, 7) for r in rows]
    found = _rows(spark, rows, ", level int")
    assert len(found) == len(rows)
    assert sum(r["text_own"] is None for r in found) == 2
    assert [r["n_quotes"] for r in found if r["turn"] == 3] == [3]
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0


def test_many_lines_in_one_text(spark):
    text = "\n".join(f"> line number {k}" for k in range(20_000)) + "\nend"
    found = _rows(spark, [(1, 0, "line number 7"), (1, 1, text)])
    assert found[1]["reply_to"] == 0 and found[1]["n_quotes"] == 1 and found[1]["text_own"] == "end"


def test_short_lines_link(spark):
    said = ["Is it sorted?", "> Is it sorted?\nYes.", "> Yes.\nWhy?", "> Why?\n你好吗", "> 你好吗\n\nk", ">\n> \nno quote"]
    found = {r["turn"]: r for r in _rows(spark, [(1, k, text) for k, text in enumerate(said)])}
    assert [found[k]["reply_to"] for k in range(6)] == [None, 0, 1, 2, 3, None]

import re
from collections import Counter

from asklens.llm import line_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = line_rules.Rules()


def _plain(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_query_against_brute_force(spark, documents):
    want = {r["doc_id"]: _plain(r["text"]) for r in documents.collect()}
    found = queries.op10(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in found} == want
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_counts_of_odd_texts():
    for text in ("", " \n\x0b\x1c ", "a b c", "a a a a", "x y z x y z", "é ß 😀 q\n\nq\nq \n😀", "w " * 5000, "\n".join(["same line."] * 9)):
        m = line_rules.measure(text, R)
        assert tuple(m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == _plain(text)


def test_lines_and_verdict(spark):
    good = "\n".join(" ".join(f"word{k}x{j}" for j in range(8)) + "." for k in range(12))
    nav = "Home | News | Sport | Weather | Travel | Shop"
    bad = "\n".join([nav, "All rights reserved by nobody at all.", "buy### now### here###", "Menu"])
    row = line_rules.measure(good + "\n" + bad, R)
    assert row["text_clean"] == good and row["kept"]
    assert (row["n_navigation"], row["n_punctuation"], row["n_boilerplate"]) == (1, 2, 1)
    junk = line_rules.measure(good + "\n" + "\n".join(f"a{k} | b{k} | c{k} | d{k} | e{k}" for k in range(20)), R)
    assert not junk["kept"] and not junk["base_failed"] and junk["text_clean"] == good


def test_awkward_rows(awkward, nothing):
    rows = line_rules.clean_lines(awkward).collect()
    assert len(rows) == 10 and not any(r["lines"]["kept"] for r in rows)
    assert {r["lines"]["text_clean"] for r in rows if r["text"] is None} == {None}
    assert line_rules.clean_lines(nothing).count() == 0

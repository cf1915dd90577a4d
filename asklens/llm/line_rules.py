"""Line-first cleaning: rules for each line, then a verdict on what is left of the document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the verdict; counts are compared with the words of the line."""

    separators: tuple[str, ...] = ("|", "»", "›", "•", "·")
    least_separators: int = 3       # navigation: so many, and one to ``per_separator`` words
    per_separator: int = 4
    least_marks: int = 3            # punctuation: so many symbols or shouts, and one to ``per_mark`` words
    per_mark: int = 2
    fragment_words: int = 5         # punctuation: fewer words have to end like a sentence
    ends: tuple[str, ...] = (".", "!", "?", ":", ";", ",", "…", "\"", "'", ")", "]", "”", "»", "。", "！", "？")
    phrases: tuple[str, ...] = (    # boilerplate, in lower case
        "all rights reserved", "licensed under", "public license", "terms of use", "terms of service", "privacy policy",
        "cookie policy", "uses cookies", "accept cookies", "enable javascript", "lorem ipsum", "click here", "sign up for",
        "subscribe to", "skip to content", "share this", "read more", "log in to", "powered by")
    most_lost: int = 40             # percent of the words that may go
    least_words: int = 50           # base rule
    most_repeated: int = 50         # base rule: percent of words in repeated windows of three


def failed_rule(line: bytes, words: int, rules: Rules) -> str | None:
    """The first rule that a line of at least one word fails: navigation, punctuation or boilerplate."""
    bars = sum(line.count(s.encode()) for s in rules.separators)
    if bars >= rules.least_separators and bars * rules.per_separator >= words:
        return "navigation"
    marks = len(line) - len(line.translate(None, b"#*$%&<>!{}~^\\_="))
    if marks >= rules.least_marks and marks * rules.per_mark >= words:
        return "punctuation"
    if words < rules.fragment_words and not line.rstrip(WHITE).endswith(tuple(e.encode() for e in rules.ends)):
        return "punctuation"
    low = line.lower()
    if any(p.encode() in low for p in rules.phrases):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more in the text, the first included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter(map(number.setdefault, words, count()), np.int64, len(words))
    pair = ids[:-1] * len(words) + ids[1:]
    if len(words) > 1_000_000:  # three numbers no longer fit one integer
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(words) + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k:len(words) - 2 + k] |= again
    return int(hit.sum())


def measure(text: str | None, rules: Rules) -> dict:
    """Counts of one whole text, what its lines lose, and the verdict."""
    data = (text or "").encode()
    lines = data.split(b"\n")
    words, kept, full, lost, failed = [], [], [], 0, {"navigation": 0, "punctuation": 0, "boilerplate": 0}
    verdicts: dict[bytes, tuple[str | None, int]] = {}
    for line in lines:
        own = line.split()
        if not own:
            kept.append(line)
            continue
        full.append(line)
        words += own
        if line not in verdicts:
            verdicts[line] = (failed_rule(line, len(own), rules), len(own))
        why = verdicts[line][0]
        if why:
            failed[why] += 1
            lost += len(own)
        else:
            kept.append(line)
    n, repeats = len(words), repeated_words(words)
    base = n < rules.least_words or 100 * repeats > rules.most_repeated * n
    return {"n_words": n, "word_chars": len(text or "") - (len(data) - len(data.translate(None, WHITE))),
            "n_symbols": len(data) - len(data.translate(None, SYMBOLS)), "n_dup_lines": len(full) - len(verdicts),
            "n_repeat_words": repeats, "n_navigation": failed["navigation"], "n_punctuation": failed["punctuation"],
            "n_boilerplate": failed["boilerplate"], "n_words_lost": lost, "base_failed": base,
            "kept": not base and 100 * lost <= rules.most_lost * n,
            "text_clean": None if text is None else b"\n".join(kept).decode()}


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_navigation", "n_punctuation",
           "n_boilerplate", "n_words_lost")
RESULT = StructType([StructField(c, LongType()) for c in _COUNTS] + [StructField(c, BooleanType()) for c in ("base_failed", "kept")])


def clean_lines(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", out: str = "lines",
                with_text: bool = True) -> DataFrame:
    """``docs`` with the struct ``out``: counts, lines failed by rule, words lost, base_failed, kept and text_clean.

    Lines that fail a rule go; lines without words stay as they are. A document is rejected if
    it fails the base rules (too few words, too many repeated ones) or if its lines lost more than the
    allowed share of its words. ``text_clean`` (left out without ``with_text``) is the text of the lines
    that stay. Null texts have no words and a null clean text. No shuffle; a column named like ``out`` is replaced.
    """
    fields = docs.drop(out).schema.fields
    place = [f.name for f in fields].index(text_col)
    result = StructType([*RESULT.fields, *([StructField("text_clean", StringType())] if with_text else [])])
    kinds = {LongType(): pa.int64(), BooleanType(): pa.bool_(), StringType(): pa.string()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(x.as_py(), rules) for x in batch.column(place)]
            columns = [pa.array([f[c.name] for f in found], kinds[c.dataType]) for c in result.fields]
            made = pa.StructArray.from_arrays(columns, names=[c.name for c in result.fields])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return docs.drop(out).mapInArrow(rows, StructType([*fields, StructField(out, result)]))

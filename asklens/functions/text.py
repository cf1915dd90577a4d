"""Column expressions on texts; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|\n|\r"

# Characters that count as blank at the ends of a text.
BLANKS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def strip(c: Column | str) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def stripped_lines(c: Column) -> Column:
    return F.transform(F.split(c, LINE_BREAK), lambda x: strip(x))


def let(value: Column, body) -> Column:
    """Name an intermediate value so that ``body`` can use it many times but compute it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_text(c: Column) -> Column:
    """A string as a quoted JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


# Fixed values of answer clean-up: leading labels (any case) and the answers that are no answer
# (compared in upper case).
ANSWER_LABELS = ("SQL:", "SQLite:", "Query:", "Answer:")
PLACEHOLDER_ANSWERS = ("SELECT ...", "SELECT ...;", "SELECT ???", "SELECT ???;", "WITH ...", "WITH ...;")


def clean_sql(c: Column, limit: int | None = None, keep_blank: bool = False) -> Column:
    """The SQL statement inside a generated answer; empty text when there is none.

    Drops one leading label and the code fence, drops comment lines that mention neither SELECT
    nor WITH, joins the rest with blanks, starts at the first SELECT or WITH, ends after the first
    semicolon, and cuts texts over ``limit`` characters if one is given. The keyword search is a plain
    substring search in any case. ``keep_blank`` keeps blank lines as extra spaces.
    """
    text = strip(F.coalesce(c, F.lit("")))
    text = F.regexp_replace(text, r"(?i)^(?:" + "|".join(ANSWER_LABELS) + r")\s*", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^```(?:sql)?", ""), r"```$", "")
    lines = F.filter(stripped_lines(strip(text)), lambda x: (
        (F.lit(True) if keep_blank else F.length(x) > 0)
        & (x.rlike(r"(?i)SELECT|WITH") | ~x.rlike(r"^(?:#|--)"))))
    text = strip(F.array_join(lines, " "))
    text = F.regexp_replace(text, r"(?is)^.*?(?=SELECT|WITH)", "")
    text = F.regexp_replace(text, r"(?s);.*$", ";")
    if limit is not None:
        text = let(text, lambda t: F.when(F.length(t) > limit, _cut(t, limit)).otherwise(t))
    nothing = "|".join(re.escape(p) for p in PLACEHOLDER_ANSWERS)
    return strip(F.regexp_replace(text, rf"(?i)^(?:{nothing})$", ""))


def _cut(t: Column, limit: int) -> Column:
    short = F.rtrim(F.substring(t, 1, limit))
    return F.when(F.contains(short, F.lit(";")), short).otherwise(F.concat(short, F.lit(";")))

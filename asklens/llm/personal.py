"""Personal data: spans proposed by expressions, confirmed by checksums, weighed by nearby words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
# The expressions of the base kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What the method adds.
# How many characters an account number of a country has.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
IBAN = "(?i:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()) + ")"
SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
_IBAN, _SSN = re.compile("(?=[A-Za-z]{2}[0-9]{2})" + IBAN, re.ASCII), re.compile(SSN)
_BESIDE_IBAN, _BESIDE_SSN = re.compile("[A-Za-z0-9]"), re.compile("[0-9-]")
_DIGIT = re.compile("[0-9]")
SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()),
                   StructField("score", DoubleType())])


@dataclass(frozen=True)
class Weights:
    """Scores before context, what a nearby word adds, and how far it may be away in characters."""

    prior: tuple[float, ...] = (0.9, 0.6, 0.8, 0.6, 0.8, 0.3)
    context: float = 0.3
    against: float = 0.3
    reach: int = 40
    least: float = 0.5  # added kinds below it are no finding; base kinds always are
    words: tuple[tuple[str, ...], ...] = (
        ("mail", "contact", "write"), ("ip", "address", "host", "server", "login"), ("card", "visa", "credit", "payment"),
        ("phone", "call", "tel", "mobile", "fax"), ("iban", "bank", "account", "konto", "cuenta", "compte"),
        ("ssn", "social security", "taxpayer"))
    unlikely: tuple[str, ...] = ("version", "isbn", "example", "order number", "part number")


def luhn(digits: str) -> bool:
    """Whether the checksum of a card number holds."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether the checksum of an account number (letters and digits, no blanks) holds."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, in time linear in the text: from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        # What is left of this @ was looked at and cannot begin a later match beyond it.
        at = text.find("@", max(at + 1, done))


def _alone(text: str, m: re.Match, beside: re.Pattern) -> bool:
    """Whether no character of ``beside`` touches the match."""
    return not beside.match(text[m.start() - 1:m.start()]) and not beside.match(text[m.end():m.end() + 1])


def find_spans(text: str | None, weights: Weights) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; code points, end exclusive."""
    if not text:
        return []
    found = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 38:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((3, *m.span()))
        for m in _IBAN.finditer(text):
            if _alone(text, m, _BESIDE_IBAN) and mod97(m[0].replace(" ", "")):
                found.append((4, *m.span()))
        found += [(5, *m.span()) for m in _SSN.finditer(text) if _alone(text, m, _BESIDE_SSN)]
    found.sort(key=lambda f: (f[1], f[0], f[2]))
    out = []
    for kind, a, b in found:
        near = (text[max(0, a - weights.reach):a] + " " + text[b:b + weights.reach]).lower()
        score = weights.prior[kind] + weights.context * any(w in near for w in weights.words[kind]) \
            - weights.against * any(w in near for w in weights.unlikely)
        if kind < len(BASE) or score >= weights.least:
            out.append((KINDS[kind], a, b, min(1.0, max(0.0, score))))
    return out


def personal_data(docs: DataFrame, weights: Weights = Weights(), text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the array ``out`` of spans (kind, start, end, score) in each whole text.

    The four base kinds are always listed: their form and checksum decide, context moves the score alone. Account
    numbers (as long as their country's are, in either case, modulo 97) and, where context supports them, social security numbers are added. Null and empty
    texts have no spans. A column named like ``out`` is replaced. No shuffle; linear in the text.
    """
    fields = docs.drop(out).schema.fields
    place = [f.name for f in fields].index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find_spans(x.as_py(), weights)]
                     for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, out])

    return docs.drop(out).mapInArrow(rows, StructType([*fields, StructField(out, ArrayType(SPAN))]))


def redacted(docs: DataFrame, text_col: str = "text", found: str = "pii", out: str = "text_redacted") -> DataFrame:
    """``docs`` with its spans replaced by ``<kind>`` in ``out``; a span inside an earlier one goes with it."""
    fields = docs.drop(out).schema.fields
    names = [f.name for f in fields]

    def hidden(text: str | None, spans: list[dict] | None) -> str | None:
        if text is None:
            return None
        parts, at = [], 0
        for s in spans or []:
            if s["start"] >= at:
                parts += [text[at:s["start"]], f"<{s['kind']}>"]
            at = max(at, s["end"])
        return "".join([*parts, text[at:]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = (batch.column(names.index(c)).to_pylist() for c in (text_col, found))
            made = pa.array([hidden(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, out])

    return docs.drop(out).mapInArrow(rows, StructType([*fields, StructField(out, docs.schema[text_col].dataType)]))


def listed(spans: str | Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as text: kind:start:end, comma-joined; only those of ``kinds`` if given."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scores(spans: str) -> Column:
    """The scores of spans in hundredths, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.round(100 * s["score"]).cast("int")), ",")


def count_of(spans: str, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

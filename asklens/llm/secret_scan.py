"""Secrets in texts: fixed forms, and tokens that a character Markov model calls random. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asklens.session import written


def _either_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


KINDS = ("assign", "access", "hex", "random")
# The base forms. Runs of one class are asked for in the length that counts.
ASSIGN = ("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
          "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
TOKEN = "[A-Za-z0-9+/_=-]{20,}"      # what the model judges
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{9,}"
ALPHABET = 64                        # characters that a smoothed share is spread over
SMOOTH = 0.05                        # that share
LEAST_SCORE = 8_000                  # thousandths of the log-likelihood ratio that make a token a secret
SPAN = "struct<start: bigint, kind: int, end: bigint, value: string, score: bigint>"


@dataclass(frozen=True)
class Model:
    """Thousandths of log(P random / P identifier) for each pair of ASCII characters, at 128 * first + second."""

    ratios: tuple[int, ...]


def _positions(found: str, gaps: str, kind: int, value: str | None = None) -> Column:
    """Spans of the matches in the column ``found``; positions follow from the pieces of text between them.

    The arrays are walked side by side: a lambda that named them would work them out anew for every match.
    """
    value = value or found

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x[gaps]).cast("long")
        end = start + F.length(x[found]).cast("long")
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                        x[value].alias("value"), F.lit(None).cast("long").alias("score"))
        # Behind the last match there is a piece of text only.
        return F.struct(F.coalesce(end, acc["at"]).alias("at"),
                        F.when(x[found].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    columns = [gaps, found] + [value] * (value != found)
    return F.when(F.size(found) == 0, none).otherwise(F.aggregate(F.arrays_zip(*columns), start, step)["out"])


def stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base array, tokens array): base spans and the tokens outside them, written; a row per document.

    Null texts count as empty. Each expression runs once over a whole text; pieces between matches are cut
    only where there is a match.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    forms = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}
    df = df.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in forms.items()))
    df = df.select("*", *(F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"g_{k}") for k, p in forms.items()),
                   F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("values"))
    df = df.select("id", _positions("m_assign", "g_assign", 0, "values").alias("assign"),
                   _positions("m_access", "g_access", 1).alias("access"), _positions("m_hex", "g_hex", 2).alias("hex"),
                   _positions("m_token", "g_token", 3).alias("token"))
    assign = F.filter("assign", lambda s: F.length(s["value"]) >= LEAST_ASSIGNED)
    df = df.select("id", F.array_sort(F.concat(assign, "access", "hex")).alias("base"), "token")
    outside = F.filter("token", lambda t: t["value"].rlike("[A-Za-z]") & ~F.exists(
        "base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return written(df.select("id", "base", outside.alias("tokens")), "secrets")


def labelled_samples(docs: DataFrame, staged: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, label, n): distinct random strings (1, values of base spans) and ordinary identifiers (0, others).

    Identifiers are counted over all texts and combined in each task first; one that is also a part of a secret is none.
    """
    secrets = staged.select(F.explode("base").alias("s")).select(F.col("s.value").alias("token"))
    secrets = secrets.groupBy("token").agg(F.count("*").alias("n"))
    parts = secrets.select(F.explode_outer(F.regexp_extract_all("token", F.lit(IDENTIFIER), F.lit(0))).alias("token")).distinct()
    # An inner explode would search each text twice, once for the filter that it implies.
    words = docs.select(F.explode_outer(F.regexp_extract_all(F.col(text_col), F.lit(IDENTIFIER), F.lit(0))).alias("token"))
    words = words.where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n")).join(parts, "token", "left_anti")
    return secrets.select("token", F.lit(1).alias("label"), "n").union(words.select("token", F.lit(0).alias("label"), "n"))


def train(samples: DataFrame, smooth: float = SMOOTH, alphabet: int = ALPHABET) -> Model:
    """Transition probabilities of both labels from (token, label, n), and their log ratios.

    Of each probability the share ``smooth`` is spread over ``alphabet`` characters, so a pair seen in neither
    sample weighs nothing. At most 128 * 128 counts for each label come to the driver; others than
    ASCII characters are left out. Empty or missing samples give ratios from the other one alone.
    """
    raw = samples.where("length(token) > 1").select("label", "n", F.encode("token", "UTF-8").alias("b"))
    pairs = raw.select("label", "n", F.explode_outer(F.transform(
        F.sequence(F.lit(1), F.octet_length("b") - 1), lambda i: F.substring("b", i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("label", "pair").agg(F.sum("n").alias("n"))
    code = [F.ascii(F.substring("pair", k, 1).cast("string")) for k in (1, 2)]
    counts = written(counts.select("label", code[0].alias("a"), code[1].alias("b"), "n").where(
        "a BETWEEN 0 AND 127 AND b BETWEEN 0 AND 127"), "pairs")
    first = counts.groupBy("label", "a").agg(F.sum("n").alias("of"))
    share = (1 - smooth) * F.col("n") / F.col("of") + smooth / alphabet
    seen = counts.join(first, ["label", "a"]).select("label", "a", "b", share.alias("p"))
    both = seen.groupBy("a", "b").pivot("label", [1, 0]).agg(F.first("p"))
    # A first character that a label never has is taken as uniform there.
    known = first.groupBy("a").pivot("label", [1, 0]).agg(F.first("of")).select("a", F.col("1").alias("r"), F.col("0").alias("i"))
    table = both.join(known, "a").select(
        "a", "b", F.round(1000 * (F.log(_filled("1", "r", smooth, alphabet)) - F.log(_filled("0", "i", smooth, alphabet)))).cast("long").alias("w"))
    ratios = [0] * (128 * 128)
    for r in table.collect():
        ratios[128 * r["a"] + r["b"]] = r["w"]
    return Model(tuple(ratios))


def _filled(p: str, of: str, smooth: float, alphabet: int) -> Column:
    return F.coalesce(F.col(p), F.when(F.col(of).isNull(), F.lit(1 / alphabet)).otherwise(F.lit(smooth / alphabet)))


def score(token: Column, model: Model) -> Column:
    """Thousandths of the log-likelihood ratio of a token: random against identifier."""
    table = F.from_json(F.lit("[" + ",".join(map(str, model.ratios)) + "]"), "array<int>")  # folded to a constant
    raw = F.encode(token, "UTF-8")
    code = lambda i: F.ascii(F.substring(raw, i, F.lit(1)).cast("string"))
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(raw) - 1), F.lit(0).cast("long"),
                       lambda acc, i: acc + F.coalesce(F.get(table, code(i) * 128 + code(i + 1)), F.lit(0)).cast("long"))


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, least: int = LEAST_SCORE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, base array, spans array): base spans, and all spans with the tokens that look random; a row per document.

    A span has start, kind (place in ``KINDS``), end (code points, exclusive), value and, for kind random, its score.
    ``samples`` (token, label, n) train the model; without them they are taken from ``docs`` itself. Spans are ordered by
    start, then kind. Repeated rows, null ids and null texts are rows like any other.
    """
    staged = stage(docs, id_col, text_col)
    model = train(labelled_samples(docs, staged, text_col) if samples is None else samples)
    # The score of a long text's many tokens is worked out once each.
    rated = staged.select("id", "base", F.transform("tokens", lambda t: F.struct(
        t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"), t["value"].alias("value"),
        score(t["value"], model).alias("score"))).alias("tokens"))
    random = F.filter("tokens", lambda t: t["score"] >= least)
    return rated.select("id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def listed(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")

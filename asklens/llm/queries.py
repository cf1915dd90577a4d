"""Registered queries of this folder: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asklens.llm import (decontaminate, dual_tree, line_rules, mixing, personal, prefix_trie, quality, quotes, rank_bpe, secret_scan,
                         simhash, toxicity, training_order)
from asklens.llm.learning import held_out
from asklens.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``check`` is the same result in SQL."""
    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return keep


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Chat turns as mail: each quotes an earlier turn, and what that one quoted, in front of its own text.
MAIL = """
SELECT c.conv_id, c.turn, c.role,
  coalesce('>> ' || replace(g.text, chr(10), chr(10) || '> > ') || chr(10), '')
  || coalesce('> ' || replace(p.text, chr(10), chr(10) || '> ') || chr(10), '') || coalesce(c.text, '') AS text
FROM conversations c
LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 - (c.conv_id + c.turn) % 2
LEFT JOIN conversations g ON g.conv_id = p.conv_id AND g.turn = p.turn - 1 - (p.conv_id + p.turn) % 2
"""


@query("op1_quotation_linking", f"""
WITH RECURSIVE m AS ({MAIL}),
  l AS (SELECT conv_id, turn, k, regexp_extract(line, '^((?:[ \\t]*>)+)', 1) AS marks,
      CASE WHEN regexp_matches(line, '^((?:[ \\t]*>)+)') THEN regexp_replace(line, '^((?:[ \\t]*>)+)[ \\t]?', '') ELSE line END AS line
    FROM (SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line
      FROM (SELECT conv_id, turn, string_split_regex(text, '\\r?\\n') AS ls FROM m))),
  d AS (SELECT *, length(regexp_replace(marks, '[^>]', '', 'g')) AS depth,
      trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS norm FROM l),
  u AS (SELECT DISTINCT conv_id, turn, depth, norm FROM d WHERE norm <> ''),
  said AS (SELECT conv_id, norm, min(turn) AS origin FROM u WHERE depth = 0 GROUP BY ALL),
  votes AS (SELECT u.conv_id, u.turn, depth, origin, sum(length(u.norm)) AS chars
    FROM u JOIN said USING (conv_id, norm) WHERE depth > 0 AND origin < u.turn GROUP BY ALL),
  parents AS (SELECT conv_id, turn, origin AS parent FROM votes
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth, chars DESC, origin DESC) = 1),
  t AS (SELECT m.conv_id, m.turn, m.turn AS thread, 0 AS level FROM m LEFT JOIN parents p USING (conv_id, turn) WHERE parent IS NULL
    UNION ALL SELECT p.conv_id, p.turn, t.thread, t.level + 1 FROM parents p JOIN t ON p.conv_id = t.conv_id AND p.parent = t.turn),
  own AS (SELECT conv_id, turn, regexp_replace(string_agg(line, chr(10) ORDER BY k), '^\\s+|\\s+$', '', 'g') AS text_own
    FROM d WHERE depth = 0 GROUP BY ALL),
  blocks AS (SELECT conv_id, turn, count(*) AS n_quotes FROM (SELECT conv_id, turn, depth,
      lag(depth) OVER (PARTITION BY conv_id, turn ORDER BY k) AS before FROM d)
    WHERE depth > 0 AND depth IS DISTINCT FROM before GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, coalesce(n_quotes, 0) AS n_quotes, parent AS reply_to, thread, level, coalesce(text_own, '') AS text_own
FROM m LEFT JOIN parents USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn) LEFT JOIN own USING (conv_id, turn)
  LEFT JOIN blocks USING (conv_id, turn)
""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """All chat turns, written as mail that quotes earlier turns, in reply order and without the quotes."""
    mail = spark.sql(MAIL.replace("FROM conversations", "FROM {chat}").replace("JOIN conversations", "JOIN {chat}"),
                     chat=table(spark, sf, "conversations"))
    return quotes.conversations(mail).select("conv_id", "turn", "role", "n_quotes", "reply_to", "thread", "level", "text_own")


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id of its class."""
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def _secret_check() -> str:
    """Base spans, samples, transition counts and scores in the checking engine."""
    def spans(kind: int, pattern: str, group: int) -> str:
        p = _quoted(pattern)
        return (f"SELECT doc_id, {kind} AS kind, unnest(range(1, len(m) + 1)) AS k, m, g, v FROM (SELECT doc_id, "
                f"regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, {group}) AS v FROM d)")

    s = secret_scan
    all_spans = " UNION ALL ".join(
        spans(k, p, g) for k, (p, g) in enumerate(((s.ASSIGN, 2), (s.ACCESS, 0), (s.HEX, 0), (s.TOKEN, 0))))
    listed = "coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind, b){}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  raw AS ({all_spans}),
  placed AS (SELECT doc_id, kind, v[k] AS value, m[k] AS whole, list_sum(list_transform(g[1:k], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS a FROM raw),
  spans AS (SELECT doc_id, kind, value, cast(a AS bigint) AS a, cast(a + length(whole) AS bigint) AS b FROM placed),
  base AS (SELECT * FROM spans WHERE kind IN (1, 2) OR kind = 0 AND length(value) >= {s.LEAST_ASSIGNED}),
  tokens AS (SELECT * FROM spans s WHERE kind = 3 AND regexp_matches(value, '[A-Za-z]') AND NOT EXISTS (
      SELECT 1 FROM base WHERE base.doc_id = s.doc_id AND base.a < s.b AND s.a < base.b)),
  secrets AS (SELECT value AS token, count(*) AS n FROM base GROUP BY 1),
  parts AS (SELECT DISTINCT unnest(regexp_extract_all(token, {_quoted(s.IDENTIFIER)})) AS token FROM secrets),
  words AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, {_quoted(s.IDENTIFIER)})) AS token FROM d)
      WHERE token NOT IN (SELECT token FROM parts) GROUP BY 1),
  samples AS (SELECT token, 1 AS label, n FROM secrets UNION ALL SELECT token, 0, n FROM words),
  pairs AS (SELECT label, substr(token, i, 1) AS x, substr(token, i + 1, 1) AS y, sum(n) AS n
      FROM (SELECT label, token, n, unnest(range(1, length(token))) AS i FROM samples) GROUP BY ALL),
  firsts AS (SELECT label, x, sum(n) AS total FROM pairs GROUP BY ALL),
  keys AS (SELECT DISTINCT x, y FROM pairs),
  shares AS (SELECT keys.x, keys.y, l.label, CASE WHEN f.total IS NULL THEN 1.0::double / {s.ALPHABET}
        WHEN p.n IS NULL THEN {s.SMOOTH}::double / {s.ALPHABET}
        ELSE (1 - {s.SMOOTH}::double) * p.n::double / f.total::double + {s.SMOOTH}::double / {s.ALPHABET} END AS p
      FROM keys CROSS JOIN (VALUES (0), (1)) l(label) LEFT JOIN firsts f ON f.x = keys.x AND f.label = l.label
      LEFT JOIN pairs p ON p.x = keys.x AND p.y = keys.y AND p.label = l.label),
  ratios AS (SELECT x, y, cast(round(1000 * (max(CASE WHEN label = 1 THEN ln(p) END) - max(CASE WHEN label = 0 THEN ln(p) END))) AS bigint) AS w
      FROM shares GROUP BY x, y),
  scored AS (SELECT doc_id, a, b, sum(w) AS score FROM (SELECT doc_id, a, b, value, unnest(range(1, length(value))) AS i FROM tokens) t
      JOIN ratios r ON r.x = substr(value, i, 1) AND r.y = substr(value, i + 1, 1) GROUP BY ALL),
  found AS (SELECT doc_id, kind, a, b FROM base UNION ALL SELECT doc_id, 3, a, b FROM scored WHERE score >= {s.LEAST_SCORE}),
  named AS (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] AS name FROM found)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256({listed.format(" FILTER (kind < 3)")}) AS base_sha256, {listed.format("")} AS spans
FROM d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id
"""


@query("op4_secret_scan", _secret_check())
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its secrets."""
    found = secret_scan.find_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), *(secret_scan.count_of("base", k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]),
        F.sha2(secret_scan.listed("base"), 256).alias("base_sha256"), secret_scan.listed("spans").alias("spans"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its toxicity score; learnt outside the held-out fifth."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_decontamination", """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL),
  phrases AS (SELECT DISTINCT item_id, least(len(w), 13) AS width,
        list_aggregate(w[k:k + least(len(w), 13) - 1], 'string_agg', ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
  widths AS (SELECT DISTINCT width FROM phrases),
  runs AS (SELECT doc_id, width, k, list_aggregate(w[k:k + width - 1], 'string_agg', ' ') AS phrase
      FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM d, widths WHERE len(w) >= width)),
  found AS (SELECT doc_id, k, r.width, item_id FROM runs r JOIN phrases p ON p.width = r.width AND p.phrase = r.phrase),
  hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit
      FROM (SELECT doc_id, unnest(range(k, k + width)) AS place FROM found) GROUP BY doc_id),
  named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(coalesce(w, [])) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(coalesce(w, [])) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its words hit by benchmark passages."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf, "benchmark"))
    c = "contamination"
    return found.select(
        "doc_id", F.col(f"{c}.n_words").alias("n_words"), F.col(f"{c}.n_hit").alias("n_hit"),
        F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f"{c}.items"), 256).alias("items_sha256"),
        decontaminate.contaminated(c).alias("contaminated"))


@query("op7_source_mixing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the words that the mix takes of it, in all and for each output shard."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken",
                                   mixing.words_by_shard("pieces").alias("shard_words"))


@query("op6_training_order")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as token sequences in training order, each at its slot, shard and byte offset."""
    return training_order.materialise(table(spark, sf, "documents").select("doc_id", "text"))


@query("op8_quality")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its quality score; learnt outside the held-out fifth."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels"))
    return quality.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _personal_check() -> str:
    """Spans, checksums and context in the checking engine."""
    w = personal.Weights()
    forms = ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "[0-9]([\\x20-]?[0-9])+",
             "\\+[0-9][\\x20().0-9-]+[0-9]", personal.IBAN, personal.SSN)
    spans = " UNION ALL ".join(
        f"SELECT doc_id, t, {k} AS kind, unnest(range(1, len(m) + 1)) AS k, m, g FROM (SELECT doc_id, t, "
        f"regexp_extract_all(t, {_quoted(p)}) AS m, string_split_regex(t, {_quoted(p)}) AS g FROM d)" for k, p in enumerate(forms))
    near = lambda words: "(" + " OR ".join(f"contains(near, {_quoted(x)})" for x in words) + ")"
    score = " ".join(f"WHEN {k} THEN {w.prior[k]} + {w.context} * {near(words)}::int - {w.against} * {near(w.unlikely)}::int"
                     for k, words in enumerate(w.words))
    listed = "coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind, b){}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  raw AS ({spans}),
  placed AS (SELECT doc_id, t, kind, m[k] AS s, cast(list_sum(list_transform(g[1:k], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS bigint) AS a FROM raw),
  found AS (SELECT doc_id, kind, s, a, cast(a + length(s) AS bigint) AS b, regexp_replace(s, '[^0-9]', '', 'g') AS digits,
      upper(replace(s, ' ', '')) AS code, CASE WHEN a > 0 THEN substr(t, a, 1) ELSE '' END AS before, substr(t, a + length(s) + 1, 1) AS after,
      lower(substr(t, greatest(a - {w.reach}, 0) + 1, a - greatest(a - {w.reach}, 0)) || ' ' || substr(t, a + length(s) + 1, {w.reach})) AS near
      FROM placed),
  checked AS (SELECT *, CASE kind {score} END AS score, list_sum(list_transform(range(0, length(digits)), lambda k: CASE
        WHEN k % 2 = 0 THEN cast(substr(digits, length(digits) - k, 1) AS int)
        WHEN cast(substr(digits, length(digits) - k, 1) AS int) > 4 THEN 2 * cast(substr(digits, length(digits) - k, 1) AS int) - 9
        ELSE 2 * cast(substr(digits, length(digits) - k, 1) AS int) END)) % 10 = 0 AS luhn,
      CASE WHEN kind = 4 THEN list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr(code, 5) || substr(code, 1, 4), ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE cast(ascii(c) - 55 AS varchar) END), ''), ''),
        lambda c: cast(c AS int)), lambda x, y: (x * 10 + y) % 97) = 1 END AS mod97 FROM found),
  kept AS (SELECT *, [{", ".join(f"'{k}'" for k in personal.KINDS)}][kind + 1] AS name FROM checked WHERE kind = 0
    OR (kind = 1 AND list_bool_and(list_transform(string_split(s, '.'), lambda p: length(ltrim(p, '0')) <= 3
        AND coalesce(try_cast(ltrim(p, '0') AS int), 0) <= 255)))
    OR (kind = 2 AND length(digits) BETWEEN 12 AND 19 AND luhn) OR (kind = 3 AND length(digits) BETWEEN 9 AND 15)
    OR (kind = 4 AND NOT regexp_matches(before || after, '[A-Za-z0-9]') AND mod97 AND score >= {w.least})
    OR (kind = 5 AND NOT regexp_matches(before || after, '[0-9-]')
        AND score >= {w.least}))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{n}" for k, n in enumerate(personal.BASE))},
  sha256({listed.format(" FILTER (kind < 4)")}) AS base_sha256, {listed.format("")} AS spans,
  coalesce(string_agg(cast(round(100 * least(1, greatest(0, score))) AS int), ',' ORDER BY a, kind, b) FILTER (kind IS NOT NULL), '') AS scores
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""


@query("op9_personal_data", _personal_check())
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its spans of personal data."""
    found = personal.personal_data(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *(personal.count_of("pii", k).alias(f"n_{k}") for k in personal.BASE),
        F.sha2(personal.listed("pii", personal.BASE), 256).alias("base_sha256"), personal.listed("pii").alias("spans"), personal.scores("pii").alias("scores"))


def _line_check() -> str:
    """Counts and line rules in the checking engine, from the same thresholds and phrases."""
    r = line_rules.Rules()
    word, letters = "'[^ \\t-\\r]+'", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    count = lambda text, chars: f"length(regexp_replace({text}, {_quoted('[^' + chars + ']')}, '', 'g'))"
    ends = _quoted("[" + "".join(e.replace("]", "\\]") for e in r.ends) + "][ \\t-\\r]*$")
    phrases = " OR ".join(f"contains(translate(line, {letters}), {_quoted(p)})" for p in r.phrases)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, t, regexp_extract_all(t, {word}) AS w FROM d),
  lines AS (SELECT doc_id, line, len(regexp_extract_all(line, {word})) AS n
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
  rated AS (SELECT *, {count("line", "".join(r.separators))} AS bars, {count("line", "#*$%&<>!{}~^" + chr(92) * 2 + "_=")} AS marks FROM lines WHERE n > 0),
  judged AS (SELECT doc_id, line, n, (bars >= {r.least_separators} AND bars * {r.per_separator} >= n)
      OR (marks >= {r.least_marks} AND marks * {r.per_mark} >= n)
      OR (n < {r.fragment_words} AND NOT regexp_matches(line, {ends})) OR ({phrases}) AS failed FROM rated),
  by_line AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (failed), 0) AS lost FROM judged GROUP BY doc_id),
  windows AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k], w[k + 1], w[k + 2]) AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
  repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + 3)) AS place FROM windows WHERE c > 1) GROUP BY doc_id),
  counted AS (SELECT doc_id, cast(len(w) AS bigint) AS n_words, {count("t", " " + chr(92) + "t-" + chr(92) + "r").replace("[^", "[")} AS word_chars,
      {count("t", "#*$%&|<>")} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
    FROM w LEFT JOIN by_line USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
  failed AS (SELECT *, n_words < {r.least_words} OR 100 * n_repeat_words > {r.most_repeated} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost <= {r.most_lost} * n_words AS kept FROM failed
"""


@query("op10_line_rules", _line_check())
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its counts and the verdict of the line rules."""
    found = line_rules.clean_lines(table(spark, sf, "documents").select("doc_id", "text"), with_text=False)
    return found.select("doc_id", *(f"lines.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


@query("op13_bpe_round")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    vocabulary = rank_bpe.Vocabulary.read()
    encoded = rank_bpe.encode(table(spark, sf, "documents"), vocabulary, keep=["doc_id"])
    found = rank_bpe.decode(encoded, vocabulary)
    return found.select("doc_id", F.col("encoded.n_tokens").alias("n_tokens"), F.sha2(F.col("encoded.ids"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def _code_check() -> str:
    """Six rounds of nearest entries and floored means in the checking engine, without trees."""
    nearest = """
  a{0} AS MATERIALIZED (SELECT r, part, min(gap * 1000 + e) % 1000 AS e, min(gap * 1000 + e) // 1000 AS gap
      FROM (SELECT r, p.part, e, list_sum(list_transform(list_zip(x, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS gap
        FROM p JOIN b{0} b ON b.part = p.part) GROUP BY r, part)"""
    means = """
  b{1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.b) AS b FROM b{0} b LEFT JOIN (
      SELECT part, e, list(cast(floor(total / n) AS bigint) ORDER BY pos) AS x FROM (
        SELECT part, e, pos, sum(c) AS total, count(*) AS n FROM (
          SELECT p.part, a.e, unnest(x) AS c, unnest(range(len(x))) AS pos FROM p JOIN a{0} a ON a.r = p.r AND a.part = p.part)
        GROUP BY ALL) GROUP BY part, e) m ON m.part = b.part AND m.e = b.e)"""
    rounds = ",".join(nearest.format(k) + "," + means.format(k, k + 1) for k in range(dual_tree.ROUNDS))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: cast(floor({dual_tree.SCALE} * cast(x AS double)) AS bigint)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS MATERIALIZED (SELECT r, vec_id, k AS part, v[k * (len(v) // {dual_tree.PARTS}) + 1:(k + 1) * (len(v) // {dual_tree.PARTS})] AS x
      FROM v, range({dual_tree.PARTS}) parts(k)),
  b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS b FROM p
      QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {dual_tree.ENTRIES}),
  {rounds},{nearest.format(dual_tree.ROUNDS)},
  coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, sum(gap)::bigint AS error FROM a{dual_tree.ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error,
  (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY part, e)) FROM b{dual_tree.ROUNDS}) AS codebooks_sha256
FROM v JOIN coded USING (r)
"""


@query("op12_vector_codes", _code_check())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Every usable vector with its code, error, the error of its label and the codebooks' digest."""
    coded, made = dual_tree.compress(table(spark, sf, "embeddings"))
    coded = written(coded, "codes")
    by_label = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["own"])).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(made.digest).alias("codebooks_sha256"))


@query("op11_prefix_trie", """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
      PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
  sizes AS (SELECT c, count(*) AS n FROM t GROUP BY c),
  convs AS (SELECT c, xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(c::varchar, ''),
        lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda r, x: xor(xor(r, x) >> 1, CASE WHEN xor(r, x) & 1 = 1 THEN 3988292384 ELSE 0 END)),
      4294967295) % 9 AS h FROM sizes),
  r AS (SELECT v.c, t.i AS d, role, text FROM convs v JOIN t ON t.c = v.c - v.c % 5 AND t.i <= h
    UNION ALL SELECT v.c, t.i - h + least(h, coalesce(b.n, 0)), role, text FROM convs v JOIN t ON t.c = v.c AND t.i > h
      LEFT JOIN sizes b ON b.c = v.c - v.c % 5),
  paths AS (SELECT c, 0 AS d, []::struct(role varchar, text varchar)[] AS k, 0 AS b FROM convs
    UNION ALL SELECT c, d, list(struct_pack(role, text)) OVER (PARTITION BY c ORDER BY d), strlen(text) FROM r),
  nodes AS MATERIALIZED (SELECT k, d, count(*) AS n, min(c) AS c, any_value(b) AS b FROM paths GROUP BY k, d),
  children AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
  below AS (SELECT k[1:j] AS k, sum(saved) AS saved, sum(leaf) AS leaves FROM (
      SELECT k, (n - 1) * b AS saved, (k NOT IN (SELECT k FROM children))::int AS leaf, unnest(range(0, d + 1)) AS j FROM nodes) GROUP BY 1),
  ends AS (SELECT k, string_agg(c::varchar, ',' ORDER BY c) AS ids FROM (
      SELECT c, k FROM paths QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY k)
SELECT a.c AS conv_id, a.d AS depth, p.c AS parent_conv_id, a.n AS n_convs, coalesce(ch.n, 0) AS n_children, leaves::bigint AS n_leaves,
  saved::bigint AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes a LEFT JOIN nodes p ON a.d > 0 AND p.d = a.d - 1 AND p.k = a.k[1:a.d - 1] LEFT JOIN children ch ON ch.k = a.k
  JOIN below ON below.k = a.k LEFT JOIN ends ON ends.k = a.k
""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))

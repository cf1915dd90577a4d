"""Token edit distance between templates, worked out by the engine's own ``levenshtein`` over coded templates.

Every token becomes one character, so a template is a short text. Templates are cut into cells by length and
blocks of bounded size; a block of queries travels as one array, and a pair exists only between two
operators of the same task. Before a distance is worked out, lengths and sets of tokens must allow one within the bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asklens.operators.log import template_tokens
from asklens.operators.similarity import _cheapest
from asklens.session import written

QUERY_BLOCK = 256
CORPUS_BLOCK = 1024
_BITS = 63  # of a template's set of tokens


def coded_templates(rows: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, skeleton, code, len, bag): each template's tokens as characters, their number, and the set of them as bits."""
    flat = rows.select(key, F.posexplode("payload").alias("at", "token")).join(vocabulary, "token")
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "char"))), lambda x: x["char"]), "")
    made = flat.groupBy(key).agg(code.alias("code"), F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(number, {_BITS}) AS int))")).alias("bag"))
    return rows.join(made, key, "left").select(
        key, "skeleton", F.coalesce("code", F.lit("")).alias("code"), F.size("payload").alias("len"),
        F.coalesce("bag", F.lit(0)).cast("long").alias("bag"))


def token_characters(*tables: DataFrame) -> DataFrame:
    """(token, number, char): a character for every token of the tables' ``payload``, in order of tokens, surrogates left out.

    Templates are masked, so their tokens are the words of the language and a few placeholders; a million different ones have a character each.
    """
    tokens = tables[0].select(F.explode("payload").alias("token"))
    for more in tables[1:]:
        tokens = tokens.union(more.select(F.explode("payload").alias("token")))
    numbered = tokens.distinct().withColumn("number", F.row_number().over(Window.orderBy("token")).cast("long"))
    point = F.col("number") + 255 + F.when(F.col("number") + 255 >= 0xD800, 0x800).otherwise(0)
    return numbered.withColumn("char", F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def _cell(length: Column) -> Column:
    """Lengths up to 64 are cells of their own; longer ones share cells 10 % wide."""
    wide = 64 + F.ceil(F.log(F.greatest(length, F.lit(1)) / 64.0) / float(np.log(1.1)))
    return F.when(length <= 64, length).otherwise(wide).cast("int")


def _routes(asked: DataFrame, templates: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(len, cell, least, home) and (cell, n): where queries of a length look first, and the least cost anywhere else.

    The nearest cells by length that hold ``n`` templates together are home. There is a cell for each tenth of length.
    """
    cells = templates.groupBy("cell").agg(F.count("*").alias("n"), F.min("len").alias("lo"), F.max("len").alias("hi"))
    listed = cells.agg(F.collect_list(F.struct("cell", "n", "lo", "hi")).alias("cells"))
    by_length = asked.select("len").distinct().withColumn("cells", listed.scalar())
    each = by_length.select("len", F.explode("cells").alias("c")).select("len", "c.*")
    shorter = F.greatest(F.col("lo") - F.col("len"), F.lit(0)) / F.greatest("lo", F.lit(1))
    longer = F.greatest(F.col("len") - F.col("hi"), F.lit(0)) / F.greatest("len", F.lit(1))
    each = each.withColumn("least", F.greatest(shorter, longer).cast("double"))
    before = Window.partitionBy("len").orderBy("least", "cell").rowsBetween(Window.unboundedPreceding, -1)
    routes = each.withColumn("home", F.coalesce(F.sum("n").over(before), F.lit(0)) < n)
    return routes.select("len", "cell", "least", "home"), cells.select("cell", "n")


def _scored(sent: DataFrame, templates: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, id, cost) within each query's ``bound`` (null: any), for queries sent to cells.

    ``sent`` is (cell, query_id, code, len, bag, bound). Blocks of queries and of templates of a cell meet in pairs of blocks. These are few
    bytes and much work, so they are dealt to a fixed number of tasks, which adaptive execution does not merge.
    """
    spark = sent.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sizes = sent.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq")).join(
        cells.select("cell", F.ceil(F.col("n") / CORPUS_BLOCK).cast("int").alias("nt")), "cell")
    items = F.collect_list(F.struct("query_id", "code", "len", "bag", "bound")).alias("items")
    blocks = sent.join(sizes, "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")).groupBy(
        "cell", "qb", "nt").agg(items).select("cell", "qb", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)).alias("tb"), "items")
    dealt = templates.join(sizes, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.pmod(F.xxhash64("id"), F.col("nt")).cast("int").alias("tb"),
        "id", F.col("code").alias("b"), F.col("len").alias("lb"), F.col("bag").alias("yb"))
    place = ["cell", "qb", "tb"]
    pairs = dealt.repartition(tasks, *place).join(blocks.repartition(tasks, *place), place).select("id", "b", "lb", "yb", F.explode("items").alias("q")).select(
        "id", "b", "lb", "yb", F.col("q.query_id").alias("query_id"), F.col("q.code").alias("a"), F.col("q.len").alias("la"),
        F.col("q.bag").alias("ya"), F.col("q.bound").alias("bound"))
    longest = F.greatest("la", "lb", F.lit(1))
    most = F.when(F.col("bound").isNull(), longest).otherwise(F.floor(F.col("bound") * longest + 1e-9)).cast("int")
    # One edit changes the set of tokens by two at most.
    pairs = pairs.withColumn("most", most).where("abs(la - lb) <= most AND bit_count(ya ^ yb) <= 2 * most")
    return pairs.withColumn("d", F.expr("levenshtein(a, b, most)")).where("d >= 0").select(
        "query_id", "id", (F.col("d") / longest).alias("cost"))


def edit_top_n(queries: DataFrame, candidates: DataFrame, n: int, mode: str = "compat") -> DataFrame:
    """(query_id, id, score, rank): candidates by token edit similarity 1 - distance / longer length.

    ``queries`` is (query_id, skeleton) and ``candidates`` (id, skeleton). Only distinct
    templates are compared: a template is represented by its n smallest ids, which is all that
    can be among the best n of any query. A query first meets the templates of about its length, which bounds the cost of its
    n-th neighbour; of the others it then meets those whose length and tokens allow as little. Nothing is cut off
    without that proof. Rows without a skeleton are left out.
    """
    queries, candidates = queries.where("skeleton IS NOT NULL"), candidates.where("skeleton IS NOT NULL")
    by_id = Window.partitionBy("skeleton").orderBy("id")
    members = candidates.select("id", "skeleton").withColumn("_m", F.row_number().over(by_id)).where(
        F.col("_m") <= n).drop("_m")
    tokens = template_tokens(F.col("skeleton"), mode)
    kept = written(candidates.groupBy("skeleton").agg(F.min("id").alias("id")).select("id", "skeleton", tokens.alias("payload")), "templates")
    wanted = written(queries.groupBy("skeleton").agg(F.min("query_id").alias("query_id")).select(
        "query_id", "skeleton", tokens.alias("payload")), "asked")
    vocabulary = token_characters(kept, wanted)
    templates = written(coded_templates(kept, vocabulary, "id").withColumn("cell", _cell(F.col("len"))), "coded")
    asked = written(coded_templates(wanted, vocabulary, "query_id"), "coded")
    routes, cells = _routes(asked, templates, n)
    payload = ["query_id", "code", "len", "bag"]
    first = asked.join(routes.where("home"), "len").select("cell", *payload, F.lit(None).cast("double").alias("bound"))
    near = written(_cheapest(_scored(first, templates, cells), n), "near")
    # A query that met fewer than n templates has no bound and visits every cell.
    limit = near.groupBy("query_id").agg(F.max("cost").alias("bound"), F.count("*").alias("_k")).where(F.col("_k") >= n).drop("_k")
    rest = asked.join(limit, "query_id", "left").join(routes.where("NOT home"), "len").where("bound IS NULL OR least <= bound + 1e-9")
    far = _scored(rest.select("cell", *payload, "bound"), templates, cells)
    best = _cheapest(near.drop("rank").unionByName(far), n)
    # Template -> its member examples, ranked once per distinct query template.
    best = best.join(templates.select("id", "skeleton"), "id").select("query_id", "skeleton", "cost")
    ranked = _cheapest(best.join(members, "skeleton").select("query_id", "id", "cost"), n)
    ranked = ranked.join(asked.select("query_id", "skeleton"), "query_id").drop("query_id")
    return queries.select("query_id", "skeleton").join(ranked, "skeleton").select(
        "query_id", "id", (1.0 - F.col("cost")).alias("score"), "rank")

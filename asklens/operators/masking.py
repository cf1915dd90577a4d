"""Question templates and their text vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The placeholders of a question template.
ENTITY, ATTRIBUTE, VALUE = "[ENTITY]", "[ATTRIBUTE]", "[VALUE]"

# Quoted texts, numbers, words, or one other character.
_PIECE = r"\"[^\"]*+\"|'[^']*+'(?![\p{L}])|\d++(?:[.,]\d++)*+|[\p{L}_][\p{L}\p{N}_'’-]*+|\s++|."


def question_pieces(question: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("(?s)" + _PIECE), F.lit(0))


def _words(question: Column) -> Column:
    """The distinct lower-cased words of a question."""
    return F.array_distinct(F.transform(
        F.filter(question_pieces(question), lambda p: p.rlike(r"^[\p{L}_]")), lambda p: F.lower(p)))


def word_counts(examples: DataFrame) -> DataFrame:
    """(w, df): in how many questions each word occurs."""
    seen = examples.select(F.explode_outer(_words(F.col("question"))).alias("w")).where(F.col("w").isNotNull())
    return seen.groupBy("w").agg(F.count(F.lit(1)).alias("df"))


def question_skeletons(examples: DataFrame, catalog: DataFrame, min_df: int = 2, words: DataFrame | None = None) -> DataFrame:
    """Add ``question_skeleton``: values, entities and attributes replaced by placeholders.

    Numbers and quoted texts are values; words naming a table of the example's database are
    entities, words naming a column are attributes, and other words that occur in fewer than
    ``min_df`` questions are entities. All other words stay.

    One aggregation with map-side combine counts each word and for ``min_df`` 2 carries the smallest
    id that it occurs in, the only one of a rare word. So rare words travel back as one short list per
    example, and frequent words are never joined. A larger ``min_df`` finds the rare words first and joins
    them to the words; each has fewer than ``min_df`` ids.

    With ``words``, the stored ``word_counts`` of a corpus, that corpus alone decides which words are rare, so a question's
    template does not depend on the others asked with it.
    """
    names = catalog.groupBy("db_id").agg(
        F.collect_set(F.lower("table_name")).alias("_tables"), F.collect_set(F.lower("col_name")).alias("_columns"))
    pieces = question_pieces(F.col("question"))
    seen = examples.select("example_id", F.explode_outer(_words(F.col("question"))).alias("w")).where(F.col("w").isNotNull())
    if words is not None:
        ids = None
    elif min_df == 2:
        ids = F.array(F.min("example_id"))
    else:
        # Lists are bounded while they grow: only words below the limit keep their ids.
        few = seen.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") < min_df).select("w")
        seen, ids = seen.join(few, "w"), F.collect_list("example_id")
    if words is not None:
        rare = seen.join(words.where(F.col("df") >= min_df).select("w"), "w", "left_anti")
    else:
        counted = seen.groupBy("w").agg(F.count(F.lit(1)).alias("df"), ids.alias("ids")).where(F.col("df") < min_df)
        rare = counted.select("w", F.explode_outer("ids").alias("example_id"))
    rare = rare.groupBy("example_id").agg(F.collect_set("w").alias("_rare"))
    none = F.array().cast("array<string>")

    def shown(p: Column) -> Column:
        word = F.lower(p)
        return (
            F.when(p.rlike(r"^(?:\d|\"|'.)"), VALUE)
            .when(F.array_contains(F.coalesce("_tables", none), word), ENTITY)
            .when(F.array_contains(F.coalesce("_columns", none), word), ATTRIBUTE)
            .when(F.array_contains(F.coalesce("_rare", none), word), ENTITY)
            .otherwise(p))

    # The texts meet the short lists as they are and are cut again here.
    known = examples.join(rare, "example_id", "left").join(names, "db_id", "left")
    masked = F.regexp_replace(F.array_join(F.transform(pieces, shown), ""), r"\s+", " ")
    return known.select(*examples.columns, F.trim(masked).alias("question_skeleton"))


def fit_vectors(texts: DataFrame, col: str, dim: int = 384) -> PipelineModel:
    """The weights by rarity of hashed words and word pairs, fitted in one pass; ``save`` and ``load`` store them."""
    stages = [
        RegexTokenizer(inputCol=col, outputCol="_w", pattern=r"\[[A-Z]+\]|[\p{L}\p{N}_]+", gaps=False, toLowercase=False),
        NGram(n=2, inputCol="_w", outputCol="_g"),
        SQLTransformer(statement="SELECT *, concat(_w, _g) AS _wg FROM __THIS__"),
        HashingTF(inputCol="_wg", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_v", p=2.0),
    ]
    return Pipeline(stages=stages).fit(texts.where(F.col(col).isNotNull()))


def text_vectors(texts: DataFrame, col: str, dim: int = 384, weights: PipelineModel | None = None) -> DataFrame:
    """Add ``embedding``: unit vectors of hashed words and word pairs weighted by rarity.

    ``weights`` are those of ``fit_vectors`` on a column of the same name; without them they are fitted to the given texts, ``dim`` buckets.
    Texts that are NULL are left out.
    """
    fitted = weights or fit_vectors(texts, col, dim)
    known = texts.where(F.col(col).isNotNull())
    return fitted.transform(known).select(*texts.columns, vector_to_array("_v", "float32").alias("embedding"))

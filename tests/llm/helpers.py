"""Small tables with every hard case: nulls in any column, empty and long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven quiet birds watch from an old stone wall near the river".split()
LONG = " ".join(WORDS[(i * 7 + i // 13) % len(WORDS)] + str(i % 97) for i in range(60_000))

HARD = [
    (1, "a plain text of several words that nobody copies anywhere else today", "en", "web", 66),
    (1, "a plain text of several words that nobody copies anywhere else today", "en", "web", 66),
    (2, None, "en", "web", None),
    (3, "", None, None, 0),
    (4, LONG, "en", None, len(LONG)),
    (None, "password = hunter2hunter2 and some more words follow here", "en", "web", 57),
    (None, None, None, None, None),
    (5, "123 456 ---", "de", "books", 11),
    (6, "naïve café \U0001f600 İstanbul line é ﬀ", "fr", "books", 30),
    (7, "x", "en", "web", 1),
    (8, LONG, "en", "web", len(LONG)),
]


def hard_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HARD, DOCS)


def clashing(docs: DataFrame) -> DataFrame:
    """The same documents beside columns named as the operators name their own."""
    from pyspark.sql import functions as F

    for name in ("spans", "bands", "bucket", "label", "class_id", "ids", "_text", "weight", "probability", "sampled", "tokens", "held_out", "score", "rank", "a", "b", "text_a", "distance", "digest", "license", "_digest", "sections", "part", "v", "id", "n", "salt", "n_tokens"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)

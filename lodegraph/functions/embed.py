"""Hashed bag-of-words embeddings in built-in functions: stems and stem pairs land on signed dimensions by sha256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import stem


def grams(text: Column) -> Column:
    """Stems of camel-case words and numbers, then neighbouring pairs of them."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][a-z0-9]*|[0-9]+)"), 1), lambda w: stem(F.lower(w)))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.concat(words, pairs)


def slot(gram: Column, dims: int) -> Column:
    """struct(idx, sign) of the first 64 bits of the gram's digest."""
    head = F.substring(F.sha2(gram, 256), 1, 16)
    number = F.conv(head, 16, 10).cast("decimal(20,0)")
    return F.struct((number % dims).cast("int").alias("idx"), F.when(F.substring(head, 1, 1) >= "8", -1.0).otherwise(1.0).alias("sign"))


def sparse_embedding(df: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """key, idx, weight: one row for each dimension of a text that isn't 0, with unit length."""
    slots = df.select(key, F.explode(F.transform(grams(F.col(text)), lambda g: slot(g, dims))).alias("s"))
    sums = slots.groupBy(key, F.col("s.idx").alias("idx")).agg(F.sum("s.sign").alias("v")).where("v != 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norms, key).select(key, "idx", (F.col("v") / F.col("norm")).alias("weight"))


def dense_embedding(text: Column, dims: int) -> Column:
    """The same as an array, without leaving the row."""
    slots = F.transform(grams(text), lambda g: slot(g, dims))
    zero = F.array_repeat(F.lit(0.0), dims)
    total = F.aggregate(slots, zero, lambda acc, s: F.transform(acc, lambda x, i: F.when(i == s["idx"], x + s["sign"]).otherwise(x)))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(total, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def content_key(model: str, dims: int, text: Column) -> Column:
    """Key of an embedding cache."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(dims)), text), 256)

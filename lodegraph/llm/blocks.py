"""Vector searches in blocks: rows and queries are dealt into parts, large parts are salted into blocks of bounded size,
and each pair of a row block and a query block of a part is one task's work."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries that one block holds, about.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096


def finite(column: str) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~bad


def matrix(column: pa.Array | pd.Series, width: int | None = None) -> np.ndarray:
    """Vectors of one width as a float64 matrix."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, width or 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, width or 0))


def bounded_sample(vectors: DataFrame, rows: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the rows of smallest hashed ids: at most `rows`, wherever they are."""
    picked = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows).select("id", "v").toArrow()
    ids = picked.column("id").to_numpy().astype(np.int64)
    return ids, matrix(picked.column("v").combine_chunks()) if len(ids) else np.zeros((0, 0))


def search(rows: DataFrame, queries: DataFrame, counts: dict[int, int], asked: dict[int, int], work: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, largest: bool, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: of what `work` finds in each pair of blocks, the best k of each query.

    rows: part, id, v. queries: part, id, v and, if `work` takes it as the last argument, floor; a row for each part that
    a query visits. counts, asked: their numbers by part (a bounded number of parts). Each row block goes to every query block of its part and the other way round."""
    spark, extra = rows.sparkSession, [c for c in queries.columns if c == "floor"]
    parts = [(p, -(-counts[p] // BLOCK_ROWS), -(-asked.get(p, 0) // BLOCK_QUERIES)) for p in sorted(counts) if asked.get(p)]
    plan = F.broadcast(spark.createDataFrame(parts or [(-1, 1, 1)], "part int, row_blocks int, query_blocks int"))
    salt = lambda n: F.pmod(F.xxhash64("id", F.lit(11)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(plan, "part").withColumn("qb", salt("query_blocks")).withColumn("rb", every("row_blocks")).select("part", "rb", "qb", "id", "v", *extra)
    right = rows.join(plan, "part").withColumn("rb", salt("row_blocks")).withColumn("qb", every("query_blocks")).select("part", "rb", "qb", "id", "v")

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        a, b, s = work(q["id"].to_numpy(np.int64), matrix(q["v"]), x["id"].to_numpy(np.int64), matrix(x["v"]), *(q[c].to_numpy(np.float64) for c in extra))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    found = left.groupBy("part", "rb", "qb").cogroup(right.groupBy("part", "rb", "qb")).applyInPandas(run, f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc() if largest else F.col("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row, -inf never, ties to smaller ids; rows ascending, best first."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        r, c = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]

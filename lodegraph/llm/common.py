"""What several corpus operators share: table access, text chunks as code point arrays, 64-bit hashing."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of text that one numpy step handles at once; a longer text is a step of its own.
CHUNK_CHARS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder. In local mode, as in tests, one is set where none is; a cluster
    without one is an error, since a folder of one machine is no use there."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints/lodegraph")


#: Rows of a table of a few longs that one checkpoint file should hold, where their number is known beforehand.
FILE_ROWS = 100_000


_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut lineage in the shared checkpoint folder (never a local checkpoint). `rows`: a bound on the rows, if known, so
    that small tables don't become many small files. The shuffle files behind the table go as soon as it is written, not
    when the driver happens to collect garbage; a task that should still ask for one has it made anew."""
    checkpoint_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP_SETTING, None)
    conf.set(_CLEANUP_SETTING, "true")
    try:  # a plan takes the setting when it is made
        out = df.select("*") if rows is None else df.coalesce(1 + rows // FILE_ROWS)
        return out.checkpoint(eager=True)
    finally:
        conf.unset(_CLEANUP_SETTING) if before is None else conf.set(_CLEANUP_SETTING, before)


#: Bytes of rows that go to a Python worker at a time. Rows vary too much in length to be bounded by their number.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of about BATCH_BYTES; a longer row is a batch of its own. The bound is a setting of the
    session, made here and left so; a session that names one of its own keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def spans_of(lengths: Iterable[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Split rows into consecutive ranges of about `limit` characters; every row is in exactly one."""
    start = total = i = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start and total >= 0:
        yield start, i + 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Nulls count as empty texts."""
    return [t or "" for t in batch.column(column).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case code point, and whether it is a letter or a digit."""
    lower, word = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN" or kind == "M":
            word[cp] = True
            if len(low := chr(cp).lower()) == 1:
                lower[cp] = ord(low)
    return lower, word


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of letters, marks and digits, in lower case), and the words in each text."""
    lower, is_word = word_tables()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = code_points("".join(texts))
    inside = is_word[cps]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    firsts = edges[:-1][sizes > 0]
    new[firsts] = inside[firsts]  # a word never runs on into the next text
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = np.flatnonzero(new[at])
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    mixed = mix64(lower[cps[at]].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21)))
    hashes = mix64(np.add.reduceat(mixed, starts))
    counts = np.diff(np.searchsorted(at[starts], edges))
    return hashes, counts


def rows_like(schema_source: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch's own columns, then the given ones."""
    names = [n for n in schema_source.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([schema_source.column(n) for n in names] + list(columns.values()), names=names + list(columns))


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Lists of the given lengths over one flat array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

"""Byte-level BPE encoding and decoding.

Texts become arrays of code point classes. Each class is a transition function over the pre-tokeniser's states, and
functions compose, so one associative scan over a whole chunk of texts gives the state before every character and with
it every token boundary, without a regular expression. The slices between boundaries feed a cache of pair merges.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lodegraph.llm.common import code_points, list_array, map_texts, spans_of, texts_of

#: Entries of the merge cache; it is emptied when full, which changes speed but no result.
CACHE_PIECES = 400_000
#: Texts of so many characters are encoded in one scan.
SCAN_CHARS = 250_000

LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, SPACES, LAST_SPACE, LAST_WHITE = range(8)
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
FREE, IN_LETTERS, IN_NUMBER, IN_OTHER, AFTER_SPACE, IN_SPACES, ONE_LEFT, TWO_LEFT = range(8)


@lru_cache(1)
def class_table() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACES by code point, by tiktoken's own Unicode version: whoever encodes must have it."""
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        out[_members(name)] = kind
    out[WHITE] = SPACES
    return out


def _members(category: str) -> list[int]:
    from tiktoken import Encoding

    points = [cp for cp in range(0x110000) if not 0xD800 <= cp < 0xE000]
    engine = Encoding(category, pat_str=rf"\p{{{category}}}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return list(map(ord, bytes(engine.encode_ordinary("".join(map(chr, points)))).decode()))


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The pre-tokeniser's next state, and whether a token starts at this character."""
    if state in (ONE_LEFT, TWO_LEFT):
        return (ONE_LEFT if state == TWO_LEFT else FREE), False
    other = kind in (OTHER, QUOTE2, QUOTE3)
    if state == IN_LETTERS and kind == LETTER or state == IN_NUMBER and kind == NUMBER or state == IN_SPACES and kind == SPACES:
        return state, False
    if state == IN_OTHER and other or state == AFTER_SPACE and other:
        return IN_OTHER, False
    if state == AFTER_SPACE and kind in (LETTER, NUMBER):
        return (IN_LETTERS if kind == LETTER else IN_NUMBER), False
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBER, OTHER: IN_OTHER, QUOTE2: ONE_LEFT, QUOTE3: TWO_LEFT, SPACES: IN_SPACES, LAST_SPACE: AFTER_SPACE, LAST_WHITE: FREE}[kind], True


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(functions as rows of states, composition table, function of each of 16 symbols, boundary by state and symbol).

    Symbols 8 to 15 are the classes at the first character of a text; they forget the state before."""
    steps = [[_step(s if k < 8 else FREE, k % 8) for s in range(8)] for k in range(16)]
    starts = np.array([[b or k >= 8 for _, b in row] for k, row in enumerate(steps)], bool).T.copy()
    known: dict[tuple[int, ...], int] = {}
    letters = [known.setdefault(tuple(s for s, _ in row), len(known)) for row in steps]
    todo = list(known)
    for f in todo:
        for g in [tuple(s for s, _ in row) for row in steps]:
            if (h := tuple(g[s] for s in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    functions = np.array(list(known), np.uint8)
    compose = np.array([[known[tuple(int(g[s]) for s in f)] for g in functions] for f in functions], np.uint16)
    return functions, compose, np.array(letters, np.uint16), starts


def symbols(cps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The scan's symbol of each character: its class, after looking at the next characters of its text."""
    kinds = class_table()[cps]
    n = len(cps)
    ends = np.cumsum(sizes)
    last = np.zeros(n, bool)
    last[ends[sizes > 0] - 1] = True
    follow = np.append(kinds[1:], SPACES)
    white = kinds == SPACES
    stays = white & (follow != SPACES) & ~last
    quote = np.flatnonzero((cps == 0x27) & ~last)
    if len(quote):
        b = cps[quote + 1]
        kinds[quote[np.isin(b, [ord(c) for c in "stmd"])]] = QUOTE2
        more = quote[~last[quote + 1]]
        b, c = cps[more + 1], cps[more + 2]
        kinds[more[((b == 114) | (b == 118)) & (c == 101) | (b == 108) & (c == 108)]] = QUOTE3
    kinds[stays] = np.where(cps[stays] == 0x20, LAST_SPACE, LAST_WHITE)
    first = (ends - sizes)[sizes > 0]
    kinds[first] += 8
    return kinds


def boundaries(cps: np.ndarray, sizes: np.ndarray, width: int = 128) -> np.ndarray:
    """Where tokens start, in the joined texts, by an associative scan of composed transition functions."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    functions, compose, letter, starts = monoid()
    m = len(functions)
    flat = compose.reshape(-1)
    kinds = symbols(cps, sizes)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint16)
    padded[:n] = letter[kinds]
    scan = padded.reshape(rows, width).T.copy()
    for j in range(1, width):  # within each block
        scan[j] = flat[scan[j - 1].astype(np.int32) * m + scan[j]]
    total, step = scan[-1].copy(), 1
    while step < rows:  # over blocks
        total[step:] = flat[total[:-step].astype(np.int32) * m + total[step:]]
        step *= 2
    entry = np.zeros(rows, np.uint8)
    entry[1:] = functions[total[:-1], FREE]
    after = functions[scan, entry].T.reshape(-1)[:n]
    before = np.empty(n, np.uint8)
    before[0] = FREE
    before[1:] = after[:-1]
    return np.flatnonzero(starts[before, kinds])


class Vocabulary:
    """Ranks of byte strings, as in a tiktoken file; ids are ranks."""

    def __init__(self, tokens: dict[bytes, int]):
        self.ranks = tokens
        self.single = [tokens.get(bytes([b]), -1) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError("a byte-level vocabulary holds every byte")
        self.pairs: dict[int, int] = {}
        for token, rank in tokens.items():
            for i in range(1, len(token)):
                a, b = tokens.get(token[:i]), tokens.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        top = max(tokens.values()) + 1
        by_id = [b""] * top
        for token, rank in tokens.items():
            by_id[rank] = token
        self.sizes = np.fromiter(map(len, by_id), np.int64, top)
        self.ends = np.cumsum(self.sizes)
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.decimal = list(map(str, range(top)))
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of lowest rank, the leftmost of several, until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        ids = [self.single[b] for b in piece]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, none = self.pairs.get, 1 << 60
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | best, none)
            if at < len(ranks):
                ranks[at] = get(best << 32 | ids[at + 1], none)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same by a heap over a linked list, in n log n steps."""
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = rank, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if (r := get(rank << 32 | ids[right[j]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[right[j]]))
            if left[i] >= 0 and (r := get(ids[left[i]] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, left[i], ids[left[i]], rank))
        return tuple(x for x, live in zip(ids, alive) if live)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids in each text, ids in each pre-token)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        begin = boundaries(code_points(joined), sizes)
        cuts = [*begin.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
        found = list(map(self.cache.get, pieces))
        if None in found:
            if len(self.cache) > CACHE_PIECES:
                self.cache.clear()
            put = self.cache
            for i, x in enumerate(found):
                if x is None:
                    x = put.get(pieces[i])
                    if x is None:
                        x = put[pieces[i]] = self.merge(pieces[i].encode("utf-8"))
                    found[i] = x
        each = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(each.sum()))
        upto = np.append(0, np.cumsum(each))
        edges = np.searchsorted(begin, np.append(0, np.cumsum(sizes)))
        return ids, np.diff(upto[edges]), each

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids, gathered by the offsets of their tokens."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, np.uint8)
        shift = (self.ends[ids] - sizes) - (ends - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(ends[-1])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


@lru_cache(2)
def _vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())})


class SharedVocabulary:
    """The driver reads the file; executors get its bytes (under MAX_BYTES) once each and build tables on first use."""

    MAX_BYTES = 64 << 20

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            data = file.read(self.MAX_BYTES + 1)
        if len(data) > self.MAX_BYTES:
            raise ValueError(f"{path} exceeds {self.MAX_BYTES} bytes")
        self.data = spark.sparkContext.broadcast(data)

    def get(self) -> Vocabulary:
        return _vocabulary(self.data.value)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _parts(batch: pa.RecordBatch, texts: list[str], limit: int = SCAN_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for a, b in spans_of(map(len, texts), limit):
        yield batch.slice(a, b - a), texts[a:b]


def encode_batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, flat ids, ids in each row) for each scan."""
    for batch in batches:
        if batch.num_rows:
            for rows, texts in _parts(batch, texts_of(batch)):
                ids, counts, _ = vocabulary.encode(texts)
                yield rows, ids, counts


def encode_columns(docs: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """These columns of each document, and `ids` array<int>, in place of one of that name; a null or empty text has an
    empty array. Rows are not moved."""
    shared = SharedVocabulary(docs.sparkSession, path or default_path())
    columns = [c for c in columns if c != "ids"]
    hidden = "_text"
    while hidden in columns:
        hidden += "_"
    own = docs.select(*columns, F.col("text").cast("string").alias(hidden))
    schema = docs.select(*columns).schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _parts(batch, texts_of(batch, hidden)):
                ids, counts, _ = shared.get().encode(texts)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), list_array(ids, counts)], names=[*columns, "ids"])

    return map_texts(own, run, schema)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and `ids` of each document, as encode_columns."""
    return encode_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], path)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and `data` binary of each row of doc_id, `ids`; null ids decode to no bytes."""
    shared = SharedVocabulary(encoded.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            data = [shared.get().decode(np.asarray(x.values, np.int64)).tobytes() if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return map_texts(encoded.select("doc_id", "ids"), run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens and the digests of the ids and of their decoded bytes, encoding and decoding in one pass.

    Null and empty texts have 0 tokens and the digest of nothing; repeated rows give repeated results; other columns of
    the input play no part. The ids are decoded by themselves: the text isn't looked at again."""
    shared = SharedVocabulary(docs.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.get()
        name = vocabulary.decimal.__getitem__
        for rows, ids, counts in encode_batches(batches, vocabulary):
            ends = np.cumsum(counts).tolist()
            data = vocabulary.decode(ids)
            cuts = np.append(0, np.cumsum(vocabulary.sizes[ids]))[np.append(0, np.cumsum(counts))].tolist()
            listed = ids.tolist()
            of_ids = [hashlib.sha256(",".join(map(name, listed[b - int(n) : b])).encode()).hexdigest() for b, n in zip(ends, counts)]
            of_data = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_data)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

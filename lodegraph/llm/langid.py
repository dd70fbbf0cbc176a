"""Language identification by interpolated Kneser-Ney character models.

One model of 4-grams per language. Counts come from all training text, in one distributed pass, and each model keeps all
of its 4-grams: what the driver and executors receive grows with the number of different ones. Models are stored
together: for each order one sorted array of 64-bit hashes, beside a row of log probabilities per language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import code_points, map_texts, mix64, spans_of, texts_of

ORDER = 4
#: A language with fewer documents than this takes the rejection limit of all languages together.
OWN_LIMIT_DOCS = 8
#: The quantile behind a limit is off by at most one rank in so many.
QUANTILE_ACCURACY = 100_000
#: A counting task hands its sums on when it holds so many 4-grams.
HELD_GRAMS = 1_500_000
SCORE_SYMBOLS = 32
BLANK = 32
_LOW = [np.uint64((1 << 16 * n) - 1) for n in range(5)]


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """16-bit symbol by code point: letters and marks in lower case, all else the blank. Letters beyond the basic plane
    share the private use area."""
    out = np.full(0x110000, BLANK, np.uint16)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] in "LM":
            low = chr(cp).lower()
            low = ord(low) if len(low) == 1 else cp
            out[cp] = low if low < 0x10000 else 0xE000 + low % 0x1900
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram ending at each symbol of all texts, symbols in each text). Runs of blanks are one; a text starts after
    blanks and, if it holds a letter, ends with one."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    symbols = symbol_table()[code_points("\n".join(texts) + "\n")]
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    ends = np.cumsum(sizes)
    before[ends - sizes] = BLANK
    keep = np.flatnonzero((symbols != BLANK) | (before != BLANK))
    x = symbols[keep].astype(np.uint64)
    edges = np.searchsorted(keep, np.append(0, ends))
    counts = np.diff(edges)
    code, first = x.copy(), edges[:-1][counts > 0]
    for back in range(1, ORDER):
        lag = np.full_like(x, BLANK)
        lag[back:] = x[:-back]
        for offset in range(back):
            at = first + offset
            lag[at[at < len(lag)]] = BLANK
        if len(first):  # short texts: an offset may have fallen into the next text, whose own offsets cover it
            code |= lag << np.uint64(16 * back)
    return code, counts


def _sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.add.reduceat(counts, at) if len(at) else counts


def count_grams(training: DataFrame) -> DataFrame:
    """lang, code, n: how often each 4-gram ends a position of all the language's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, n = _sums(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))
                for i in range(0, len(codes), 200_000):
                    part = slice(i, i + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes[part])), pa.array(codes[part].view(np.int64)), pa.array(n[part])], names=["lang", "code", "n"])

        for batch in batches:
            texts, langs = texts_of(batch), batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for a, b in spans_of(map(len, own)):
                    codes, n = np.unique(grams(own[a:b])[0], return_counts=True)
                    held.setdefault(lang, []).append((codes, n))
                    size += len(codes)
            if size > HELD_GRAMS:
                held = {lang: [_sums(np.concatenate([c for c, _ in p]), np.concatenate([n for _, n in p]))] for lang, p in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
            if size > HELD_GRAMS:
                yield from rows()
                held, size = {}, 0
        yield from rows()

    return map_texts(training.select("lang", "text"), run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Hashes:
    """A sorted array of hashes; a table by their leading bits says where to begin."""

    keys: np.ndarray
    first: np.ndarray
    shift: np.uint64

    @staticmethod
    def of(codes: np.ndarray) -> tuple[Hashes, np.ndarray]:
        """Also the order of the codes in the array."""
        keys = mix64(codes)
        order = np.argsort(keys)
        keys = keys[order]
        bits = max(1, int(len(keys)).bit_length())
        first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        return Hashes(np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF)), first, np.uint64(64 - bits)), order

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there)."""
        h = mix64(codes)
        at = self.first[(h >> self.shift).astype(np.int32)]
        for _ in range(2):
            at += self.keys[at] < h
        rest = np.flatnonzero(self.keys[at] < h)
        while len(rest):
            at[rest] += 1
            rest = rest[self.keys[at[rest]] < h[rest]]
        last = len(self.keys) - 1
        return at, (self.keys[at] == h) & (at < last)


class KneserNey:
    """All languages' models over shared keys."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        k = len(self.langs)
        types: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {ORDER: [_sums(*counts[lang]) for lang in self.langs]}
        for n in range(ORDER - 1, 0, -1):  # below the top, how many different symbols go before
            types[n] = [tuple(np.unique(codes & _LOW[n], return_counts=True)) for codes, _ in types[n + 1]]
        self.order: dict[int, tuple[Hashes, np.ndarray]] = {}
        self.backoff: dict[int, tuple[Hashes, np.ndarray]] = {}
        alphabet = np.unique(np.concatenate([c for c, _ in types[1]])) if k else np.zeros(0, np.uint64)
        self.unigram = np.zeros((k, 1 << 16))
        for i, (codes, n) in enumerate(types[1]):
            d, total = _discount(n), n.sum()
            self.unigram[i] = d * len(n) / total / (len(alphabet) + 1)
            self.unigram[i, codes.astype(np.int64)] += np.maximum(n - d, 0) / total
        self.unigram = np.log(np.maximum(self.unigram, 1e-12)).astype(np.float32)
        for n in range(2, ORDER + 1):
            union = np.unique(np.concatenate([c for c, _ in types[n]])) if k else np.zeros(0, np.uint64)
            contexts = np.unique(union >> np.uint64(16))
            keys, order = Hashes.of(union)
            context_keys, context_order = Hashes.of(contexts)
            lower = self._log(n - 1, union & _LOW[n - 1])
            p, back = np.zeros((k, len(union)), np.float32), np.zeros((k, len(contexts)), np.float32)
            for i, (codes, c) in enumerate(types[n]):
                d = _discount(c)
                at = np.searchsorted(contexts, codes >> np.uint64(16))
                total, kinds = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
                weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
                back[i] = np.log(weight)
                of = np.searchsorted(contexts, union >> np.uint64(16))
                x = weight[of] * np.exp(lower[i].astype(np.float64))
                x[np.searchsorted(union, codes)] += np.maximum(c - d, 0) / total[at]
                p[i] = np.log(np.maximum(x, 1e-12))
            self.order[n] = keys, np.ascontiguousarray(p[:, order])
            self.backoff[n] = context_keys, np.ascontiguousarray(back[:, context_order])

    def _log(self, n: int, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each n-gram after the others: a row for each language."""
        if n == 1:
            return self.unigram[:, codes.astype(np.int64)]
        keys, p = self.order[n]
        at, hit = keys.find(codes)
        out = p[:, np.minimum(at, p.shape[1] - 1)] if p.shape[1] else np.zeros((len(self.langs), len(codes)), np.float32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[:, miss] = self._unseen(n, codes[miss])
        return out

    def _unseen(self, n: int, codes: np.ndarray) -> np.ndarray:
        keys, back = self.backoff[n]
        at, hit = keys.find(codes >> np.uint64(16))
        weight = np.where(hit, back[:, np.minimum(at, back.shape[1] - 1)], 0) if back.shape[1] else 0
        return weight + self._log(n - 1, codes & _LOW[n - 1])

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per symbol by text and language, symbols of each text); texts without letters have 0 symbols."""
        codes, counts = grams(texts)
        out = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(counts)
        if not len(full) or not self.langs:
            return out, counts
        starts = (np.cumsum(counts) - counts)[full]
        keys, p = self.order[ORDER]
        at, hit = keys.find(codes)
        miss = np.flatnonzero(~hit)
        at[miss] = 0
        rest = self._unseen(ORDER, codes[miss]) if len(miss) else None
        for i in range(len(self.langs)):
            each = p[i][at]
            if rest is not None:
                each[miss] = rest[i]
            out[full, i] = -np.add.reduceat(each, starts, dtype=np.float64) / counts[full]
        return out, counts


def _discount(n: np.ndarray) -> float:
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 0.5


@dataclass
class LanguageModel:
    """`mean` and `limit` by language: what cross-entropy true texts have, and how far beyond the mean (times the root
    of the length) one may be."""

    models: KneserNey
    mean: np.ndarray
    limit: np.ndarray

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        ce, counts = self.models.cross_entropy(texts)
        n = len(texts)
        if not self.models.langs:
            return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        best = ce.argmin(1)
        rows = np.arange(n)
        gap = (ce - ce[rows, best][:, None]) * np.minimum(counts, SCORE_SYMBOLS)[:, None]
        score = 1 / np.exp(-gap).sum(1)
        none = counts == 0
        own = ce[rows, best]
        rejected = none | ((own - self.mean[best]) * np.sqrt(np.maximum(counts, 1)) > self.limit[best])
        names = [("und" if x else self.models.langs[b]) for b, x in zip(best.tolist(), none.tolist())]
        return names, np.where(none, 0.0, np.round(score, 6)), np.where(none, 0.0, own), rejected


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == 0, F.lit(False))


def fit(docs: DataFrame) -> LanguageModel:
    """Models of all languages in `docs` (doc_id, text, lang); rows with null text or lang are left out.

    Counts cover all rows, and every counted 4-gram is kept. Limits of rejection: twice the 0.999 quantile of the
    standardised cross-entropy of all the language's documents with a letter; languages of fewer than OWN_LIMIT_DOCS of
    them take mean and limit of the documents of all languages."""
    spark = docs.sparkSession
    training = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    table = count_grams(training).toPandas()
    models = KneserNey({lang: (g["code"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy(np.int64)) for lang, g in table.groupby("lang")})
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {x: i for i, x in enumerate(shared.value.langs)}
        for batch in batches:
            texts, langs = texts_of(batch), batch.column("lang").to_pylist()
            for a, b in spans_of(map(len, texts)):
                ce, n = shared.value.cross_entropy(texts[a:b])
                own = np.array([names.get(x, -1) for x in langs[a:b]])
                ok = (n > 0) & (own >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(ce[ok, own[ok]]), pa.array(n[ok])], names=["lang", "ce", "n"])

    seen = map_texts(training, run, "lang long, ce double, n long").persist()
    k = len(models.langs)
    sums = {r["lang"]: r for r in seen.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.col("ce") * F.col("n")).alias("nats"), F.sum("n").alias("n")).collect()}
    common = sum(r["nats"] for r in sums.values()) / max(sum(r["n"] for r in sums.values()), 1)
    own = [i in sums and sums[i]["docs"] >= OWN_LIMIT_DOCS for i in range(k)]
    mean = np.array([sums[i]["nats"] / sums[i]["n"] if own[i] else common for i in range(k)], float)

    def limit_of(centre: Column) -> Column:
        return 2 * F.greatest(F.percentile_approx((F.col("ce") - centre) * F.sqrt("n"), 0.999, QUANTILE_ACCURACY), F.lit(1.0))

    limit = np.full(k, np.inf)
    if not all(own):
        limit[:] = seen.agg(limit_of(F.lit(common))).first()[0]
    if any(own):
        means = F.get(F.array(*[F.lit(float(m)) for m in mean]), F.col("lang").cast("int"))
        for r in seen.groupBy("lang").agg(limit_of(means).alias("limit")).collect():
            if own[r["lang"]]:
                limit[r["lang"]] = r["limit"]
    seen.unpersist()
    return LanguageModel(models, mean, limit)


def _judged(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    for batch in batches:
        texts = texts_of(batch)
        for a, b in spans_of(map(len, texts)):
            yield batch.slice(a, b - a), model.judge(texts[a:b])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected of each document, from its whole text alone.

    lang_pred is `und` (score 0, rejected) if the text is null or holds no letter, or nothing was learned. Among equal
    cross-entropies the alphabetically first language is taken. score is the winner's share when each language weighs
    exp(-cross-entropy x symbols), at most 32 symbols counted. Repeated rows give repeated results, other columns play
    no part; rows aren't moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (names, score, ce, rejected) in _judged(batches, shared.value):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names), pa.array(score), pa.array(ce), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents, as they are, that the models don't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (_, _, _, rejected) in _judged(batches, shared.value):
            yield rows.filter(pa.array(~rejected))

    return map_texts(docs, run, docs.schema)

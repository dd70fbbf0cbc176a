"""Mixing sources to target weights: iterative proportional fitting of token weights to source, language and topic
marginals, then sampling of documents by calibrated probabilities.

A cell is a combination of source, language and topic that occurs. Raking gives each value of a dimension one factor, so
the weight of a token is the product of three factors. The cells stay a table; the driver holds factors and marginals,
whose number is that of the dimensions' values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodegraph.llm.common import cut, map_texts, spans_of, texts_of, word_hashes

TOLERANCE, MAX_ROUNDS = 1e-8, 500
#: Raking ends where so many rounds haven't brought the marginals nearer to the targets by a hundredth.
PATIENCE = 25
#: A table of so many values or fewer is broadcast; a longer one is joined by a shuffle with salted keys.
BROADCAST_VALUES = 50_000
SALTS = 16
#: Topics are learned from words hashed to so many buckets.
TOPIC_BUCKETS, TOPICS, TOPIC_ROUNDS = 512, 12, 12
#: Topics are learned on vectors in whole steps of 1 / UNIT: their products and sums are exact, so no order changes them.
UNIT = float(1 << 20)


@dataclass(frozen=True)
class Marginal:
    """Target shares of one column's values. `shares` names values (None is null) and their shares; the others divide
    what is left, in proportion to their tokens' share to `power` (1: as they are, 0: all alike)."""

    name: str
    shares: tuple[tuple[str | None, float], ...] = ()
    power: float = 1.0

    def of(self, values: list[str | None], tokens: np.ndarray) -> np.ndarray:
        """Targets of the values that occur, scaled to sum to 1; a value without tokens has none."""
        named = dict(self.shares)
        free = np.array([v not in named for v in values], bool) & (tokens > 0)
        own = np.where(free, tokens / max(tokens.sum(), 1), 1.0) ** self.power * free
        rest = max(0.0, 1 - sum(named.values()))
        out = own / max(own.sum(), 1e-300) * rest
        out += [named.get(v, 0.0) if t > 0 else 0.0 for v, t in zip(values, tokens)]
        return out / max(out.sum(), 1e-300)


@dataclass(frozen=True)
class MixTarget:
    """The marginals to meet, the share of all tokens that the sample should hold, and the seed of the sample."""

    marginals: tuple[Marginal, ...] = (
        Marginal("source", power=0.7),
        Marginal("lang", (("en", 0.5), ("fr", 0.17), ("de", 0.17), ("es", 0.12))),
        Marginal("topic", power=0.5),
    )
    keep: float = 0.6
    seed: int = 17


# topics -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TopicModel:
    """Spherical k-means over hashed words. `weight`: of each bucket; `centres`: unit vectors, the largest topic first."""

    weight: np.ndarray
    centres: np.ndarray

    def topic(self, counts: np.ndarray) -> np.ndarray:
        """The nearest centre of each row of `hashed`, -1 for rows without words; ties to the larger topic."""
        x = counts * self.weight
        if not len(self.centres):
            return np.full(len(x), -1)
        return np.where((counts != 0).any(1), (x @ self.centres.T).argmax(1), -1)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words in each bucket by text, words of each text)."""
    words, counts = word_hashes(texts)
    slot = np.repeat(np.arange(len(texts)), counts) * TOPIC_BUCKETS + (words % np.uint64(TOPIC_BUCKETS)).astype(np.int64)
    return np.bincount(slot, minlength=len(texts) * TOPIC_BUCKETS).reshape(len(texts), TOPIC_BUCKETS).astype(np.float32), counts


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    return spans_of(len(t) + 500 for t in texts)


def counted(docs: DataFrame) -> DataFrame:
    """The word counts by bucket of all documents with words, in blocks: of each the filled buckets, their counts, and how
    many buckets each document fills, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in _slices(texts):
                counts, _ = hashed(texts[a:b])
                row, slot = np.nonzero(counts)
                if not len(row):
                    continue
                n, size = counts[row, slot], np.bincount(row)
                data = [slot.astype(np.uint16), n.astype(np.uint8 if n.max() < 256 else np.float32), size[size > 0].astype(np.uint16)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in data], names=["slot", "n", "size"])

    return map_texts(docs.select(F.col("text").cast("string").alias("text")), run, "slot binary, n binary, size binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of `counted` as matrices (documents x buckets)."""
    for batch in batches:
        for slot, n, size in zip(*(batch.column(c).to_pylist() for c in ("slot", "n", "size"))):
            each = np.frombuffer(size, np.uint16)
            out = np.zeros((len(each), TOPIC_BUCKETS))
            out[np.repeat(np.arange(len(each)), each), np.frombuffer(slot, np.uint16)] = np.frombuffer(n, np.uint8 if 2 * len(n) == len(slot) else np.float32)
            yield out


def units(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of word counts, in whole steps of 1 / UNIT."""
    x = counts * weight.astype(np.float64)
    return np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * UNIT)


def fit_topics(docs: DataFrame, topics: int = TOPICS) -> TopicModel:
    """Topics of `docs` (text), learned on every document with words, copies too; fewer where fewer documents differ.

    Weights come from the buckets' document frequencies. The first centre is the document whose vector is the smallest in
    order, each next one that whose nearest centre is the farthest (ties to the smallest vector); rounds of k-means over
    all documents follow, until nothing moves or after TOPIC_ROUNDS. Word counts are written once; each round sums them in
    parallel, and only centres go to the driver."""
    blocks = cut(counted(docs))

    def summed(size: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of what `work` makes of one: `size` whole numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size, np.int64)
            for counts in _blocks(batches):
                out += work(counts).astype(np.int64)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["k", "x"])

        got, out = blocks.mapInArrow(run, "k long, x long").groupBy("k").agg(F.sum("x").alias("x")).toArrow(), np.zeros(size, np.int64)
        out[got.column("k").to_numpy()] = got.column("x").to_numpy()
        return out

    *found, n, filled = summed(TOPIC_BUCKETS + 2, lambda x: np.concatenate([(x > 0).sum(0), [len(x), (x > 0).sum()]]))
    weight = np.log((1 + n) / (1 + np.array(found))).astype(np.float32) + np.float32(0.01)
    # a task reads 4 MB or so where that makes no more tasks than cores, otherwise up to 64 MB
    blocks = blocks.coalesce(int(1 + max(min(3 * filled >> 22, docs.sparkSession.sparkContext.defaultParallelism), 3 * filled >> 26)))

    def farthest(centres: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least: tuple[float, bytes] | None = None
            for counts in _blocks(batches):
                x = units(counts, weight)
                near = (x @ centres.T).max(1, initial=0.0)
                if least is None or near.min() <= least[0]:
                    here = min(v.tobytes() for v in x[near == near.min()].astype(">i4"))
                    least = min((float(near.min()), here), least or (np.inf, b""))
            if least:
                yield pa.RecordBatch.from_arrays([pa.array([least[0]]), pa.array([least[1]], pa.binary())], names=["near", "v"])

        return np.frombuffer(blocks.mapInArrow(run, "near double, v binary").orderBy("near", "v").first()["v"], ">i4").astype(np.float64)

    centres = np.zeros((0, TOPIC_BUCKETS))
    while n and len(centres) < topics:
        new = farthest(centres)
        if (centres == new).all(1).any():  # all documents lie on centres
            break
        centres = np.concatenate([centres, [new]])

    def nearest(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = units(counts, weight)
        return x, np.eye(len(centres))[(x @ centres.T).argmax(1)]

    def total(counts: np.ndarray) -> np.ndarray:
        x, of = nearest(counts)
        return (of.T @ x).reshape(-1)

    for _ in range(TOPIC_ROUNDS if n else 0):
        sums = summed(centres.size, total).reshape(centres.shape).astype(np.float64)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        before, centres = centres, np.where(norm > 0, np.rint(sums / np.maximum(norm, 1) * UNIT), centres)
        if (before == centres).all():
            break
    size = summed(len(centres), lambda counts: nearest(counts)[1].sum(0)) if n else np.zeros(0)
    return TopicModel(weight, (centres[np.argsort(-size, kind="stable")] / UNIT).astype(np.float32))


def measured(docs: DataFrame, tokens: str, topic: str | None, model: TopicModel | None = None) -> DataFrame:
    """The rows with the column `tokens`, words of the text (runs of letters, marks and digits), and, if named, `topic`:
    t0, t1 ... by the model, `none` for texts without words, null for a null text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(tokens, LongType()), *([StructField(topic, StringType())] if topic else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            absent = batch.column("text").is_null().to_pylist()
            for a, b in _slices(texts):
                part = batch.slice(a, b - a)
                if topic:
                    counts, n = hashed(texts[a:b])
                    of = shared.value.topic(counts).tolist()
                    extra = [pa.array(n), pa.array([None if none else "none" if i < 0 else f"t{i}" for i, none in zip(of, absent[a:b])], pa.string())]
                else:
                    extra = [pa.array(word_hashes(texts[a:b])[1])]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=schema.names)

    return map_texts(docs, run, schema)


# raking -------------------------------------------------------------------------------------------------------------


def _joined(rows: DataFrame, key: str, table: DataFrame, few: bool) -> DataFrame:
    """`rows` with the columns of `table` (its `key` is unique, null is a value) that have the row's key."""
    theirs = table.withColumnRenamed(key, f"{key}_of")
    same = F.col(key).eqNullSafe(F.col(f"{key}_of"))
    if few:
        return rows.join(F.broadcast(theirs), same, "left").drop(f"{key}_of")
    salted = rows.withColumn(f"{key}_salt", (F.rand(7) * SALTS).cast("int"))
    theirs = theirs.withColumn(f"{key}_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(theirs, same & (F.col(f"{key}_salt") == F.col(f"{key}_at")), "left").drop(f"{key}_of", f"{key}_salt", f"{key}_at")


@dataclass
class Raked:
    """values, factors, tokens, targets, reached, wanted of each marginal: arrays over the dimension's values. A row's
    weight is the product of its values' factors; min(1, scale * weight) is its probability."""

    names: list[str]
    values: list[list[str | None]]
    factors: list[np.ndarray]
    targets: list[np.ndarray]
    reached: list[np.ndarray]
    wanted: list[dict[str | None, float]]
    rounds: int
    scale: float

    @property
    def gap(self) -> float:
        """How far, at most, a share that was reached is from its target."""
        return float(max((np.abs(r - t).max(initial=0) for r, t in zip(self.reached, self.targets)), default=0.0))

    def report(self, cells: DataFrame) -> DataFrame:
        """dimension, value, target, reached, gap, rounds: also of named values that don't occur (reached 0)."""
        rows = []
        for name, values, target, reached, wanted in zip(self.names, self.values, self.targets, self.reached, self.wanted):
            rows += [(name, v, float(t), float(r), float(abs(r - t)), self.rounds) for v, t, r in zip(values, target, reached)]
            rows += [(name, v, float(s), 0.0, float(s), self.rounds) for v, s in wanted.items() if v not in values]
        return cells.sparkSession.createDataFrame(rows, "dimension string, value string, target double, reached double, gap double, rounds int")


class Accelerator:
    """Anderson acceleration of the rounds, over the logarithms of all factors: the next round starts from the
    combination of the last ones whose changes cancel best, which needs far fewer rounds to the same fixed point."""

    MEMORY = 6

    def __init__(self, sizes: list[int]):
        self.cuts = np.cumsum(sizes)[:-1]
        self.start: list[np.ndarray] = []
        self.change: list[np.ndarray] = []

    def again(self, factors: list[np.ndarray]) -> list[np.ndarray]:
        self.start, self.change = [], []
        return factors

    def next(self, before: list[np.ndarray], after: list[np.ndarray]) -> list[np.ndarray]:
        a, b = np.concatenate(before), np.concatenate(after)
        live = (a > 0) & (b > 0)
        log = lambda x: np.log(np.where(live, x, 1.0))
        self.start, self.change = [*self.start, log(a)][-self.MEMORY :], [*self.change, log(b) - log(a)][-self.MEMORY :]
        if len(self.start) < 2:
            return after
        x, f = np.stack(self.start, 1), np.stack(self.change, 1)
        by, _, _, _ = np.linalg.lstsq(np.diff(f, axis=1), f[:, -1], rcond=1e-10)
        new = x[:, -1] + f[:, -1] - (np.diff(x, axis=1) + np.diff(f, axis=1)) @ by
        if not np.isfinite(new).all() or np.abs(new).max(initial=0) > 200:
            return self.again(after)
        return np.split(np.where(live, np.exp(new), b), self.cuts)


def rake(cells: DataFrame, target: MixTarget) -> Raked:
    """Factors that bring the cells' (columns of the marginals' names, and `tokens`) weighted tokens to the targets.

    Rounds go on until all marginals are met within TOLERANCE; where targets are out of reach, because some combinations
    don't occur, until they come no nearer (PATIENCE) or after MAX_ROUNDS: `gap` then tells how far off the best round
    was. Each step sums the cells over one dimension, in parallel; nothing but those sums goes to the driver."""
    spark, names = cells.sparkSession, [m.name for m in target.marginals]
    coded, values, targets = cells.select(*names, F.col("tokens").cast("double").alias("tokens")), [], []
    count = cells.count()
    for i, marginal in enumerate(target.marginals):
        rows = cells.groupBy(marginal.name).agg(F.sum("tokens").cast("double").alias("n")).collect()
        rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
        values.append([r[0] for r in rows])
        targets.append(marginal.of(values[i], np.array([r["n"] for r in rows], float)))
        table = spark.createDataFrame([(v, k) for k, v in enumerate(values[i])], f"{marginal.name} string, c{i} long")
        coded = _joined(coded, marginal.name, table, len(rows) <= BROADCAST_VALUES)
    coded = cut(coded.drop(*names), count)

    def summed(size: int, work: Callable[[np.ndarray, list[np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The sum over all cells of what `work` makes of (tokens, codes): (indices below size, values)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                at, x = work(batch.column("tokens").to_numpy(), [batch.column(f"c{i}").to_numpy() for i in range(len(names))])
                out += np.bincount(at, x, size)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["k", "x"])

        got = coded.mapInArrow(run, "k long, x double").toArrow()
        return np.bincount(got.column("k").to_numpy(), got.column("x").to_numpy(), size)

    total = max(float(coded.agg(F.sum("tokens")).first()[0] or 0.0), 1.0) if count else 1.0
    factors = [np.ones(len(t)) for t in targets]

    def weight(codes: list[np.ndarray], of: list[np.ndarray]) -> np.ndarray:
        x = np.ones(len(codes[0]))
        for c, f in zip(codes, of):
            x = x * f[c]
        return x

    def shares(d: int, of: list[np.ndarray]) -> np.ndarray:
        shared = spark.sparkContext.broadcast(of)
        out = summed(len(targets[d]), lambda tokens, codes: (codes[d], tokens / total * weight(codes, shared.value)))
        shared.destroy()
        return out

    best: tuple[float, list[np.ndarray], list[np.ndarray]] = (np.inf, factors, [np.zeros(len(t)) for t in targets])
    rounds, stale, mark, past = 0, 0, np.inf, Accelerator([len(t) for t in targets])
    while count and rounds < MAX_ROUNDS and stale < PATIENCE and best[0] >= TOLERANCE:
        reached, before = [], factors
        for d, share in enumerate(targets):
            now = shares(d, factors)
            reached.append(now)
            factors = [f * np.divide(share, now, out=np.ones_like(share), where=now > 0) if i == d else f for i, f in enumerate(factors)]
        rounds += 1
        # each marginal was looked at just before it was fitted: what it was off by is the round's gap
        gap = max(np.abs(r - t).max() for r, t in zip(reached, targets))
        if gap < best[0]:
            best = (gap, factors, reached)
        stale = 0 if gap < 0.99 * mark else stale + 1
        mark = gap if gap < 0.99 * mark else mark
        factors = past.next(before, factors) if gap <= 4 * best[0] else past.again(best[1])
    factors = best[1]
    reached = [shares(d, factors) for d in range(len(targets))] if count else best[2]

    cap, scale, filled = np.inf, 0.0, -1.0
    while count:  # cells beyond the cap are taken whole; it ends when no other joins them
        shared = spark.sparkContext.broadcast((factors, cap))

        def split(tokens: np.ndarray, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            w = weight(codes, shared.value[0])
            full = w > shared.value[1]
            return np.repeat([0, 1, 2], len(w)), np.concatenate([full, full * tokens, ~full * tokens * w])

        n, taken, rest = summed(3, split)
        shared.destroy()
        if n == filled or rest <= 0:
            break
        filled, scale = n, max(0.0, (target.keep * total - taken) / rest)
        cap = min(cap, 1 / scale) if scale > 0 else cap
    return Raked(names, values, factors, targets, reached, [dict(m.shares) for m in target.marginals], rounds, scale)


# mixing -------------------------------------------------------------------------------------------------------------


def _free_prefix(columns: list[str]) -> str:
    """A start of names that no column has."""
    out = "_mix"
    while any(c.lower().startswith(out) for c in columns):
        out += "_"
    return out


def _decided(docs: DataFrame, target: MixTarget, p: str, keep: list[str] | None = None) -> tuple[DataFrame, Raked, DataFrame]:
    """(the rows with these columns, all by default, and doc_id, and {p}tokens, {p}<dimension>, {p}weight, {p}probability, {p}sampled; the factors;
    the cells). A dimension that is no column is the learned topic."""
    names = [m.name for m in target.marginals]
    learned = [n for n in names if n not in docs.columns]
    if learned not in ([], ["topic"]):
        raise ValueError(f"no columns {learned}")
    text = docs.withColumn("text", F.col("text").cast("string"))
    rows = measured(text, f"{p}tokens", f"{p}topic" if learned else None, fit_topics(docs) if learned else None)
    rows = rows.withColumns({f"{p}{n}": F.col(n).cast("string") for n in names if n not in learned})
    if keep is not None:
        rows = rows.select(*dict.fromkeys([*keep, "doc_id"]), *[c for c in rows.columns if c.startswith(p)])
    rows = cut(rows)
    cells = rows.groupBy(*[F.col(f"{p}{n}").alias(n) for n in names]).agg(F.sum(f"{p}tokens").alias("tokens"))
    cells = cut(cells)
    raked = rake(cells, target)
    weight = F.lit(1.0)
    for i, n in enumerate(names):
        table = docs.sparkSession.createDataFrame(list(zip(raked.values[i], raked.factors[i].tolist())), f"{p}{n} string, {p}f{i} double")
        rows = _joined(rows, f"{p}{n}", table, len(raked.values[i]) <= BROADCAST_VALUES)
        weight = weight * F.col(f"{p}f{i}")
    rows = rows.withColumn(f"{p}weight", weight).drop(*[f"{p}f{i}" for i in range(len(names))])
    probability = F.when(F.col(f"{p}tokens") == 0, F.lit(target.keep)).otherwise(F.least(F.lit(1.0), F.col(f"{p}weight") * raked.scale))
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(target.seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = rows.withColumn(f"{p}probability", probability).withColumn(f"{p}sampled", u < F.col(f"{p}probability"))
    return rows, raked, cells


def mix(docs: DataFrame, target: MixTarget | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows of `docs` (doc_id, text and the target's dimensions) with topic, n_tokens, weight (of each of the row's
    tokens), probability, sampled and gap (how far the worst marginal is from its target), in place of columns of these
    names; `columns`: the input's own columns to keep, all by default.

    The dimension `topic` is learned from the texts' words where the input has no such column. A null dimension is a
    category of its own. A document is sampled if a uniform number hashed from its doc_id and the seed is below its
    probability, so repeated rows share their fate and a rerun gives the same sample; a null doc_id is hashed as 0.
    Documents without words have the probability `keep`. An empty table gives no rows. Documents aren't moved: sums by
    cell come from one partial aggregation, and factors go back by broadcast, or, for more than BROADCAST_VALUES values
    of a dimension, by a join with salted keys. Texts are read once: what they measure is written beside `columns`."""
    target, p = target or MixTarget(), _free_prefix(docs.columns)
    made = {"topic": f"{p}topic", "n_tokens": f"{p}tokens", "weight": f"{p}weight", "probability": f"{p}probability", "sampled": f"{p}sampled"}
    own = [c for c in (columns if columns is not None else docs.columns) if c not in made and c != "gap"]
    rows, raked, _ = _decided(docs, target, p, own)
    if f"{p}topic" not in rows.columns:
        del made["topic"]
    return rows.select(*own, *[F.col(c).alias(n) for n, c in made.items()], F.lit(raked.gap).alias("gap"))


def mix_report(docs: DataFrame, target: MixTarget | None = None) -> DataFrame:
    """dimension, value, target, reached, gap, rounds: whether and how nearly each marginal is met. Named values that
    don't occur can't be reached; the others' targets are scaled to sum to 1."""
    _, raked, cells = _decided(docs, target or MixTarget(), _free_prefix(docs.columns), [])
    return raked.report(cells)


def sample_mixture(docs: DataFrame, target: MixTarget | None = None) -> DataFrame:
    """The sampled documents, with the columns of the input as they are."""
    p = _free_prefix(docs.columns)
    return _decided(docs, target or MixTarget(), p)[0].where(f"{p}sampled").select(*docs.columns)

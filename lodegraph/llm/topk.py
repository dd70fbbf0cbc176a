"""Exact top-k search by inner product with dual cover trees.

Rows and queries are dealt to coarse nodes of covering radii; a query visits only nodes whose bound reaches its kth
score so far. In each pair of blocks, cover trees over queries and rows are descended together: a pair of nodes is
pruned when no inner product between them can reach the worst kth score of the query node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.blocks import BLOCK_ROWS, bounded_sample, finite, matrix, search

#: Rows that the coarse nodes' centres and the first lower bounds come from.
SAMPLE_ROWS = 4096
#: Coarse nodes at least; there are more where the table holds more blocks, up to the sample's rows.
COARSE = 32
#: Children of a node at most, and rows and queries that a leaf holds at most unless they are all alike.
FAN_OUT, LEAF_ROWS, LEAF_QUERIES = 16, 64, 8
#: Row leaves that a query leaf is multiplied with before its bounds are looked at again: one, two, four ... so many.
STEP_LEAVES = 32
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


@dataclass
class CoverTree:
    """Nodes in arrays, parents before children. Node i holds the rows order[start[i]:end[i]], all within radius[i] of its
    centre, the row centre[i]; children[i] is a range of nodes. A node's first child has its centre (nesting), children's
    centres are further apart than the level's scale (separation), and every row belongs to its nearest child within
    that scale (covering)."""

    x: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    last: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.child == self.last).sum())


def _cover(x: np.ndarray, rows: np.ndarray, first: int, fan_out: int) -> tuple[list[int], np.ndarray]:
    """(centres, the number of the nearest of them for each row): the first, then always the row farthest from those
    before, until `fan_out` or until all rows coincide with one. The distance at the end is the level's scale."""
    centres, owner = [first], np.zeros(len(rows), np.int64)
    d = ((x[rows] - x[first]) ** 2).sum(1)
    while len(centres) < fan_out:
        far = int(d.argmax())
        if d[far] <= 0:
            break
        centres.append(int(rows[far]))
        new = ((x[rows] - x[rows[far]]) ** 2).sum(1)
        nearer = new < d
        owner[nearer], d[nearer] = len(centres) - 1, new[nearer]
    return centres, owner


def cover_tree(x: np.ndarray, leaf: int = LEAF_ROWS, fan_out: int = FAN_OUT) -> CoverTree:
    """Built from the top down to leaves of at most `leaf` rows; only rows that are all alike may fill a larger leaf."""
    order = np.arange(len(x))
    start, end, centre, radius, child, last = [0], [len(x)], [0], [0.0], [0], [0]
    if len(x):
        radius[0] = float(np.sqrt(((x - x[0]) ** 2).sum(1).max()))
    i = 0
    while i < len(start):
        a, b = start[i], end[i]
        child[i] = last[i] = len(start)
        if b - a > leaf and radius[i] > 0:
            rows = order[a:b]
            centres, owner = _cover(x, rows, centre[i], fan_out)
            place = np.argsort(owner, kind="stable")
            order[a:b] = rows[place]
            ends = a + np.cumsum(np.bincount(owner, minlength=len(centres)))
            for c, p, q in zip(centres, [a, *ends[:-1]], ends):
                start.append(int(p))
                end.append(int(q))
                centre.append(c)
                radius.append(float(np.sqrt(((x[order[p:q]] - x[c]) ** 2).sum(1).max())))
                child.append(0)
                last.append(0)
            last[i] = len(start)
        i += 1
    return CoverTree(x, order, *(np.array(v) for v in (start, end, centre, radius, child, last)))


@dataclass
class Visits:
    """What a search did: pairs of a query and a row that were multiplied, of how many, and pairs of nodes pruned."""

    multiplied: int = 0
    pairs: int = 0
    pruned: int = 0


def _exact(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of whole numbers, of any size, cut to the range of a long."""
    return max(LONG_MIN, min(LONG_MAX, sum(int(s) * int(t) for s, t in zip(a, b))))


def dual_tree(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None, visits: Visits | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the k best rows of each query, its own id left out; only those of a score of at least
    the query's floor are sure to be there.

    Where products outgrow what doubles hold exactly, doubles with their error bound choose the candidates, and whole
    numbers of any size rank those."""
    visits = visits or Visits()
    visits.pairs += len(q) * len(x)
    size = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    slack = 0.0 if size < float(1 << 53) else size * 2.0**-50 * max(1, x.shape[1])
    least = np.full(len(q), -np.inf) if floor is None else np.minimum(floor.astype(float), float(LONG_MAX)) - slack
    scores: list[np.ndarray] = [np.zeros(0)] * len(q)
    names: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    a, b = cover_tree(q, LEAF_QUERIES), cover_tree(x)
    norm_x = np.sqrt((x[b.centre] ** 2).sum(1)) if len(x) else np.zeros(1)

    def bounds(s: int, nodes: np.ndarray) -> np.ndarray:
        """No inner product between rows of query node s and of each of these nodes exceeds this."""
        c, r = q[a.centre[s]], a.radius[s]
        top = x[b.centre[nodes]] @ c + r * norm_x[nodes] + b.radius[nodes] * (np.linalg.norm(c) + r)
        return np.maximum(top + 1e-9 * np.abs(top) + 1e-6 + slack, float(LONG_MIN))

    def leaf(s: int, nodes: np.ndarray) -> None:
        mine = a.order[a.start[s] : a.end[s]]
        top = bounds(s, nodes)
        place = np.argsort(-top, kind="stable")
        nodes, top = nodes[place], top[place]
        i, step = 0, 1
        while i < len(nodes):
            some = nodes[i : i + step][top[i : i + step] >= least[mine].min()]
            if not len(some):  # bounds fall from here on
                visits.pruned += len(nodes) - i
                break
            visits.pruned += len(nodes[i : i + step]) - len(some)
            i, step = i + step, min(2 * step, STEP_LEAVES)
            rows = np.concatenate([b.order[b.start[t] : b.end[t]] for t in some])
            visits.multiplied += len(mine) * len(rows)
            got = np.clip(q[mine] @ x[rows].T, float(LONG_MIN), float(LONG_MAX))  # what is cut to the range ties
            got[q_ids[mine][:, None] == ids[rows][None]] = -np.inf
            for j, row in zip(mine.tolist(), got):
                keep = np.flatnonzero((row >= least[j]) & (row > -np.inf))
                every, who = np.concatenate([scores[j], row[keep]]), np.concatenate([names[j], rows[keep]])
                if len(every) > k:
                    kth = np.partition(every, len(every) - k)[len(every) - k]
                    least[j] = max(least[j], kth - 2 * slack)
                    stay = every >= least[j]
                    every, who = every[stay], who[stay]
                    if not slack and len(every) > k:
                        best_ = np.lexsort((ids[who], -every))[:k]
                        every, who = every[best_], who[best_]
                scores[j], names[j] = every, who

    todo = [(0, np.zeros(1, np.int64))] if len(q) and len(x) else []
    while todo:
        s, nodes = todo.pop()
        mine = a.order[a.start[s] : a.end[s]]
        open_ = bounds(s, nodes) >= least[mine].min()
        visits.pruned += int((~open_).sum())
        nodes = nodes[open_]
        inner = a.child[s] < a.last[s]
        grown = nodes[b.child[nodes] < b.last[nodes]]
        if not inner:
            while len(grown):  # the query node is a leaf: only rows are descended
                below = np.concatenate([np.arange(b.child[t], b.last[t]) for t in grown])
                open_ = bounds(s, below) >= least[mine].min()
                visits.pruned += int((~open_).sum())
                nodes = np.concatenate([nodes[b.child[nodes] == b.last[nodes]], below[open_]])
                grown = nodes[b.child[nodes] < b.last[nodes]]
            leaf(s, nodes)
            continue
        below = [np.arange(b.child[t], b.last[t]) for t in grown]
        nodes = np.concatenate([nodes[b.child[nodes] == b.last[nodes]], *below])
        todo += [(t, nodes) for t in range(a.child[s], a.last[s])]
    out: list[tuple[int, int, int]] = []
    for j, (every, who) in enumerate(zip(scores, names)):
        if slack:
            ranked = sorted(((_exact(q[j], x[i]), int(ids[i])) for i in who.tolist()), key=lambda p: (-p[0], p[1]))
            out += [(int(q_ids[j]), i, s) for s, i in ranked[:k]]
        else:
            place = np.lexsort((ids[who], -every))[:k]
            out += list(zip([int(q_ids[j])] * len(place), ids[who[place]].tolist(), every[place].astype(np.int64).tolist()))
    found = np.array([r[0] for r in out], np.int64), np.array([r[1] for r in out], np.int64), np.array([r[2] for r in out], np.int64)
    return found


def quantized(column: str, factor: int = 256) -> Column:
    """floor(factor * x) of each component x taken as double, as doubles of whole numbers; from 2**52 on a double is whole."""
    scaled = F.transform(F.col(column).cast("array<double>"), lambda x: x * F.lit(float(factor)))
    return F.transform(scaled, lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y))


def centres_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows that cover the sample: each the farthest from those before."""
    if not len(sample):
        return np.zeros((1, 1))
    return sample[_cover(sample, np.arange(len(sample)), 0, count)[0]]


def _filed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """part (the nearest centre), id, v, distance to the centre."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            part = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
            d = np.sqrt(((x - c[part]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column("id"), batch.column("v"), pa.array(d)], names=["part", "id", "v", "distance"])

    return rows.select("id", "v").mapInArrow(run, "part int, id long, v array<double>, distance double")


def _visits(asked: DataFrame, centres: np.ndarray, radii: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """part, id, v, floor: the coarse nodes that may hold one of a query's k best. The kth best of the sample is a lower
    bound, the floor, that goes with the query."""
    shared = asked.sparkSession.sparkContext.broadcast((centres, radii, ids, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, radius, names, known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q, own = matrix(batch.column("v")), batch.column("id").to_numpy()
            got = q @ known.T
            got[own[:, None] == names[None]] = -np.inf
            least = np.partition(got, -k, axis=1)[:, -k] if got.shape[1] >= k else np.full(len(q), -np.inf)
            norms = np.linalg.norm(q, axis=1)
            least = least - 1e-9 * norms * np.linalg.norm(known, axis=1).max(initial=0)  # the last digits of large products
            least = np.minimum(least, float(LONG_MAX))
            limit = q @ c.T + norms[:, None] * radius[None]
            limit = np.maximum(limit + 1e-9 * np.abs(limit) + 1e-6, float(LONG_MIN))
            r, p = np.nonzero((limit >= least[:, None]) & (radius >= 0)[None])
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), batch.column("id").take(take), batch.column("v").take(take), pa.array(least[r])], names=["part", "id", "v", "floor"])

    return asked.select("id", "v").mapInArrow(run, "part int, id long, v array<double>, floor double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, column: str = "embedding", factor: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products with rows, in exact integers.

    Components are floor(factor * x) first. A row of the query's own vec_id is no candidate; ties go to smaller vec_id.
    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id or of
    another width than the table's most common one. Repeated rows are candidates of their own; a repeated query is
    answered once, by its smallest vector. Scores beyond a long are cut to its range. Other columns play no part."""
    ok = lambda df: df.where(finite(column) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), quantized(column, factor).alias("v"))
    rows, asked = ok(vectors), ok(queries).groupBy("id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.col("count").desc(), "width").first()
    width = sizes["width"] if sizes else 1
    rows, asked = rows.where(F.size("v") == width), asked.where(F.size("v") == width)
    ids, sample = bounded_sample(rows, SAMPLE_ROWS)
    sample = sample if len(sample) else np.zeros((0, width))
    coarse = max(COARSE, (sizes["count"] if sizes else 0) // BLOCK_ROWS)
    centres = centres_of(sample, coarse) if len(sample) else np.zeros((1, width))
    filed = _filed(rows, centres)
    stats = filed.groupBy("part").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
    radii = np.full(len(centres), -1.0)
    for r in stats:
        radii[r["part"]] = r["radius"] * (1 + 1e-9) + 1e-9
    sent = _visits(asked, centres, radii, ids, sample, k)
    wanted = {r["part"]: r["count"] for r in sent.groupBy("part").count().collect()}
    return search(filed.drop("distance"), sent, {r["part"]: r["n"] for r in stats}, wanted, lambda a, q, i, x, floor: dual_tree(a, q, i, x, k, floor), k, True, "long")

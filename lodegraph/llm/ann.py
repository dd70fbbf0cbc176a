"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a graph of nearest neighbours is cut into balanced parts with few edges between them, and a small
network learns a vector's part and its neighbours' parts. The network then files every row under its most probable part
and sends a query to its several most probable parts, where all rows are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.blocks import best, bounded_sample, finite, matrix, search

#: Rows a part should hold. Tables of any size have parts, MIN_PARTS at least.
PART_ROWS, MIN_PARTS = 256, 12
#: Vectors that the partition and the network are fitted on: PART_SAMPLE for each part, within these bounds. Beyond the
#: 1024 parts that the upper bound allows, parts hold more rows and are salted into blocks.
SAMPLE_LEAST, SAMPLE_MOST, PART_SAMPLE = 6144, 24_576, 24
NEIGHBOURS = 10
#: Queries visit as many parts as it takes to find this share of true neighbours in the sample.
TARGET_RECALL = 0.94


def _nearest(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k nearest other rows of each row (of the given rows, else of all)."""
    rows = np.arange(len(x)) if of is None else of
    out = np.empty((len(rows), k), np.int64)
    squares = (x * x).sum(1)
    for i in range(0, len(rows), 1024):
        part = rows[i : i + 1024]
        d = squares[None] - 2 * x[part] @ x.T
        d[np.arange(len(part)), part] = np.inf
        out[i : i + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.05, sweeps: int = 12) -> np.ndarray:
    """A part for each vertex, none over (1 + slack) n / parts: bisected at medians of principal directions, then vertices
    move to where most of their neighbours are while there is room."""
    n = len(x)
    label = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        half = count // 2
        cut = len(rows) * half // count
        todo += [(order[:cut], first, half), (order[cut:], first + half, count - half)]
    both = [np.concatenate([graph.reshape(-1), np.repeat(np.arange(n), graph.shape[1])]), np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)])]
    order = np.argsort(both[0], kind="stable")
    ends, edges = np.cumsum(np.bincount(both[0], minlength=n)), both[1][order]
    most = int(np.ceil((1 + slack) * n / parts))
    size = np.bincount(label, minlength=parts)
    rng = np.random.default_rng(7)
    for _ in range(sweeps):
        moved = 0
        for v in rng.permutation(n):
            votes = np.bincount(label[edges[ends[v - 1] if v else 0 : ends[v]]], minlength=parts)
            now = label[v]
            votes = np.where((size < most) | (np.arange(parts) == now), votes, -1)
            new = int(votes.argmax())
            if votes[new] > votes[now]:
                size[now] -= 1
                size[new] += 1
                label[v] = new
                moved += 1
        if moved < n // 200:
            break
    return label


@dataclass
class Router:
    """A network of one hidden layer: vector -> log probabilities of parts, up to a constant. probes: parts to visit."""

    mean: np.ndarray
    scale: float
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.d)

    def logits(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) / self.scale
        return np.maximum(y @ self.a + self.b, 0) @ self.c + self.d


def _train(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 60) -> Router:
    rng = np.random.default_rng(3)
    n, width = x.shape
    mean = x.mean(0)
    scale = float((x - mean).std()) or 1.0
    y = (x - mean) / scale
    w = [rng.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, target.shape[1])), np.zeros(target.shape[1])]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 256)):
            h = np.maximum(y[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            g = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (g @ w[2].T) * (h > 0)
            step += 1
            for i, grad in enumerate((y[rows].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                grad = grad + 1e-4 * w[i]
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                w[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *w, 1)


def parts_of(rows: int) -> int:
    """Parts of a table of so many rows."""
    return int(min(SAMPLE_MOST // PART_SAMPLE, max(MIN_PARTS, rows // PART_ROWS)))


def sample_rows(rows: int) -> int:
    return max(SAMPLE_LEAST, parts_of(rows) * PART_SAMPLE)


def fit(sample: np.ndarray, rows: int) -> Router:
    """A router for a table of so many rows, from a bounded sample of them.

    The number of probes is found on a third of the sample that the network isn't trained on; neighbours in a sample are
    farther than in the table, which errs towards more probes."""
    width = sample.shape[1] if sample.size else 1
    x = np.unique(sample, axis=0) if sample.size else sample  # copies of a vector would fill its neighbourhood
    x = x[np.random.default_rng(1).permutation(len(x))]
    parts = min(parts_of(rows), len(x) // 6)
    if parts < 2:  # under twelve different vectors: nothing to partition
        return Router(np.zeros(width), 1.0, np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    learn, held = np.arange(len(x) * 2 // 3), np.arange(len(x) * 2 // 3, len(x))
    own = x[learn]
    k = min(NEIGHBOURS, len(own) - 1)
    graph = _nearest(own, k)
    label = balanced_parts(own, graph, parts)
    target = np.zeros((len(own), parts))
    np.add.at(target, (np.repeat(np.arange(len(own)), k), label[graph].reshape(-1)), 1 / (2 * k))
    target[np.arange(len(own)), label] += 0.5
    router = _train(own, target)
    logits = router.logits(x)
    part = logits.argmax(1)
    near = _nearest(x, k, held)
    rank = np.empty((len(held), parts), np.int64)
    np.put_along_axis(rank, np.argsort(-logits[held], axis=1, kind="stable"), np.arange(parts)[None], 1)
    needed = np.take_along_axis(rank, part[near], 1).reshape(-1) + 1
    router.probes = int(np.quantile(needed, TARGET_RECALL, method="higher"))
    return router


def _routed(rows: DataFrame, router: Router, probes: int) -> DataFrame:
    """part, id, v for the `probes` most probable parts of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            logits = shared.value.logits(matrix(batch.column("v")))
            parts = np.argsort(-logits, axis=1, kind="stable")[:, :probes]
            take = pa.array(np.repeat(np.arange(batch.num_rows), probes))
            yield pa.RecordBatch.from_arrays([pa.array(parts.reshape(-1).astype(np.int32)), batch.column("id").take(take), batch.column("v").take(take)], names=["part", "id", "v"])

    return rows.select("id", "v").mapInArrow(run, "part int, id long, v array<double>")


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((q - x) ** 2).sum(-1))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query's nearest rows found, the k nearest by Euclidean distance.

    `vectors` and `queries` hold vec_id and vectors. A row of the query's own vec_id is no candidate. Ties go to smaller
    vec_id. Vectors that are null, empty, all zero or hold null or non-finite components take no part, nor do rows
    without vec_id or of another width than the sample's most common one. Repeated rows are candidates of their own;
    a repeated query is answered once, by its smallest vector. Every row is in the index. Other columns play no part."""
    ok = lambda df: df.where(finite(column) & F.exists(column, lambda x: x != 0) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    rows, asked = ok(vectors), ok(queries).groupBy("id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.col("count").desc(), "width").first()
    width, n = (sizes["width"], sizes["count"]) if sizes else (1, 0)
    rows, asked = rows.where(F.size("v") == width), asked.where(F.size("v") == width)
    router = fit(bounded_sample(rows, sample_rows(n))[1], n)
    filed, sent = _routed(rows, router, 1), _routed(asked, router, router.probes)
    counts = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}
    wanted = {r["part"]: r["count"] for r in sent.groupBy("part").count().collect()}

    def work(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        for i in range(0, len(q), 512):
            part = q[i : i + 512]
            rough = 2 * part @ x.T - (x * x).sum(1)[None] - (part * part).sum(1)[:, None]
            rough[q_ids[i : i + 512, None] == ids[None]] = -np.inf
            r, c = best(rough, ids, k + 6)
            # the rough order may err in the last digits: candidates within them are ranked again
            if len(ids) > k + 6:
                edge = np.partition(rough, len(ids) - k - 6, axis=1)[:, len(ids) - k - 6]
                close = 1e-9 * (1 + np.abs(rough).max(1, where=np.isfinite(rough), initial=0))
                r, c = np.nonzero((rough >= (edge - close)[:, None]) & np.isfinite(rough))
            d = distances(part[r], x[c])
            order = np.lexsort((ids[c], d, r))
            r, c, d = r[order], c[order], d[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((q_ids[i + r[keep]], ids[c[keep]], d[keep]))
        return tuple(np.concatenate(x) for x in zip(*out))

    return search(filed, sent, counts, wanted, work, k, False, "double")

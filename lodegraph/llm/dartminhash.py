"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is a weighted set: its five-word shingles, each as heavy as it is frequent. Every unit of weight is a region
at which darts are thrown by hashing: a Poisson number per doubling of time, each with a coordinate and a time of
arrival. The earliest dart of each coordinate is the signature, so two documents agree on a coordinate with their
weighted Jaccard similarity as probability. Documents that share a band of coordinates are compared exactly.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import cut, list_array, map_texts, mix64, spans_of, text_or_empty, texts_of, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Darts land by levels of time: [0, 2**FIRST_LEVEL), then doublings.
FIRST_LEVEL = -9
#: Salts for mappings whose keys may be shared by a large part of all rows.
SALTS = 16
#: Buckets whose open comparisons number at most so many are compared pair by pair, larger ones in blocks; both exactly.
OPEN_PAIRS = 2000
#: Pairs of one pivot that meet in one task, about.
PIVOT_PAIRS = 512
#: What a text costs beyond its characters when texts are sliced: short ones throw as many darts as others.
TEXT_COST = 400
#: Members far from the pivot, and members of any kind, that a block holds, about.
BLOCK_FAR, BLOCK_ALL = 512, 4096
BLOCK_BYTES = 24 << 20
#: Closest similar others of a far member that are linked before components are looked at.
CLOSEST = 6


def cells(texts: list[str], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit cells of all texts, cells of each text, 128-bit keys of the word sequences as two uint64).

    A cell is a shingle and a number from 1 to its frequency. Texts of fewer than k words are one shingle; texts without
    words have no cell. Cells of a text are distinct, in no order."""
    words, counts = word_hashes(texts)
    n = len(words)
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = np.cumsum(counts) - counts
    place = (np.arange(n) - np.repeat(starts, counts)).astype(np.uint64)
    keys = []
    for seed in (0x51, 0xA3):
        mixed = mix64(words + mix64(place + np.uint64(seed << 40)))
        sums = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
        keys.append(mix64((sums[starts + counts] - sums[starts]) ^ counts.astype(np.uint64)))
    full = np.flatnonzero(place + np.uint64(k) <= np.repeat(counts, counts).astype(np.uint64))
    shingle = np.zeros(len(full), np.uint64)
    for i in range(k):
        shingle = mix64(shingle + words[full + i])
    whose = owner[full]
    short = np.flatnonzero((counts > 0) & (counts < k))
    shingle, whose = np.concatenate([shingle, keys[0][short]]), np.concatenate([whose, short])
    order = np.lexsort((shingle, whose))
    shingle, whose = shingle[order], whose[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (whose[1:] != whose[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(shingle)) - np.repeat(first, np.diff(np.append(first, len(shingle))))
    again = nth > 0
    shingle[again] = mix64(shingle[again] + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return shingle, np.bincount(whose, minlength=len(texts)), keys[0], keys[1]


@lru_cache(64)
def _poisson(level: int) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts in a cell on a level, as uint64 thresholds."""
    mean = 2.0**level
    p, total, out = np.exp(-mean), 0.0, []
    for i in range(int(mean + 12 * mean**0.5 + 20)):
        total += p
        out.append(min(total, 1.0))
        p *= mean / (i + 1)
    return (np.array(out) * (2.0**64 - 4096)).astype(np.uint64)


def signatures(cell: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """For each text with cells, the hash of the earliest dart of each of k coordinates (texts x k)."""
    texts = len(counts)
    out = np.zeros(texts * k, np.uint64)
    empty = np.ones(texts * k, bool)
    owner = np.repeat(np.arange(texts, dtype=np.int64), counts)
    level = FIRST_LEVEL - 1
    while len(cell):
        level += 1
        base = level == FIRST_LEVEL
        u = mix64(cell ^ np.uint64((level + 64) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        steps = _poisson(FIRST_LEVEL if base else level - 1)
        some = np.flatnonzero(u > steps[0])
        darts = np.searchsorted(steps, u[some])
        each = np.repeat(some, darts)
        number = np.arange(len(each)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix64(u[each] + number.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))
        slot = owner[each] * k + (dart % np.uint64(k)).astype(np.int64)
        free = empty[slot]
        dart, slot = dart[free], slot[free]
        time = mix64(dart ^ np.uint64(0x8BB84B93962EACC9))
        order = np.lexsort((time, slot))
        slot, dart = slot[order], dart[order]
        lead = np.ones(len(slot), bool)
        lead[1:] = slot[1:] != slot[:-1]
        out[slot[lead]] = dart[lead]
        empty[slot[lead]] = False
        open_text = empty.reshape(texts, k).any(1)
        stay = open_text[owner]
        if not stay.all():
            cell, owner = cell[stay], owner[stay]
    return out.reshape(texts, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """texts x bands; the band's number is part of its key."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.tile(np.arange(bands, dtype=np.uint64), (len(signature), 1))
    for i in range(rows):
        key = mix64(key + parts[:, :, i])
    return key


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h, text: rows of the same doc_id and hash are the same document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"))


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h (of the text), text_hi, text_lo (of the word sequence), bands array<long> (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in spans_of(len(t) + TEXT_COST for t in texts):
                cell, counts, hi, lo = cells(texts[a:b])
                full = np.flatnonzero(counts)
                keys = band_keys(signatures(cell, counts[full], bands * rows), bands, rows)
                lengths = np.where(counts > 0, bands, 0)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), list_array(keys.reshape(-1).view(np.int64), lengths)], names=["doc_id", "h", "text_hi", "text_lo", "bands"])

    return map_texts(keyed(docs), run, "doc_id long, h long, text_hi long, text_lo long, bands array<long>")


def whole_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, text of each of `ids` (doc, doc_id, h: a number for a document and what it is known by); written once."""
    theirs = ids.select("doc", F.col("doc_id").alias("own_id"), F.col("h").alias("own_h"))
    mine = keyed(docs).join(theirs, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h")))
    return cut(mine.groupBy("doc").agg(F.min("text").alias("text")))


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, distance: exact weighted Jaccard distance of each pair of documents, over whole texts.

    The pairs of a document that has many (the pivot of a large bucket) are dealt to several tasks, its text to each."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_PAIRS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    firsts = parts.select(F.col("a").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts, "doc")
    firsts = firsts.select(F.col("doc").alias("a"), "part", F.col("text").alias("text_a"))
    both = dealt.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").join(firsts, ["a", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            size = 256
            for i in range(0, len(a), size):
                part = slice(i, i + size)
                new: dict[int, str] = {}
                for side, ids_ in (("text_a", a[part]), ("text_b", b[part])):
                    texts_ = batch.column(side).slice(i, size)
                    new.update((x, texts_[j].as_py()) for j, x in enumerate(ids_) if x not in kept and x not in new)
                names = list(new)
                for p, q in spans_of([len(new[x]) for x in names]):
                    cell, counts, _, _ = cells([new[x] for x in names[p:q]])
                    ends = np.cumsum(counts)
                    kept.update((x, cell[e - c : e]) for x, e, c in zip(names[p:q], ends, counts))
                out = []
                for x, y in zip(a[part], b[part]):
                    s, t = kept[x], kept[y]
                    both_ = len(np.intersect1d(s, t, assume_unique=True))
                    out.append(1 - both_ / max(1, len(s) + len(t) - both_))
                    kept.move_to_end(x)
                while len(kept) > 1024:
                    kept.popitem(last=False)
                yield pa.RecordBatch.from_arrays([batch.column("a").slice(i, size), batch.column("b").slice(i, size), pa.array(out, pa.float64())], names=["a", "b", "distance"])

    return map_texts(both.select("a", "b", "text_a", "text_b"), run, "a long, b long, distance double")


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id of each component of the undirected edges (a, b).

    Every node points to its smallest neighbour, pointers are followed four steps, and edges between nodes that point
    elsewhere are contracted until none is left: stars take one round, a chain of n nodes about log4 n. Nothing goes to
    the driver but whether edges are left."""
    edges = edges.select("a", "b").where("a != b")
    levels: list[DataFrame] = []
    n = edges.count()
    while True:
        both = edges.union(edges.select("b", "a")).toDF("id", "other")
        point = both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label"))
        for _ in range(2):
            far = point.select(F.col("id").alias("label"), F.col("label").alias("far"))
            point = point.join(far, "label").select("id", F.col("far").alias("label"))
        levels.append(cut(point, 2 * n))
        ends = lambda name: levels[-1].select(F.col("id").alias(name), F.col("label").alias(f"to_{name}"))
        left = edges.join(ends("a"), "a").join(ends("b"), "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = cut(left.where("a != b").distinct(), n)
        n = edges.count()
        if not n:
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.join(level.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "left").select("id", F.coalesce("far", "label").alias("label"))
    return out


def _with_distance(members: DataFrame, seen: DataFrame) -> DataFrame:
    """bucket, pivot, doc, n, distance from the pivot."""
    known = seen.select(F.col("a").alias("pivot"), F.col("b").alias("doc"), "distance")
    return members.join(known, ["pivot", "doc"], "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))


def _open_pairs(x: DataFrame, limit: float) -> DataFrame:
    """a, b: pairs of a bucket, one of them far from the pivot, that the triangle inequality doesn't part."""
    p = x.where(F.col("distance") > limit).select("bucket", F.col("doc").alias("p"), F.col("distance").alias("dp"))
    q = x.where("doc != pivot").select("bucket", F.col("doc").alias("q"), F.col("distance").alias("dq"))
    pairs = p.join(q, "bucket").where((F.col("p") != F.col("q")) & (F.abs(F.col("dp") - F.col("dq")) <= limit))
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def links(sketched: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b, distance of similar pairs that share a band, enough of them that every similar pair is linked through them.

    `sketched` holds one document of each word sequence (doc, a number; doc_id, h; bands). In each bucket all members are compared with its smallest id,
    the pivot. Members near it are linked by that. Distances are a metric, so two members that lie further apart on the
    pivot's scale than the limit can't be similar; what stays open is compared pair by pair in small buckets, and in
    blocks in large ones. No bucket is capped."""
    limit = 1 - similarity + 1e-12
    members = sketched.select(F.explode("bands").alias("bucket"), "doc")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc").alias("pivot")).where("n > 1")
    members = cut(members.join(sizes, "bucket"))
    texts = whole_texts(docs, sketched.select("doc", "doc_id", "h").join(members.select("doc").distinct(), "doc", "left_semi"))
    pairs = members.where("doc != pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    seen = cut(similarities(pairs, texts))
    placed = _with_distance(members.where("n > 2"), seen)
    far = placed.groupBy("bucket").agg(F.count_if(F.col("distance") > limit).alias("far")).where("far > 0")
    placed = cut(placed.join(far, "bucket"))
    few = F.col("far") * F.col("n") <= OPEN_PAIRS
    todo = _open_pairs(placed.where(few), limit).join(seen, ["a", "b"], "left_anti")
    seen = seen.union(cut(similarities(todo, texts)))
    dense = placed.where(~few).select("pivot", "doc", "distance").distinct()
    dense = cut(_with_cells(dense.join(texts, "doc")))
    near = seen.where(F.col("distance") <= limit)
    return near if dense.isEmpty() else _dense_links(dense, near, limit)


def _with_cells(rows: DataFrame) -> DataFrame:
    """pivot, doc, distance and the ascending cells of the text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in spans_of(map(len, texts)):
                cell, counts, _, _ = cells(texts[a:b])
                ends = np.cumsum(counts)
                data = [np.sort(cell[e - c : e]).tobytes() for e, c in zip(ends, counts)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("pivot", "doc", "distance")), pa.array(data, pa.binary())], names=["pivot", "doc", "distance", "cells"])

    return map_texts(rows.select("pivot", "doc", "distance", "text"), run, "pivot long, doc long, distance double, cells binary")


class Bitmaps:
    """Which slots of a row of bits each set of cells occupies. A slot that one set occupies and the other doesn't holds a
    cell of the first alone, so the bits tell, never wrongly, that a pair shares too few cells."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        usual = int(np.quantile(self.sizes, 0.9)) if len(sets) else 1
        self.shift = np.uint64(64 - min(14, max(9, int(4 * usual).bit_length())))
        self.bits = np.stack([self._row(x) for x in sets]) if sets else np.zeros((0, 1), np.uint64)

    def _row(self, cell: np.ndarray) -> np.ndarray:
        row = np.zeros(1 << (64 - int(self.shift)), bool)
        row[(cell >> self.shift).astype(np.int64)] = True
        return np.packbits(row).view(np.uint64)

    def may_be_similar(self, cell: np.ndarray, similarity: float, among: np.ndarray) -> np.ndarray:
        """Those of the sets numbered `among` whose weighted Jaccard similarity to `cell` isn't ruled out."""
        shared = similarity / (1 + similarity) * (len(cell) + self.sizes[among]) - 1e-6
        among, shared = among[(shared <= len(cell)) & (shared <= self.sizes[among])], shared[(shared <= len(cell)) & (shared <= self.sizes[among])]
        own, theirs = self._row(cell), self.bits[among]
        fits = np.bitwise_count(own & ~theirs).sum(1) <= len(cell) - shared
        fits &= np.bitwise_count(theirs & ~own).sum(1) <= self.sizes[among] - shared
        return among[fits]


def _dense_links(dense: DataFrame, near: DataFrame, limit: float) -> DataFrame:
    """`near` and what large buckets add. dense: pivot, doc, distance, cells.

    Members far from their pivot are held against all members of the pivot's buckets, in pairs of blocks of bounded size:
    by bitmaps that rule out most pairs and no similar one, then exactly. Of a far member's similar others only the closest few come out,
    then, as components tell what those have linked, the closest of each other component: no link that joins components
    is lost, and a group's pairs are never listed."""
    big = lambda c, most: F.sum(F.length("cells") * F.col(c).cast("int")) / most
    dense = dense.withColumn("far", F.col("distance") > limit).withColumn("any", F.lit(True))
    blocks = lambda c, rows: F.ceil(F.greatest(F.count_if(F.col(c)) / rows, big(c, BLOCK_BYTES))).cast("int")
    sizes = dense.groupBy("pivot").agg(blocks("far", BLOCK_FAR).alias("pbs"), blocks("any", BLOCK_ALL).alias("qbs"))
    columns = ["pivot", "pb", "qb", "doc", "label", "distance", "cells"]

    def found(named: DataFrame, top: int | None) -> DataFrame:
        x = named.join(sizes, "pivot").withColumn("h", F.xxhash64("doc"))
        block = lambda c: F.pmod("h", F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = x.where("far").withColumn("pb", block("pbs")).withColumn("qb", every("qbs"))
        right = x.where("doc != pivot and pbs > 0").withColumn("qb", block("qbs")).withColumn("pb", every("pbs"))

        def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            rows: list[tuple[int, int, float]] = []
            if len(p) and len(q):
                ids, labels, far, theirs = q["doc"].to_numpy(), q["label"].to_numpy(), q["distance"].to_numpy(), [np.frombuffer(c, np.uint64) for c in q["cells"]]
                maps = Bitmaps(theirs)
                sizes_ = maps.sizes
                for doc, label, d, mine in zip(p["doc"], p["label"], p["distance"], p["cells"]):
                    mine = np.frombuffer(mine, np.uint64)
                    at = maps.may_be_similar(mine, 1 - limit, np.flatnonzero((labels != label) & (np.abs(far - d) <= limit)))
                    if not len(at):
                        continue
                    flat = np.concatenate([theirs[i] for i in at])
                    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    both = np.bincount(np.repeat(np.arange(len(at)), sizes_[at]), hit, len(at))
                    gap = 1 - both / (len(mine) + sizes_[at] - both)
                    order = np.lexsort((ids[at], gap))
                    order = order[gap[order] <= limit]
                    if top is None:
                        order = order[np.sort(np.unique(labels[at[order]], return_index=True)[1])]
                    else:
                        order = order[:top]
                    rows += [(min(doc, ids[at[i]]), max(doc, ids[at[i]]), gap[i]) for i in order]
            return pd.DataFrame(rows, columns=["a", "b", "distance"]).astype({"a": "int64", "b": "int64", "distance": "float64"})

        # both sides come from one table: new names keep their columns apart
        fresh = lambda df: df.select(*[F.col(c).alias(f"_{c}") for c in columns]).toDF(*columns)
        keys = columns[:3]
        pairs = fresh(left).groupBy(*keys).cogroup(fresh(right).groupBy(*keys)).applyInPandas(run, "a long, b long, distance double")
        return pairs.groupBy("a", "b").agg(F.min("distance").alias("distance"))

    first = dense.withColumn("label", F.when(F.col("far"), F.col("doc")).otherwise(F.col("pivot")))
    near = cut(near.union(found(first, CLOSEST)).groupBy("a", "b").agg(F.min("distance").alias("distance")))
    mine = near.join(dense.select(F.col("doc").alias("b")).distinct(), "b", "left_semi")
    labels = components(mine).select(F.col("id").alias("doc"), "label")
    named = dense.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    return cut(near.union(found(named, None)).groupBy("a", "b").agg(F.min("distance").alias("distance")))


def _classified(docs: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    """doc_id, h, kept, n_exact, n_links of each row; kept (none, doc_id, h) is the document that stands for its class.
    For rows without words the last three are null."""
    sketched = cut(sketch(docs, bands, rows))
    n = sketched.count()
    worded = sketched.where(F.size("bands") > 0)
    # nulls come last: a document without doc_id stands for others only where none has one
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    first = worded.groupBy("text_hi", "text_lo").agg(least.alias("own"), F.count("*").alias("n_exact"), F.first("bands").alias("bands"))
    first = cut(first.select("text_hi", "text_lo", "own", "own.doc_id", "own.h", "n_exact", "bands", F.monotonically_increasing_id().alias("doc")), n)
    near = links(first, docs, similarity)
    labels = components(near)
    degree = near.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n_links"))
    linked = cut(first.select("doc", "own").join(labels.withColumnRenamed("id", "doc"), "doc"), n)
    kept = linked.groupBy("label").agg(F.min("own").alias("kept"))
    classes = linked.join(kept, "label").select("doc", "kept")
    named = first.select("text_hi", "text_lo", "doc", "own", "n_exact").join(classes, "doc", "left").join(degree, "doc", "left")
    told = named.select("text_hi", "text_lo", F.coalesce("kept", "own").alias("kept"), "n_exact", "n_links").where("n_exact > 1 or n_links > 0")
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = sketched.select("doc_id", "h", "text_hi", "text_lo", (F.size("bands") > 0).alias("worded")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)).cast("int"))
    # a text without words has the key of no words: it is nobody's copy
    out = mine.join(told, ["text_hi", "text_lo", "salt"], "left")
    of = lambda c: F.when(F.col("worded"), F.col(c))
    return out.select("doc_id", "h", of("kept").alias("kept"), of("n_exact").alias("n_exact"), of("n_links").alias("n_links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, n_exact, n_links: the class of each document is named by its smallest doc_id.

    Documents are of one class if linked by a chain of pairs of similarity (weighted Jaccard of five-word shingles, words
    being runs of letters and digits in lower case) of at least `similarity`; equal word sequences are similar by
    definition, compared by a 128-bit key, once. Documents without words (null or empty texts) are classes of their own.
    n_exact counts the documents of the same word sequence, n_links the links found with other sequences: all that join
    components, not every pair of a large group.
    A null doc_id is a document like others and comes out as null; a class of such documents alone has a null name. Rows
    that repeat a doc_id are each of the class of their own text. Other columns play no part; an empty table gives no
    rows."""
    out = _classified(docs, similarity, bands, rows)
    name = F.when(F.col("kept").isNotNull(), F.col("kept")["doc_id"]).otherwise(F.col("doc_id"))
    return out.select("doc_id", name.alias("class_id"), F.coalesce("n_exact", F.lit(1)).cast("long").alias("n_exact"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, as they are, that stand for their class: one of each group stays, the one of the smallest doc_id.

    A document without doc_id stays only where no other of its class has one, and then one of them does. Rows that
    repeat a doc_id are judged by their own texts; rows that repeat both doc_id and text are one document, and all of
    them stay or none."""
    told = _classified(docs, similarity, BANDS, ROWS).where("n_exact > 1 or n_links > 0").persist()
    same = F.col("doc_id").eqNullSafe(F.col("kept")["doc_id"]) & (F.col("h") == F.col("kept")["h"])
    nameless = told.where(same & F.col("doc_id").isNull() & (F.col("n_exact") > 1))
    gone = cut(told.where(~same).union(nameless).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct(), told.count())
    again = nameless.select(F.col("h").alias("gone_h")).distinct()
    p = "_keep"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    mine = docs.withColumn(p, F.xxhash64(text_or_empty()))
    out = mine.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.col(p) == F.col("gone_h")), "left_anti")
    if not again.isEmpty():  # copies without any doc_id: one row of each text
        again = cut(again)
        out = out.unionByName(mine.where("doc_id is null").join(again, F.col(p) == F.col("gone_h"), "left_semi").dropDuplicates([p]))
    told.unpersist()
    return out.select(*docs.columns)

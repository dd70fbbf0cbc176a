"""Token counts by offset-mapped attribution: each document is encoded once, whole; its tokens' character spans are
interval-joined to sections, and a token that crosses a boundary is given by an explicit rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.bpe import SharedVocabulary, _parts, default_path
from lodegraph.llm.common import map_texts, text_or_empty, texts_of

RULES = ("first", "last", "largest")
SECTIONS = "array<struct<name:string,start:int,end:int>>"


def line_ends(text: str) -> np.ndarray:
    """Ends of the lines of a text, breaks included."""
    data = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.append(np.flatnonzero(data == 10) + 1, len(data))


def token_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of consecutive tokens of these byte sizes: from the character of a token's first byte to the end
    of the character of its last. Tokens that share a character overlap in it."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str) -> np.ndarray:
    """The section (a gap counts as one) of each token span; sections are the intervals between ascending edges.

    first: that of the token's first character. last: that of its last. largest: the one with most of its characters,
    the earliest of several."""
    a, b = np.searchsorted(edges, start, side="right") - 1, np.searchsorted(edges, end - 1, side="right") - 1
    if rule == "first":
        return a
    if rule == "last":
        return b
    out = a.copy()
    for i in np.flatnonzero(a != b):
        cuts = np.concatenate([[start[i]], edges[a[i] + 1 : b[i] + 1], [end[i]]])
        out[i] = a[i] + np.diff(cuts).argmax()
    return out


def layers_of(starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """Sections in order of start, parted into layers in which none overlap: one layer if none do at all."""
    layers: list[list[int]] = []
    ends: list[int] = []
    for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist())):
        at = next((k for k, end in enumerate(ends) if end <= a), len(layers))
        if at == len(layers):
            layers.append([])
            ends.append(0)
        layers[at].append(i)
        ends[at] = b
    return [np.array(x, np.int64) for x in layers or [[]]]


def gapless(starts: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending edges from 0 to the length, the interval between edges that each section is)."""
    cuts, index = [0], []
    for a, b in zip(starts.tolist(), stops.tolist()):
        if a > cuts[-1]:
            cuts.append(a)
        index.append(len(cuts) - 1)
        cuts.append(b)
    if cuts[-1] < length or len(cuts) == 1:
        cuts.append(length)
    return np.array(cuts), np.array(index, np.int64)


def count_sections(docs: DataFrame, sections: str | None = None, rule: str = "first", path: str | None = None) -> DataFrame:
    """doc_id, section (from 0), name, start, end, n_tokens, n_crossing of every section of every document.

    `sections` names a column of sections (name, start, end; code points, end exclusive), numbered by start; null ones
    are left out, and ends are cut at the text's. Without it, sections are lines. Each of sections that overlap counts
    the tokens of its own characters, whatever the others count. Tokens in no section are counted under the name null,
    section -1, if there are any, so where sections don't overlap counts add up to the document's.
    n_crossing counts the section's tokens that reach beyond it. Null texts are empty and have one empty line. Rows
    aren't moved: the interval join runs inside each document, over sorted edges. Other columns play no part."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = SharedVocabulary(docs.sparkSession, path or default_path())
    columns = [F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")] + ([F.col(sections).cast(SECTIONS).alias("sections")] if sections else [])

    def rows_of(text: str, sizes: np.ndarray, own: list[tuple[str, int, int]] | None):
        if own is None:
            edges = np.append(0, line_ends(text))
            names = list(map(str, range(len(edges) - 1)))
            starts, stops, layers = edges[:-1], edges[1:], [np.arange(len(edges) - 1)]
        else:
            clip = lambda x: min(max(x, 0), len(text))
            spans = sorted(((clip(a), max(clip(a), clip(b)), name) for name, a, b in own), key=lambda x: (x[0], x[1], x[2] or ""))
            names, starts, stops = [x[2] for x in spans], np.array([x[0] for x in spans], np.int64), np.array([x[1] for x in spans], np.int64)
            layers = layers_of(starts, stops)
        start, end = token_spans(text, sizes) if len(sizes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        n, over = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        placed, touched = np.zeros(len(start), bool), np.zeros(len(start), bool)
        for layer in layers:
            edges, index = gapless(starts[layer], stops[layer], len(text))
            if not len(start):
                continue
            at = allocate(start, end, edges, rule)
            crossing = (start < edges[at]) | (end > edges[np.minimum(at + 1, len(edges) - 1)])
            n[layer] = np.bincount(at, minlength=len(edges))[index]
            over[layer] = np.bincount(at, crossing, len(edges)).astype(np.int64)[index]
            placed |= np.isin(at, index)
            touched |= crossing
        out = [np.arange(len(names)), names, starts, stops, n, over]
        if not placed.all():
            extra = (-1, None, 0, len(text), int((~placed).sum()), int((touched & ~placed).sum()))
            out = [[*x, y] for x, y in zip(out, extra)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.get()
        names = ["doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing"]
        for batch in batches:
            for part, texts in _parts(batch, texts_of(batch)):
                ids, counts, _ = vocabulary.encode(texts)
                sizes, at = vocabulary.sizes[ids], 0
                given = part.column("sections").to_pylist() if sections else [None] * len(texts)
                columns_: list[list] = [[] for _ in names]
                for doc, text, n, own in zip(part.column("doc_id").to_pylist(), texts, counts.tolist(), given):
                    spans = [(s["name"], s["start"], s["end"]) for s in own or [] if s and s["start"] is not None and s["end"] is not None] if sections else None
                    found = rows_of(text, sizes[at : at + n], spans)
                    at += n
                    columns_[0] += [doc] * len(found[0])
                    for c, x in zip(columns_[1:], found):
                        c.extend(x.tolist() if isinstance(x, np.ndarray) else x)
                types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, types)], names=names)

    return map_texts(docs.select(*columns), run, "doc_id long, section int, name string, start int, end int, n_tokens long, n_crossing long")

"""Operator 4: benchmark passages in documents, by the q-gram lemma on diagonals.

Each benchmark item is cut into windows of ``WIDTH`` characters, ``STRIDE`` apart, the
last one flush with its end. A document holds an item when one of its windows
occurs in the text within an edit budget of ``EDITS`` per character.

A window of n characters that occurs with k edits shares at least
n - q + 1 - q k of its q-grams with the place, and all of them lie on diagonals
(place in the text less place in the window) at most 2 k apart. So, per text:
stretches of text with too few known q-grams for any window go first; in the rest
the shared q-grams of each window are counted in overlapping bands of diagonals;
bands that reach the bound are verified by an alignment inside the band. Nothing
that meets the budget is lost on the way.

Letters are compared in lower case and any white space as one blank. Items with
fewer than ``LEAST`` characters are not looked for: they say too little. The windows
are a stated query set: they are dealt into blocks of ``BLOCK`` windows, each sent to
all tasks and run against all documents; texts stay where they are.

Null texts and items count as empty. Repeated rows are reported each; two items
with the same text are both reported. Extra columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import sliced
from glyphmill.session import materialise

Q = 8
WIDTH, STRIDE, LEAST = 100, 50, 40
EDITS = 0.08
#: Windows in one block: about 25 MB of q-grams and places.
BLOCK = 20_000
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
BITS = 22


def fold(text: str) -> tuple[str, list[str]]:
    """Lower case and single blanks, with as many characters per word as the text has; and the words."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = low.split()
    return " ".join(found), found


def grams(text: str) -> np.ndarray:
    """Hashes of the q-grams of the text, by doubling."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(h) < Q:
        return np.zeros(0, np.uint64)
    span, factor = 1, STEP
    while span < Q:
        h = h[: len(h) - span] * factor + h[span:]
        span, factor = span * 2, U(int(factor) ** 2 % 2**64)
    return (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)


def budget(length: int) -> int:
    return int(length * EDITS)


def bound(length: int) -> int:
    """Shared q-grams that an occurrence within the budget has at least."""
    return length - Q + 1 - Q * budget(length)


class Block(NamedTuple):
    """Windows of items and an index of their q-grams."""

    texts: list[str]
    items: list[int]
    keys: np.ndarray  # distinct grams, sorted
    first: np.ndarray  # where each gram's places start
    window: np.ndarray
    place: np.ndarray
    known: np.ndarray  # a bit per hash prefix
    least: int  # the lowest bound of all windows
    reach: int  # the longest stretch that an occurrence covers


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, window) of all items of ``LEAST`` characters or more."""

    def run(batches):
        for batch in sliced(batches):
            items, texts = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = fold(text or "")[0]
                starts = sorted({*range(0, max(1, len(text) - WIDTH + 1), STRIDE), max(0, len(text) - WIDTH)})
                for s in starts if len(text) >= LEAST else ():
                    items.append(item)
                    texts.append(text[s : s + WIDTH])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(texts, pa.string())], names=["item_id", "window"])

    return benchmark.select(F.col("item_id").cast("bigint"), "text").mapInArrow(run, "item_id long, window string")


def index(rows: list[tuple[int, str]]) -> Block:
    texts, items = [t for _, t in rows], [i for i, _ in rows]
    every = [grams(t) for t in texts]
    gram = np.concatenate(every)
    window = np.repeat(np.arange(len(texts)), [len(g) for g in every])
    place = np.concatenate([np.arange(len(g)) for g in every])
    order = np.argsort(gram, kind="stable")
    keys, first = np.unique(gram[order], return_index=True)
    known = np.zeros(1 << BITS, bool)
    known[(keys >> U(64 - BITS)).astype(np.int64)] = True
    return Block(
        texts, items, keys, np.append(first, len(gram)), window[order], place[order], known,
        min(bound(len(t)) for t in texts), max(len(t) + budget(len(t)) for t in texts),
    )


def dense(hit: np.ndarray, least: int, reach: int) -> np.ndarray:
    """The hits that lie in some stretch of ``reach`` places with ``least`` hits or more."""
    at = np.flatnonzero(hit)
    if len(at) < least:
        return at[:0]
    close = at[least - 1 :] - at[: len(at) - least + 1] < reach
    cover = np.zeros(len(at) + 1, np.int64)
    starts = np.flatnonzero(close)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + least, -1)
    return at[np.cumsum(cover[:-1]) > 0]


def found_in(text: str, block: Block) -> list[tuple[int, int, int, int]]:
    """(window, start, end, edits) of every window of the block that the folded text holds."""
    gram = grams(text)
    at = dense(block.known[(gram >> U(64 - BITS)).astype(np.int64)], block.least, block.reach)
    if len(at) == 0:
        return []
    key = np.minimum(np.searchsorted(block.keys, gram[at]), len(block.keys) - 1)
    at, key = at[block.keys[key] == gram[at]], key[block.keys[key] == gram[at]]
    count = block.first[key + 1] - block.first[key]
    spots = np.repeat(block.first[key] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    window, place, at = block.window[spots], block.place[spots], np.repeat(at, count)
    out = []
    half = 2 * budget(WIDTH) + 1
    # Band b holds the diagonals from (b - 1) * half - WIDTH, two cells of half each: any 2 k neighbours share a
    # band. A hit counts in both bands that its cell belongs to.
    span = len(text) + 2 * WIDTH
    band = window.astype(np.int64) * span + (at - place + WIDTH) // half
    # A q-gram of the window counts once per band.
    pair = np.unique(np.concatenate([band, band + 1]) * WIDTH + np.concatenate([place, place]))
    bands, n = np.unique(pair // WIDTH, return_counts=True)
    least = np.array([bound(len(t)) for t in block.texts])
    for c in bands[n >= least[bands // span]].tolist():
        w, b = divmod(c, span)
        low = (b - 1) * half - WIDTH
        hit = align(block.texts[w], text, low, low + 2 * half - 1, budget(len(block.texts[w])))
        if hit is not None:
            out.append((w, *hit))
    best: dict[int, tuple[int, int, int, int]] = {}
    for w, start, end, edits in sorted(out, key=lambda x: (x[3], x[1], x[2])):
        best.setdefault(w, (w, start, end, edits))
    return list(best.values())


def align(window: str, text: str, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The place with the fewest edits, at most ``most``, among alignments on the diagonals ``low`` to ``high``.

    Gives (start, end, edits) of the first such place in the text, or None.
    """
    exact = text.find(window, max(0, low), max(0, high) + len(window))
    if exact >= 0:
        return exact, exact + len(window), 0
    low, high = low - most, high + most
    far, width = most + 1, high - low + 1
    # Row i, cell d: edits of the first i characters of the window against text that ends at i + low + d.
    cost = [0 if 0 <= low + d <= len(text) else far for d in range(width)]
    start = [low + d for d in range(width)]
    for i, c in enumerate(window):
        new, begin = [far] * width, [0] * width
        for d in range(width):
            j = i + 1 + low + d
            if not 0 <= j <= len(text):
                continue
            best, origin = far, 0
            if j > 0 and cost[d] + (text[j - 1] != c) < best:
                best, origin = cost[d] + (text[j - 1] != c), start[d]
            if d + 1 < width and cost[d + 1] + 1 < best:
                best, origin = cost[d + 1] + 1, start[d + 1]
            if d and j > 0 and new[d - 1] + 1 < best:
                best, origin = new[d - 1] + 1, begin[d - 1]
            new[d], begin[d] = best, origin
        cost, start = new, begin
        if min(cost) >= far:
            return None
    edits = min(cost)
    d = cost.index(edits)
    return start[d], len(window) + low + d, edits


def original(text: str, start: int, end: int) -> tuple[int, int]:
    """Places in the folded text as places in the text itself."""
    import re

    at, out = 0, [len(text), 0]
    for m in re.finditer(r"\S+", text):
        size = m.end() - m.start()
        if at <= start < at + size + 1 and out[0] == len(text):
            out[0] = min(m.start() + start - at, m.end())
        if at < end <= at + size:
            out[1] = m.start() + end - at
        at += size + 1
        if at >= end and out[1]:
            break
    return out[0], max(out)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, doc_id, item_id, start, end, edits): one row per row of ``docs`` and item that it holds.

    ``start`` and ``end`` bound the item's windows found, in code points of the text;
    ``edits`` is the lowest of theirs. ``key`` is the hash of doc_id and text.
    """
    spark = docs.sparkSession
    cut = materialise(windows(benchmark), "benchmark-windows")
    blocks = -(-cut.count() // BLOCK)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "key long, doc_id long, item_id long, start long, end long, edits int"
    out = None
    for b in range(max(blocks, 1)):
        # Two times BLOCK windows at the very most hash to one block of a few.
        rows = cut.filter(F.pmod(F.xxhash64("item_id", "window"), F.lit(max(blocks, 1))) == b).collect() if blocks else []
        shared = spark.sparkContext.broadcast(index([(r["item_id"], r["window"]) for r in rows]) if rows else None)
        part = texts.mapInArrow(searcher(shared), schema)
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        out = out.groupBy("key", "doc_id", "item_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"))
    return out


def searcher(shared):
    """The search of one block, for mapInArrow."""

    def run(batches):
        block = shared.value
        for batch in sliced(batches):
            rows = []
            for key, doc, text in zip(*[batch.column(c).to_pylist() for c in ("key", "doc_id", "text")], strict=True):
                folded = fold(text)[0] if text and block else ""
                held: dict[int, list[int]] = {}
                for w, start, end, edits in found_in(folded, block) if len(folded) >= Q else ():
                    old = held.get(block.items[w], [start, end, edits])
                    held[block.items[w]] = [min(start, old[0]), max(end, old[1]), min(edits, old[2])]
                for item, (start, end, edits) in sorted(held.items(), key=lambda x: (x[0] is None, x[0] or 0)):
                    rows.append((key, doc, item, *original(text, start, end), edits))
            columns = zip(*rows, strict=True) if rows else [[] for _ in range(6)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "doc_id", "item_id", "start", "end", "edits"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    held = materialise(leaks(docs, benchmark).select("key").distinct(), "leaks")
    return docs.join(held, F.xxhash64(docs["doc_id"], docs["text"]) == held["key"], "left_anti")

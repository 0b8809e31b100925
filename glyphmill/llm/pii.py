"""Operator 9: personal data by fixed patterns and a semi-Markov conditional random field.

The base spans are the matches of fixed patterns and always stay. A semi-Markov
field then reads the same places as a whole: a segmentation is a sequence of
segments, each an entity of some type or one outside token; a segment's score is a
sum of weights of features of the whole span (its shape, digit count, checks that
hold for it, what stands around it) and its type. Dynamic programming finds the
best segmentation, boundaries and types together. Entities it finds beside the
base spans are added, such as numbers written with dots or blanks that the
patterns do not know.

An entity needs a digit or an at sign and is at most ``LONGEST`` tokens long, so
only stretches of text around such characters are read; outside them every token
is outside any entity, and the result is that of the whole text. A stretch is a
run of chunks between white space, so its length is bounded by the text alone and
the work is linear in it.

The weights maximise the conditional likelihood of stretches whose segmentation
the base patterns give. The sample has at most ``SAMPLE`` stretches, those of the
lowest hashes; everything else covers all rows. Without a sample no span is added.

Null texts count as empty. Repeated rows get the same spans. Rows without any
span have the empty list. Extra columns are not looked at.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import sliced

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: A stretch: chunks with a digit or an at sign, blanks between them, and the chunk on either side.
ANCHOR = re.compile(r"[0-9@]")
CHUNK = re.compile(r"\S+")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
LONGEST = 24
#: Digits that an entity without an at sign has, unless dots cut it into four.
LEAST_DIGITS = 7
SAMPLE = 2000
#: Made-up runs of numbers of no meaning, such as dates, versions and tables, that teach the field what is nothing.
DECOYS = 600
#: Outside, then the entity types.
TYPES = len(KINDS) + 1


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    if kind == "card":
        number = digits(found)
        return 13 <= len(number) <= 19 and luhn(number)
    if kind == "phone":
        return 9 <= len(digits(found)) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns: leftmost matches per kind, those that fail their check dropped."""
    if not ANCHOR.search(text):
        return []
    out = []
    for kind, pattern in PATTERNS.items():
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(kind, m[0])]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Bounds of the maximal runs of neighbouring chunks of which no two in a row lack an anchor."""
    out: list[list[int]] = []
    last = -1
    for a in ANCHOR.finditer(text):
        if a.start() < last:
            continue
        start = end = a.start()
        while start and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        last = end
        if out and not text[out[-1][1] : start].strip() and start - out[-1][1] <= 3:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def shape(text: str) -> str:
    """Letters as a, digits as 0, runs of either as one; blanks as they are."""
    return re.sub("0+", "0", re.sub("a+", "a", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", text))))


def features(text: str, start: int, end: int) -> tuple[str, ...]:
    """Features of the whole span."""
    found = text[start:end]
    number = digits(found)
    form = shape(found)
    before, after = text[start - 1 : start], text[end : end + 1]
    side = lambda c: "edge" if not c or c.isspace() else "a" if c.isalpha() else "0" if c.isdigit() else c
    out = [f"shape={form[:40]}", f"digits={min(len(number), 20)}", f"before={side(before)}", f"after={side(after)}"]
    out += [f"first={form[:1]}", f"last={form[-1:]}", f"groups={min(form.count('0'), 9)}", f"at={min(form.count('@'), 2)}"]
    if 13 <= len(number) <= 19:
        out.append(f"luhn={luhn(number)}")
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", found):
        out.append(f"octets={holds('ip', found)}")
    if re.search("[a-zA-Z]", found):
        out.append("letters")
    if re.search(r"[^0-9+().\x20-]", found):
        out.append("odd for a number")
    return tuple(out)


class Lattice(NamedTuple):
    """The tokens of a stretch and the segments that may be entities."""

    tokens: list[tuple[int, int]]
    segments: list[tuple[int, int, tuple[str, ...]]]  # first token, token after the last, features


def lattice(text: str, start: int, end: int) -> Lattice:
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]
    segments = []
    for i, (a, first) in enumerate(tokens):
        lead = text[a]
        if not (lead.isascii() and (lead.isalnum() or lead in "+(._%-")):
            continue
        size = at = dots = 0
        for j in range(i, min(len(tokens), i + LONGEST)):
            b = tokens[j][1]
            piece = text[tokens[j][0] : b]
            if j > i and tokens[j][0] - tokens[j - 1][1] > 1 or not (piece.isascii() and (piece.isalnum() or piece in "@._%+-()")):
                break
            size += len(piece) if piece.isdigit() else 0
            at += piece == "@"
            dots += piece == "."
            if size > 24 or at > 1:
                break
            if piece.isalnum() and (at or size >= LEAST_DIGITS or size and dots == 3):
                segments.append((i, j + 1, features(text, a, b)))
    return Lattice(tokens, segments)


def gold(text: str, part: Lattice, base: list[tuple[str, int, int]]) -> dict[tuple[int, int], int]:
    """The segments that base spans mark, with their types; of overlapping spans the first listed."""
    starts, ends = {a: k for k, (a, _) in enumerate(part.tokens)}, {b: k + 1 for k, (_, b) in enumerate(part.tokens)}
    out: dict[tuple[int, int], int] = {}
    for kind, a, b in base:
        i, j = starts.get(a), ends.get(b)
        if i is not None and j is not None and not any(i < y and x < j for x, y in out):
            out[i, j] = KINDS.index(kind) + 1
    return out


class Weights(NamedTuple):
    index: dict[str, int]
    value: np.ndarray  # features by types; the first column, outside, stays zero


def scores(weights: Weights, found: tuple[str, ...]) -> np.ndarray:
    rows = [weights.index[f] for f in found if f in weights.index]
    return weights.value[rows].sum(0) + weights.value[0]


def fit(samples: list[tuple[Lattice, dict[tuple[int, int], int], float]], rounds: int = 80, rate: float = 0.3, ridge: float = 0.01) -> Weights:
    """Maximise the conditional log-likelihood of the segmentations, by AdaGrad over all samples at once.

    Forward and backward sums run over token places; a segment's expected count
    is its share of all segmentations' weight.
    """
    names = sorted({f for part, _, _ in samples for s in part.segments for f in s[2]})
    index = {"": 0} | {f: k + 1 for k, f in enumerate(names)}
    value, square = np.zeros((len(index), TYPES)), np.full((len(index), TYPES), 1e-8)
    # Without a matching feature no segment should be an entity.
    value[0, 1:] = -4.0
    found = [[0, *(index[f] for f in s[2])] for part, _, _ in samples for s in part.segments]
    flat, first = np.array([k for r in found for k in r], int), np.cumsum([0, *map(len, found)])[:-1]
    owner, size = np.repeat(np.arange(len(found)), [len(r) for r in found]), np.cumsum([0, *(len(part.segments) for part, _, _ in samples)])
    total = max(sum(w for _, _, w in samples), 1.0)
    for _ in range(rounds):
        score = np.add.reduceat(value[flat], first, axis=0)[:, 1:]
        whole = np.exp(score).sum(1)
        expected = np.zeros_like(score)
        for s, (part, marks, weight) in enumerate(samples):
            mine = whole[size[s] : size[s + 1]].tolist()
            n = len(part.tokens)
            ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            into: list[list[int]] = [[] for _ in range(n + 1)]
            out: list[list[int]] = [[] for _ in range(n + 1)]
            for k, (i, j, _) in enumerate(part.segments):
                into[j].append(k)
                out[i].append(k)
            for t in range(1, n + 1):
                ahead[t] = ahead[t - 1] + sum(ahead[part.segments[k][0]] * mine[k] for k in into[t])
            for t in range(n - 1, -1, -1):
                back[t] = back[t + 1] + sum(back[part.segments[k][1]] * mine[k] for k in out[t])
            for k, (i, j, _) in enumerate(part.segments, size[s]):
                expected[k] = weight * ahead[i] * back[j] / ahead[n] * np.exp(score[k])
                if (mark := marks.get((i, j))) is not None:
                    expected[k, mark - 1] -= weight
        gradient = np.zeros_like(value)
        np.add.at(gradient[:, 1:], flat, expected[owner])
        gradient = gradient / total + ridge * value / total
        square += gradient**2
        value -= rate * gradient / np.sqrt(square)
        value[:, 0] = 0
    return Weights(index, value)


def best(part: Lattice, weights: Weights) -> list[tuple[int, int, int]]:
    """(first token, token after the last, type) of the entities of the best segmentation."""
    n = len(part.tokens)
    into: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
    for i, j, found in part.segments:
        score = scores(weights, found)
        kind = int(np.argmax(score[1:])) + 1
        if score[kind] > 0:
            into[j].append((i, float(score[kind]), kind))
    top, came = [0.0] * (n + 1), [(0, 0)] * (n + 1)
    for t in range(1, n + 1):
        top[t], came[t] = top[t - 1], (t - 1, 0)
        for i, score, kind in into[t]:
            if top[i] + score > top[t]:
                top[t], came[t] = top[i] + score, (i, kind)
    out, t = [], n
    while t:
        i, kind = came[t]
        if kind:
            out.append((i, t, kind))
        t = i
    return out[::-1]


def all_spans(text: str, weights: Weights | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind as listed, then start."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if weights is not None:
        for start, end in stretches(text):
            part = lattice(text, start, end)
            if part.segments:
                for i, j, kind in best(part, weights):
                    a, b = part.tokens[i][0], part.tokens[j - 1][1]
                    if not any(x < b and a < y for _, x, y in base):
                        out.append((KINDS[kind - 1], a, b, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def stretch_rows(docs: DataFrame) -> DataFrame:
    """Every stretch of up to 200 characters, with the character on either side."""

    def run(batches):
        for batch in sliced(batches):
            out = []
            for text in batch.column("text").to_pylist():
                if text and ANCHOR.search(text):
                    out += [text[max(0, a - 1) : b + 1] for a, b in stretches(text) if b - a <= 200]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["stretch"])

    return docs.select("text").mapInArrow(run, "stretch string")


def decoys(count: int = DECOYS) -> list[str]:
    """Numbers in runs, as in dates, versions and tables, that hold no base span."""
    rnd, out = np.random.default_rng(7), []
    while len(out) < count:
        marks = rnd.choice(list(" .:/-,"), 2)
        groups = ["".join(map(str, rnd.integers(0, 10, rnd.integers(1, 9)))) for _ in range(rnd.integers(2, 14))]
        text = groups[0] + "".join(str(rnd.choice(marks)) + g for g in groups[1:])
        if not base_spans(text):
            out.append(f" {text} ")
    return out


def samples_of(texts: list[str]) -> list[tuple[Lattice, dict[tuple[int, int], int], float]]:
    """Stretches with their surroundings as samples; equal lattices are one sample of their joint weight."""
    seen: dict[tuple, list] = {}
    for text in texts:
        part = lattice(text, len(text) - len(text.lstrip()), len(text.rstrip()))
        if part.segments:
            marks = gold(text, part, base_spans(text))
            seen.setdefault((tuple(part.segments), tuple(sorted(marks.items()))), [part, marks, 0.0])[2] += 1.0
    return [tuple(v) for v in seen.values()]


def train(docs: DataFrame, sample: int = SAMPLE) -> Weights | None:
    """Fit on the ``sample`` stretches of the lowest hashes, and the decoys."""
    rows = stretch_rows(docs).distinct().orderBy(F.xxhash64("stretch"), "stretch").limit(sample).collect()
    return fit(samples_of([r["stretch"] for r in rows] + decoys())) if rows else None


def personal(docs: DataFrame, weights: Weights | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ``spans``, an array of (kind, start, end, base)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        for batch in sliced(batches):
            found = [
                [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in all_spans(t, shared.value)] if t else []
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(item))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")

"""Operator 12: how many tokens a text has, without making them.

A byte-level tokenizer cuts a text into pre-tokens and encodes each one alone, so a
text's number of tokens is the sum over its pre-tokens. Every distinct pre-token of
the corpus is counted once, with the public library; a table of them meets the
frequencies of pre-tokens in each document.

The frequencies are taken in the task that reads the text. The ``HEAD`` most frequent
pre-tokens at most, which make up nearly all text and would be the hot keys of a join,
go to all tasks as a table of bounded size; what is left of a document, its rare
pre-tokens, is joined with the whole table. Both give the same sums.

Special strings inside a text are one token each, as the library does by default.
Null texts are empty and have no tokens. Repeated rows each have a row. Very long texts are
read in one piece; pre-tokens above ``LONG`` characters are counted where they stand and
never shuffled. Empty tables give no rows. Further columns are not read.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import sliced
from glyphmill.session import materialise

#: Pre-tokens that go to all tasks at most, and the longest of them in characters: some 20 MB of text on average words.
HEAD, HEAD_LONG = 400_000, 48
LONG = 1000
LIMIT = 512
#: Fixed value: the public byte-level pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII only; \x1c to \x1f are no white space there.
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\x20\x09-\x0DA-Za-z0-9]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]+"
#: Counted pre-tokens that a task holds before it hands them on.
FLUSH = 1_000_000


class Cutter:
    """The pre-tokens and special strings of a text under one tokenizer file."""

    def __init__(self, path: str):
        import re

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        step = told["pre_tokenizer"] or {}
        if told["normalizer"] or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True):
            raise ValueError("only byte-level tokenizers without a normaliser and a leading blank are supported")
        for t in told["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("special strings with conditions are not supported")
        special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.plain, self.wide = re.compile(ASCII).findall, regex.compile(PATTERN).findall
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of the text outside special strings, and the number of these."""
        if self.special is None or not self.special.search(text):
            return (self.plain if text.isascii() else self.wide)(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in (self.plain if part.isascii() else self.wide)(part)], len(parts) - 1

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    return Cutter(path)


def pretokens(docs: DataFrame, model: str) -> DataFrame:
    """(piece, n): all distinct pre-tokens of up to ``LONG`` characters and how often they occur; counted before the shuffle."""

    def run(batches):
        cut = cutter(model).cut
        held: Counter[str] = Counter()

        def out():
            rows = [(p, n) for p, n in held.items() if len(p) <= LONG]
            held.clear()
            for k in range(0, len(rows), 100_000):
                part = rows[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["piece", "n"])

        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                held.update(cut(text or "")[0])
            if len(held) > FLUSH:
                yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def with_counts(pieces: DataFrame, model: str) -> DataFrame:
    """Add ``tokens``, the number of tokens of the pre-token."""

    def run(batches):
        counts = cutter(model).counts
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts(batch.column("piece").to_pylist()), pa.int64())], names=[*batch.schema.names, "tokens"])

    return pieces.select("piece", "n").mapInArrow(run, "piece string, n long, tokens long")


def head_of(table: DataFrame) -> dict[str, int]:
    """The most frequent pre-tokens, at most ``HEAD`` and only from a frequency that no more of them reach."""
    short = table.filter(F.length("piece") <= HEAD_LONG)
    # Frequencies by power of two: at most 64 rows, whatever the size of the table.
    steps = short.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()
    room, least = HEAD, None
    for r in steps:
        if r["count"] > room:
            break
        room, least = room - r["count"], r["step"]
    if least is None:
        return {}
    rows = short.filter(F.floor(F.log2("n")) >= least).select("piece", "tokens").toArrow()
    return dict(zip(rows.column("piece").to_pylist(), rows.column("tokens").to_pylist(), strict=True))


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens and over_limit.

    ``model`` is a tokenizer file that every worker can open.
    """
    docs = docs.select("doc_id", "text")
    table = materialise(with_counts(pretokens(docs, model), model), "pretokens")
    head = docs.sparkSession.sparkContext.broadcast(head_of(table))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known, tool = head.value, cutter(model)
        for batch in sliced(batches):
            sums, sizes, rest, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                pieces, total = tool.cut(text)
                found = [known.get(p) for p in pieces]
                if None in found:
                    rare = Counter(p for p, n in zip(pieces, found, strict=True) if n is None)
                    long = [p for p in rare if len(p) > LONG]
                    if long:
                        total += sum(n * rare.pop(p) for p, n in zip(long, tool.counts(long), strict=True))
                    total += sum(n for n in found if n is not None)
                    rest.append(list(rare))
                    times.append(list(rare.values()))
                else:
                    total += sum(found)
                    rest.append([])
                    times.append([])
                sums.append(total)
                sizes.append(len(text.encode()))
            offsets = pa.array(np.cumsum([0, *map(len, rest)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array([x for r in part for x in r], t)) for part, t in ((rest, pa.string()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), *lists], names=["doc_id", "n_bytes", "said", "rest", "times"]
            )

    each = docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, said long, rest array<string>, times array<long>")
    each = materialise(each.withColumn("_row", F.monotonically_increasing_id()), "pretoken-frequencies")
    rare = each.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("_row", F.col("x.rest").alias("piece"), F.col("x.times").alias("times"))
    later = rare.join(table.select("piece", "tokens"), "piece").groupBy("_row").agg(F.sum(F.col("times") * F.col("tokens")).alias("later"))
    total = F.col("said") + F.coalesce("later", F.lit(0))
    out = each.drop("rest", "times").join(later, "_row", "left")
    return out.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))

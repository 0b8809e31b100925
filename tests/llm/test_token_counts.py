"""Token counts against the public library, text by text."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphmill.llm import token_counts as t
from glyphmill.llm.queries import op12_token_counts

MODEL = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(MODEL)
ODD = ["", " ", "a", "don't we'll I'VE", "x  y   z\n\n  q", "\t\x1c\x1d a\x85b c​d", "été Ärger 漢字 🙂🏽", "123abc４５٣", "<|endoftext|>a<|endoftext|>", " <|endoftext|> x",
       "'s't'", "!'s", "\r\n\x0b\x0c", "á", "x" * 3000, "  a", "_-_ '", "﻿z", "\x00\x1f\x7f"]


def want(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def whole(tool, text):
    pieces, special = tool.cut(text)
    return special + sum(tool.counts(pieces))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert whole(t.Cutter(MODEL), text) == want(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'srteld\x1c\x85 ")), max_size=40))
def test_any_text(text):
    assert whole(t.cutter(MODEL), text) == want(text)


@pytest.mark.parametrize("head", [t.HEAD, 3, 0])
def test_equals_the_library(spark, head, monkeypatch):
    """With a small head the frequencies meet the table in the join."""
    monkeypatch.setattr(t, "HEAD", head)
    rng = random.Random(1)
    words = ["the", "of", "rare", "éclair", "x1", "'s", "\n", "  "]
    texts = [*ODD, None, "long " * 50_000, *["".join(rng.choice(words) + " " for _ in range(rng.randrange(40))) for _ in range(60)]]
    rows = [(i if i % 7 else None, x, "n") for i, x in enumerate(texts)] + [(1, " ", "n"), (1, " ", "n"), (1, "other", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rest string").selectExpr("*", "1 AS n", "2 AS piece", "3 AS _row")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in t.token_counts(df, MODEL).collect())
    assert got == sorted((i is None, i or 0, len((x or "").encode()), want(x), want(x) > 512) for i, x, _ in rows)


def test_head_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(t, "HEAD", 5)
    table = spark.createDataFrame([(f"p{i}", 2**min(i, 4), 1) for i in range(12)] + [("y" * 60, 1000, 1)], "piece string, n long, tokens long")
    assert t.head_of(table) == {}  # the eight most frequent fall into one step, which has no room
    monkeypatch.setattr(t, "HEAD", 9)
    assert set(t.head_of(table)) == {f"p{i}" for i in range(3, 12)}


def test_empty(spark):
    assert t.token_counts(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12_token_counts(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: want(x) for i, x in texts.items()}
    assert all(r.over_limit == (r.n_tokens > 512) and r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in rows)

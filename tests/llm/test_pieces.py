"""SentencePiece ids and texts against the public library, id by id."""

import random

import pytest
import sentencepiece

from glyphmill.llm.pieces import encode_decode, pieces
from glyphmill.llm.queries import op8_sentencepiece, tokenizer_model


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_model())


def texts():
    rnd = random.Random(1)
    some = [None, "", " ", "  ", " a", "a  b", "a ", "▁a", "▁", "a\x00b", "日本😀x", "<s>", "<0x41>", "é", "\n\n  x", "\r\n", "a" * 3000, "word " * 30_000, "😀" * 500]
    return some + ["".join(rnd.choice("aaaabbe  eennthst▁\n.é日😀ö0012") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]


def test_against_library(spark, library):
    given = texts()
    docs = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(given)], "doc_id long, text string, ids array<int>")
    out = encode_decode(docs, tokenizer_model()).collect()
    assert len(out) == len(given)
    for r in out:
        ids = library.encode(given[r.doc_id] or "", add_eos=True)
        assert r.ids == ids and r.decoded == library.decode(ids), given[r.doc_id]


def test_decode_any_ids(library):
    rnd, known = random.Random(2), pieces(tokenizer_model())
    for _ in range(5000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.choice([0, 1, 2])]) for _ in range(rnd.randint(0, 8))]
        assert known.decode(ids) == library.decode(ids), ids


def test_empty_table(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), tokenizer_model()).count() == 0


def test_query(spark, sf, library):
    import hashlib

    given = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_sentencepiece(spark, sf).collect():
        ids = library.encode(given[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()

"""The tokenizer job equals the public trainer and encoder."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import ByteLevelBPETokenizer

from glyphmill.operators import bpe
from glyphmill.plans.vocabulary import SPECIAL_TOKENS


def public(texts, vocab, folder):
    path = folder / "corpus.txt"
    path.write_text("".join(t + "\n" for t in texts), encoding="utf-8", newline="")
    t = ByteLevelBPETokenizer()
    t.train(files=[str(path)], vocab_size=vocab, min_frequency=2, special_tokens=SPECIAL_TOKENS, show_progress=False)
    t.save_model(str(folder))
    lines = (folder / "merges.txt").read_text(encoding="utf-8").split("\n")[1:]
    tokens = [k for k, _ in sorted(t.get_vocab().items(), key=lambda x: x[1])]
    return tokens, [tuple(x.split(" ")) for x in lines if x]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def ours(spark, texts, vocab):
    return bpe.train(bpe.pretoken_counts(frame(spark, texts), "text"), vocab)


def corpus(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]


def test_training_equals_public(spark, tmp_path):
    texts = corpus(spark)
    tokens, merges = public(texts, 340, tmp_path)
    got = ours(spark, texts, 340)
    assert got.merges == merges and got.tokens == tokens


def test_full_size_equals_public(spark, tmp_path, monkeypatch):
    """Whole documents to 2,000 tokens; bounds that the words pass."""
    monkeypatch.setattr(bpe, "STRETCHES", 8_000)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    tokens, merges = public(texts, 2_000, tmp_path)
    got = ours(spark, texts, 2_000)
    assert got.merges == merges and got.tokens == tokens


@pytest.mark.parametrize("seed,hot,stretches", [(0, 12, 40), (1, 4, 3), (2, 30, 20), (3, 65_536, 200_000)])
def test_small_alphabets(spark, tmp_path, monkeypatch, seed, hot, stretches):
    """Few letters make ties, doubled symbols and tokens spelled two ways; small
    bounds make the job cut words between rare neighbours and go through many rounds."""
    monkeypatch.setattr(bpe, "HOT", hot)
    monkeypatch.setattr(bpe, "STRETCHES", stretches)
    rnd = random.Random(seed)
    texts = [" ".join("".join(rnd.choice("ab" if seed % 2 else "abc") for _ in range(rnd.randint(1, 9))) for _ in range(12)) for _ in range(15)]
    tokens, merges = public(texts, 275, tmp_path)
    got = ours(spark, texts, 275)
    assert got.merges == merges and got.tokens == tokens


def test_rounds_equal_one_at_a_time():
    """Settling stretches in rounds, without Spark: random counted words, few hot pairs a round, against plain training."""
    rnd = random.Random(7)
    for trial in range(150):
        pieces = {"".join(rnd.choice("abcd"[: 2 + trial % 3]) for _ in range(rnd.randint(2, 12))): rnd.randint(1, 30) for _ in range(40)}
        vocab = 260 + rnd.randint(5, 40)
        plain = bpe.Training(vocab, 2)
        plain.settle(list(pieces.items()), 1)
        state, words = bpe.Training(vocab, 2), dict(pieces)
        while not state.full():
            count = {}
            for w, n in words.items():
                for p in map("".join, zip(w, w[1:])):
                    count[p] = count.get(p, 0) + n
            ranked = sorted(((n, p) for p, n in count.items() if n >= 2), key=lambda x: (-x[0], x[1]))
            if not ranked:
                break
            room = rnd.randint(1, 4)
            cold = ranked[room][0] if room < len(ranked) else 1
            hot = {p for n, p in ranked if n > cold}
            parts = {}
            for w, n in words.items():
                at = 0
                for k in range(1, len(w) + 1):
                    if k == len(w) or w[k - 1 : k + 1] not in hot:
                        parts[w[at:k]] = parts.get(w[at:k], 0) + n
                        at = k
            done = state.settle(list(parts.items()), cold) if hot else [(ranked[0][1], state.learn(ranked[0][1])[0])]
            for pair, symbol in done:
                changed = {}
                for w, n in words.items():
                    changed[w.replace(pair, symbol)] = changed.get(w.replace(pair, symbol), 0) + n
                words = changed
        assert state.merges == plain.merges and state.tokens == plain.tokens


HARD = ["", " ", "a  b\n   c\n", "naïve – ‘quotes’ 東京 🙂\t\r\nend", "it's 'll DON'T 12 345", "<s> </s> <pad>", "x" * 3000, "\x00\x01", "===---===" * 40]


def test_encode_decode_equal_public(spark, tmp_path):
    texts = corpus(spark)
    public(texts, 340, tmp_path)
    reference = ByteLevelBPETokenizer(str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"))
    model = ours(spark, texts, 340)
    df = frame(spark, texts + HARD)
    out = df.withColumn("ids", bpe.encode(F.col("text"), model)).withColumn("back", bpe.decode(F.col("ids"), model)).collect()
    for r in out:
        assert r.ids == reference.encode(r.text).ids, r.text[:40]
        assert r.back == r.text
    assert bpe.roundtrip_check(df, "text", model).first() == (len(texts) + len(HARD), 0)


def test_broken_bytes_decode_as_public(spark, tmp_path):
    texts = ["é東" * 5, "plain"]
    public(texts, 262, tmp_path)
    reference = ByteLevelBPETokenizer(str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"))
    model = ours(spark, texts, 262)
    ids = [reference.encode("é").ids[0], *reference.encode("ok").ids]
    got = spark.range(1).select(bpe.decode(F.array(*[F.lit(i) for i in ids]), model).alias("t")).first().t
    assert got == reference.decode(ids)


def test_load_public_files(spark, tmp_path):
    texts = corpus(spark)[:10]
    tokens, merges = public(texts, 290, tmp_path)
    model = bpe.load_public(spark, str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"))
    assert model == bpe.Tokenizer(tokens, merges)


def test_save_load(spark, tmp_path):
    model = ours(spark, ["low lower lowest newer newest"] * 3, 266)
    bpe.save(spark, model, str(tmp_path / "t"))
    assert bpe.load(spark, str(tmp_path / "t")) == model


def test_cross_lines_learns_line_breaks(spark):
    df = frame(spark, ["a\n    b\n    c"] * 3)
    by_line = {r.piece for r in bpe.pretoken_counts(df, "text").collect()}
    whole = {r.piece for r in bpe.pretoken_counts(df, "text", cross_lines=True).collect()}
    assert "\n" in by_line and "\n   " in whole

"""Work that grows with the rows is done once per row, not once per use."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from catalog import standins, tables
from glyphmill.functions.text import stripped
from glyphmill.operators import bpe, structure
from glyphmill.operators import sequences as seq


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


FLOW = 'flowchart TD\n    A["x"]\n    B["y"]\n    C["x"]\n    A --> B\n    B -->|no| C\n    A --> C'


def test_structure_reads_a_text_once_per_list(spark):
    rows = [(1, FLOW, FLOW.replace("A --> C", "C --> B")), (2, FLOW, None), (3, 'pie\n    "x" : 1', FLOW), (4, None, FLOW), (5, "graph TD", "graph TD")]
    df = spark.createDataFrame(rows, "id int, truth string, prediction string")
    scored = structure.with_structure(df, "truth", "prediction")
    got = {r.id: tuple(r)[3:] for r in scored.collect()}
    assert scored.columns == [*df.columns, "nodes_true", "nodes_predicted", "nodes_shared", "edges_true", "edges_predicted", "edges_shared"]
    assert got[1] == (3, 3, 3, 3, 3, 2) and got[3] == got[4] == (None,) * 6 and got[5] == (0,) * 6
    # Per text: the labels for the nodes; identifiers, labels and three parts of the arrows for the edges.
    f1 = structure.structure_f1(scored.withColumn("kind", F.lit("flow")), "kind")
    assert plan_of(f1).count("regexp_extract_all") <= 12


def test_pretokens_are_those_of_the_public_pattern(spark):
    public = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab'stmdrevl 1²é漢.\n\t\u0085\u00a0 ''") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where(bpe.pretokens(F.col("text"), True) != F.regexp_extract_all("text", F.lit(public), F.lit(0))).count() == 0


def small_model(seed=5):
    """Few letters and many merges, so that tokens are spelled in several ways."""
    rnd, tokens, merges = random.Random(seed), list(bpe.ALPHABET), []
    known = ["a", "b", "c", "d", bpe.LETTER[ord(" ")]]
    while len(merges) < 120:
        pair = rnd.choice(known), rnd.choice(known)
        if pair in merges or len("".join(pair)) > 9:
            continue
        merges.append(pair)
        if "".join(pair) not in tokens:
            tokens.append("".join(pair)), known.append("".join(pair))
    return bpe.Tokenizer(tokens, merges)


def test_pretokens_spelled_together_equal_single_ones():
    model, rnd = small_model(), random.Random(7)
    pieces = list(dict.fromkeys("".join(rnd.choice("abcd é") for _ in range(rnd.choice((1, 3, 8, 9, 16, 17, 32, 33, 200)))) for _ in range(6000)))
    memo = bpe.Memo(model)
    memo.learn(pieces)
    for p in pieces:
        at = memo.place[p]
        got = memo.flat[memo.starts[at] : memo.starts[at] + memo.widths[at]].tolist()
        assert got == [memo.number[t] for t in bpe.spell(p, memo.ranks)]


def test_encoding_goes_through_a_batch_in_slices(spark, monkeypatch):
    """What a task holds for encoding follows SLICE, not the rows of a batch."""
    rows = [["ab"] * 30, None, [], ["c" * 500], *[["abc", " d"]] * 50]
    pieces = pa.array(rows, pa.list_(pa.string()))
    monkeypatch.setattr(bpe, "SLICE", 100)
    parts = list(bpe.sliced(pieces))
    assert [x for p in parts for x in p.to_pylist()] == rows
    assert all(len(p) == 1 or sum(len(w) for r in p.to_pylist() for w in r or ()) <= 100 for p in parts)
    memo = bpe.Memo(small_model())
    whole = memo.encoded(pieces).to_pylist()
    assert [x for p in parts for x in memo.encoded(p).to_pylist()] == whole
    assert whole[1] is None and whole[2] == [] and len(whole[3]) > 1


def test_stripping_reads_the_ends_only(spark):
    """Every character that the pattern takes for a blank goes, at the ends alone, and no pattern is run over the text."""
    pattern = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
    odd = [(chr(c) + "a" + chr(c) + "b" + chr(c) * 2,) for c in range(0x10000) if not 0xD800 <= c < 0xE000] + [("",), (" \n",), (None,)]
    df = spark.createDataFrame(odd, "t string").select(stripped(F.col("t")).alias("x"), F.regexp_replace("t", pattern, "").alias("y"))
    assert df.where(~F.col("x").eqNullSafe(F.col("y"))).count() == 0
    assert "regexp" not in plan_of(df.select("x"))


def test_top_pairs(spark, monkeypatch):
    """Listed are the same pairs as by counting each of them, whatever the cells hold; a pair in a cell that counts less is never counted."""
    rnd = random.Random(9)
    rows = [[f"w{int(60 ** rnd.random())}" for _ in range(rnd.randint(1, 12))] for _ in range(300)] + [[f"once{i}", f"twice{i}"] for i in range(200)]
    want = Counter((a, b) for r in rows for a, b in zip(r, r[1:]))
    ranked = sorted(((a, b, n) for (a, b), n in want.items()), key=lambda x: (-x[2], x[0], x[1]))
    df = spark.createDataFrame([*[(r,) for r in rows], (None,), ([],)], "w array<string>")
    for cells, fullest, most in ((1 << 20, 1000, 50), (16, 1, 50), (1 << 20, 60, 40), (1 << 10, 3, 2), (1 << 20, 1000, 10_000)):
        monkeypatch.setattr(seq, "CELLS", cells)
        monkeypatch.setattr(seq, "FULLEST", fullest)
        assert [tuple(r) for r in seq.top_pairs(df, "w", most).collect()] == ranked[:most]
    monkeypatch.setattr(seq, "CELLS", 1 << 20)
    listed = seq.top_pairs(df, "w", 20)
    assert "LeftSemi" in plan_of(listed)


def test_runs_are_read_once(spark, tmp_path):
    docs = [(i, None if i == 7 else f"w{i} x y z", ("src1", "src2", None)[i % 3]) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = standins.predictions(spark, str(tmp_path), "pred").collect()
    got = {r.metric: r.value for r in tables.run_metrics(spark, str(tmp_path), "pred").collect()}
    same = sum(r.prediction is not None and r.prediction.strip() == r.ground_truth.strip() for r in rows)
    chars = Counter()
    for r in rows:
        chars[r.diagram_type and f"chars_{r.diagram_type[:5]}"] += len(r.prediction or "")
    assert got == {"exact_match": same / 60, "chars": sum(chars.values()), **chars}
    assert plan_of(tables.run_metrics(spark, str(tmp_path), "pred")).count("md5") == 0


def test_pairs_are_added_up_before_they_are_handed_on(spark):
    """Counted on arrays, without a row for each pair of each word."""
    rnd = random.Random(8)
    words = [("".join(rnd.choice("abc\U00010400ž") for _ in range(rnd.randint(0, 9))), rnd.randint(1, 2**60 // 10**5)) for _ in range(3000)]
    df = spark.createDataFrame([*words, ("", 5), ("a", 7)], "word string, n long").repartition(3)
    want = Counter()
    for w, n in words:
        for a, b in zip(w, w[1:]):
            want[int(ord(a) << 21 | ord(b))] += n
    counted = bpe.pair_counts(df)
    assert {r.code: r.n for r in counted.collect()} == dict(want)
    assert "Generate" not in plan_of(counted) and bpe.pair_counts(df.limit(0)).count() == 0


def test_merges_are_applied_in_their_order(spark):
    """Against replacing one merge after the other; tokens spelled two ways, pairs merged twice, doubled symbols, long words."""
    rnd = random.Random(9)
    for trial in range(4):
        pieces = Counter("".join(rnd.choice("abcd"[: 2 + trial % 3]) for _ in range(rnd.choice((1, 2, 5, 9, 14, 40)))) for _ in range(400))
        done = bpe.Training(256 + 60, 2).settle(list(pieces.items()), 1)
        assert len(done) > 20
        want = Counter()
        for w, n in pieces.items():
            for pair, symbol in done:
                w = w.replace(pair, symbol)
            want[w] += n if len(w) > 1 else 0
        got = Counter()
        for r in bpe.advanced(spark.createDataFrame(list(pieces.items()), "word string, n long").repartition(2), done).collect():
            got[r.word] += r.n
        assert got == +want

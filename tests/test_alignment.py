"""Positional joins, padded batches, vocabularies and nested summaries."""

from pyspark.sql import functions as F

from glyphmill.operators import repair, summary
from glyphmill.operators import sequences as seq
from glyphmill.operators.splits import with_batches


def test_kth_with_kth(spark):
    """Unequal counts, a surplus on either side, a group without a key, and one group spread over buckets."""
    left = [(g, i, f"l{i}") for g in (1, 2, None) for i in range({1: 3, 2: 5, None: 2}[g])] + [(9, i, f"l{i}") for i in range(300)]
    right = [(g, 10 * i, f"r{i}") for g in (1, 2, 4, None) for i in range({1: 5, 2: 2, 4: 1, None: 1}[g])] + [(9, -i, f"r{i}") for i in range(250)]
    a, b = spark.createDataFrame(left, "g int, i int, x string"), spark.createDataFrame(right, "g int, j int, y string")
    want = set()
    for g in (1, 2, 9, None):
        mine = sorted((i, x) for h, i, x in left if h == g)
        other = [y for _, y in sorted((j, y) for h, j, y in right if h == g)]
        want |= {(g, k + 1, x, other[k] if k < len(other) else None) for k, (_, x) in enumerate(mine)}
    for rows in (2_000_000, 40):
        got = repair.kth_with_kth(a, b, ["g"], ["i"], ["j"], rows)
        assert {(r.g, r.pos, r.x, r.y) for r in got.collect()} == want and got.count() == len(left)


def test_padded_batches_move_the_sequences_once(spark):
    df = spark.range(0, 53).select(F.col("id"), F.transform(F.sequence(F.lit(1), F.col("id") % 7 + 1), lambda x: x.cast("int")).alias("ids"))
    df = df.repartition(4)
    old = seq.pad_batches(with_batches(df, "id", 8), "ids")
    for rows in (2_000_000, 10):
        got = seq.padded_batches(df, "id", "ids", 8, rows)
        assert sorted(map(str, got.select(*old.columns).collect())) == sorted(map(str, old.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = seq.padded_batches(spark.range(40).select("id", F.array(F.col("id").cast("int")).alias("ids")), "id", "ids", 8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("Initial Plan")[-1]
    wide = [line for line in final.split("\n") if " Exchange " in line and "hashpartitioning(id" in line]
    assert len(wide) == 2  # the sequences, and the keys that meet them


def test_vocabulary_both_ways(spark):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("b a b c a b d".split())] + [(2, 0, "zz"), (2, 1, None)], "doc int, pos int, word string")
    vocabulary = seq.ranked_vocabulary(words, "word", 3, 4, rows_per_bucket=1)
    assert {r.word: r.id for r in vocabulary.collect()} == {"b": 4, "a": 5, "c": 6}
    ids = seq.words_to_ids(words, "word", vocabulary, 3)
    back = {r.doc: r.text for r in seq.ids_to_text(ids, "doc", "pos", vocabulary, "word", "<unk>").collect()}
    assert back == {1: "b a b c a b <unk>", 2: "<unk> <unk>"}
    whole = seq.ranked_vocabulary(words.where("word is not null"), "word", 99, 4)
    text = seq.ids_to_text(seq.words_to_ids(words.where("doc = 1"), "word", whole, 3), "doc", "pos", whole, "word", "<unk>")
    assert text.first().text == "b a b c a b d"


def test_summaries_come_back_whole(spark, tmp_path):
    history = spark.createDataFrame([(1, 0.5, 0.7, 0.8, 10), (2, 0.6, 0.75, 0.9, 11)], "epoch int, val_loss double, val_token_acc double, train_token_acc double, seconds int")
    params = spark.createDataFrame([("total", 105), ("encoder", 80)], "name string, n long")
    hits = spark.createDataFrame([(True,), (False,)], "exact_match boolean")
    facts = summary.sequence_summary(history, params, 6000, hits, hits.limit(0), hits, 58_000)
    facts.write.json(str(tmp_path / "s"))
    got = summary.read_summary(spark, str(tmp_path / "s"), summary.SEQUENCE_SUMMARY).first()
    assert tuple(got) == ({"encoder": 80, "total": 105}, 6000, 0.5, 0.75, 0.9, 0.5, None, 2, False, "58000", 2, 21.0)
    scored = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "b"), ("a", "z")], "t string, p string")
    split = spark.createDataFrame([("train",), ("train",), ("val",)], "split string")
    told = summary.classifier_summary(history.withColumnRenamed("val_loss", "val_accuracy"), scored, "t", "p", ["a", "b", "c"], split)
    told.write.json(str(tmp_path / "c"))
    got = summary.read_summary(spark, str(tmp_path / "c"), summary.CLASSIFIER_SUMMARY).first()
    assert tuple(got) == (["a", "b", "c"], 0.6, [[1, 1, 0], [0, 1, 0], [0, 0, 0]], 2, 2, 1)


def test_label_index_ranks_in_spark(spark):
    from glyphmill.operators.classify import label_index

    words = ["b", "a", "ab", "aaaaaaz", "aaaaaab", "Z", "é", "日本", "", "a\x00", None, "b"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    order = sorted({w for w in words if w is not None}, key=lambda w: w.encode())
    for rows in (2_000_000, 3):
        got = {r.i: r.label_id for r in label_index(df, "w", rows_per_bucket=rows).collect()}
        assert got == {i: None if w is None else order.index(w) for i, w in enumerate(words)}
    assert label_index(df.select(F.col("i").alias("w")), "w").where("label_id is null").count() == 0

"""Training in epochs, and the inference flow from a fitted model to repaired code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import bpe, epochs
from glyphmill.operators import sequences as seq
from glyphmill.plans import inference
from glyphmill.plans.vocabulary import SPECIAL_TOKENS

BYTES = bpe.Tokenizer([*SPECIAL_TOKENS, *bpe.ALPHABET], [])


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    made = [(i, [rnd.gauss(i % 3 == k, 0.6) for k in range(3)], i % 3, i % 5 == 0) for i in range(200)]
    odd = [(900, [1.0, None, 0.0], 1, False), (901, None, 0, False), (902, [1.0, 2.0], 0, True), (903, [1.0, 1.0, 1.0], 7, True), (904, [0.0, 0.0, 1.0], None, None)]
    return spark.createDataFrame(made + odd, "id long, x array<double>, y int, val boolean")


def train(rows, folder, upto):
    return epochs.train_epochs(rows, "x", "y", F.col("val"), 3, 3, folder, upto)


def test_one_pass_equals_numpy(rows):
    model = epochs.Linear(np.arange(12, dtype=float).reshape(3, 4) / 7)
    data = epochs.numbered(rows, "x", "y", F.col("val"), 3, 3)
    sums, gradient = epochs.one_pass(data.repartition(5), model)
    got = data.collect()
    x, y, val = np.array([r.x for r in got]), np.array([r.y for r in got]), np.array([r.val for r in got])
    p = np.exp(model.scores(x))
    p /= p.sum(axis=1, keepdims=True)
    for name, some in (("train", ~val), ("val", val)):
        assert sums[f"n_{name}"] == some.sum() and sums[f"{name}_hits"] == (p.argmax(axis=1) == y)[some].sum()
        assert abs(sums[f"{name}_loss"] + np.log(p[np.arange(len(y)), y])[some].sum()) < 1e-9
    want = ((p - np.eye(3)[y])[~val].T @ np.hstack([x, np.ones((len(x), 1))])[~val]) / (~val).sum()
    assert np.allclose(gradient, want)


def test_goes_on_where_it_ended(rows, tmp_path):
    whole = train(rows, str(tmp_path / "a"), 5).orderBy("epoch").collect()
    for upto in (1, 3, 3, 5):
        train(rows, str(tmp_path / "b"), upto)
    parts = epochs.history(rows.sparkSession, str(tmp_path / "b")).orderBy("epoch").collect()
    assert [r.epoch for r in parts] == [1, 2, 3, 4, 5]
    assert all(abs(a - b) < 1e-9 for p, q in zip(whole, parts) for a, b in zip(p, q))
    assert whole[-1].train_loss < whole[0].train_loss and whole[-1].val_accuracy > 0.6


def test_keeps_the_first_best(rows, tmp_path):
    told = epochs.with_best(train(rows, str(tmp_path), 6)).orderBy("epoch").collect()
    last = max(r.epoch for r in told if r.new_best)
    kept, model = epochs.best_model(rows.sparkSession, str(tmp_path))
    assert kept == last == min(r.epoch for r in told if r.val_accuracy == max(q.val_accuracy for q in told))
    sums, _ = epochs.one_pass(epochs.numbered(rows, "x", "y", F.col("val"), 3, 3), model)
    assert sums["val_hits"] / sums["n_val"] == told[kept - 1].val_accuracy


def test_flow(spark):
    vectors = spark.createDataFrame([([1.0, 0.0], 0), ([0.0, 1.0], 1), ([5.0, 5.0], 3), ([1.0, 0.2], 0)], "x array<double>, y int")
    model = inference.centroids(vectors, "x", "y")
    assert len(model.weights) == 4  # class 2 has no rows
    code = {0: 'a "one" b "two"', 1: "no label", 2: 'é "x"'}
    base = spark.createDataFrame(
        [(0, [1.0, 0.1], code[0], ["ONE"]), (1, [0.1, 1.0], code[1], None), (2, [5.0, 4.0], code[2], ["y"]), (3, [0.9, 0.0], "", ["z"])],
        "id int, features array<double>, code_in string, texts array<string>",
    )
    items = base.withColumn("ids", F.concat(seq.to_sequence(bpe.encode(F.col("code_in"), BYTES), None), seq.ints(9, 2)))
    done, stopped = inference.infer(items, model, BYTES, [3])
    got = {r.id: r for r in done.collect()}
    assert {r.id for r in stopped.collect()} == {2} and set(got) == {0, 1, 3}
    assert got[0].code == code[0] and got[0].repaired == 'a "ONE" b "two"' and [s.status for s in got[0].slots] == ["replaced", "kept"]
    assert got[1].repaired == code[1] and got[1].pred == 1 and got[3].repaired == ""
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_model_is_loaded_once_a_worker(spark):
    """A batch size of one row: the loader runs no oftener than there are tasks."""
    from glyphmill.operators.classify import batch_scorer

    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda batch: batch

    scored = spark.range(40).repartition(2).select(F.array(F.col("id").cast("double")).alias("x"))
    assert scored.select(batch_scorer(load, 1, batch_size=1)("x").alias("s")).collect()
    assert loads.value <= 2

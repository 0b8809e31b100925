"""Classifier training in resumable epochs, with a validation metric each; the best model is kept.

An epoch is one pass over the rows: every task sums loss, hits and gradient of its rows under
the weights so far, Spark adds the tasks' sums up, and the driver, which holds the weights and
nothing else, takes one step. State, history and best model are tables in the training's folder, so a
run that ended in between goes on from its last whole epoch, and one that is complete does nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.metrics import best_so_far
from glyphmill.session import materialise
from glyphmill.streaming.live import latest_version, new_version, versions

#: Step size, and how slowly the means of the gradient and of its square change.
RATE, FIRST, SECOND = 0.1, 0.9, 0.99
SUMS = ("n_train", "train_loss", "train_hits", "n_val", "val_loss", "val_hits")


class Linear(NamedTuple):
    """Scores are ``weights @ (features, 1)``: a row per class, the offset last."""

    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:, :-1].T + self.weights[:, -1]


def numbered(rows: DataFrame, features: str, label: str, is_val: Column, classes: int, width: int) -> DataFrame:
    """(x, y, val) of the rows with all features and a class below ``classes``; others teach nothing."""
    out = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), F.coalesce(is_val, F.lit(False)).alias("val"))
    whole = (F.size("x") == width) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    return out.where(F.col("y").between(0, classes - 1) & F.coalesce(whole, F.lit(False)))


def one_pass(rows: DataFrame, model: Linear) -> tuple[dict[str, float], np.ndarray]:
    """Sums of ``SUMS`` over all rows, and the gradient of the training loss."""
    classes, width = model.weights.shape
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        sums, gradient = np.zeros(len(SUMS)), np.zeros((classes, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width - 1)
            y, val = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "val"))
            raw = shared.value.scores(x)
            raw -= raw.max(axis=1, keepdims=True)
            log_p = raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))
            loss, hit = -log_p[np.arange(len(y)), y], raw.argmax(axis=1) == y
            for k, some in enumerate((~val, val)):
                sums[3 * k : 3 * k + 3] += some.sum(), loss[some].sum(), hit[some].sum()
            off = np.exp(log_p)
            off[np.arange(len(y)), y] -= 1
            off[val] = 0
            gradient += off.T @ np.hstack([x, np.ones((len(x), 1))])
        yield pa.RecordBatch.from_arrays([*[pa.array([s]) for s in sums], pa.array([gradient.ravel()], pa.list_(pa.float64()))], names=[*SUMS, "g"])

    parts = rows.mapInArrow(run, ", ".join([*[f"{s} double" for s in SUMS], "g array<double>"]))
    parts = materialise(parts, "gradients")  # a row per task
    told = parts.agg(*[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in SUMS]).first().asDict()
    cells = parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(classes * width)
    out[cells.column("i").to_numpy()] = cells.column("v").to_numpy()
    return told, out.reshape(classes, width) / max(told["n_train"], 1)


def table_of(spark: SparkSession, **parts: np.ndarray) -> DataFrame:
    """Arrays of a model, a row per class; a model fits the driver."""
    names = list(parts)
    rows = [(i, *[list(map(float, parts[n][i])) for n in names]) for i in range(len(parts[names[0]]))]
    return spark.createDataFrame(rows, ", ".join(["class int", *[f"{n} array<double>" for n in names]]))


def arrays_of(table: DataFrame) -> dict[str, np.ndarray]:
    rows = table.orderBy("class").collect()
    return {n: np.array([r[n] for r in rows]) for n in table.columns if n != "class"}


def train_epochs(rows: DataFrame, features: str, label: str, is_val: Column, classes: int, width: int, folder: str, epochs: int) -> DataFrame:
    """Train to ``epochs`` epochs, going on from what ``folder`` holds; the history so far.

    A model replaces the best one only if its validation accuracy is higher, so the first wins ties.
    """
    spark = rows.sparkSession
    data = numbered(rows, features, label, is_val, classes, width)
    done = versions(spark, f"{folder}/state")
    at = done[-1] if done else 0
    if done:
        state = arrays_of(latest_version(spark, f"{folder}/state"))
    else:
        state = {n: np.zeros((classes, width + 1)) for n in ("weights", "mean", "square")}
    told = versions(spark, f"{folder}/history")
    while at <= epochs and not (told and told[-1] >= epochs):
        sums, gradient = one_pass(data, Linear(state["weights"]))
        if at:
            share = lambda k, n: float(sums[k] / sums[n]) if sums[n] else None
            row = (at, share("train_loss", "n_train"), share("val_loss", "n_val"), share("val_hits", "n_val"))
            before = [r.val_accuracy for r in history(spark, folder).where(F.col("epoch") < at).collect()] if told else []
            best = row[3] is not None and all(a is None or row[3] > a for a in before)
            if best or not before:
                new_version(table_of(spark, weights=state["weights"]), f"{folder}/best", at)
            # The row comes last: an epoch without it is done again.
            spark.createDataFrame([row], HISTORY).write.mode("overwrite").parquet(f"{folder}/history/version={at}")
            told = [*told, at]
        if at == epochs:
            break
        at += 1
        state["mean"] = FIRST * state["mean"] + (1 - FIRST) * gradient
        state["square"] = SECOND * state["square"] + (1 - SECOND) * gradient**2
        step = (state["mean"] / (1 - FIRST**at)) / (np.sqrt(state["square"] / (1 - SECOND**at)) + 1e-8)
        state["weights"] = state["weights"] - RATE * step
        new_version(table_of(spark, **state), f"{folder}/state", at)
    return history(spark, folder)


HISTORY = "epoch int, train_loss double, val_loss double, val_accuracy double"


def history(spark: SparkSession, folder: str) -> DataFrame:
    """One row per epoch, as written."""
    return spark.read.schema(HISTORY).parquet(*[f"{folder}/history/version={v}" for v in versions(spark, f"{folder}/history")])


def with_best(told: DataFrame) -> DataFrame:
    """The history with a flag on each epoch that beats the accuracy of all before it."""
    named = told.withColumn("_run", F.lit(0))
    return best_so_far(named, ["_run"], "epoch", "val_accuracy", lower=False).drop("_run")


def best_model(spark: SparkSession, folder: str) -> tuple[int, Linear]:
    """Epoch and weights of the model that was kept."""
    return versions(spark, f"{folder}/best")[-1], Linear(arrays_of(latest_version(spark, f"{folder}/best"))["weights"])

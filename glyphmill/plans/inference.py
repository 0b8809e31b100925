"""From items to repaired code in one plan: score, gate, decode, repair, report.

The first model scores the features; it is a broadcast value that a Python worker unpacks once.
Rows of a rejected class stop at the gate, ahead of the second model's output, whose ids are cut at
the end mark, freed of special ids and decoded in the JVM. The texts read from the picture then take the
places of the quoted labels. Nothing is shuffled: the flow is one narrow stage.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.vectors import softmax
from glyphmill.operators import bpe, repair
from glyphmill.operators import sequences as seq
from glyphmill.operators.classify import batch_scorer, gate, gate_rejects, with_top
from glyphmill.operators.epochs import Linear


def centroids(rows: DataFrame, features: str, label: str) -> Linear:
    """A classifier fitted in one pass: the nearest of the classes' means, as linear scores; classes are 0, 1, ...

    Means are grouped sums; a row per class reaches the driver. A class without rows scores lowest everywhere.
    """
    cells = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("c"), F.posexplode(F.col(features).cast("array<double>")).alias("i", "v"))
    means = cells.groupBy("c", "i").agg(F.avg("v").alias("m")).toArrow()
    c, i, m = (means.column(n).to_numpy() for n in ("c", "i", "m"))
    mu = np.full((c.max() + 1, i.max() + 1), np.nan)
    mu[c, i] = m
    known = ~np.isnan(mu).any(axis=1)
    mu[~known] = 0
    return Linear(np.hstack([2 * mu, np.where(known, -(mu**2).sum(axis=1), -1e30)[:, None]]))


def scorer(df: DataFrame, model: Linear):
    """Column function of a model; each Python worker unpacks it once."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def load():
        known = shared.value
        return lambda batch: known.scores(batch.astype(np.float64))

    return batch_scorer(load, model.weights.shape[1] - 1, kind="double")


def routed(items: DataFrame, features: str, model: Linear) -> DataFrame:
    """Add the top class ``pred`` and its ``confidence``."""
    scored = items.withColumn("_scores", scorer(items, model)(F.col(features)))
    return with_top(scored.withColumn("_probs", softmax(F.col("_scores"))), "_probs").drop("_scores", "_probs")


def code_of(ids: Column, tokenizer: bpe.Tokenizer) -> Column:
    """Text of a model's output: up to the end mark, without special ids."""
    return bpe.decode(seq.without_special(seq.cut_at_eos(ids, None)), tokenizer)


def infer(items: DataFrame, model: Linear, tokenizer: bpe.Tokenizer, rejected: Sequence, features: str = "features", ids: str = "ids", texts: str = "texts") -> tuple[DataFrame, DataFrame]:
    """The items that pass the gate, with pred, confidence, code, repaired and slots; and those that the gate stops.

    ``slots`` says what became of each label; null texts leave the code as it is.
    """
    scored = routed(items, features, model)
    passed = gate(scored, "pred", rejected).withColumn("code", code_of(F.col(ids), tokenizer))
    read = F.coalesce(texts, F.array().cast("array<string>"))
    done = passed.withColumns({"repaired": repair.substitute(F.col("code"), read), "slots": repair.substitutions(F.col("code"), read)})
    return done, gate_rejects(scored, "pred", rejected)

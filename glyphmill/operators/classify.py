"""Label index, classifier training, scoring with a gate, batch inference."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.vectors import arg_max, softmax
from glyphmill.operators.running import ROWS_PER_BUCKET, with_rank
from glyphmill.session import materialise

Predict = Callable[[np.ndarray], np.ndarray]


def label_index(df: DataFrame, label: str, name: str = "label_id", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the 0-based alphabetical position of the label among the labels present; none for a null label.

    The distinct labels are ranked in buckets by their first bytes, so there may be as many as rows; Catalyst sends
    their table to all tasks only if it is small.
    """
    text = F.col(label).cast("string")
    labels = df.where(F.col(label).isNotNull()).select(text.alias("_label")).distinct().withColumn("_first", first_of("_label"))
    ranked = with_rank(labels, [], ["_first", "_label"], "_place", rows_per_bucket)
    known = materialise(ranked.select("_label", (F.col("_place") - 1).cast("int").alias(name)), "labels")
    return df.join(known, text == F.col("_label"), "left").drop("_label")


def first_of(text: str) -> Column:
    """The first six bytes of a string as a number that rises with it."""
    return F.conv(F.rpad(F.substring(F.hex(text), 1, 12), 12, "0"), 16, 10).cast("long")


def train_classifier(train: DataFrame, features: str, label: str, iterations: int = 15) -> LogisticRegressionModel:
    """Multi-class classifier on a numeric array column."""
    vectors = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(family="multinomial", maxIter=iterations).fit(vectors)


def training_history(model: LogisticRegressionModel) -> DataFrame:
    """Loss per iteration; as long as the number of iterations."""
    spark = model.summary.predictions.sparkSession
    rows = [(i, float(x)) for i, x in enumerate(model.summary.objectiveHistory)]
    return spark.createDataFrame(rows, "epoch int, train_loss double")


def score(df: DataFrame, features: str, model: LogisticRegressionModel) -> DataFrame:
    """Add class probabilities, predicted class and its probability."""
    vectors = df.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    probs = model.transform(vectors).withColumn("probs", vector_to_array("probability"))
    return with_top(probs.select(*df.columns, "probs"), "probs")


def score_logits(df: DataFrame, logits: str) -> DataFrame:
    """Softmax of raw scores, then the top class."""
    return with_top(df.withColumn("probs", softmax(F.col(logits))), "probs")


def with_top(df: DataFrame, probs: str) -> DataFrame:
    return df.withColumns({"pred": arg_max(F.col(probs)), "confidence": F.array_max(probs)})


def gate(df: DataFrame, pred: str, rejected: Sequence) -> DataFrame:
    """Stop rows of the rejected classes, and rows without a class, before the next, dearer step."""
    return df.where(passes(pred, rejected))


def gate_rejects(df: DataFrame, pred: str, rejected: Sequence) -> DataFrame:
    """The rows that ``gate`` stops."""
    return df.where(~passes(pred, rejected))


def passes(pred: str, rejected: Sequence) -> Column:
    return F.coalesce(~F.col(pred).isin(list(rejected)), F.lit(False))


def batch_scorer(load: Callable[[], Predict], width: int, batch_size: int = 256, kind: str = "float") -> Callable[..., Column]:
    """Column function of a model that ``load`` brings up once per Python worker.

    The model maps a batch of feature rows, ``width`` wide, to a batch of class scores.
    """
    return predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType() if kind == "double" else T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[width]])


def route_and_repair(df: DataFrame, features: str, scorer: Callable[..., Column], rejected: Sequence, second: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Batch inference: score, pick the class, gate, then the second step on what is left."""
    scored = score_logits(df.withColumn("logits", scorer(F.col(features))), "logits").drop("logits", "probs")
    return second(gate(scored, "pred", rejected))

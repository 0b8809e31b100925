"""Run summaries: one nested row of facts, with a map of parameter counts or a confusion matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE_SUMMARY = (
    "model_size_params map<string,bigint>, vocab_size int, best_val_loss double, final_val_token_acc double, final_train_token_acc double, "
    "qualitative_exact_match_rate double, roundtrip_exact_match_rate double, num_epochs int, on_the_fly boolean, num_train_samples string, "
    "num_val_samples int, total_train_seconds double"
)
CLASSIFIER_SUMMARY = (
    "classes array<string>, best_val_acc double, final_confusion_matrix array<array<bigint>>, num_epochs int, num_train_images bigint, num_val_images bigint"
)


def match_rate(df: DataFrame, name: str) -> DataFrame:
    """Share of exact matches; null without rows."""
    return df.agg((F.count_if("exact_match") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias(name))


def beside(*frames: DataFrame) -> DataFrame:
    """One-row frames as one row."""
    out = frames[0]
    for f in frames[1:]:
        out = out.withColumn("_one", F.lit(1)).join(f.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out


def sequence_summary(history: DataFrame, params: DataFrame, vocab_size: int, qualitative: DataFrame, roundtrip: DataFrame, val_rows: DataFrame, train_samples: int | None) -> DataFrame:
    """``history`` has epoch, val_loss, val_token_acc, train_token_acc and seconds; ``params`` name and n, a row per part of
    the model; the next two exact_match per row. ``train_samples`` is None where rows are made on the fly."""
    last = lambda c: F.max_by(c, "epoch")
    facts = history.agg(
        F.min("val_loss").alias("best_val_loss"), last("val_token_acc").alias("final_val_token_acc"), last("train_token_acc").alias("final_train_token_acc"),
        F.count(F.lit(1)).cast("int").alias("num_epochs"), F.sum("seconds").cast("double").alias("total_train_seconds"),
    )
    sizes = params.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("model_size_params"))
    rates = match_rate(qualitative, "qualitative_exact_match_rate"), match_rate(roundtrip, "roundtrip_exact_match_rate")
    whole = beside(facts, sizes, *rates, val_rows.agg(F.count(F.lit(1)).cast("int").alias("num_val_samples")))
    told = F.lit("unbounded (on the fly)" if train_samples is None else str(train_samples))
    out = whole.withColumns({"vocab_size": F.lit(vocab_size), "on_the_fly": F.lit(train_samples is None), "num_train_samples": told})
    return out.select(*[c.split()[0] for c in SEQUENCE_SUMMARY.split(", ")])


def classifier_summary(history: DataFrame, scored: DataFrame, truth: str, pred: str, classes: Sequence[str], split: DataFrame) -> DataFrame:
    """``history`` has epoch and val_accuracy, ``scored`` truth and prediction, ``split`` the column split.

    The matrix has the classes in order, truth down, prediction across; a cell without rows is 0.
    """
    facts = history.agg(F.max("val_accuracy").alias("best_val_acc"), F.count(F.lit(1)).cast("int").alias("num_epochs"))
    cells = scored.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    known = cells.agg(F.map_from_entries(F.collect_list(F.struct(F.struct(truth, pred), "n"))).alias("_cells"))
    cell = lambda t, p: F.coalesce(F.try_element_at("_cells", F.struct(F.lit(t).alias(truth), F.lit(p).alias(pred))), F.lit(0))
    matrix = F.array(*[F.array(*[cell(t, p) for p in classes]) for t in classes])
    rows = split.agg(*[F.count_if(F.col("split") == s).alias(f"num_{s}_images") for s in ("train", "val")])
    whole = beside(facts, known, rows)
    named = whole.withColumns({"classes": F.array(*[F.lit(c) for c in classes]), "final_confusion_matrix": matrix})
    return named.select("classes", "best_val_acc", "final_confusion_matrix", "num_epochs", "num_train_images", "num_val_images")


def read_summary(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)

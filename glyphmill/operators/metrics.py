"""Classifier and sequence metrics, training logs and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import stripped_equal
from glyphmill.operators.running import ROWS_PER_BUCKET, Run, count_so_far, meet, running
from glyphmill.plans.vocabulary import PAD
from glyphmill.session import materialise


def class_list(df: DataFrame, classes: Sequence[str], name: str) -> DataFrame:
    """The class contract, a short list given by the caller, as a table."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias(name))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


#: Row and column of the names that the class list lacks, null among them.
OTHER = "other"


def listed_or_other(value: Column, classes: Sequence) -> Column:
    return F.when(value.isin(list(classes)), value.cast("string")).otherwise(F.lit(OTHER))


def confusion_dense(df: DataFrame, truth: str, pred: str, classes: Sequence) -> DataFrame:
    """One row per true class, one column per predicted class, zeros filled in; what is not listed counts as ``other``."""
    names = [*map(str, classes), OTHER]
    mapped = df.select(*[listed_or_other(F.col(c), classes).alias(c) for c in (truth, pred)])
    cells = confusion(mapped, truth, pred).groupBy("truth").pivot("pred", names).agg(F.sum("n"))
    grid = class_list(df, names, "truth").join(cells, "truth", "left")
    return grid.select("truth", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in names])


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    hit = F.count_if(F.col(truth) == F.col(pred))
    n = F.count(F.lit(1))
    return df.agg(hit.alias("correct"), n.alias("total"), (hit / F.nullif(n, F.lit(0))).alias("accuracy"))


def count_by_class(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by)


def dense_counts(df: DataFrame, by: str, classes: Sequence[str]) -> DataFrame:
    """Rows per class: 0 for listed classes without rows; classes that are not listed stay in."""
    found = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return class_list(df, classes, by).join(found, by, "full_outer").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def correct_tokens(preds: Column, labels: Column) -> Column:
    """Positions predicted right, padding left out."""
    return F.size(F.filter(F.zip_with(preds, labels, lambda p, t: (p == t) & (t != PAD)), lambda hit: hit))


def real_tokens(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != PAD))


def token_accuracy(df: DataFrame, preds: str, labels: str, by: Sequence[str] = ()) -> DataFrame:
    n = F.sum("_n")
    return (
        df.select(*by, correct_tokens(F.col(preds), F.col(labels)).alias("_ok"), real_tokens(F.col(labels)).alias("_n"))
        .groupBy(*by)
        .agg(F.sum("_ok").alias("correct"), n.alias("total"), (F.sum("_ok") / F.greatest(n, F.lit(1))).alias("token_accuracy"))
    )


#: Decimals of reported means; sums of doubles differ beyond them with the order of the rows.
DECIMALS = 6


def losses(df: DataFrame, loss: str, tokens: str, by: Sequence[str] = ()) -> DataFrame:
    """Token-weighted mean (validation) beside the plain mean of batch means (training).

    A loss that is not a number shows in both means; a step without a loss counts in neither.
    """
    value = F.col(loss).cast("double")
    known = F.when(value.isNotNull(), F.col(tokens))
    return df.groupBy(*by).agg(
        F.round(F.sum(value * F.col(tokens)) / F.greatest(F.sum(known), F.lit(1)), DECIMALS).alias("weighted_loss"),
        F.round(F.avg(value), DECIMALS).alias("mean_loss"),
    )


def epoch_metrics(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both means of the loss and the token accuracy per group of steps (loss, correct, total), in one pass."""
    value, n = F.col("loss").cast("double"), F.sum("total")
    known = F.when(value.isNotNull(), F.col("total"))
    return steps.groupBy(*by).agg(
        F.round(F.sum(value * F.col("total")) / F.greatest(F.sum(known), F.lit(1)), DECIMALS).alias("weighted_loss"),
        F.round(F.avg(value), DECIMALS).alias("mean_loss"), (F.sum("correct") / F.greatest(n, F.lit(1))).alias("token_accuracy"),
    )


def sampled_loss(df: DataFrame, loss: str, samples: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of batch losses weighted by the samples in each batch."""
    return losses(df, loss, samples, by).select(*by, F.col("weighted_loss").alias("sample_loss"))


def exact_match(df: DataFrame) -> DataFrame:
    return df.withColumn("exact_match", stripped_equal(F.col("ground_truth"), F.col("prediction")))


def exact_match_rates(df: DataFrame, by: str = "diagram_type") -> DataFrame:
    """Rate per class and over all; ``is_total`` marks the latter, a class may be null itself."""
    hits = F.count_if("exact_match")
    n = F.count(F.lit(1))
    total = (F.grouping(by) == 1).alias("is_total")
    return df.rollup(by).agg(total, hits.alias("matches"), n.alias("n"), (hits / F.nullif(n, F.lit(0))).alias("rate"))


def corpus_size(df: DataFrame, text: str, tokens: Column) -> DataFrame:
    chars, toks = F.coalesce(F.sum(F.length(text)), F.lit(0)), F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("texts"), chars.alias("chars"), toks.alias("tokens"),
        (chars / F.greatest(toks, F.lit(1))).alias("chars_per_token"),
    )


def progress_log(df: DataFrame, epoch: str, order: str, every: int, batch_size: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Epoch-running loss, accuracy, rates and time left, each ``every`` steps and at the last.

    ``df`` has loss, correct, total and elapsed (seconds since the epoch began) per step.
    """
    steps = materialise(df.groupBy(epoch).agg(F.count(F.lit(1)).alias("last_step")), "epochs")
    run = running(
        df.select(epoch, order, "loss", "correct", "total", "elapsed"), [epoch], [order], rows_per_bucket,
        step=count_so_far(), _loss=Run("sum", F.col("loss").cast("double")),
        _ok=Run("sum", F.col("correct")), _n=Run("sum", F.col("total")),
    )
    rate = F.when(F.col("elapsed") > 0, F.col("step") / F.col("elapsed")).otherwise(F.lit(0.0))
    return (
        meet(run, steps, [epoch]).select(
            epoch, "step", "last_step", "elapsed",
            F.round(F.col("_loss") / F.col("step"), DECIMALS).alias("avg_loss"),
            (F.col("_ok") / F.greatest("_n", F.lit(1))).alias("avg_accuracy"),
            rate.alias("steps_per_sec"), (rate * batch_size).alias("samples_per_sec"),
        )
        .where((F.col("step") % every == 0) | (F.col("step") == F.col("last_step")))
        .withColumn("eta", F.when(F.col("steps_per_sec") > 0, (F.col("last_step") - F.col("step")) / F.col("steps_per_sec")))
    )


def best_so_far(history: DataFrame, run: list[str], epoch: str, value: str, lower: bool = True) -> DataFrame:
    """Flag each epoch that beats all before it; a tie is no new best."""
    out = running(history, run, [epoch], **{"_best": Run("min" if lower else "max", F.col(value), before=True)})
    beats = F.col(value) < F.col("_best") if lower else F.col(value) > F.col("_best")
    return out.withColumn("new_best", F.col("_best").isNull() | beats).drop("_best")


def best_epoch(history: DataFrame, run: list[str], epoch: str, value: str) -> DataFrame:
    """Epoch of the lowest value, the first one on ties; null where no epoch has a value."""
    return history.groupBy(*run).agg(F.min(with_value(value, epoch)).alias("b")).select(*run, f"b.{epoch}", f"b.{value}")


def with_value(value: str, epoch: str) -> Column:
    """(value, epoch) where the value is a number; a missing one is never the lowest."""
    return F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.struct(F.col(value), F.col(epoch)))


def time_left(history: DataFrame, run: list[str], epoch: str, seconds: str) -> DataFrame:
    """Time so far, and the last epoch's time for each epoch still to come."""
    total = history.groupBy(*run).agg(F.max(epoch).alias("last_epoch"))
    out = running(history, run, [epoch], total_elapsed=Run("sum", F.col(seconds)))
    left = F.col(seconds) * (F.col("last_epoch") - F.col(epoch))
    return meet(out, total, run).withColumn("remaining", left).drop("last_epoch")


def run_totals(df: DataFrame, steps: str, batch_size: int, seconds: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("num_epochs"), (F.sum(steps) * batch_size).alias("num_train_samples"),
        F.sum(seconds).alias("total_train_seconds"),
    )


def overfit_onset(history: DataFrame, run: list[str], epoch: str, train: str, val: str) -> DataFrame:
    """Best epoch, how far the validation loss rose after it, and the last train/val gap."""
    facts = history.groupBy(*run).agg(
        F.min(with_value(val, epoch)).alias("best"),
        F.max(F.struct(F.col(epoch), F.col(val), F.col(train))).alias("last"),
    )
    return facts.select(
        *run, F.col(f"best.{epoch}").alias("best_epoch"), F.col(f"best.{val}").alias("best_val_loss"),
        F.col(f"last.{val}").alias("last_val_loss"), (F.col(f"last.{val}") - F.col(f"best.{val}")).alias("rise"),
        (F.col(f"last.{val}") - F.col(f"last.{train}")).alias("gap"),
    )


def compare_runs(a: DataFrame, b: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Metrics of two runs side by side; one that only one run has stays in."""
    left, right = a.select(metric, F.col(value).alias("run_a")), b.select(metric, F.col(value).alias("run_b"))
    return left.join(right, metric, "full_outer").withColumn("change", F.col("run_b") - F.col("run_a"))


def family_table(df: DataFrame, by: str, templated: Sequence[str]) -> DataFrame:
    """Exact-match table split into classes of few fixed texts and classes of free text."""
    family = F.when(F.col(by).isin(list(templated)), "templated").otherwise("free text")
    return df.groupBy(family.alias("family"), by).agg(
        F.count_if("exact_match").alias("matches"), F.count(F.lit(1)).alias("n")
    ).withColumn("rate", F.col("matches") / F.col("n"))


def contract_drift(df: DataFrame, by: str, required: Sequence[str]) -> DataFrame:
    """Class names in only one of the table and the contract; empty when they agree."""
    present = df.select(by).distinct().withColumn("present", F.lit(True))
    wanted = class_list(df, required, by).distinct().withColumn("required", F.lit(True))
    both = present.join(wanted, by, "full_outer")
    return both.where(F.col("present").isNull() | F.col("required").isNull()).select(
        by, F.when(F.col("present").isNull(), "missing").otherwise("unexpected").alias("drift")
    )


def duplicate_rates(df: DataFrame, by: str, text: str) -> DataFrame:
    """Rows, different texts and the share of rows whose text came before, per class."""
    digests = df.groupBy(by, F.sha2(text, 256).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    n, texts = F.sum("_n"), F.count(F.lit(1))
    return digests.groupBy(by).agg(n.alias("n"), texts.alias("texts"), (1 - texts / n).alias("duplicate_rate"))


def leakage(df: DataFrame, by: str, text: str, split: str = "split") -> DataFrame:
    """Validation rows per class, and those whose text is also a training text of any class."""
    digests = df.select(by, split, F.sha2(text, 256).alias("_d"))
    seen = digests.where(F.col(split) == "train").select("_d").distinct().withColumn("_seen", F.lit(True))
    val = digests.where(F.col(split) == "val").join(seen, "_d", "left")
    n, leaked = F.count(F.lit(1)), F.count("_seen")
    return val.groupBy(by).agg(n.alias("n"), leaked.alias("leaked"), (leaked / n).alias("leak_rate"))


def repetition(text: Column) -> Column:
    """Share of a text's lines that repeat an earlier line of it; 0 for an empty text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    return F.coalesce(1 - F.size(F.array_distinct(lines)) / F.nullif(F.size(lines), F.lit(0)), F.lit(0.0))


def label_entropy(df: DataFrame, by: str, labels: Column) -> DataFrame:
    """Labels, different labels, the share of the most frequent one, and Shannon bits, per class."""
    counts = df.select(by, F.explode(labels).alias("_label")).groupBy(by, "_label").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n")
    bits = F.log2(total) - F.sum(F.col("_n") * F.log2("_n")) / total
    return counts.groupBy(by).agg(
        total.alias("n"), F.count(F.lit(1)).alias("labels"), (F.max("_n") / total).alias("top_share"),
        F.round(bits, DECIMALS).alias("bits"),
    )

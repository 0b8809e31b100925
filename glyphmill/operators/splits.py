"""Stratified split, samples per class, batches, random order, rotating mirror."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.draws import u32
from glyphmill.operators.running import BUCKET, ROWS_PER_BUCKET, meet, with_buckets, with_rank
from glyphmill.plans.vocabulary import VAL_FRACTION
from glyphmill.session import materialise


def class_cutoffs(df: DataFrame, by: str, order: str, wanted: Callable[[Column], Column], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per class of n rows, the key of its ``wanted(n)``-th row; none for classes where that is 0.

    Only (class, key) is read. Counts per (class, bucket) find the bucket the
    cutoff falls in, and only that bucket of each class is sorted.
    """
    slim, _ = with_buckets(df.select(by, order), order, rows_per_bucket)
    counts = slim.groupBy(by, BUCKET).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(by)
    target = (
        counts.withColumn("seen", F.sum("n").over(whole.orderBy(BUCKET)) - F.col("n"))
        .withColumn("wanted", wanted(F.sum("n").over(whole)))
        .where((F.col("seen") < F.col("wanted")) & (F.col("wanted") <= F.col("seen") + F.col("n")))
        .select(by, BUCKET, (F.col("wanted") - F.col("seen")).alias("nth"))
    )
    target = materialise(target, "cutoff-buckets")
    edge = meet(slim, target, [by, BUCKET])
    place = F.row_number().over(Window.partitionBy(by, BUCKET).orderBy(order))
    return materialise(
        edge.withColumn("place", place).where("place = nth").select(by, F.col(order).alias("cutoff")), "cutoffs"
    )


def stratified_split(df: DataFrame, by: str, order: str, fraction: float = VAL_FRACTION, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``split``: the first ``floor(n * fraction)`` rows of each class are ``val``.

    ``order`` is a unique key. The wide rows are never sorted or shuffled by
    class: they meet a table of one cutoff per class.
    """
    cut = class_cutoffs(df, by, order, lambda n: F.floor(n * F.lit(fraction)), rows_per_bucket)
    split = F.when(F.col(order) <= F.col("cutoff"), "val").otherwise("train")
    return meet(df, cut, [by], "left").withColumn("split", split).drop("cutoff")


def window_keeps(df: DataFrame, n: int) -> bool:
    """Whether a rank of up to ``n`` is cut in the map tasks already."""
    return n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def first_per_class(df: DataFrame, by: str, order: str, n: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The first ``n`` rows of each class by a unique key, with their place.

    For a small n each map task keeps n rows before the shuffle; for a larger one
    a cutoff per class picks the rows and the rank runs in buckets, so that no
    class has to fit a task.
    """
    if window_keeps(df, n):
        place = F.row_number().over(Window.partitionBy(by).orderBy(order))
        return df.withColumn("place", place).where(F.col("place") <= n)
    cut = class_cutoffs(df, by, order, lambda total: F.least(total, F.lit(n)), rows_per_bucket)
    kept = meet(df, cut, [by], "left").where(F.col(order) <= F.col("cutoff")).drop("cutoff")
    return with_rank(kept, [by], [order], "place", rows_per_bucket).withColumn("place", F.col("place").cast("int"))


def with_batches(df: DataFrame, order: str, size: int, by: list[str] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Cut rows into batches of ``size`` in order of a unique key; the last batch may be short.

    Only the keys are ranked; the wide rows meet their batch number on the key.
    The explicit partitioning keeps a rank done in few tasks from drawing the
    wide side into those tasks.
    """
    ranked = with_rank(df.select(*(by or []), order), by or [], [order], "_place", rows_per_bucket)
    batches = ranked.select(order, F.expr(f"(_place - 1) div {size}").alias("batch_id")).repartition(F.col(order))
    return df.join(batches, order).select(*df.columns, "batch_id")


def shuffled(df: DataFrame, row: str, seed: int, epoch: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``place``, the position of the row in a repeatable random order of the epoch."""
    drawn = df.withColumn("_draw", u32(seed, "order", epoch, F.col(row)))
    return with_rank(drawn, [], ["_draw", row], "place", rows_per_bucket).drop("_draw")


def mirror_slots(df: DataFrame, worker: str, order: str, slots: int, payload: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Latest row of each (worker, slot); slot is the worker's row counter modulo ``slots``.

    The counter of the last rows follows from the worker's row count, so only
    the last ``slots`` rows per worker are ranked: in the map tasks, or by a
    cutoff per worker where that is too many for a window.
    """
    counts = df.groupBy(worker).agg(F.count(F.lit(1)).alias("seen"))
    slim = df.select(worker, order, *payload)
    if not window_keeps(df, slots):
        cut = class_cutoffs(df, worker, order, lambda n: F.greatest(n - slots, F.lit(0)), rows_per_bucket)
        last = meet(slim, cut, [worker], "left").where(F.col("cutoff").isNull() | (F.col(order) > F.col("cutoff"))).drop("cutoff")
        joined = meet(with_rank(last, [worker], [order], "place", rows_per_bucket), counts, [worker])
        counter = F.greatest(F.col("seen") - slots, F.lit(0)) + F.col("place")
        return joined.select(worker, (counter % slots).cast("int").alias("slot"), counter.alias("counter"), order, *payload)
    back = F.row_number().over(Window.partitionBy(worker).orderBy(F.desc(order)))
    last = slim.withColumn("back", back).where(F.col("back") <= slots)
    joined = meet(last, counts, [worker])
    counter: Column = F.col("seen") - F.col("back") + 1
    return joined.select(worker, (counter % slots).cast("int").alias("slot"), counter.alias("counter"), order, *payload)

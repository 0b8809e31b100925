"""Live sample streams: bounded intake, dead letters, mirrors, epochs, clean end.

Every sink writes one folder per micro-batch and replaces that folder when a
batch is replayed, so a restart from the checkpoint repeats no row.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from glyphmill.functions.text import preview
from glyphmill.operators.running import Run, meet, running
from glyphmill.plans.corpus import with_samples

BatchWriter = Callable[[DataFrame, int], None]


def rate_rows(spark: SparkSession, rows_per_batch: int) -> DataFrame:
    """Endless row numbers; ``value`` is the same on every replay."""
    return (
        spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)
        .option("startTimestamp", 0).option("advanceMillisPerBatch", 1000).load()
    )


def file_rows(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Rows of a folder that files keep arriving in, so many files per micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def samples(rows: DataFrame, row: str, seed: int) -> DataFrame:
    """A text of a random type per arriving row."""
    return with_samples(rows, row, seed)


def drain(query: StreamingQuery, seconds: int = 3600) -> StreamingQuery:
    """Wait for what is pending, then end the query whatever happened."""
    try:
        if not query.awaitTermination(seconds):
            raise TimeoutError(f"stream still running after {seconds} s")
    finally:
        query.stop()
    return query


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Take in all that is there now, in micro-batches, and end."""
    return drain(writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def each_batch(stream: DataFrame, write: BatchWriter, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return run_to_end(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Plain file sink: its commit log hides files of unfinished batches from readers."""
    return run_to_end(stream.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)


def batch_folder(path: str) -> BatchWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def with_dead_letters(good_path: str, bad_path: str, valid: Column) -> BatchWriter:
    """Bad samples go to a table of their own; the stream goes on."""
    ok = F.coalesce(valid, F.lit(False))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch_folder(good_path)(batch.where(ok), batch_id)
            batch_folder(bad_path)(batch.where(~ok), batch_id)
        finally:
            batch.unpersist()

    return write


def by_epoch(path: str, steps_per_epoch: int) -> BatchWriter:
    """An epoch is a fixed number of micro-batches of a stream that has no end."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("epoch", F.lit(batch_id // steps_per_epoch)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def mirror(path: str, worker: str, order: str, slots: int, payload: list[str]) -> BatchWriter:
    """Keep the last rows per worker in rotating slots.

    Each micro-batch contributes at most ``slots`` rows per worker. The result of
    batch n is made from the result of batch n-1 and written beside it, so a
    replay gives the same table.
    """
    back = F.row_number().over(Window.partitionBy(worker).orderBy(F.desc(order)))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = batch.groupBy(worker).agg(F.count(F.lit(1)).alias("here"))
        last = batch.select(worker, order, *payload).withColumn("back", back).where(F.col("back") <= slots)
        old = committed_before(spark, path, batch_id)
        rows = meet(last, counts, [worker])
        if old is None:
            rows = rows.withColumn("seen", F.lit(0).cast("bigint"))
        else:
            seen = old.groupBy(worker).agg(F.max("counter").alias("seen"))
            rows = meet(rows, seen, [worker], "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("bigint")))
        counter = F.col("seen") + F.col("here") - F.col("back") + 1
        fresh = rows.select(worker, (counter % slots).cast("int").alias("slot"), counter.alias("counter"), order, *payload)
        both = fresh if old is None else fresh.unionByName(old)
        kept = both.groupBy(worker, "slot").agg(F.max_by(F.struct("counter", order, *payload), "counter").alias("r"))
        new_version(kept.select(worker, "slot", "r.*"), path, batch_id)

    return write


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table that were written to the end, in order."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    numbers = sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))
    return [n for n in numbers if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/_SUCCESS"))]


def committed_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The newest whole version that an earlier micro-batch left."""
    found = [n for n in versions(spark, path) if n < batch_id]
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def new_version(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the table as this micro-batch leaves it; the version before stays for a replay, older ones go."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
    for n in [n for n in versions(spark, path) if n < batch_id][:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last micro-batch that ended left it, whichever run that was."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no version in {path}")
    return spark.read.parquet(f"{path}/version={found[-1]}")


def hadoop_folder(spark: SparkSession, path: str):
    """The folder and the file system it lies in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def epoch_folder(epoch) -> str:
    return f"epoch={'__HIVE_DEFAULT_PARTITION__' if epoch is None else epoch}"


def epoch_batches(spark: SparkSession, path: str, epoch: str = "epoch=*") -> dict[str, list[int]]:
    """By epoch folder, the micro-batches that wrote it to the end, in order."""
    pattern, files = hadoop_folder(spark, f"{path}/batch_id=*/{epoch}")
    out: dict[str, list[int]] = {}
    for f in files.globStatus(pattern) or []:
        where = f.getPath()
        if files.exists(hadoop_folder(spark, f"{where.getParent()}/_SUCCESS")[0]):
            out.setdefault(where.getName(), []).append(int(where.getParent().getName().partition("=")[2]))
    return {k: sorted(v) for k, v in out.items()}


def cleared_each_epoch(path: str, epoch: Column, worker: str, order: str, slots: int, payload: list[str]) -> BatchWriter:
    """Mirror that starts anew every epoch, and keeps what each epoch ended with.

    A micro-batch writes the epochs that it has rows of and no other: those rows join what the epoch held
    and the last ``slots`` rows per worker stay. An epoch's newest folder of a whole write is its state; the one before
    stays for a replay, older ones go. So a micro-batch writes slots x workers rows per open epoch, however many are past.
    """
    back = F.row_number().over(Window.partitionBy("epoch", worker).orderBy(F.desc(order)))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("epoch", epoch).select("epoch", worker, order, *payload)
        rows = rows.withColumn("back", back).where(F.col("back") <= slots).drop("back").persist()
        try:
            touched = [r.epoch for r in rows.select("epoch").distinct().collect()]
            both, spare = rows, []
            for e in touched:
                found = [n for n in epoch_batches(spark, path, epoch_folder(e)).get(epoch_folder(e), []) if n < batch_id]
                if found:
                    old = spark.read.parquet(f"{path}/batch_id={found[-1]}/{epoch_folder(e)}")
                    both = both.unionByName(old.withColumn("epoch", F.lit(e).cast(rows.schema["epoch"].dataType)))
                    spare += [f"{path}/batch_id={n}/{epoch_folder(e)}" for n in found[:-1]]
            kept = both.withColumn("back", back).where(F.col("back") <= slots).drop("back")
            kept.write.mode("overwrite").partitionBy("epoch").parquet(f"{path}/batch_id={batch_id}")
            for name in spare:
                folder, files = hadoop_folder(spark, name)
                files.delete(folder, True)
        finally:
            rows.unpersist()

    return write


def epoch_mirrors(spark: SparkSession, path: str) -> DataFrame:
    """What each epoch's mirror holds, with its ``epoch``."""
    newest = [f"{path}/batch_id={found[-1]}/{name}" for name, found in sorted(epoch_batches(spark, path).items())]
    if not newest:
        raise FileNotFoundError(f"no epoch in {path}")
    return spark.read.option("basePath", path).parquet(*newest).drop("batch_id")


def stateful_mirror(rows: DataFrame, worker: str, order: str, slots: int, payload: list[str]) -> DataFrame:
    """The last rows per worker in rotating slots, held as the state of a stream.

    A worker's state is its counter and its last ``slots`` rows, whatever has gone through. Each micro-batch gives the
    mirror of the workers that it has rows of; within it rows may stand in any order. ``each_batch`` in update mode with
    ``batch_folder`` keeps what it gives, and ``slots_now`` reads the newest row of every slot.
    A worker's rows of one micro-batch go through one task, chunk by chunk; the intake bounds their number.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    columns = [order, *payload]

    def keep(key, chunks, state):
        seen, *held = state.get if state.exists else (0, *[[] for _ in columns])
        last = [tuple(r) for r in zip(*held)]
        for chunk in chunks:
            seen += len(chunk)
            fresh = [tuple(r) for r in chunk[columns].astype(object).where(chunk[columns].notna(), None).itertuples(index=False)]
            last = sorted(last + fresh, key=lambda r: r[0])[-slots:]
        state.update((seen, *[[r[i] for r in last] for i in range(len(columns))]))
        counters = range(seen - len(last) + 1, seen + 1)
        name = None if pd.isna(key[0]) else key[0]
        out = {worker: [name] * len(last), "slot": [c % slots for c in counters], "counter": list(counters)}
        yield pd.DataFrame({**{k: pd.Series(v, dtype=object) for k, v in out.items()}, **{c: pd.Series([r[i] for r in last], dtype=object) for i, c in enumerate(columns)}})

    shown = ", ".join([f"`{worker}` {kinds[worker]}", "slot int", "counter long", *[f"`{c}` {kinds[c]}" for c in columns]])
    held = ", ".join(["seen long", *[f"`{c}` array<{kinds[c]}>" for c in columns]])
    return rows.select(worker, *columns).groupBy(worker).applyInPandasWithState(keep, shown, held, "update", GroupStateTimeout.NoTimeout)


def slots_now(spark: SparkSession, path: str, worker: str) -> DataFrame:
    """The newest row of each slot among all that a stateful mirror gave."""
    rows = spark.read.parquet(path).drop("batch_id")
    return rows.groupBy(worker, "slot").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (worker, "slot")]), "counter").alias("r")).select(worker, "slot", "r.*")


def running_counts(path: str) -> BatchWriter:
    """Whole result of a complete-mode aggregate, one folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        new_version(batch, path, batch_id)

    return write


def recorded(path: str, write: BatchWriter, **metrics: Column) -> BatchWriter:
    """Write each micro-batch, and a row of its progress beside it: rows, the given metrics, and seconds taken.

    The rows of all runs stay, one folder per micro-batch; a replay replaces its row.
    """

    def both(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            began = time.monotonic()
            write(batch, batch_id)
            row = batch.agg(F.count(F.lit(1)).alias("input_rows"), *[m.alias(n) for n, m in metrics.items()])
            row.withColumn("seconds", F.lit(time.monotonic() - began)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return both


def progress(spark: SparkSession, path: str, available: int | None = None) -> DataFrame:
    """The recorded micro-batches with rows per second and, where ``available`` rows were there to take, the rows still pending."""
    rows = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("bigint"))
    out = rows.withColumn("rows_per_sec", F.when(F.col("seconds") > 0, F.col("input_rows") / F.col("seconds")))
    if available is None:
        return out
    return running(out, [], ["batch_id"], taken=Run("sum", F.col("input_rows"))).withColumn("pending", F.lit(available) - F.col("taken"))


def snapshot(df: DataFrame, now: Column, payload: str = "target") -> DataFrame:
    """What the mirror holds: type, age, state and a preview of each sample."""
    age = F.coalesce(now.cast("double") - F.col("written_at").cast("double"), F.lit(0.0))
    return df.select(
        "*", age.alias("age"), F.coalesce("diagram_type", F.lit("?")).alias("shown_type"),
        preview(F.coalesce(payload, F.lit(""))).alias("preview"),
    ).drop(payload)

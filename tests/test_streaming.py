"""Streams: endless source, bounded intake, restart, mirrors, dead letters."""

import pytest
from pyspark.sql import functions as F

from glyphmill.operators.splits import mirror_slots
from glyphmill.plans.corpus import with_samples
from glyphmill.streaming import live


def test_endless_samples_equal_batch(spark, tmp_path):
    stream = live.samples(live.rate_rows(spark, 40).select("value"), "value", 42)
    live.to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    n = got.count()
    assert n >= 40 and got.select("value").distinct().count() == n
    want = with_samples(got.select("value"), "value", 42)
    assert got.exceptAll(want).count() == 0 and got.select("diagram_type").distinct().count() > 5


def land(spark, folder, low, high):
    df = spark.range(low, high, 1, 2).select(F.col("id"), (F.col("id") % 3).alias("worker"), F.concat(F.lit("t"), "id").alias("target"))
    df.write.mode("append").parquet(folder)
    return df.schema


def test_intake_is_bounded(spark, tmp_path):
    schema = land(spark, str(tmp_path / "in"), 0, 100)
    land(spark, str(tmp_path / "in"), 100, 200)
    q = live.each_batch(live.file_rows(spark, str(tmp_path / "in"), schema, 1), live.batch_folder(str(tmp_path / "out")), str(tmp_path / "cp"))
    sizes = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert len(sizes) == 4 and max(sizes) == 50 and not q.isActive


@pytest.mark.parametrize("cuts", [[0, 7, 50, 200], [0, 200], [0, 1, 2, 3, 200]])
def test_mirror_equals_batch(spark, tmp_path, cuts):
    write = live.mirror(str(tmp_path / "m"), "worker", "id", 5, ["target"])
    for low, high in zip(cuts, cuts[1:]):
        schema = land(spark, str(tmp_path / "in"), low, high)
        live.each_batch(live.file_rows(spark, str(tmp_path / "in"), schema), write, str(tmp_path / "cp"))
    got = live.latest_version(spark, str(tmp_path / "m")).select("worker", "slot", "counter", "id", "target")
    whole = spark.read.parquet(str(tmp_path / "in"))
    want = mirror_slots(whole, "worker", "id", 5, ["target"]).select("worker", "slot", "counter", "id", "target")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 15


def test_failed_batch_is_replayed_once(spark, tmp_path):
    schema = land(spark, str(tmp_path / "in"), 0, 60)
    rows = lambda: live.file_rows(spark, str(tmp_path / "in"), schema)
    write = live.batch_folder(str(tmp_path / "out"))

    def breaks(batch, batch_id):
        write(batch, batch_id)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        live.each_batch(rows(), breaks, str(tmp_path / "cp"))
    live.each_batch(rows(), write, str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_dead_letters(spark, tmp_path):
    schema = land(spark, str(tmp_path / "in"), 0, 30)
    write = live.with_dead_letters(str(tmp_path / "g"), str(tmp_path / "b"), F.when(F.col("id") % 4 != 3, F.col("id") % 2 == 0))
    live.each_batch(live.file_rows(spark, str(tmp_path / "in"), schema), write, str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 15 and spark.read.parquet(str(tmp_path / "b")).count() == 15


def test_progress_and_snapshot(spark, tmp_path):
    schema = land(spark, str(tmp_path / "in"), 0, 30)
    write = live.recorded(str(tmp_path / "log"), live.batch_folder(str(tmp_path / "out")), even=F.count_if(F.col("id") % 2 == 0))
    live.each_batch(live.file_rows(spark, str(tmp_path / "in"), schema), write, str(tmp_path / "cp"))
    land(spark, str(tmp_path / "in"), 30, 50)
    live.each_batch(live.file_rows(spark, str(tmp_path / "in"), schema), write, str(tmp_path / "cp"))
    log = live.progress(spark, str(tmp_path / "log"), 60).orderBy("batch_id").collect()
    assert [(r.batch_id, r.input_rows, r.even, r.pending) for r in log] == [(0, 30, 15, 30), (1, 20, 10, 10)]
    assert all(r.rows_per_sec > 0 for r in log)
    held = spark.createDataFrame([(None, None, "a\nb"), ("pie", "2024-01-01 00:00:00", None)], "diagram_type string, at string, target string")
    held = held.withColumn("written_at", F.col("at").cast("timestamp")).drop("at")
    got = live.snapshot(held, F.lit("2024-01-01 00:00:07.5").cast("timestamp")).collect()
    assert [(r.shown_type, r.age, r.preview) for r in got] == [("?", 0.0, "a \\n b"), ("pie", 7.5, "")]


def test_mirror_keeps_rows_without_worker(spark, tmp_path):
    rows = [(i, None if i % 2 else "w") for i in range(10)]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, "id long, worker string").write.mode("append").parquet(str(tmp_path / "in"))
        write = live.mirror(str(tmp_path / "m"), "worker", "id", 3, [])
        live.each_batch(live.file_rows(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), write, str(tmp_path / "cp"))
    got = live.latest_version(spark, str(tmp_path / "m")).select("worker", "id").collect()
    assert sorted((r.worker or "", r.id) for r in got) == [("", 5), ("", 7), ("", 9), ("w", 4), ("w", 6), ("w", 8)]
    write = live.mirror(str(tmp_path / "m"), "worker", "id", 3, [])
    live.each_batch(live.file_rows(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), write, str(tmp_path / "cp"))
    assert live.latest_version(spark, str(tmp_path / "m")).count() == 6, "a run without new rows changes nothing"


def test_epoch_mirror_spans_batches_and_old_versions_go(spark, tmp_path):
    schema = "id long, worker long"
    write = live.cleared_each_epoch(str(tmp_path / "m"), F.floor(F.col("id") / 30).cast("int"), "worker", "id", 4, [])
    for low, high in ((0, 20), (20, 22), (22, 40), (40, 60)):
        spark.range(low, high).select("id", (F.col("id") % 2).alias("worker")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.file_rows(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        live.each_batch(stream, write, str(tmp_path / "cp"))
    got = sorted((r.epoch, r.id) for r in live.epoch_mirrors(spark, str(tmp_path / "m")).collect())
    assert got == [(0, i) for i in range(22, 30)] + [(1, i) for i in range(52, 60)]
    assert live.epoch_batches(spark, str(tmp_path / "m")) == {"epoch=0": [1, 2], "epoch=1": [2, 3]}


def test_epoch_mirror_writes_open_epochs_only(spark, tmp_path):
    """Twelve epochs, one micro-batch each: the last one writes as much as the first."""
    write = live.cleared_each_epoch(str(tmp_path / "m"), F.floor(F.col("id") / 10).cast("int"), "worker", "id", 4, [])
    for n in range(12):
        write(spark.range(10 * n, 10 * n + 10).select("id", (F.col("id") % 2).alias("worker")), n)
        assert spark.read.parquet(str(tmp_path / "m" / f"batch_id={n}")).count() == 8
    assert live.epoch_mirrors(spark, str(tmp_path / "m")).count() == 12 * 8
    # A micro-batch that is played again leaves the same; one that broke off is not seen.
    write(spark.range(110, 120).select("id", (F.col("id") % 2).alias("worker")), 11)
    (tmp_path / "m" / "batch_id=11" / "_SUCCESS").unlink()
    assert live.epoch_mirrors(spark, str(tmp_path / "m")).where("epoch = 11").count() == 0
    write(spark.range(110, 120).select("id", (F.col("id") % 2).alias("worker")), 11)
    assert live.epoch_mirrors(spark, str(tmp_path / "m")).count() == 12 * 8
    write(spark.range(3).select(F.lit(None).cast("long").alias("id"), F.lit(1).cast("long").alias("worker")), 12)
    assert live.epoch_mirrors(spark, str(tmp_path / "m")).where("epoch is null").count() == 3


def test_stateful_mirror_equals_batch(spark, tmp_path):
    """Three runs of one checkpoint; a worker that comes late, one without a name, times and nulls as payload."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    worker = F.when(F.col("id") % 4 == 3, None).when((F.col("id") % 4 == 2) & (F.col("id") < 50), 0).otherwise(F.col("id") % 4)
    note = F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), "id"))
    for low, high in ((0, 7), (7, 60), (60, 200)):
        df = spark.range(low, high, 1, 2).select(F.col("id"), worker.alias("worker"), note.alias("target"), at.alias("written_at"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.stateful_mirror(live.file_rows(spark, str(tmp_path / "in"), df.schema), "worker", "id", 5, ["target", "written_at"])
        live.each_batch(stream, live.batch_folder(str(tmp_path / "m")), str(tmp_path / "cp"), "update")
    columns = ["worker", "slot", "counter", "id", "target", "written_at"]
    got = live.slots_now(spark, str(tmp_path / "m"), "worker").select(columns)
    want = mirror_slots(spark.read.parquet(str(tmp_path / "in")), "worker", "id", 5, ["target", "written_at"]).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 20

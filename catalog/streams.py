"""Streams over the events: every query runs a stream to its end and returns what it left."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import standins as s
from catalog.generation import G, GRAMMAR
from catalog.registry import query, table
from catalog.tables import MIRROR_SQL
from glyphmill.functions.draws import u32
from glyphmill.plans import vocabulary as v
from glyphmill.session import new_path
from glyphmill.streaming import live

WAVES = 3


def waves(spark, sf, count=WAVES):
    """Events cut by id range, to arrive one part after the other."""
    ev = table(spark, sf, "events")
    low, high = ev.agg(F.min("event_id"), F.max("event_id")).first()
    wave = F.floor((F.col("event_id") - low) * count / (high - low + 1))
    return [ev.where(wave == i) for i in range(count)]


def play(spark, sf, start, count=WAVES):
    """Land the waves one by one; after each, a new stream run goes on from the checkpoint."""
    folder, checkpoint = new_path(spark, "landing"), new_path(spark, "stream")
    done = None
    for wave in waves(spark, sf, count):
        wave.write.mode("append").parquet(folder)
        done = start(live.file_rows(spark, folder, wave.schema), checkpoint)
    return done


TYPE_OF = G("event_id", "'type'").pick(v.DIAGRAM_TYPES, "'type'")
TEXT_OF = "CASE diagram_type " + " ".join(f"WHEN '{t}' THEN {GRAMMAR[t](G('event_id', chr(39) + t + chr(39)))}" for t in v.DIAGRAM_TYPES) + " END"


@query("stream_samples", f"SELECT event_id, diagram_type, {TEXT_OF} AS target FROM (SELECT event_id, {TYPE_OF} AS diagram_type FROM events)")
def stream_samples(spark, sf):
    """A generated text of a random type per arriving event."""
    out = new_path(spark, "samples")
    play(spark, sf, lambda rows, cp: live.to_files(live.samples(rows.select("event_id"), "event_id", 42), out, cp), count=1)
    return spark.read.parquet(out)


@query("stream_bounded_intake", "SELECT 0::BIGINT AS files_not_alone, count(*) AS n FROM events")
def stream_bounded_intake(spark, sf):
    """One file per micro-batch: intake never runs ahead of the consumer."""
    folder, out = new_path(spark, "landing"), new_path(spark, "intake")
    for wave in waves(spark, sf):
        wave.write.mode("append").parquet(folder)
    rows = live.file_rows(spark, folder, wave.schema, files_per_batch=1)
    live.each_batch(rows.select("event_id", F.input_file_name().alias("file")), live.batch_folder(out), new_path(spark, "stream"))
    taken = spark.read.parquet(out).groupBy("batch_id").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n"))
    return taken.agg(F.count_if(F.col("files") != 1).alias("files_not_alone"), F.sum("n").alias("n"))


@query("stream_epochs", "SELECT wave // 2 AS epoch, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT event_id, floor((event_id - min(event_id) OVER ()) * 3 / (max(event_id) OVER () - min(event_id) OVER () + 1))::INTEGER AS wave FROM events) GROUP BY 1")
def stream_epochs(spark, sf):
    """Two micro-batches make an epoch."""
    out = new_path(spark, "epochs")
    play(spark, sf, lambda rows, cp: live.each_batch(rows.select("event_id"), live.by_epoch(out, 2), cp))
    return spark.read.parquet(out).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("stream_dead_letters", f"SELECT event_id, CASE WHEN good_note THEN 'good' ELSE 'bad' END AS fate FROM {s.IMAGES_SQL}")
def stream_dead_letters(spark, sf):
    good, bad = new_path(spark, "good"), new_path(spark, "bad")
    point = u32("img", F.col("event_id"))
    note = F.when(point % 11 == 0, F.lit("{")).otherwise(F.col("props"))

    def start(rows, cp):
        noted = rows.select("event_id", F.when(point % 13 != 0, note).alias("note"))
        return live.each_batch(noted, live.with_dead_letters(good, bad, F.try_parse_json("note").isNotNull()), cp)

    play(spark, sf, start)
    fates = [spark.read.parquet(p).select("event_id", F.lit(f).alias("fate")) for p, f in ((good, "good"), (bad, "bad"))]
    return fates[0].unionByName(fates[1])


@query("stream_mirror", MIRROR_SQL)
def stream_mirror(spark, sf):
    """The last eight rows per worker, the same as over the whole table."""
    out = new_path(spark, "mirror")
    write = live.mirror(out, "worker", "event_id", 8, ["event_type"])
    play(spark, sf, lambda rows, cp: live.each_batch(rows.withColumn("worker", F.col("user_id") % 4), write, cp))
    return live.latest_version(spark, out)


@query("stream_mirror_stateful", MIRROR_SQL)
def stream_mirror_stateful(spark, sf):
    """The same from the stream's own state, over three runs of one checkpoint."""
    out = new_path(spark, "mirror")
    play(spark, sf, lambda rows, cp: live.each_batch(
        live.stateful_mirror(rows.withColumn("worker", F.col("user_id") % 4), "worker", "event_id", 8, ["event_type"]), live.batch_folder(out), cp, "update"))
    return live.slots_now(spark, out, "worker")


TAKEN_SQL = "(SELECT unnest(range(0, 3 * ((count(*) + 2) // 3))) AS value FROM events)"


@query("stream_endless", f"SELECT value, diagram_type, {TEXT_OF.replace('event_id', 'value')} AS target FROM (SELECT value, {TYPE_OF.replace('event_id', 'value')} AS diagram_type FROM {TAKEN_SQL})")
def stream_endless(spark, sf):
    """As many generated samples as there are events, from a source without an end in three runs of one checkpoint."""
    out, checkpoint = new_path(spark, "endless"), new_path(spark, "stream")
    each = -(-table(spark, sf, "events").count() // 3)
    for _ in range(3):
        live.to_files(live.samples(live.rate_rows(spark, each).select("value"), "value", 42), out, checkpoint)
    return spark.read.parquet(out)


@query("stream_mirror_by_epoch", """
    SELECT epoch, worker, event_id FROM (SELECT event_id, user_id % 4 AS worker, wave AS epoch, row_number() OVER (PARTITION BY wave, user_id % 4 ORDER BY event_id DESC) AS back
      FROM (SELECT *, floor((event_id - min(event_id) OVER ()) * 3 / (max(event_id) OVER () - min(event_id) OVER () + 1))::INTEGER AS wave FROM events)) WHERE back <= 8""")
def stream_mirror_by_epoch(spark, sf):
    """Two micro-batches or more make an epoch."""
    out = new_path(spark, "mirror")
    low, high = table(spark, sf, "events").agg(F.min("event_id"), F.max("event_id")).first()
    epoch = F.floor((F.col("event_id") - low) * WAVES / (high - low + 1)).cast("int")
    write = live.cleared_each_epoch(out, epoch, "worker", "event_id", 8, [])
    play(spark, sf, lambda rows, cp: live.each_batch(rows.withColumn("worker", F.col("user_id") % 4), write, cp), count=2 * WAVES)
    return live.epoch_mirrors(spark, out).select("epoch", "worker", "event_id")


@query("stream_atomic_output", "SELECT event_id, value FROM events")
def stream_atomic_output(spark, sf):
    """Readers of the file sink see whole micro-batches only, each row once."""
    out = new_path(spark, "sink")
    play(spark, sf, lambda rows, cp: live.to_files(rows.select("event_id", "value"), out, cp))
    return spark.read.parquet(out)


@query("stream_running_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_running_counts(spark, sf):
    out = new_path(spark, "counts")
    play(spark, sf, lambda rows, cp: live.each_batch(
        rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), live.running_counts(out), cp, "complete"))
    return live.latest_version(spark, out)


@query("stream_progress", """
    SELECT wave::BIGINT AS batch_id, count(*) AS input_rows, count(*) FILTER (WHERE event_type = 'error') AS errors,
      ((SELECT count(*) FROM events) - sum(count(*)) OVER (ORDER BY wave))::BIGINT AS pending
    FROM (SELECT event_type, floor((event_id - min(event_id) OVER ()) * 3 / (max(event_id) OVER () - min(event_id) OVER () + 1))::INTEGER AS wave FROM events) GROUP BY wave""")
def stream_progress(spark, sf):
    """Rows, and errors among them, of each micro-batch of all runs, and the rows then still to come."""
    out, seen = new_path(spark, "progress"), new_path(spark, "seen")
    write = live.recorded(out, live.batch_folder(seen), errors=F.count_if(F.col("event_type") == "error"))
    play(spark, sf, lambda rows, cp: live.each_batch(rows, write, cp))
    rows = live.progress(spark, out, table(spark, sf, "events").count())
    return rows.select("batch_id", "input_rows", "errors", "pending")


@query("stream_snapshot", f"""
    SELECT worker, slot::INTEGER AS slot, event_id, epoch(TIMESTAMP '2025-01-01 00:00:00') - epoch_us(ts)::DOUBLE / 1e6 AS age, event_type AS shown_type, left(props, 70) AS preview
    FROM ({MIRROR_SQL}) JOIN (SELECT event_id, ts, props FROM events) USING (event_id)""")
def stream_snapshot(spark, sf):
    """What the mirror holds at a given moment."""
    out = new_path(spark, "mirror")
    write = live.mirror(out, "worker", "event_id", 8, ["diagram_type", "written_at", "target"])

    def start(rows, cp):
        named = rows.select("event_id", (F.col("user_id") % 4).alias("worker"), F.col("event_type").alias("diagram_type"),
                            F.col("ts").cast("timestamp").alias("written_at"), F.col("props").alias("target"))
        return live.each_batch(named, write, cp)

    play(spark, sf, start)
    held = live.latest_version(spark, out)
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return live.snapshot(held, now).select("worker", "slot", "event_id", "age", "shown_type", "preview")


@query("stream_restart", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids, sum(event_id)::BIGINT AS total FROM events")
def stream_restart(spark, sf):
    """Three runs on one checkpoint: nothing lost, nothing twice, each ends by itself."""
    out = new_path(spark, "restart")
    play(spark, sf, lambda rows, cp: live.each_batch(rows.select("event_id"), live.batch_folder(out), cp))
    return spark.read.parquet(out).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), F.sum("event_id").alias("total")
    )

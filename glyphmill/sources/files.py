"""Readers and writers of manifests, corpora, class folders, reports and run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.text import class_of, png_header, split_of, stem

MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("file_name", "diagram_type", "target", "theme", "look", "split")]
)
CORPUS = T.StructType([T.StructField(n, T.StringType()) for n in ("diagram_type", "target")])
SIDECAR = T.StructType([
    T.StructField("diagram_type", T.StringType()), T.StructField("theme", T.StringType()),
    T.StructField("look", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("target", T.StringType()), T.StructField("worker_id", T.IntegerType()),
    T.StructField("engine", T.StringType()), T.StructField("written_at", T.DoubleType()),
])
PREDICTIONS = T.StructType([
    T.StructField("file_name", T.StringType()), T.StructField("image_file", T.StringType()),
    T.StructField("diagram_type", T.StringType()), T.StructField("ground_truth", T.StringType()),
    T.StructField("prediction", T.StringType()), T.StructField("exact_match", T.BooleanType()),
])
HISTORY = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    *[T.StructField(n, T.DoubleType()) for n in
      ("train_loss", "train_token_acc", "val_loss", "val_token_acc", "val_acc", "epoch_seconds")],
])


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines in one folder per split, so that a reader of one split skips the others.

    The rebalance hint brings the rows of a folder together in files of sensible
    size; a folder with most of the rows is spread over many tasks.
    """
    df.select(*MANIFEST.fieldNames()).hint("rebalance", "split").write.partitionBy("split").json(path)


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.schema(MANIFEST).json(path)
    return rows if split is None else rows.where(F.col("split") == split)


def write_corpus(df: DataFrame, path: str) -> None:
    df.select(*CORPUS.fieldNames()).write.json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Target texts only; the other fields are not parsed."""
    return spark.read.schema(CORPUS).json(path).select("target")


def write_corpus_text(df: DataFrame, path: str, text: str = "target") -> None:
    """Each text followed by a newline, as a trainer reads it."""
    df.select(text).write.option("lineSep", "\n").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def write_labelled_tree(df: DataFrame, path: str, payload: str = "payload") -> None:
    """A folder per split and class, written in files of sensible size."""
    df.select("split", "label", "file_name", payload).hint("rebalance", "split", "label").write.partitionBy("split", "label").parquet(path)


def read_labelled_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The written form of a labelled tree; a filter on split or label skips folders."""
    return spark.read.schema(schema).parquet(path)


def read_labelled_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below ``<split>/<class>/`` with both names taken from the path.

    File bytes are read only if the query uses ``content``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.withColumns({"split": split_of(F.col("path")), "label": class_of(F.col("path")), "stem": stem(F.col("path"))})


def read_sidecar_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Images with the JSON file of the same name, and what is wrong with either."""
    images = read_labelled_tree(spark, path, "*.png").select("stem", "content")
    notes = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return pair_sidecars(images, notes.select(stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("note")))


def pair_sidecars(images: DataFrame, notes: DataFrame) -> DataFrame:
    """Left join on the stem; unreadable JSON counts as missing, a cut image as corrupt."""
    shape = T.StructType([*SIDECAR.fields, T.StructField("_bad", T.StringType())])
    parsed = notes.withColumn("meta", F.from_json("note", shape, {"columnNameOfCorruptRecord": "_bad"}))
    meta = F.when(F.col("meta._bad").isNull(), F.col("meta"))
    seen = images.select("stem", *[c.alias(n) for n, c in png_header(F.col("content")).items()])  # the bytes stay behind
    joined = seen.join(parsed.select("stem", meta.alias("meta")), "stem", "left")
    return joined.select("stem", "meta", "width", "height", status_of(F.col("meta"), F.col("whole")).alias("status"))


def status_of(meta: Column, whole: Column) -> Column:
    return F.when(meta.isNull(), "missing_meta").when(~whole, "corrupt").otherwise("ok")


def read_history(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """JSON lines, or files that each hold one JSON array (these cannot be split)."""
    return spark.read.schema(HISTORY).option("multiLine", whole_file).json(path)


def read_predictions(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    return spark.read.schema(PREDICTIONS).option("multiLine", whole_file).json(path)


def report_block(row: dict[str, Column]) -> Column:
    """Readable form of one prediction."""
    return F.concat_ws(
        "\n",
        F.format_string("=== %s  (exact_match=%s) ===", row["diagram_type"], F.initcap(row["exact_match"].cast("string"))),
        F.lit("--- ground truth ---"), row["ground_truth"], F.lit("--- prediction ---"), row["prediction"], F.lit(""),
    )


def report_header(df: DataFrame, title: str) -> DataFrame:
    counts = df.agg(F.count_if("exact_match").alias("m"), F.count(F.lit(1)).alias("n"))
    return counts.select(F.format_string(f"{title}: %d/%d exact matches", "m", "n").alias("value"))


def write_eval_report(df: DataFrame, path: str, order: Sequence[str], title: str = "Round-trip test", compression: str | None = None) -> None:
    """Rows as JSON lines, readable blocks in order, and one header line.

    ``order`` ends in a unique key, so that a large class is sorted by many tasks. ``compression`` names a codec for rows
    and blocks, which hold all texts twice each; without one they are plain files.
    """
    df.write.json(f"{path}/rows", compression=compression)
    df = df.sparkSession.read.schema(df.schema).json(f"{path}/rows")  # what was written is not worked out again
    names = ("diagram_type", "exact_match", "ground_truth", "prediction")
    df.orderBy(*order).select(report_block({n: F.col(n) for n in names}).alias("value")).write.text(f"{path}/blocks", compression=compression)
    report_header(df, title).write.text(f"{path}/header")


def write_run_summary(df: DataFrame, path: str) -> None:
    """One row of run facts as JSON."""
    df.write.json(path)

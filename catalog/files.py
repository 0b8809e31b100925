"""Sources and sinks: what is written to the shared folder is read back and returned."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import standins as s
from catalog.generation import G
from catalog.registry import query, table
from catalog.tables import SPLIT_SQL, split_docs
from glyphmill.functions.draws import Draws
from glyphmill.operators import metrics, summary
from glyphmill.plans import corpus, vocabulary as v
from glyphmill.session import new_path
from glyphmill.sources import files

STYLE = G("doc_id", "'style'")
MANIFEST_SQL = f"""(SELECT source || '_' || printf('%05d', doc_id) || '.png' AS file_name, source AS diagram_type, text AS target,
    {STYLE.pick(v.THEMES, "'theme'")} AS theme, {STYLE.pick(v.LOOKS, "'look'")} AS look, split FROM {SPLIT_SQL})"""


def manifest(spark, sf):
    look = corpus.style(Draws(42, "style", F.col("doc_id")))
    return split_docs(spark, sf).select(
        corpus.file_name(F.col("source"), F.col("doc_id")).alias("file_name"), F.col("source").alias("diagram_type"),
        F.col("text").alias("target"), look["theme"].alias("theme"), look["look"].alias("look"), "split",
    )


@query("src_read_manifest", f"SELECT file_name, diagram_type, target, theme, look, split FROM {MANIFEST_SQL} WHERE split = 'val'")
def src_read_manifest(spark, sf):
    path = new_path(spark, "manifest")
    files.write_manifest(manifest(spark, sf), path)
    return files.read_manifest(spark, path, "val")


@query("snk_write_manifest", f"SELECT * FROM {MANIFEST_SQL}")
def snk_write_manifest(spark, sf):
    path = new_path(spark, "manifest")
    files.write_manifest(manifest(spark, sf), path)
    return files.read_manifest(spark, path)


@query("src_read_corpus", "SELECT text AS target FROM documents")
def src_read_corpus(spark, sf):
    path = new_path(spark, "corpus")
    files.write_corpus(table(spark, sf, "documents").select(F.col("source").alias("diagram_type"), F.col("text").alias("target")), path)
    return files.read_corpus(spark, path)


@query("snk_corpus_text", "SELECT count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def snk_corpus_text(spark, sf):
    path = new_path(spark, "text")
    files.write_corpus_text(table(spark, sf, "documents"), path, "text")
    return files.read_lines(spark, path).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


@query("snk_labelled_tree", f"SELECT split, source AS label, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM {SPLIT_SQL} GROUP BY 1, 2")
def snk_labelled_tree(spark, sf):
    path = new_path(spark, "tree")
    rows = split_docs(spark, sf).select(
        "split", F.col("source").alias("label"), F.col("doc_id").cast("string").alias("file_name"), F.encode("text", "UTF-8").alias("payload")
    )
    files.write_labelled_tree(rows, path)
    schema = T.StructType([
        T.StructField("file_name", T.StringType()), T.StructField("payload", T.BinaryType()),
        T.StructField("split", T.StringType()), T.StructField("label", T.StringType()),
    ])
    back = files.read_labelled_table(spark, path, schema)
    return back.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))


@query("src_labelled_tree", f"SELECT DISTINCT split, source AS label FROM {SPLIT_SQL}")
def src_labelled_tree(spark, sf):
    """Class folders of whatever files, read as bytes; the names come from the path."""
    path = new_path(spark, "folders")
    rows = split_docs(spark, sf).select("split", F.col("source").alias("label"), F.col("text").alias("value"))
    rows.write.partitionBy("split", "label").text(path)
    tree = files.read_labelled_tree(spark, path, "*.txt")
    name = lambda c: F.regexp_replace(c, "^[a-z]+=", "")
    return tree.where(F.col("length") > 0).select(name(F.col("split")).alias("split"), name(F.col("label")).alias("label")).distinct()


@query("src_sidecar_pairs", f"SELECT stem, CASE WHEN good_note THEN event_type END AS diagram_type, width, height::INTEGER AS height, status FROM {s.IMAGES_SQL}")
def src_sidecar_pairs(spark, sf):
    path = new_path(spark, "pairs")
    img = s.images(spark, sf)
    img.select("stem", "content").write.parquet(f"{path}/images")
    img.where("note IS NOT NULL").select("stem", "note").write.parquet(f"{path}/notes")
    pairs = files.pair_sidecars(spark.read.parquet(f"{path}/images"), spark.read.parquet(f"{path}/notes"))
    return pairs.select("stem", F.col("meta.diagram_type").alias("diagram_type"), "width", "height", "status")


@query("src_read_history", f"SELECT epoch, train_loss, val_loss, seconds::DOUBLE AS epoch_seconds FROM {s.HISTORY_SQL}")
def src_read_history(spark, sf):
    path = new_path(spark, "history")
    s.history(spark, sf).select("epoch", "train_loss", "val_loss", F.col("seconds").alias("epoch_seconds")).write.json(path)
    return files.read_history(spark, path).select("epoch", "train_loss", "val_loss", "epoch_seconds")


OK_SQL = f"{s.sql_strip('ground_truth')} = {s.sql_strip('prediction')}"


@query("src_read_predictions", f"SELECT diagram_type, ground_truth, prediction, {OK_SQL} AS exact_match FROM {s.predictions_sql()}")
def src_read_predictions(spark, sf):
    path = new_path(spark, "predictions")
    metrics.exact_match(s.predictions(spark, sf)).drop("doc_id").write.json(path)
    return files.read_predictions(spark, path).select("diagram_type", "ground_truth", "prediction", "exact_match")


@query("snk_eval_report", f"""
    SELECT value, count(*) AS n FROM (
      SELECT 'Round-trip test: ' || count(*) FILTER (WHERE ok) || '/' || count(*) || ' exact matches' AS value FROM q
      UNION ALL SELECT unnest(string_split('=== ' || diagram_type || '  (exact_match=' || CASE WHEN ok THEN 'True' ELSE 'False' END || ') ===' || chr(10) || '--- ground truth ---' || chr(10)
        || ground_truth || chr(10) || '--- prediction ---' || chr(10) || prediction || chr(10), chr(10))) FROM q) GROUP BY 1""".replace(
    "SELECT value, count(*) AS n FROM (", f"WITH q AS (SELECT *, {OK_SQL} AS ok FROM {s.predictions_sql()}) SELECT value, count(*) AS n FROM (", 1))
def snk_eval_report(spark, sf):
    path = new_path(spark, "report")
    files.write_eval_report(metrics.exact_match(s.predictions(spark, sf)), path, ["diagram_type", "doc_id"], compression="snappy")
    lines = files.read_lines(spark, f"{path}/blocks").unionByName(files.read_lines(spark, f"{path}/header"))
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("snk_run_summary", f"""
    SELECT best.val_loss AS best_val_loss, num_epochs, on_the_fly, total_train_seconds FROM (SELECT min({{'val_loss': val_loss}}) AS best, count(*) AS num_epochs,
      true AS on_the_fly, sum(seconds)::DOUBLE AS total_train_seconds FROM {s.HISTORY_SQL})""")
def snk_run_summary(spark, sf):
    path = new_path(spark, "summary")
    facts = s.history(spark, sf).agg(
        F.min("val_loss").alias("best_val_loss"), F.count(F.lit(1)).alias("num_epochs"), F.lit(True).alias("on_the_fly"),
        F.sum("seconds").cast("double").alias("total_train_seconds"),
    )
    files.write_run_summary(facts, path)
    return spark.read.schema("best_val_loss double, num_epochs bigint, on_the_fly boolean, total_train_seconds double").json(path)


RUN_SQL = f"(SELECT epoch, sum(val_loss) AS val_loss, sum(steps)::DOUBLE / 7 AS val_token_acc, sum(seconds)::DOUBLE / 9 AS train_token_acc, sum(seconds) AS seconds FROM {s.HISTORY_SQL} WHERE run = 'click' GROUP BY 1)"


@query("snk_sequence_summary", f"""
    SELECT part, size, 6000 AS vocab_size, best_val_loss, final_val_token_acc, final_train_token_acc, q AS qualitative_exact_match_rate, r AS roundtrip_exact_match_rate, num_epochs, true AS on_the_fly,
      'unbounded (on the fly)' AS num_train_samples, num_val_samples, total_train_seconds
    FROM (SELECT c_mktsegment AS part, count(*) AS size FROM customer GROUP BY 1),
      (SELECT min(val_loss) AS best_val_loss, arg_max(val_token_acc, epoch) AS final_val_token_acc, arg_max(train_token_acc, epoch) AS final_train_token_acc, count(*)::INTEGER AS num_epochs, sum(seconds)::DOUBLE AS total_train_seconds FROM {RUN_SQL}),
      (SELECT count(*) FILTER (WHERE ok) / count(*) AS r, count(*) FILTER (WHERE ok AND doc_id % 2 = 0) / count(*) FILTER (WHERE doc_id % 2 = 0) AS q, count(*)::INTEGER AS num_val_samples
        FROM (SELECT doc_id, {s.sql_strip('ground_truth')} = {s.sql_strip('prediction')} AS ok FROM {s.predictions_sql()}))""")
def snk_sequence_summary(spark, sf):
    """All facts of a training run, written as one nested row and read back; a row per part of the model here."""
    path = new_path(spark, "summary")
    run = s.history(spark, sf).where("run = 'click'").select("epoch", "val_loss", (F.col("steps") / 7).alias("val_token_acc"), (F.col("seconds") / 9).alias("train_token_acc"), "seconds")
    params = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    scored = metrics.exact_match(s.predictions(spark, sf))
    facts = summary.sequence_summary(run, params, v.VOCAB_SIZE, scored.where("doc_id % 2 = 0"), scored, scored, None)
    files.write_run_summary(facts, path)
    back = summary.read_summary(spark, path, summary.SEQUENCE_SUMMARY)
    return back.select(F.explode("model_size_params").alias("part", "size"), *[c for c in back.columns if c != "model_size_params"])


@query("snk_classifier_summary", f"""
    SELECT truth, pred, coalesce(n, 0) AS n, best_val_acc, num_epochs, num_train_images, num_val_images
    FROM (SELECT unnest(['A', 'N', 'R']) AS truth) CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS pred) LEFT JOIN (SELECT truth, pred, count(*) AS n FROM {s.ANSWERS_SQL} GROUP BY 1, 2) USING (truth, pred),
      (SELECT max(val_loss) AS best_val_acc, count(*)::INTEGER AS num_epochs FROM {s.HISTORY_SQL} WHERE run = 'view'),
      (SELECT count(*) FILTER (WHERE split = 'train') AS num_train_images, count(*) FILTER (WHERE split = 'val') AS num_val_images FROM {SPLIT_SQL})""")
def snk_classifier_summary(spark, sf):
    """The classifier's facts with its confusion matrix, written and read back; a row per cell here."""
    path = new_path(spark, "summary")
    run = s.history(spark, sf).where("run = 'view'").withColumnRenamed("val_loss", "val_accuracy")
    files.write_run_summary(summary.classifier_summary(run, s.answers(spark, sf), "truth", "pred", s.CLASSES, split_docs(spark, sf)), path)
    back = summary.read_summary(spark, path, summary.CLASSIFIER_SUMMARY)
    cells = back.select("*", F.posexplode("final_confusion_matrix").alias("t", "row")).select("*", F.posexplode("row").alias("p", "n"))
    facts = ["best_val_acc", "num_epochs", "num_train_images", "num_val_images"]
    return cells.select(F.get("classes", F.col("t")).alias("truth"), F.get("classes", F.col("p")).alias("pred"), "n", *facts)

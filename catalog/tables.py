"""Filters, joins, aggregates, windows, sorting and set checks on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import standins as s
from catalog.grammar_sql import arr, u32 as sql_u32
from catalog.registry import query, table
from glyphmill.functions import text
from glyphmill.operators import classify, metrics, sequences as seq, splits
from glyphmill.operators.repair import corner, kth_with_kth, positional_join, reading_order
from glyphmill.session import materialise, spread

SPLIT_SQL = """(SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id)
    <= floor(count(*) OVER (PARTITION BY source) * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM documents)"""


def split_docs(spark, sf):
    return splits.stratified_split(table(spark, sf, "documents"), "source", "doc_id")


# --- filters and predicates ---------------------------------------------------------


@query("filter_split", f"SELECT doc_id, source, split FROM {SPLIT_SQL} WHERE split = 'val'")
def filter_split(spark, sf):
    return split_docs(spark, sf).where("split = 'val'").select("doc_id", "source", "split")


@query("filter_gate", """
    SELECT vec_id, label FROM (SELECT vec_id, label, list_position(embedding, list_max(embedding)) - 1 AS pred FROM embeddings) WHERE pred <> 0""")
def filter_gate(spark, sf):
    vec = table(spark, sf, "embeddings")
    top = classify.with_top(vec, "embedding")
    return classify.gate(top, "pred", [0]).select("vec_id", "label")


@query("filter_failed_payload", f"SELECT stem FROM {s.IMAGES_SQL} WHERE has_note")
def filter_failed_payload(spark, sf):
    return s.images(spark, sf).where(F.col("note").isNotNull()).select("stem")


@query("stripped_equality", f"""
    SELECT doc_id, {s.sql_strip('ground_truth')} = {s.sql_strip('prediction')} AS exact_match FROM {s.predictions_sql()}""")
def stripped_equality(spark, sf):
    return metrics.exact_match(s.predictions(spark, sf)).select("doc_id", "exact_match")


@query("preview_text", "SELECT doc_id, left(replace(text, chr(10), ' \\n '), 70) AS preview FROM documents")
def preview_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("image_header", f"SELECT stem, width, height::INTEGER AS height, whole FROM {s.IMAGES_SQL}")
def image_header(spark, sf):
    header = text.png_header(F.col("content"))
    return s.images(spark, sf).select("stem", *[c.alias(n) for n, c in header.items()])


PATHS = "'/data/' || lang || '/' || source || '/' || source || '_' || doc_id || '.png'"


@query("path_parts", f"""
    SELECT doc_id, regexp_extract(p, '([^/]+)\\.[^./]+$', 1) AS stem, regexp_extract(p, '\\.([^./]+)$', 1) AS extension,
      source AS class, lang AS split FROM (SELECT *, {PATHS} AS p FROM documents)""")
def path_parts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.format_string("/data/%s/%s/%s_%d.png", "lang", "source", "source", "doc_id").alias("p"))
    p = F.col("p")
    return docs.select(
        "doc_id", text.stem(p).alias("stem"), text.extension(p).alias("extension"),
        text.class_of(p).alias("class"), text.split_of(p).alias("split"),
    )


@query("defaulted_field", """
    SELECT event_id, coalesce(json_extract_string(props, '$.k'), '?') AS k, coalesce(json_extract_string(props, '$.diagram_type'), '?') AS diagram_type FROM events""")
def defaulted_field(spark, sf):
    meta = F.from_json("props", "k string, diagram_type string")
    return table(spark, sf, "events").select("event_id", meta.alias("m")).select(
        "event_id", F.coalesce("m.k", F.lit("?")).alias("k"), F.coalesce("m.diagram_type", F.lit("?")).alias("diagram_type")
    )


@query("clock_format", """
    SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS shown
    FROM (SELECT o_orderkey, greatest(trunc(o_totalprice - 5000)::BIGINT, 0) AS s FROM orders)""")
def clock_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.clock(F.col("o_totalprice") - 5000).alias("shown"))


# --- joins ------------------------------------------------------------------------


@query("join_manifest_payload", "SELECT o_orderkey, l_linenumber, l_quantity, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_manifest_payload(spark, sf):
    manifest, payload = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return manifest.join(payload, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity", "o_orderstatus")


@query("join_sidecars", f"SELECT stem, status, CASE WHEN good_note THEN event_type END AS diagram_type FROM {s.IMAGES_SQL}")
def join_sidecars(spark, sf):
    from glyphmill.sources.files import pair_sidecars

    img = s.images(spark, sf)
    pairs = pair_sidecars(img.select("stem", "content"), img.where("note IS NOT NULL").select("stem", "note"))
    return pairs.select("stem", "status", F.col("meta.diagram_type").alias("diagram_type"))


@query("join_label_id", """
    SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS label_id FROM customer""")
def join_label_id(spark, sf):
    return classify.label_index(table(spark, sf, "customer"), "c_mktsegment").select("c_custkey", "label_id")


@query("join_prediction_truth", "SELECT doc_id, quality = toxic AS agree, n_chars FROM documents JOIN labels USING (doc_id)")
def join_prediction_truth(spark, sf):
    truth = table(spark, sf, "labels")
    return table(spark, sf, "documents").join(truth, "doc_id").select("doc_id", (F.col("quality") == F.col("toxic")).alias("agree"), "n_chars")


@query("join_positional", """
    SELECT l.conv_id, l.turn, l.text AS original, r.text AS replacement FROM
      (SELECT * FROM conversations WHERE role = 'user') l LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') r USING (conv_id, turn)""")
def join_positional(spark, sf):
    conv = table(spark, sf, "conversations")
    left = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("original"))
    right = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("replacement"))
    return positional_join(left, right, "conv_id", "turn")


@query("join_kth_with_kth", """
    SELECT conv_id, turn, pos, original, replacement FROM
      (SELECT conv_id, turn, text AS original, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'user') LEFT JOIN
      (SELECT conv_id, text AS replacement, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'assistant') USING (conv_id, pos)""")
def join_kth_with_kth(spark, sf):
    """The k-th question of a conversation with its k-th answer, wherever they stand."""
    conv = table(spark, sf, "conversations")
    left = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("original"))
    right = conv.where("role = 'assistant'").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("replacement"))
    return kth_with_kth(left, right, ["conv_id"], ["turn"], ["at"]).select("conv_id", "turn", "pos", "original", "replacement")


@query("join_class_zero_fill", f"""
    SELECT event_type, coalesce(n, 0) AS n FROM (SELECT unnest({arr(['click', 'error', 'missing', 'purchase', 'view'])}) AS event_type)
    FULL JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)""")
def join_class_zero_fill(spark, sf):
    return metrics.dense_counts(table(spark, sf, "events"), "event_type", ["click", "error", "missing", "purchase", "view"])


def run_metrics_sql(salt):
    p = s.predictions_sql(salt)
    hit = f"{s.sql_strip('ground_truth')} = {s.sql_strip('prediction')}"
    extra = "UNION ALL SELECT 'chars_' || left(diagram_type, 5), sum(length(prediction))::DOUBLE FROM q GROUP BY 1" if salt == "pred" else ""
    return f"""(WITH q AS (SELECT *, {hit} AS ok FROM {p}) SELECT 'exact_match' AS metric, count(*) FILTER (WHERE ok)::DOUBLE / count(*) AS value FROM q
      UNION ALL SELECT 'chars', sum(length(prediction))::DOUBLE FROM q {extra})"""


def run_metrics(spark, sf, salt):
    """The rows are read once: sums per class are written, and the whole run's follow from them."""
    q = metrics.exact_match(s.predictions(spark, sf, salt))
    per = q.groupBy(F.concat(F.lit("chars_"), F.left("diagram_type", F.lit(5))).alias("metric")).agg(
        F.count_if("exact_match").alias("hits"), F.count(F.lit(1)).alias("n"), F.sum(F.length("prediction")).alias("chars")
    )
    per = materialise(per, "run-metrics")
    hits, n = (F.coalesce(F.sum(c), F.lit(0)) for c in ("hits", "n"))
    whole = per.agg((hits / n).alias("exact_match"), F.sum("chars").cast("double").alias("chars"))
    out = whole.unpivot([], ["exact_match", "chars"], "metric", "value")
    return out.unionByName(per.select("metric", F.col("chars").cast("double").alias("value"))) if salt == "pred" else out


@query("join_compare_runs", f"""
    SELECT metric, a.value AS run_a, b.value AS run_b, b.value - a.value AS change
    FROM {run_metrics_sql('pred')} a FULL JOIN {run_metrics_sql('pred2')} b USING (metric)""")
def join_compare_runs(spark, sf):
    return metrics.compare_runs(run_metrics(spark, sf, "pred"), run_metrics(spark, sf, "pred2"))


# --- aggregates ---------------------------------------------------------------------


@query("agg_rows_per_class", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY 1")
def agg_rows_per_class(spark, sf):
    return metrics.count_by_class(table(spark, sf, "documents"), "source")


@query("agg_confusion", f"SELECT truth, pred, count(*) AS n FROM {s.ANSWERS_SQL} GROUP BY 1, 2")
def agg_confusion(spark, sf):
    return metrics.confusion(s.answers(spark, sf), "truth", "pred")


@query("agg_confusion_dense", f"""
    SELECT truth, coalesce(a, 0) AS A, coalesce(n, 0) AS N, coalesce(x, 0) AS X, coalesce(o, 0) AS other FROM (SELECT unnest(['A','N','X','other']) AS truth)
    LEFT JOIN (SELECT CASE WHEN truth IN ('A','N','X') THEN truth ELSE 'other' END AS truth, count(*) FILTER (WHERE pred = 'A') AS a, count(*) FILTER (WHERE pred = 'N') AS n,
      count(*) FILTER (WHERE pred = 'X') AS x, count(*) FILTER (WHERE pred NOT IN ('A','N','X')) AS o FROM {s.ANSWERS_SQL} GROUP BY 1) USING (truth)""")
def agg_confusion_dense(spark, sf):
    """One class without rows is listed, and one with rows is not: it counts as other."""
    return metrics.confusion_dense(s.answers(spark, sf), "truth", "pred", ["A", "N", "X"])


@query("agg_accuracy", f"SELECT count(*) FILTER (WHERE truth = pred) AS correct, count(*) AS total, count(*) FILTER (WHERE truth = pred) / count(*) AS accuracy FROM {s.ANSWERS_SQL}")
def agg_accuracy(spark, sf):
    return metrics.accuracy(s.answers(spark, sf), "truth", "pred")


@query("agg_loss_means", f"""
    SELECT epoch, round(sum(loss * correct) / greatest(sum(correct) FILTER (WHERE loss IS NOT NULL), 1), 6) AS weighted_loss,
      round(avg(loss), 6) AS mean_loss FROM {s.STEPS_SQL} GROUP BY 1""")
def agg_loss_means(spark, sf):
    return metrics.losses(s.steps(spark, sf), "loss", "correct", ["epoch"])


@query("eval_epoch_metrics", f"""
    SELECT epoch, part, round(sum(loss * total) / greatest(sum(total), 1), 6) AS weighted_loss, round(avg(loss), 6) AS mean_loss, sum(correct) / greatest(sum(total), 1) AS token_accuracy
    FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'val' ELSE 'train' END AS part FROM {s.STEPS_SQL}) GROUP BY 1, 2""")
def eval_epoch_metrics(spark, sf):
    """Loss and accuracy of each epoch, train beside validation."""
    steps = s.steps(spark, sf).withColumn("part", F.when(F.col("event_id") % 5 == 0, "val").otherwise("train"))
    return metrics.epoch_metrics(steps, ["epoch", "part"])


@query("agg_exact_match_rate", f"""
    SELECT diagram_type, grouping(diagram_type) = 1 AS is_total, count(*) FILTER (WHERE ok) AS matches, count(*) AS n, count(*) FILTER (WHERE ok) / count(*) AS rate
    FROM (SELECT diagram_type, {s.sql_strip('ground_truth')} = {s.sql_strip('prediction')} AS ok FROM {s.predictions_sql()}) GROUP BY ROLLUP (diagram_type)""")
def agg_exact_match_rate(spark, sf):
    return metrics.exact_match_rates(metrics.exact_match(s.predictions(spark, sf)))


@query("agg_corpus_size", f"""
    SELECT count(*) AS texts, sum(length(text))::BIGINT AS chars, sum(len(ids))::BIGINT AS tokens, sum(length(text)) / greatest(sum(len(ids)), 1) AS chars_per_token
    FROM documents JOIN {s.TOKEN_IDS_SQL} USING (doc_id)""")
def agg_corpus_size(spark, sf):
    return metrics.corpus_size(table(spark, sf, "documents"), "text", F.size(F.split("text", " ")))


@query("agg_sidecar_totals", f"SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'corrupt') AS corrupt, count(*) FILTER (WHERE status = 'missing_meta') AS missing_meta FROM {s.IMAGES_SQL}")
def agg_sidecar_totals(spark, sf):
    pairs = join_sidecars(spark, sf)
    return pairs.agg(*[F.count_if(F.col("status") == k).alias(k) for k in ("ok", "corrupt", "missing_meta")])


@query("agg_box_corner", f"""
    SELECT page_id, i AS pos, ({sql_u32("'x'", 'page_id', 'i')} % 800)::DOUBLE AS x, ({sql_u32("'y'", 'page_id', 'i')} % 60 * 10)::DOUBLE AS y
    FROM (SELECT page_id, unnest(range(0, len(items)))::INTEGER AS i FROM {s.OCR_SQL})""")
def agg_box_corner(spark, sf):
    boxes = s.ocr_items(spark, sf).select("page_id", F.posexplode("items").alias("pos", "item"))
    x, y = corner(F.col("item.box"))
    return boxes.select("page_id", "pos", x.alias("x"), y.alias("y"))


@query("agg_run_totals", f"SELECT count(*) AS num_epochs, (sum(steps) * 16)::BIGINT AS num_train_samples, sum(seconds)::BIGINT AS total_train_seconds FROM {s.HISTORY_SQL}")
def agg_run_totals(spark, sf):
    return metrics.run_totals(s.history(spark, sf), "steps", 16, "seconds")


# --- windows ---------------------------------------------------------------------------


@query("win_stratified_split", f"SELECT source, split, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM {SPLIT_SQL} GROUP BY 1, 2")
def win_stratified_split(spark, sf):
    return split_docs(spark, sf).groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


@query("win_first_per_class", """
    SELECT source, doc_id, n_chars, place::INTEGER AS place FROM
      (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 2""")
def win_first_per_class(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return splits.first_per_class(docs, "source", "doc_id", 2)


PROGRESS = f"""SELECT epoch, step, last_step, elapsed, round(total_loss / step, 6) AS avg_loss, ok / greatest(n, 1) AS avg_accuracy,
      CASE WHEN elapsed > 0 THEN step / elapsed ELSE 0 END AS steps_per_sec, CASE WHEN elapsed > 0 THEN step / elapsed ELSE 0 END * 16 AS samples_per_sec,
      CASE WHEN elapsed > 0 THEN (last_step - step) / (step / elapsed) END AS eta
    FROM (SELECT epoch, elapsed, row_number() OVER w AS step, count(*) OVER (PARTITION BY epoch) AS last_step,
        sum(loss) OVER w AS total_loss, (sum(correct) OVER w)::DOUBLE AS ok, (sum(total) OVER w)::DOUBLE AS n
      FROM {s.STEPS_SQL} WINDOW w AS (PARTITION BY epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""


@query("win_progress_log", f"{PROGRESS} WHERE step % 25 = 0 OR step = last_step")
def win_progress_log(spark, sf):
    return metrics.progress_log(s.steps(spark, sf), "epoch", "event_id", 25, 16)


@query("win_new_best", f"""
    SELECT run, epoch, val_loss, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new_best
    FROM {s.HISTORY_SQL}""")
def win_new_best(spark, sf):
    return metrics.best_so_far(s.history(spark, sf), ["run"], "epoch", "val_loss").select("run", "epoch", "val_loss", "new_best")


@query("win_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM documents")
def win_batches(spark, sf):
    return splits.with_batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 16)


MIRROR_SQL = """SELECT worker, slot::INTEGER AS slot, counter, event_id, event_type FROM (SELECT *, counter % 8 AS slot,
      row_number() OVER (PARTITION BY worker, counter % 8 ORDER BY counter DESC) AS newest
      FROM (SELECT event_id, event_type, user_id % 4 AS worker, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS counter FROM events)) WHERE newest = 1"""


@query("win_rotating_slots", MIRROR_SQL)
def win_rotating_slots(spark, sf):
    ev = table(spark, sf, "events").withColumn("worker", F.col("user_id") % 4)
    return splits.mirror_slots(ev, "worker", "event_id", 8, ["event_type"])


@query("win_time_left", f"""
    SELECT run, epoch, seconds, (sum(seconds) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING))::BIGINT AS total_elapsed,
      seconds * (max(epoch) OVER (PARTITION BY run) - epoch) AS remaining FROM {s.HISTORY_SQL}""")
def win_time_left(spark, sf):
    return metrics.time_left(s.history(spark, sf).select("run", "epoch", "seconds"), ["run"], "epoch", "seconds")


@query("win_random_order", f"SELECT doc_id, row_number() OVER (ORDER BY {sql_u32('7', chr(39) + 'order' + chr(39), '3', 'doc_id')}, doc_id) AS place FROM documents")
def win_random_order(spark, sf):
    return splits.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 7, 3)


# --- sorting, top-k, sets ------------------------------------------------------------------


@query("sort_reading_order", f"SELECT page_id, array_to_string(texts, '|') AS texts FROM {s.TEXTS_SQL}")
def sort_reading_order(spark, sf):
    return s.ocr_items(spark, sf).select("page_id", F.array_join(reading_order(F.col("items")), "|").alias("texts"))


@query("sort_arg_max", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS pred, list_max(embedding)::DOUBLE AS confidence FROM embeddings")
def sort_arg_max(spark, sf):
    top = classify.with_top(table(spark, sf, "embeddings"), "embedding")
    return top.select("vec_id", "pred", F.col("confidence").cast("double").alias("confidence"))


@query("sort_top_pairs", """
    SELECT a, b, count(*) AS n FROM (SELECT w[i] AS a, w[i + 1] AS b FROM
      (SELECT string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')))) AS i FROM documents)) GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 50""")
def sort_top_pairs(spark, sf):
    words = spread(table(spark, sf, "documents").select("text")).select(F.split("text", " ").alias("w"))
    return seq.top_pairs(words, "w", 50)


@query("sort_by_key", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY 1, 2")
def sort_by_key(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).orderBy("p_brand", "p_type")


@query("set_class_contract", f"""
    SELECT event_type, CASE WHEN p IS NULL THEN 'missing' ELSE 'unexpected' END AS drift FROM (SELECT DISTINCT event_type, 1 AS p FROM events)
    FULL JOIN (SELECT unnest({arr(['click', 'view', 'refund'])}) AS event_type, 1 AS r) USING (event_type) WHERE p IS NULL OR r IS NULL""")
def set_class_contract(spark, sf):
    return metrics.contract_drift(table(spark, sf, "events"), "event_type", ["click", "view", "refund"])


@query("set_union_profiles", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def set_union_profiles(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return a.unionByName(table(spark, sf, "benchmark").select("text", F.col("item_id").alias("id")))


@query("win_first_per_class_many", """
    SELECT event_type, event_id, place::INTEGER AS place FROM
      (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events) WHERE place <= 1500""")
def win_first_per_class_many(spark, sf):
    """More rows per class than a window keeps in the map tasks; the rank runs in buckets."""
    ev = table(spark, sf, "events").select("event_type", "event_id")
    return splits.first_per_class(ev, "event_type", "event_id", 1500, rows_per_bucket=700)


@query("win_rotating_slots_many", MIRROR_SQL.replace("counter % 8", "counter % 1200"))
def win_rotating_slots_many(spark, sf):
    ev = table(spark, sf, "events").withColumn("worker", F.col("user_id") % 4)
    return splits.mirror_slots(ev, "worker", "event_id", 1200, ["event_type"], rows_per_bucket=700)


@query("win_progress_log_bucketed", f"{PROGRESS} WHERE step % 25 = 0 OR step = last_step")
def win_progress_log_bucketed(spark, sf):
    """The same log with the order cut into many small buckets."""
    return metrics.progress_log(s.steps(spark, sf), "epoch", "event_id", 25, 16, rows_per_bucket=300)


@query("win_stratified_split_bucketed", f"SELECT source, split, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM {SPLIT_SQL} GROUP BY 1, 2")
def win_stratified_split_bucketed(spark, sf):
    docs = splits.stratified_split(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", rows_per_bucket=100)
    return docs.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))

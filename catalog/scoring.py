"""Classification, label repair and evaluation reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog import standins as s
from catalog.generation import all_types_sql
from catalog.grammar_sql import arr, u32 as sql_u32
from catalog.registry import query, table
from catalog.tables import SPLIT_SQL
from glyphmill.functions import text, vectors
from glyphmill.operators import bpe, classify, epochs, metrics, repair, splits, structure
from glyphmill.operators import sequences as seq
from glyphmill.plans import corpus, inference
from glyphmill.plans import vocabulary as v
from glyphmill.session import new_path

# Channel statistics of the image inputs (fixed values).
MEAN, STD = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]


def vecs(spark, sf):
    return table(spark, sf, "embeddings")


# --- classification ------------------------------------------------------------------


def split_vecs(spark, sf):
    return splits.stratified_split(vecs(spark, sf), "label", "vec_id")


def fitted(spark, sf):
    return classify.train_classifier(split_vecs(spark, sf).where("split = 'train'"), "embedding", "label")


@query("cls_train_and_evaluate")
def cls_train_and_evaluate(spark, sf):
    """Confusion matrix of the validation split, from the model whose accuracy is reported."""
    val = split_vecs(spark, sf).where("split = 'val'")
    return metrics.confusion(classify.score(val, "embedding", fitted(spark, sf)), "label", "pred")


@query("cls_training_history")
def cls_training_history(spark, sf):
    history = classify.training_history(fitted(spark, sf)).withColumn("run", F.lit("train"))
    return metrics.best_so_far(history, ["run"], "epoch", "train_loss").select("epoch", "train_loss", "new_best")


@query("cls_best_epoch")
def cls_best_epoch(spark, sf):
    """History with losses and validation accuracy per epoch, trained in two runs that share a folder; the kept model's epoch is flagged."""
    rows, folder = split_vecs(spark, sf), new_path(spark, "classifier")
    for last in (3, 8):
        told = epochs.train_epochs(rows, "embedding", "label", F.col("split") == "val", 64, 64, folder, last)
    kept, _ = epochs.best_model(spark, folder)
    return epochs.with_best(told).withColumn("kept", F.col("epoch") == kept)


SCORED_SQL = """(SELECT vec_id, label, list_position(e, list_max(e)) - 1 AS pred, list_transform(p, lambda x: x / list_sum(p)) AS probs FROM
  (SELECT vec_id, label, e, list_transform(e, lambda x: exp(x::DOUBLE - list_max(e)::DOUBLE)) AS p FROM (SELECT vec_id, label, embedding AS e FROM embeddings)))"""


@query("cls_score", f"SELECT vec_id, pred::INTEGER AS pred, round(list_max(probs), 9) AS confidence FROM {SCORED_SQL}")
def cls_score(spark, sf):
    scored = classify.score_logits(vecs(spark, sf).withColumn("logits", F.col("embedding")), "logits")
    return scored.select("vec_id", "pred", F.round("confidence", 9).alias("confidence"))


@query("cls_label_index", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS label_id FROM part")
def cls_label_index(spark, sf):
    return classify.label_index(table(spark, sf, "part"), "p_type").select("p_partkey", "label_id")


@query("cls_evaluate", f"""
    SELECT t AS truth, p AS pred, coalesce(n, 0) AS n, (SELECT count(*) FILTER (WHERE label = pred) / count(*) FROM {SCORED_SQL}) AS accuracy
    FROM (SELECT unnest(range(0, 64))::INTEGER AS t) CROSS JOIN (SELECT unnest(range(0, 64))::INTEGER AS p)
    LEFT JOIN (SELECT label AS t, pred AS p, count(*) AS n FROM {SCORED_SQL} GROUP BY 1, 2) USING (t, p)""")
def cls_evaluate(spark, sf):
    """Every cell of the matrix beside the accuracy, both from the same scores."""
    scored = classify.score_logits(vecs(spark, sf).withColumn("logits", F.col("embedding")), "logits").select("label", "pred")
    cells = metrics.confusion_dense(scored, "label", "pred", list(range(64))).where(F.col("truth") != metrics.OTHER)
    cells = cells.unpivot(["truth"], [F.col(f"`{c}`").alias(str(c)) for c in range(64)], "pred", "n")
    share = metrics.accuracy(scored, "label", "pred").select("accuracy")
    return cells.withColumn("accuracy", share.scalar()).select(F.col("truth").try_cast("int").alias("truth"), F.col("pred").cast("int").alias("pred"), "n", "accuracy")


@query("cls_normalise", f"""
    SELECT vec_id, i::INTEGER AS pos, round((embedding[i + 1]::DOUBLE - ({arr(MEAN)}::DOUBLE[])[i % 3 + 1]) / ({arr(STD)}::DOUBLE[])[i % 3 + 1], 9) AS normal,
      least(greatest(embedding[i + 1]::DOUBLE, 0), 1)::DOUBLE AS clamped FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)""")
def cls_normalise(spark, sf):
    e = F.col("embedding")
    both = F.arrays_zip(vectors.normalise(e, MEAN, STD).alias("normal"), vectors.clamp(e).alias("clamped"))
    rows = vecs(spark, sf).select("vec_id", F.posexplode(both).alias("pos", "v"))
    return rows.select("vec_id", "pos", F.round(F.col("v.normal"), 9).alias("normal"), F.col("v.clamped").alias("clamped"))


def _u(part):
    return sql_u32("42", "'noise'", "vec_id", "i", f"'{part}'")


@query("cls_noise", f"""
    SELECT vec_id, i::INTEGER AS pos, round(least(greatest(embedding[i + 1]::DOUBLE + sqrt(-2.0::DOUBLE * ln(({_u('a')} + 1) / 4294967296.0::DOUBLE))
      * cos(2.0::DOUBLE * pi() * ({_u('b')} / 4294967296.0::DOUBLE)) * 0.05::DOUBLE, 0), 1), 9) AS value FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)""")
def cls_noise(spark, sf):
    noisy = vectors.add_noise(F.col("embedding"), 0.05, 42, F.col("vec_id"))
    return vecs(spark, sf).select("vec_id", F.posexplode(noisy).alias("pos", "x")).select("vec_id", "pos", F.round("x", 9).alias("value"))


@query("udf_transform_chain", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: least(greatest(x::DOUBLE, 0), 1))), 9) AS total FROM embeddings")
def udf_transform_chain(spark, sf):
    """Steps chain with ``transform``; strength 0 leaves the plan as it was."""

    def noise(strength):
        return lambda df: df.withColumn("embedding", vectors.add_noise(F.col("embedding"), strength, 42, F.col("vec_id")))

    def clamped(df):
        return df.withColumn("embedding", vectors.clamp(F.col("embedding")))

    out = vecs(spark, sf).transform(noise(0)).transform(clamped)
    return out.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


def load_linear():
    """Stand-in for a trained model, loaded once per Python worker: the features are the scores."""

    def predict(batch: np.ndarray) -> np.ndarray:
        return batch * np.float32(1.0)

    return predict


@query("cls_batch_scoring", f"""
    SELECT vec_id, pred::INTEGER AS pred, round(list_max(probs), 6) AS confidence, 'shape ' || pred AS answer FROM {SCORED_SQL} WHERE pred <> 3""")
def cls_batch_scoring(spark, sf):
    """Route, gate, then the second step only for what passed."""

    def second(df):
        return df.withColumn("answer", F.concat(F.lit("shape "), F.col("pred").cast("string")))

    out = classify.route_and_repair(vecs(spark, sf), "embedding", classify.batch_scorer(load_linear, 64), [3], second)
    return out.select("vec_id", "pred", F.round("confidence", 6).alias("confidence"), "answer")


def flow_items(spark, sf):
    """A page with the vector of its id; what the second model would put out: the page's bytes as ids, an end mark, and more."""
    pages = read_pages(spark, sf).select("page_id", "html", "texts")
    ids = F.concat(seq.to_sequence(bpe.encode(F.col("html"), BYTES), None), seq.ints(7, 8, v.EOS))
    return pages.withColumn("ids", ids).join(vecs(spark, sf), F.col("page_id") == F.col("vec_id"))


# A tokenizer without merges: one token per byte.
BYTES = bpe.Tokenizer([*v.SPECIAL_TOKENS, *bpe.ALPHABET], [])
MEANS_SQL = "(SELECT label, list(m ORDER BY i) AS mu FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


@query("cls_inference_flow", f"""
    WITH s AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, mu), lambda z: 2 * z[1]::DOUBLE * z[2] - z[2] * z[2])) AS score FROM (SELECT vec_id, embedding FROM embeddings) CROSS JOIN {MEANS_SQL}),
    p AS (SELECT vec_id, arg_max(label, score)::INTEGER AS pred, round(1 / sum(exp(score - top)), 6) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY vec_id) AS top FROM s) GROUP BY vec_id)
    SELECT page_id, pred, confidence, len(labels)::INTEGER AS labels,
      len(list_filter(labels, lambda x, i: texts[i] IS NOT NULL AND texts[i] <> x))::INTEGER AS replaced,
      sha256(array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i <= len(labels) THEN '"' || coalesce(texts[i], labels[i]) || '"' ELSE '' END), '')) AS code_sha256
    FROM (SELECT *, regexp_split_to_array(html, '"[^"]*"') AS parts FROM {s.TEXTS_SQL}) JOIN p ON vec_id = page_id WHERE pred % 5 <> 3""")
def cls_inference_flow(spark, sf):
    """A fitted model routes, the gate stops a fifth of the classes, the rest is decoded and repaired."""
    model = inference.centroids(vecs(spark, sf), "embedding", "label")
    rejected = [c for c in range(len(model.weights)) if c % 5 == 3]
    done, _ = inference.infer(flow_items(spark, sf), model, BYTES, rejected, "embedding")
    replaced = F.size(F.filter("slots", lambda x: x["status"] == "replaced"))
    return done.select("page_id", "pred", F.round("confidence", 6).alias("confidence"), F.size("slots").alias("labels"), replaced.alias("replaced"), F.sha2("repaired", 256).alias("code_sha256"))


# --- label repair ------------------------------------------------------------------------


def read_pages(spark, sf):
    return s.ocr_items(spark, sf).withColumn("texts", repair.reading_order(F.col("items")))


@query("repair_extract_labels", "SELECT page_id, len(labels)::INTEGER AS n, array_to_string(labels, '|') AS labels FROM (SELECT page_id, regexp_extract_all(html, '\"([^\"]*)\"', 1) AS labels FROM pages)")
def repair_extract_labels(spark, sf):
    labels = text.labels_of(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(labels).alias("n"), F.array_join(labels, "|").alias("labels"))


@query("repair_ordered_texts", f"SELECT page_id, pos::INTEGER AS pos, texts[pos + 1] AS text FROM (SELECT *, unnest(range(0, len(texts))) AS pos FROM {s.TEXTS_SQL})")
def repair_ordered_texts(spark, sf):
    return read_pages(spark, sf).select("page_id", F.posexplode("texts").alias("pos", "text"))


@query("repair_substitute", f"""
    SELECT page_id, array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i <= len(labels) THEN '"' || coalesce(texts[i], labels[i]) || '"' ELSE '' END), '') AS code
    FROM (SELECT *, regexp_split_to_array(html, '"[^"]*"') AS parts FROM {s.TEXTS_SQL})""")
def repair_substitute(spark, sf):
    return read_pages(spark, sf).select("page_id", repair.substitute(F.col("html"), F.col("texts")).alias("code"))


@query("repair_report", f"""
    SELECT page_id, pos::INTEGER AS pos, labels[pos + 1] AS original, texts[pos + 1] AS replacement,
      CASE WHEN texts[pos + 1] IS NULL THEN 'kept' WHEN texts[pos + 1] = labels[pos + 1] THEN 'unchanged' ELSE 'replaced' END AS status
    FROM (SELECT *, unnest(range(0, len(labels))) AS pos FROM {s.TEXTS_SQL})""")
def repair_report(spark, sf):
    slots = repair.substitutions(F.col("html"), F.col("texts"))
    return read_pages(spark, sf).select("page_id", F.inline(slots))


@query("repair_count_mismatch", f"SELECT page_id, len(labels) <> len(texts) AS mismatch FROM {s.TEXTS_SQL}")
def repair_count_mismatch(spark, sf):
    return read_pages(spark, sf).select("page_id", (F.size(text.labels_of(F.col("html"))) != F.size("texts")).alias("mismatch"))


# --- evaluation ---------------------------------------------------------------------------

OK_SQL = f"{s.sql_strip('ground_truth')} = {s.sql_strip('prediction')}"


@query("eval_prediction_report", f"SELECT doc_id, diagram_type, md5(prediction) AS prediction_md5, {OK_SQL} AS exact_match FROM {s.predictions_sql()}")
def eval_prediction_report(spark, sf):
    """Truth and prediction come from two tables and meet on the item key; only digests travel."""
    made = s.predictions(spark, sf).select(
        "doc_id", F.md5("prediction").alias("prediction_md5"), F.sha2(text.stripped(F.col("prediction")), 256).alias("made")
    )
    truth = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("diagram_type"), F.sha2(text.stripped(F.col("text")), 256).alias("truth")
    )
    same = F.col("truth") == F.col("made")
    return truth.join(made, "doc_id").select("doc_id", "diagram_type", "prediction_md5", same.alias("exact_match"))


@query("eval_qualitative_sample", f"""
    SELECT diagram_type, doc_id, place::INTEGER AS place, {OK_SQL} AS exact_match FROM
      (SELECT p.*, row_number() OVER (PARTITION BY diagram_type ORDER BY doc_id) AS place FROM {s.predictions_sql()} p
        JOIN (SELECT doc_id FROM {SPLIT_SQL} WHERE split = 'val') USING (doc_id)) WHERE place <= 2""")
def eval_qualitative_sample(spark, sf):
    """The first rows of every class of the validation split, not just of the first class."""
    docs = splits.stratified_split(s.predictions(spark, sf), "diagram_type", "doc_id")
    first = splits.first_per_class(docs.where("split = 'val'"), "diagram_type", "doc_id", 2)
    return metrics.exact_match(first).select("diagram_type", "doc_id", "place", "exact_match")


@query("eval_run_summary", f"""
    SELECT run, min(val_loss) AS best_val_loss, arg_max(train_loss, epoch) AS final_train_loss, count(*) AS num_epochs, sum(seconds)::BIGINT AS total_train_seconds
    FROM {s.HISTORY_SQL} GROUP BY 1""")
def eval_run_summary(spark, sf):
    return s.history(spark, sf).groupBy("run").agg(
        F.min("val_loss").alias("best_val_loss"), F.max_by("train_loss", "epoch").alias("final_train_loss"),
        F.count(F.lit(1)).alias("num_epochs"), F.sum("seconds").alias("total_train_seconds"),
    )


@query("eval_overfit_onset", f"""
    SELECT run, best.epoch AS best_epoch, best.val_loss AS best_val_loss, last.val_loss AS last_val_loss, last.val_loss - best.val_loss AS rise, last.val_loss - last.train_loss AS gap
    FROM (SELECT run, min({{'val_loss': val_loss, 'epoch': epoch}}) AS best, max({{'epoch': epoch, 'val_loss': val_loss, 'train_loss': train_loss}}) AS last FROM {s.HISTORY_SQL} GROUP BY 1)""")
def eval_overfit_onset(spark, sf):
    return metrics.overfit_onset(s.history(spark, sf), ["run"], "epoch", "train_loss", "val_loss")


@query("eval_structure_match", f"""
    SELECT page_id, html = code AS exact_match, regexp_replace(html, '"[^"]*"', '""', 'g') = regexp_replace(code, '"[^"]*"', '""', 'g') AS structure_match FROM
      (SELECT *, array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i <= len(labels) THEN '"' || coalesce(texts[i], labels[i]) || '"' ELSE '' END), '') AS code
       FROM (SELECT *, regexp_split_to_array(html, '"[^"]*"') AS parts FROM {s.TEXTS_SQL}))""")
def eval_structure_match(spark, sf):
    made = read_pages(spark, sf).withColumn("code", repair.substitute(F.col("html"), F.col("texts")))
    return made.select(
        "page_id", (F.col("html") == F.col("code")).alias("exact_match"),
        (text.structure_of(F.col("html")) == text.structure_of(F.col("code"))).alias("structure_match"),
    )


@query("eval_compare_runs", """
    WITH a AS (SELECT event_type AS metric, count(*)::DOUBLE AS value FROM events WHERE user_id % 2 = 0 AND event_type <> 'signup' GROUP BY 1),
      b AS (SELECT event_type AS metric, count(*)::DOUBLE AS value FROM events WHERE user_id % 2 = 1 AND event_type <> 'error' GROUP BY 1)
    SELECT metric, a.value AS run_a, b.value AS run_b, b.value - a.value AS change FROM a FULL JOIN b USING (metric)""")
def eval_compare_runs(spark, sf):
    """Two halves of the users, each without one metric that the other has."""

    def half(odd: int, without: str):
        rows = table(spark, sf, "events").where((F.col("user_id") % 2 == odd) & (F.col("event_type") != without))
        return rows.groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))

    return metrics.compare_runs(half(0, "signup"), half(1, "error"))


@query("eval_family_table", f"""
    SELECT CASE WHEN diagram_type IN ('src1', 'src3', 'src5') THEN 'templated' ELSE 'free text' END AS family, diagram_type,
      count(*) FILTER (WHERE ok) AS matches, count(*) AS n, count(*) FILTER (WHERE ok) / count(*) AS rate
    FROM (SELECT diagram_type, {OK_SQL} AS ok FROM {s.predictions_sql()}) GROUP BY 1, 2""")
def eval_family_table(spark, sf):
    return metrics.family_table(metrics.exact_match(s.predictions(spark, sf)), "diagram_type", ["src1", "src3", "src5"])


# --- duplicates, leakage, repetition, entropy ----------------------------------------------


@query("eval_duplicates", "SELECT source, count(*) AS n, count(DISTINCT text) AS texts, 1 - count(DISTINCT text) / count(*) AS duplicate_rate FROM documents GROUP BY 1")
def eval_duplicates(spark, sf):
    return metrics.duplicate_rates(table(spark, sf, "documents"), "source", "text")


@query("eval_leakage", f"""
    SELECT source, count(*) AS n, count(*) FILTER (WHERE leaked) AS leaked, count(*) FILTER (WHERE leaked) / count(*) AS leak_rate FROM
      (SELECT d.source, text IN (SELECT text FROM documents JOIN (SELECT doc_id FROM {SPLIT_SQL} WHERE split = 'train') USING (doc_id)) AS leaked
       FROM documents d JOIN (SELECT doc_id FROM {SPLIT_SQL} WHERE split = 'val') USING (doc_id)) GROUP BY 1""")
def eval_leakage(spark, sf):
    """Validation texts of the stratified split that are training texts too."""
    docs = splits.stratified_split(table(spark, sf, "documents").select("doc_id", "source", "text"), "source", "doc_id")
    return metrics.leakage(docs, "source", "text")


@query("eval_repetition", """
    SELECT doc_id, coalesce(1 - len(list_distinct(lines)) / nullif(len(lines), 0), 0)::DOUBLE AS repetition FROM
      (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS lines FROM documents)""")
def eval_repetition(spark, sf):
    return table(spark, sf, "documents").select("doc_id", metrics.repetition(F.col("text")).alias("repetition"))


@query("eval_label_entropy", """
    SELECT role, sum(n)::BIGINT AS n, count(*) AS labels, max(n) / sum(n) AS top_share, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM
      (SELECT role, label, count(*) AS n FROM (SELECT role, unnest(string_split(text, ' ')) AS label FROM conversations) GROUP BY 1, 2) GROUP BY 1""")
def eval_label_entropy(spark, sf):
    """Words stand in for labels, roles for classes."""
    return metrics.label_entropy(table(spark, sf, "conversations"), "role", F.split("text", " "))


@query("eval_quoted_label_entropy", """
    SELECT host, sum(n)::BIGINT AS n, count(*) AS labels, max(n) / sum(n) AS top_share, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM
      (SELECT host, label, count(*) AS n FROM (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, '"([^"]*)"', 1)) AS label FROM pages) GROUP BY 1, 2) GROUP BY 1""")
def eval_quoted_label_entropy(spark, sf):
    """Quoted labels of the pages, hosts for classes."""
    pages = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "html")
    return metrics.label_entropy(pages, "host", text.labels_of(F.col("html")))


# --- structure of flowcharts ----------------------------------------------------------------


def charts(spark, sf):
    """Flowcharts, and pies among them, beside copies with a wrong edge, a wrong label or neither."""
    made = corpus.generate(table(spark, sf, "documents").select("doc_id"), "doc_id", 42, types=["flowchart", "pie"])
    chosen = made.where((F.col("doc_id") % 5 == 0) == (F.col("diagram_type") == "pie"))
    wrong = F.when(F.col("doc_id") % 3 == 0, F.replace("target", F.lit(" --> N2"), F.lit(" --> N1"))).when(
        F.col("doc_id") % 3 == 1, F.regexp_replace("target", '"Check [a-z]+"', '"Check it"')
    )
    return chosen.select("doc_id", "diagram_type", F.col("target").alias("truth"), F.coalesce(wrong, "target").alias("prediction"))


CHARTS_SQL = f"""(SELECT *, CASE doc_id % 3 WHEN 0 THEN replace(target, ' --> N2', ' --> N1') WHEN 1 THEN regexp_replace(target, '"Check [a-z]+"', '"Check it"', 'g') ELSE target END AS made
  FROM {all_types_sql('documents', 'doc_id', '42', ['flowchart', 'pie'])} WHERE (doc_id % 5 = 0) = (diagram_type = 'pie'))"""
_NODE, _EDGE = structure.NODE.replace("'", "''"), structure.EDGE.replace("'", "''")


def _edges_sql(text):
    ids, labels = f"regexp_extract_all({text}, '{_NODE}', 1)", f"regexp_extract_all({text}, '{_NODE}', 2)"
    named = lambda x: f"coalesce({labels}[nullif(coalesce(list_position({ids}, {x}), 0), 0)], {x})"
    a, l, b = (f"regexp_extract_all({text}, '{_EDGE}', {k})" for k in (1, 2, 3))
    return f"list_transform({a}, lambda x, i: concat_ws('|', {named('x')}, {l}[i], {named(b + '[i]')}))"


def _shared_sql(a, b):
    return f"list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda z: z = x)))))"


STRUCTURE_SQL = f"""(SELECT doc_id, diagram_type, flow, CASE WHEN flow THEN len(nt) END AS nt, CASE WHEN flow THEN len(np) END AS np, CASE WHEN flow THEN coalesce({_shared_sql('nt', 'np')}, 0) END AS ns,
    CASE WHEN flow THEN len(et) END AS et, CASE WHEN flow THEN len(ep) END AS ep, CASE WHEN flow THEN coalesce({_shared_sql('et', 'ep')}, 0) END AS es
  FROM (SELECT doc_id, diagram_type, regexp_matches(target, '{structure.FLOW}') AS flow, regexp_extract_all(target, '{_NODE}', 2) AS nt, regexp_extract_all(made, '{_NODE}', 2) AS np,
    {_edges_sql('target')} AS et, {_edges_sql('made')} AS ep FROM {CHARTS_SQL}))"""


@query("eval_structure_scores", f"""
    SELECT doc_id, CASE WHEN flow THEN coalesce(ns / nullif(np, 0), 0) END AS node_precision, CASE WHEN flow THEN coalesce(ns / nullif(nt, 0), 0) END AS node_recall,
      CASE WHEN flow THEN coalesce(2 * ns / nullif(nt + np, 0), 0) END AS node_f1, CASE WHEN flow THEN coalesce(es / nullif(ep, 0), 0) END AS edge_precision,
      CASE WHEN flow THEN coalesce(es / nullif(et, 0), 0) END AS edge_recall, CASE WHEN flow THEN coalesce(2 * es / nullif(et + ep, 0), 0) END AS edge_f1 FROM {STRUCTURE_SQL}""")
def eval_structure_scores(spark, sf):
    scored = structure.with_structure(charts(spark, sf), "truth", "prediction")
    return scored.withColumns(structure.rates("node") | structure.rates("edge")).select(
        "doc_id", *[f"{k}_{m}" for k in ("node", "edge") for m in ("precision", "recall", "f1")]
    )


@query("eval_structure_f1", f"""
    SELECT diagram_type, count(nt) AS flowcharts, 2 * sum(ns) / nullif(sum(nt) + sum(np), 0) AS node_micro_f1, 2 * sum(es) / nullif(sum(et) + sum(ep), 0) AS edge_micro_f1,
      round(avg(2 * ns / nullif(nt + np, 0)), 9) AS node_macro_f1, round(avg(2 * es / nullif(et + ep, 0)), 9) AS edge_macro_f1 FROM {STRUCTURE_SQL} GROUP BY 1""")
def eval_structure_f1(spark, sf):
    """Pies have no nodes to score: null."""
    return structure.structure_f1(structure.with_structure(charts(spark, sf), "truth", "prediction"), "diagram_type")

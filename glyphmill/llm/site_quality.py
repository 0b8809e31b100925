"""Operator 5: document quality by hierarchical empirical Bayes over sites.

A logistic classifier gives every document log-odds of being good from measures
of its own text. Where it was found says something too: a host's share of good
documents, and that of a path of the host. Most hosts and paths have few
documents, so a share is shrunk: a path's towards its host's, a host's towards
that of all documents, each by the weight of as many pseudo-documents as the
spread between groups warrants (within-group variance over between-group
variance, both estimated from all groups). A document's score adds to its own
log-odds how far its path's posterior lies from the global prior.

The counts and sums are grouped aggregates, first by (host, path), then by host,
then over all; a host with a third of the documents is summed in parts. The
groups go back to the documents in joins on narrow rows; texts never move.

The classifier is fitted on the labelled rows outside the held-out fold. Null
hosts and paths are groups of their own. Null texts count as empty. Repeated rows
count each. A label other than 0 and 1 is none. Without labels of both classes
all evidence is nought; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.quality_rules import with_measures
from glyphmill.operators.running import meet
from glyphmill.session import materialise

HELD_OUT = 2
KEEP = 0.5
#: name: SQL over the measures of a text; a classifier input, each within a fixed range.
INPUTS = {
    "words": "ln(1 + n_words)",
    "short": "double(n_words < 10)",
    "word_length": "least(word_chars / greatest(n_words, 1), 30)",
    "symbols": "least(n_symbols / greatest(n_words, 1), 3)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def evidence(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``evidence``, the classifier's log-odds, to rows with the columns of ``INPUTS``; those columns go."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_label")).filter("_label in (0, 1)")
    known = rows.join(marks, rows["doc_id"] == marks["_id"]).filter(~F.col("held_out"))
    rest = [c for c in rows.columns if c not in INPUTS]
    if known.select("_label").distinct().count() < 2:
        return rows.select(*rest, F.lit(0.0).alias("evidence"))
    vectors = VectorAssembler(inputCols=list(INPUTS), outputCol="_inputs")
    model = LogisticRegression(featuresCol="_inputs", labelCol="_label", rawPredictionCol="_raw", regParam=1e-4, maxIter=100).fit(
        vectors.transform(known).select("_inputs", "_label")
    )
    scored = model.transform(vectors.transform(rows))
    return scored.select(*rest, F.greatest(F.lit(-12.0), F.least(F.lit(12.0), vector_to_array("_raw")[1])).alias("evidence"))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def pull(groups: DataFrame, centre: Column) -> float:
    """Pseudo-documents that hold a group at ``centre``: within-group over between-group variance.

    ``groups`` has n, s and ss: documents, sum and sum of squares of their probabilities.
    """
    mean = F.col("s") / F.col("n")
    row = groups.agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"),
        F.sum(F.col("ss") - F.col("n") * mean * mean).alias("within"),
        F.sum(F.col("n") * (mean - centre) ** 2).alias("between"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not row["n"] or row["groups"] < 2 or row["n"] <= row["groups"]:
        return 1e6
    within = max(row["within"], 0.0) / (row["n"] - row["groups"])
    between = (row["between"] - (row["groups"] - 1) * within) / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return float(min(1e6, max(1.0, within / between))) if between > 0 else 1e6


def posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """Per (host, path): host_posterior and path_posterior; and the global prior. ``rows`` has host, path, p."""
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = materialise(paths, "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = min(1 - 1e-4, max(1e-4, total["s"] / total["n"])) if total["n"] else 0.5
    weight = pull(hosts, F.lit(prior))
    hosts = hosts.select("host", ((F.col("s") + weight * prior) / (F.col("n") + weight)).alias("host_posterior"),
                         (F.col("s") / F.col("n")).alias("host_mean"))
    joined = materialise(meet(paths, hosts, ["host"]), "paths-in-hosts")
    weight = pull(joined, F.col("host_mean"))
    own = (F.col("s") + weight * F.col("host_posterior")) / (F.col("n") + weight)
    return joined.select("host", "path", "host_posterior", own.alias("path_posterior")), prior


def quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, host, path): evidence, host_posterior, path_posterior, score, kept, held_out."""
    held = (fold(F.col("doc_id")) == HELD_OUT).alias("held_out")
    measured = with_measures(docs.select("doc_id", "text", "host", "path"))
    inputs = [F.expr(v).cast("double").alias(k) for k, v in INPUTS.items()]
    rows = materialise(measured.select("doc_id", "host", "path", held, *inputs), "quality-inputs")
    rows = materialise(evidence(rows, labels).withColumn("p", logistic(F.col("evidence"))), "evidence")
    groups, prior = posteriors(rows)
    out = meet(rows, materialise(groups, "posteriors"), ["host", "path"])
    inside = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("path_posterior")))
    scored = out.withColumn("score", logistic(F.col("evidence") + logit(inside) - logit(F.lit(prior))))
    return scored.withColumn("kept", F.col("score") >= keep).drop("p")

"""A training corpus from raw documents: five stages, each a table in and a table out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of documents.

Null and empty texts: the quality rules reject them, as they have no words; a later stage given one keeps it and
encodes it as its end id. Null ids stay. Repeated rows are judged alike: rows of equal id and text are one document for line
dedup and get the same text back, and near copies leave all rows of the one id that stays. Of equal lines or documents the
one of the smallest doc_id stays. Very long texts are read whole, in memory in
proportion to their length. Columns beyond those of documents pass through all but the last stage, whatever their
names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table
from glyphmill.llm import decontaminate, lines, near_documents, pieces, quality_rules
from glyphmill.llm.queries import tokenizer_model
from glyphmill.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    measured = materialise(quality_rules.with_measures(rows).drop("text"), "pipeline-measures")
    model = quality_rules.fit(quality_rules.with_votes(measured))
    return quality_rules.judged(measured, model).filter("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line matches; ``n_chars`` follows the text."""
    out = lines.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram similarity links."""
    return near_documents.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids with an end id, their number, and the text that they decode to."""
    out = pieces.encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_model())
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "decoded")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("ngram_join", near_copies),
    ("decontaminate", benchmark),
    ("sentencepiece", tokens),
]
#: Estimation and encoding have no SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Small shared pieces: words, row views of the input tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.session import discard, materialise

#: White space that separates words, as a character class for Java and RE2 alike.
SPACE = r"[\x20\x09-\x0D]"
#: A document read in one piece costs memory; larger Arrow batches gain nothing.
BATCH_CHARS = 4_000_000


def words(text: Column) -> Column:
    """The runs of characters other than ``SPACE``; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), body)[0]


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*names)


def sliced(batches, text: str = "text"):
    """Cut Arrow batches so that each piece holds about ``BATCH_CHARS`` bytes of text, and one row at least."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64()).to_numpy()
        block = np.cumsum(sizes) // BATCH_CHARS
        starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (x, y): rows (node, root).

    Each round takes the smallest label among the neighbours and then follows
    labels twice, so a chain of n links needs about log n rounds. Labels go
    through a table of the shared folder each round; the driver sees one count.
    """
    both = materialise(
        edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), name
    )
    labels = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("root"))
    labels = held = materialise(labels, name)
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("root").alias("r")), "y")
        near = near.groupBy(F.col("x").alias("node")).agg(F.min("r").alias("r"))
        once = labels.join(near, "node").select("node", F.least("root", "r").alias("new"), F.col("root").alias("old"))
        ahead = once.select(F.col("node").alias("new"), F.col("new").alias("next"))
        jump = once.join(ahead, "new").select("node", F.least("new", "next").alias("root"), "old")
        step = materialise(jump, name)
        moved = step.filter(F.col("root") != F.col("old")).limit(1).count()
        discard(held)
        labels, held = step.select("node", "root"), step
        if not moved:
            discard(both)
            return labels

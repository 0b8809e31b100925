"""Ranks and running aggregates that do not need a whole group in one task.

``Window.partitionBy(cls).orderBy(id)`` sorts a class in one task, which fails
when one class holds a third of the table. Here the order key is cut at its
quantiles: totals per (group, bucket) give each bucket its starting value, and
the window runs inside (group, bucket) only. Results are exact, and every step
is a plain function of the row, so a lost executor recomputes the same values.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import materialise

ROWS_PER_BUCKET = 2_000_000
BUCKET = "_bucket"


class Run(NamedTuple):
    """One running column: ``kind`` of sum, min or max over ``value``.

    ``before`` leaves the current row out of its own value.
    """

    kind: str
    value: Column
    before: bool = False


def count_so_far() -> Run:
    return Run("sum", F.lit(1).cast("bigint"))


def with_buckets(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, int]:
    """Add a bucket number that rises with ``key``; reads that column only."""
    wanted = -(-df.select(key).count() // rows_per_bucket)
    inner: list[float] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        found = df.agg(F.percentile_approx(F.col(key).cast("double"), shares, max(10_000, 8 * wanted))).first()[0]
        inner = sorted(set(found or []))
    if not inner:
        return df.withColumn(BUCKET, F.lit(0)), 1
    cut = Bucketizer(
        splits=[float("-inf"), *inner, float("inf")], inputCol="_key", outputCol=BUCKET, handleInvalid="keep"
    )
    keyed = cut.transform(df.withColumn("_key", F.col(key).cast("double"))).drop("_key")
    return keyed.withColumn(BUCKET, F.col(BUCKET).cast("int")), len(inner) + 1


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` null-safely, so rows without a class stay in; the keys come from the left."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    hit = F.lit(True)
    for k in keys:
        hit = hit & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(other, hit, how).drop(*[f"_right_{k}" for k in keys])


def running(
    df: DataFrame, by: list[str], order: list[str], rows_per_bucket: int = ROWS_PER_BUCKET, **runs: Run
) -> DataFrame:
    """Add running columns over ``order`` inside each ``by`` group.

    ``order`` must be a total order; its first column is numeric or a timestamp
    and spreads the rows (an id, a time, a draw).
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    join = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
    named = df.withColumns({f"_v_{n}": r.value for n, r in runs.items()})
    keyed, buckets = with_buckets(named, order[0], rows_per_bucket)
    inside = Window.partitionBy(*by, BUCKET).orderBy(*order)

    def local(name: str, run: Run) -> Column:
        return fold[run.kind](f"_v_{name}").over(inside.rowsBetween(Window.unboundedPreceding, -1 if run.before else 0))

    if buckets == 1:
        out = keyed.withColumns({n: local(n, r) for n, r in runs.items()})
    else:
        earlier = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        totals = keyed.groupBy(*by, BUCKET).agg(*[fold[r.kind](f"_v_{n}").alias(f"_t_{n}") for n, r in runs.items()])
        base = materialise(
            totals.select(*by, BUCKET, *[fold[r.kind](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, r in runs.items()]),
            "offsets",
        )
        joined = meet(keyed, base, [*by, BUCKET], "left")

        def total(name: str, run: Run) -> Column:
            here, base_value = F.col(name), F.col(f"_b_{name}")
            return F.when(here.isNull(), base_value).when(base_value.isNull(), here).otherwise(
                join[run.kind](base_value, here)
            )

        within = joined.withColumns({n: local(n, r) for n, r in runs.items()})
        out = within.withColumns({n: total(n, r) for n, r in runs.items()})
    return out.select(*df.columns, *runs)


def with_rank(df: DataFrame, by: list[str], order: list[str], name: str = "rank", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the 1-based position of the row in its group."""
    return running(df, by, order, rows_per_bucket, **{name: count_so_far()})

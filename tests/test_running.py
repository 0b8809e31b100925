"""Ranks and running values by buckets equal the plain window, also with a hot class."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.operators import splits
from glyphmill.operators.running import Run, count_so_far, running, with_buckets


def hot(spark, n=3000, parts=8):
    """A third of the rows in one class, some rows without a class, ids far apart."""
    k = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 17 == 0, None).otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string")))
    return spark.range(0, n, 1, parts).select((F.col("id") * F.col("id") * 5 + 3).alias("id"), k.alias("k"), ((F.col("id") * 37) % 101).alias("v"))


def plain(df):
    w = Window.partitionBy("k").orderBy("id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"rank": F.count(F.lit(1)).over(run), "total": F.sum("v").over(run), "low": F.min("v").over(before), "high": F.max("v").over(run)})


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("per_bucket", [100, 700, 10**6])
@pytest.mark.parametrize("parts", [1, 4, 17])
def test_running_equals_window(spark, per_bucket, parts):
    df = hot(spark, parts=parts)
    got = running(
        df, ["k"], ["id"], per_bucket, rank=count_so_far(), total=Run("sum", F.col("v")),
        low=Run("min", F.col("v"), before=True), high=Run("max", F.col("v")),
    )
    assert rows(got) == rows(plain(df))


def test_buckets_hold_no_hot_group(spark):
    df, n = with_buckets(hot(spark), "id", 100)
    assert n == 30
    assert df.groupBy("k", "_bucket").count().agg(F.max("count")).first()[0] <= 100


@pytest.mark.parametrize("per_bucket", [100, 10**6])
def test_split_takes_the_first_share_of_each_class(spark, per_bucket):
    df = hot(spark)
    got = splits.stratified_split(df, "k", "id", 0.15, per_bucket)
    n, place = F.count(F.lit(1)).over(Window.partitionBy("k")), F.row_number().over(Window.partitionBy("k").orderBy("id"))
    want = df.withColumn("split", F.when(place <= F.floor(n * F.lit(0.15)), "val").otherwise("train"))
    assert rows(got) == rows(want)


def test_split_of_300_is_45(spark):
    df = spark.range(300).withColumn("k", F.lit("x"))
    assert splits.stratified_split(df, "k", "id").where("split = 'val'").count() == 45


@pytest.mark.parametrize("per_bucket", [50, 10**6])
def test_batches_and_order(spark, per_bucket):
    df = spark.range(0, 333, 1, 5)
    got = {r.id: r.batch_id for r in splits.with_batches(df, "id", 16, rows_per_bucket=per_bucket).collect()}
    assert got == {i: i // 16 for i in range(333)}
    a = {r.id: r.place for r in splits.shuffled(df, "id", 7, 1, per_bucket).collect()}
    b = {r.id: r.place for r in splits.shuffled(df.repartition(3), "id", 7, 1).collect()}
    c = {r.id: r.place for r in splits.shuffled(df, "id", 7, 2).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 334)) and a != c


def test_first_per_class_sees_every_class(spark):
    df = spark.range(600).select("id", F.when(F.col("id") < 500, "flowchart").otherwise(F.concat(F.lit("t"), (F.col("id") % 5).cast("string"))).alias("k"))
    got = splits.first_per_class(df, "k", "id", 2).groupBy("k").count().collect()
    assert len(got) == 6 and {r["count"] for r in got} == {2}
    plan = splits.first_per_class(df, "k", "id", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # cut to n rows before the shuffle and after it


@pytest.mark.parametrize("rows_per_bucket", [40, 10**6])
def test_many_rows_per_class(spark, rows_per_bucket):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").alias("k"))
    got = splits.first_per_class(df, "k", "id", 1100, rows_per_bucket)
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {"hot": 1100, None: 1000}
    many = splits.mirror_slots(df, "k", "id", 1100, [], rows_per_bucket)
    few = {r.k: (r.n, r.low, r.high) for r in many.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("counter").alias("high")).collect()}
    assert few["hot"][0] == 1100 and few["hot"][2] == 2000
    assert few[None] == (1000, 0, 1000)

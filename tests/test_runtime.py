"""Session helpers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.runtime import few, join_split, scratch_path, scratch_root, stage, with_offsets, numbered


def test_stage_and_root(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2).repartition(50)
    out = stage(df, "t")
    assert out.count() == 1000 and out.dtypes == df.dtypes and len(out.inputFiles()) <= 8
    assert scratch_root(spark).rsplit("/", 1)[-1] in out.inputFiles()[0] and scratch_path(spark, "x").startswith("file:/")
    assert stage(df.filter("id < 0"), "none").count() == 0
    assert len(stage(df, "many", 5_000_000).inputFiles()) > 8


def test_few_counts_bytes(spark):
    df = spark.range(100).select("id", F.array_repeat(F.col("id"), 1000).alias("a"), F.lit("text").alias("s"))
    assert few(df, 10_000_000) and not few(df, 500_000) and not few(df, 1000)
    assert few(spark.range(0), 1)
    nested = spark.range(10).select(F.array(F.struct(F.lit("x" * 1000).alias("s"), F.array(F.lit(1)).alias("n"))).alias("a"))
    assert not few(nested, 9000) and few(nested, 20_000)


def test_ranks_without_one_task_a_group(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", (F.xxhash64("id") % 7).alias("b"))
    ranked = with_offsets(df, ["g"], "b", F.lit(1), "before")
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("g", "b").orderBy("id")))
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("b", "id")).cast("long"))
    assert ranked.select("g", "id", "rank").exceptAll(want.select("g", "id", "rank")).isEmpty()


def test_join_split_equals_a_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = join_split(left, right, "k", "n", 3000)
    assert out.exceptAll(left.join(right, "k").select(out.columns)).isEmpty() and out.count() == 3000


def test_numbered_is_dense_and_in_order(spark):
    d = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit("x").alias("_nth")).repartition(7)
    got = {r.k: r.place for r in numbered(d, [F.desc("k")], "place").collect()}
    assert got == {k: 999 - k for k in range(1000)}
    assert numbered(d.limit(0), [F.asc("k")], "_nth2").count() == 0

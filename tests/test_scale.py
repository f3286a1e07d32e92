from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelloom.scale import joins as J
from labelloom.scale import ordering as O
from labelloom.scale.staging import clear_staged, shared_dir, stage


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_staged_tables_live_in_the_configured_folder(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    staged = stage(spark.range(5), "five")
    assert staged.count() == 5 and shared_dir(spark) in staged.inputFiles()[0]


def test_clear_staged_removes_the_files(spark):
    staged = stage(spark.range(5), "five")
    path = staged.inputFiles()[0]
    clear_staged(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_ordered_index_equals_row_number(spark):
    df = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("k"), (F.col("id") % 3).alias("v"))
    got = rows_of(O.ordered_index(df, [F.desc("v"), F.col("k")], "at"))
    want = rows_of(df.withColumn("at", (F.row_number().over(Window.orderBy(F.desc("v"), "k")) - 1).cast("long")))
    assert got == want


def test_top_rows_ranked_in_parallel_equals_limit(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"))
    order = [F.desc("k")]
    assert rows_of(O.top_rows(df, order, 100, inline=10)) == rows_of(O.top_rows(df, order, 100))


@pytest.mark.parametrize("prefix", [1, 4])
def test_rank_in_group_equals_window(spark, prefix):
    # Group 'a' holds two thirds of all rows.
    df = stage(
        spark.range(3000).select(
            F.when(F.col("id") % 3 < 2, "a").otherwise(F.concat(F.lit("b"), (F.col("id") % 50).cast("string"))).alias("g"),
            F.when(F.col("id") % 10 == 0, 4).otherwise(1).alias("n"),
            F.md5(F.col("id").cast("string")).alias("h"),
            F.col("id").cast("string").alias("key"),
        ),
        "ranks",
    )
    got = O.rank_in_group(df, "g", "n", "h", "key", "rank", prefix).select("key", "rank")
    window = Window.partitionBy("g").orderBy(F.desc("n"), "h", "key")
    want = df.select("key", (F.row_number().over(window) - 1).cast("long").alias("rank"))
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    # One key holds a third of the rows.
    rows = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).cast("string").alias("k")
    )
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("cast(k as int) % 2 = 0")
    plain = rows.join(table, "k", how)
    salted = J.salted_join(rows, table, "k", how, "n", F.col("id"), hot_key_rows=100)
    unbroadcast = J.lookup_join(rows, table, "k", how, "n", F.col("id"), max_broadcast_rows=10, hot_key_rows=100)
    small = J.lookup_join(rows, table, "k", how)
    columns = plain.columns
    assert rows_of(plain) == rows_of(salted.select(columns))
    assert rows_of(plain) == rows_of(unbroadcast.select(columns)) == rows_of(small.select(columns))


def test_salting_spreads_the_hot_key(spark):
    rows = spark.range(6000).select(F.col("id"), F.lit("hot").alias("k"))
    table = spark.createDataFrame([("hot", 6000), ("cold", 1)], "k string, n bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = J.salted_join(rows, table, "k", "inner", "n", F.col("id"), hot_key_rows=100)
        parts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in parts) == 6000
    assert len(parts) == 4 and max(r["count"] for r in parts) < 3000


def test_pin_keeps_small_tables_local_and_stages_large_ones(spark):
    small, large = J.pin(spark.range(10), "t", 10), J.pin(spark.range(11), "t", 10)
    assert small.count() == 10 and not small.inputFiles()
    assert large.count() == 11 and large.inputFiles()

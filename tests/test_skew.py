"""Joins with a key on most rows."""

import pytest
from pyspark.sql import functions as F

from tagloom.operators import maintenance, skew


def skewed(spark, n=40_000):
    tag = F.when(F.col("id") % 10 < 9, F.lit("1girl")).otherwise(F.concat(F.lit("t"), (F.col("id") % 997).cast("string")))
    return spark.range(n).select("id", F.when(F.col("id") % 1_000 != 5, tag).alias("tag"))


def test_the_common_tag_is_heavy_and_stays_in_its_tasks(spark):
    rows = skewed(spark)
    assert len(skew.heavy_hashes(rows, ["tag"])) == 1
    words = spark.createDataFrame([("1girl", "eine"), ("t13", "x")], "tag string, translated string").withColumn("lang", F.lit("de"))
    got = maintenance.join_translations(rows, words, "de")
    want = rows.join(words.drop("lang"), "tag", "left")
    assert sorted(map(str, got.select("id", "tag", "translated").collect())) == sorted(map(str, want.select("id", "tag", "translated").collect()))


def test_no_task_has_twice_the_median(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        side = spark.range(997).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tag"), F.col("id").alias("v"))
        side = side.unionByName(spark.createDataFrame([("1girl", -1)], "tag string, v long"))
        sizes = [r["count"] for r in skew.join_heavy(skewed(spark), side, "tag").groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in skewed(spark).join(side, "tag", "left").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    hot = sorted(sizes)[len(sizes) // 2 :]  # the tasks of the scan, whose rows stay where they are
    assert max(hot) < 2 * hot[len(hot) // 2] and max(plain) > 5 * sorted(plain)[len(plain) // 2]


def test_inner_join_without_heavy_keys_and_other_kinds(spark):
    rows = spark.range(5_000).withColumnRenamed("id", "k")
    assert skew.heavy_hashes(rows, ["k"]) == []
    assert skew.join_heavy(rows, rows.where("k < 10").withColumn("v", F.lit(1)), "k", "inner").count() == 10
    assert skew.join_heavy(rows.limit(0), rows, "k", "inner").count() == 0
    with pytest.raises(ValueError):
        skew.join_heavy(rows, rows, "k", "full")

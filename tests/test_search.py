"""Search of many queries at once, and passes over the documents."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tagloom.operators import ranking as R
from tests.conftest import SF, plan_of


@pytest.mark.parametrize("name", ["search_tags", "search_translated"])
def test_a_search_counts_the_words_once(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "documents.parquet" not in plan and plan.count("Generate") <= 2


def test_many_queries_are_as_one_by_one(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abAB_") for _ in range(n))
    rows = [(word(draw.randint(1, 7)), 0, draw.randint(0, 4), draw.choice([word(draw.randint(0, 6)), None])) for _ in range(150)]
    rows = list({r[0]: r for r in rows}.values()) + [(None, 0, 1, "a"), ("", 0, 9, "ab")]
    dictionary = spark.createDataFrame(rows, "name string, category int, post_count long, aliases string").cache()
    asked = [word(n) for n in (1, 1, 2, 2, 3, 4, 4, 5, 6)] + ["a b", "A", "", "zzz"]
    got = R.search_tags_many(dictionary, spark.createDataFrame([(q,) for q in asked], "query string"), 3, per_block=2).collect()
    for q in set(asked):
        ranked = [(r.name, r.stage, r.post_count) for r in R.search_tags(dictionary, q, 3).collect()]
        assert [(r.name, r.stage, r.post_count) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == ranked
    assert R.search_tags_many(dictionary, dictionary.select(F.col("name").alias("query")).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["join_translations", "cache_counts", "translate_tags", "read_files"])
def test_words_are_counted_once(spark, name):
    assert "documents.parquet" not in plan_of(entry.queries()[name](spark, SF))


def test_hits_are_split_without_a_pass_for_heavy_tags(spark, monkeypatch):
    from tagloom.operators import skew

    monkeypatch.setattr(skew, "heavy_hashes", lambda *a: pytest.fail("the words were read for heavy ones"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(entry.queries()["split_cache_hits"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan


def test_frequent_join_is_the_plain_one(spark):
    from tagloom.operators.skew import join_frequent

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2_000).select("id", F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 8, "b").when(F.col("id") % 10 < 9, "c").alias("tag"))
        side = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "3"), ("z", "4")], "tag string, translated string")
        frequent = spark.createDataFrame([("a",), ("b",)], "tag string")  # b has no translation
        got = join_frequent(rows, side, "tag", frequent)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(side, "tag", "left").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_requests_counted_first_give_the_same_counts(spark):
    from tagloom.operators import maintenance as M

    rows = spark.createDataFrame([("a", True), ("a", True), ("b", False), ("b", False), ("c", True)], "tag string, hit boolean")
    whole = rows.groupBy("tag", "hit").agg(F.count("*").alias("n"))
    assert M.cache_counts(whole, "n").collect() == M.cache_counts(rows).collect()
    assert M.cache_counts(whole.limit(0), "n").first() == (0, 0)


def test_dictionary_files_are_not_written_by_one_task(spark, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "coalesce", lambda *a: pytest.fail("all lines go through one task"))
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda *a: pytest.fail("all lines go through one task"))
    assert entry.queries()["read_files"](spark, SF).count() > 0

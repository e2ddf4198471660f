"""Keyed tables without a table format: dictionary and translation cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.skew import join_frequent, join_heavy

#: A tag with more than one in so many of all tags is frequent; there are no more frequent tags than that.
FREQUENT_SHARE = 1 << 18


def frequent_tags(dictionary: DataFrame, on: str = "tag") -> DataFrame:
    """Tags of a dictionary with a large share of its counts."""
    total = dictionary.agg(F.sum("post_count")).first()[0] or 0
    return dictionary.where(F.col("post_count") > total / FREQUENT_SHARE).select(F.col("name").alias(on))


def join_translations(tags: DataFrame, translations: DataFrame, lang: str, on: str = "tag", frequent: DataFrame | None = None) -> DataFrame:
    """Each tag with its translation or null; tags on most rows don't move.

    These are found by a pass over ``tags`` unless ``frequent`` (a column ``on``, of bounded size) names them.
    """
    words = translations.where(F.col("lang") == lang).select(F.col("tag").alias(on), "translated")
    return join_heavy(tags, words, on) if frequent is None else join_frequent(tags, words, on, frequent)


def untranslated_tags(dictionary: DataFrame, translations: DataFrame, lang: str) -> DataFrame:
    """Dictionary entries without a translation; consumers order by count, then name."""
    known = translations.where(F.col("lang") == lang).select(F.col("tag").alias("name"))
    return dictionary.join(known, "name", "left_anti")


def split_cache_hits(requests: DataFrame, translations: DataFrame, lang: str, frequent: DataFrame | None = None) -> DataFrame:
    """Requested tags with the cached translation; repeats and positions are kept."""
    return join_translations(requests, translations, lang, frequent=frequent).withColumn("hit", F.col("translated").isNotNull())


def cache_counts(split: DataFrame, times: str | None = None) -> DataFrame:
    """Distinct tags found in the cache, and requests still to translate.

    With ``times``, a column of that name says how many requests a row stands for.
    """
    missing = F.count_if(~F.col("hit")) if times is None else F.coalesce(F.sum(F.when(~F.col("hit"), F.col(times))), F.lit(0))
    return split.agg(F.count_distinct(F.when(F.col("hit"), F.col("tag"))).alias("cached_count"), missing.cast("long").alias("uncached_count"))


def upsert_translations(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace by ``(tag, lang)``; the highest ``seq`` wins.

    Expressed as an aggregation so that repeated keys shrink before the shuffle.
    """
    columns = ["tag", "translated", "lang", "seq"]
    merged = current.select(*columns).unionByName(changes.select(*columns))
    last = F.max(F.struct("seq", "translated")).alias("last")
    return merged.groupBy("tag", "lang").agg(last).select("tag", "last.translated", "lang", "last.seq")


def delete_translations(current: DataFrame, lang: str | None = None) -> DataFrame:
    """Empty the cache, or drop one language."""
    return current.where(F.lit(False)) if lang is None else current.where(F.col("lang") != lang)


def dictionary_metadata(dictionary: DataFrame, source_file: str, import_epoch: int) -> DataFrame:
    """The two facts recorded when a dictionary is replaced."""
    rows = F.array(
        F.struct(F.lit("source_file").alias("key"), F.lit(source_file).alias("value")),
        F.struct(F.lit("import_date").alias("key"), F.lit(str(import_epoch)).alias("value")),
    )
    return dictionary.agg(F.count("*").alias("entries")).select(F.inline(rows), "entries")

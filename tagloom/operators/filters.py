"""Row filters over asset and caption relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import tags as T
from tagloom.functions.tags import strip


def resolution_matches(condition: str, width: int, height: int) -> Column:
    """The rows to act on: small ones for ``min_*`` and ``below``, large for ``above``."""
    w, h = F.col("width"), F.col("height")
    tests = {
        "min_width": w < width,
        "min_height": h < height,
        "below": (w < width) & (h < height),
        "above": (w > width) & (h > height),
    }
    if condition not in tests:
        raise ValueError(f"unknown resolution condition {condition!r}")
    return tests[condition]


def filter_resolution(assets: DataFrame, condition: str, width: int, height: int) -> DataFrame:
    return assets.where(resolution_matches(condition, width, height))


def keep_extensions(files: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Add ``action``: ``keep`` for listed extensions, ``delete`` for the rest."""
    kept = F.lower(F.coalesce(F.col("ext"), F.lit(""))).isin([e.lower() for e in keep])
    return files.withColumn("action", F.when(kept, "keep").otherwise("delete"))


def filter_tagged(rows: DataFrame, state: str, has: Column) -> DataFrame:
    """``state`` is all, tagged or untagged; ``has`` tells which rows carry content."""
    if state == "all":
        return rows
    if state not in ("tagged", "untagged"):
        raise ValueError(f"unknown state {state!r}")
    return rows.where(has if state == "tagged" else ~has)


def has_tags() -> Column:
    return F.size("tags") > 0


def has_caption() -> Column:
    return strip(F.col("caption")) != ""


def search_assets(rows: DataFrame, query: str) -> DataFrame:
    """Lower-cased query inside the lower-cased name or inside a tag as written."""
    q = query.lower()
    return rows.where(F.lower("name").contains(q) | F.exists("tags", lambda t: t.contains(q)))


def filter_all_tags(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return rows.where(T.contains_all(F.col("tags"), T.literal_list(wanted)))


def search_tag_stats(stats: DataFrame, translations: DataFrame, lang: str, query: str) -> DataFrame:
    """Statistics rows whose tag or translation contains the lower-cased query."""
    q = query.lower()
    words = translations.where(F.col("lang") == lang).select("tag", "translated")
    joined = stats.join(words, "tag", "left")
    return joined.where(F.col("tag").contains(q) | F.coalesce(F.col("translated").contains(q), F.lit(False)))


def skip_existing(assets: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Assets without a non-blank description; a ``.json`` hides a ``.txt``."""
    described = (
        sidecars.where(F.col("kind").isin("txt", "json"))
        .groupBy("stem")
        .agg(F.max_by(strip(F.col("content")) != "", F.when(F.col("kind") == "json", 1).otherwise(0)).alias("filled"))
        .where("filled")
    )
    return assets.join(described.select("stem"), "stem", "left_anti")


def _format(ext: Column) -> Column:
    return F.when(F.lower(ext) == "jpeg", "jpg").otherwise(F.lower(ext))


def skip_same_format(assets: DataFrame, target: str) -> DataFrame:
    """Drop rows already in the target format; ``jpeg`` and ``jpg`` are one."""
    wanted = "jpg" if target.lower() == "jpeg" else target.lower()
    return assets.where(_format(F.col("ext")) != wanted)


def changed_rows(edits: DataFrame, before: str, after: str) -> DataFrame:
    return edits.where(~F.col(before).eqNullSafe(F.col(after)))

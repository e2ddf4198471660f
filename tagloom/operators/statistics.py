"""Counts and summaries.  Every one is a partial aggregation before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_tags(captions: DataFrame) -> DataFrame:
    """One row per tag.

    An inner explode would have the optimizer test ``size(tags) > 0`` below it and
    so compute a derived list twice; the outer form with a null test does not.
    """
    return captions.select(F.explode_outer("tags").alias("tag")).where("tag is not null")


def tag_stats(tags: DataFrame) -> DataFrame:
    """Occurrences of each tag in a one-row-per-occurrence relation."""
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def distinct_tags(tags: DataFrame) -> DataFrame:
    return tags.select("tag").distinct()


def common_tags(captions: DataFrame, distinct_per_asset: bool = False) -> DataFrame:
    """Tags whose count equals the number of tagged assets.

    Counts are occurrences, so a tag repeated inside one asset can stand in for
    another asset that lacks it; ``distinct_per_asset`` counts assets instead.
    """
    tags = F.array_distinct("tags") if distinct_per_asset else F.col("tags")
    stats = tag_stats(explode_tags(captions.select(tags.alias("tags"))))
    tagged = captions.select(F.count_if(F.size("tags") > 0)).scalar()
    return stats.where(F.col("n") == tagged)


def coverage_stats(rows: DataFrame, has: Column) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(has).alias("tagged"),
        F.count_if(~has).alias("untagged"),
    )


def sort_tag_stats(stats: DataFrame, by: str = "freq", descending: bool = True) -> DataFrame:
    """By frequency or name; equal frequencies are ordered by name."""
    name = F.col("tag")
    if by == "name":
        return stats.orderBy(name.desc() if descending else name.asc())
    n = F.col("n")
    return stats.orderBy(n.desc() if descending else n.asc(), name)


def concept_balance(concepts: DataFrame) -> DataFrame:
    """Samples and share of every concept, summed per name."""
    per = concepts.groupBy("name").agg(F.sum(F.col("image_count") * F.col("repeats")).alias("samples"))
    total = concepts.select(F.coalesce(F.sum(F.col("image_count") * F.col("repeats")), F.lit(0))).scalar()
    share = F.when(total > 0, F.col("samples") * 100.0 / total).otherwise(0.0)
    return per.withColumn("percent", share)


def training_steps_epochs(concepts: DataFrame, batch: int, accumulate: int, epochs: int) -> DataFrame:
    """Steps per epoch and in all, for a number of epochs."""
    samples = F.coalesce(F.sum(F.col("image_count") * F.col("repeats")), F.lit(0)).cast("long")
    effective = batch * accumulate
    per_epoch = F.ceil(F.col("samples") / effective).cast("long") if effective > 0 else F.lit(0).cast("long")
    return (
        concepts.agg(samples.alias("samples"))
        .withColumn("steps_per_epoch", per_epoch)
        .withColumn("total_steps", (F.col("steps_per_epoch") * epochs).cast("long"))
    )


def training_steps_budget(concepts: DataFrame, batch: int, accumulate: int, max_steps: int) -> DataFrame:
    """How a step budget falls on epochs, and what a cut epoch loses."""
    base = training_steps_epochs(concepts, batch, accumulate, 1).select("samples", "steps_per_epoch")
    per = F.col("steps_per_epoch")
    some = per > 0
    budget = F.lit(max_steps).cast("long")
    return (
        base.withColumn("full_epochs", F.when(some, F.floor(budget / per)).otherwise(0).cast("long"))
        .withColumn("remaining", F.when(some, budget - F.col("full_epochs") * per).otherwise(0).cast("long"))
        .withColumn("epochs", F.when(some, F.ceil(budget / per)).otherwise(0).cast("long"))
        .withColumn("suggested_steps", (F.col("epochs") * per).cast("long"))
        .withColumn("is_cut", F.col("remaining") > 0)
        .withColumn("lost_steps", F.when(F.col("remaining") > 0, per - F.col("remaining")).otherwise(0).cast("long"))
    )


def epoch_timeline(plan: DataFrame, max_steps: int) -> DataFrame:
    """One row per epoch of each budget plan, the last one possibly truncated."""
    per = F.col("steps_per_epoch")
    rows = plan.where("epochs > 0").select(
        *plan.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))).alias("epoch")
    )
    return (
        rows.withColumn("start_step", (F.col("epoch") - 1) * per)
        .withColumn("end_step", F.least(F.col("epoch") * per, F.lit(max_steps).cast("long")))
        .withColumn("truncated", (F.col("epoch") == F.col("epochs")) & F.col("is_cut"))
    )


def translation_stats(translations: DataFrame) -> DataFrame:
    """Entries per language and, under ``all``, in total."""
    counted = translations.rollup("lang").agg(F.count("*").alias("n"))
    return counted.select(F.coalesce("lang", F.lit("all")).alias("lang"), "n")


def dict_stats(dictionary: DataFrame, translations: DataFrame, lang: str, meta: DataFrame | None = None) -> DataFrame:
    """Dictionary size and the size of the translation cache for a language.

    The translated count is of the whole cache, whether or not a tag is in the
    dictionary.
    """
    translated = translations.where(F.col("lang") == lang).select(F.count("*")).scalar()
    out = dictionary.agg(F.count("*").alias("total_tags")).select(
        "total_tags", translated.alias("translated_count"), (F.col("total_tags") > 0).alias("has_data")
    )
    for key in ("source_file", "import_date") if meta is not None else ():
        out = out.withColumn(key, meta.where(F.col("key") == key).select(F.max("value")).scalar())
    return out


def job_outcome(outcomes: DataFrame) -> DataFrame:
    """Tallies per job."""
    return outcomes.groupBy("job").agg(
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "error").alias("fail_count"),
        F.count("*").alias("total"),
    )


def job_errors(outcomes: DataFrame) -> DataFrame:
    """Every error of every job as a row of its own; a report sorts and pages them."""
    return outcomes.where(F.col("status") == "error").select("job", "name", "message")

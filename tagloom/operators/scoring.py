"""From score vectors to tag lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import tags as T

# fixed values: the order in which categories appear in a tag list
CATEGORY_ORDER = ("rating", "quality", "general", "character", "copyright", "artist", "meta", "model")
ARGMAX_CATEGORIES = ("rating", "quality")
GENERAL_LIKE = ("general", "meta", "model")
CHARACTER_LIKE = ("character", "copyright", "artist")


def score_assets(
    images: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], list]], key: str = "asset_id"
) -> DataFrame:
    """Run a user's batch scorer; ``make_scorer`` is called once per Python task."""
    schema = f"{key} {images.schema[key].dataType.simpleString()}, scores array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "scores": list(scorer(batch))})

    return images.mapInPandas(run, schema)


def sigmoid(x: Column, clip: float = 30.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), x))))


def sigmoid_scores(df: DataFrame, column: str = "scores") -> DataFrame:
    return df.withColumn(column, F.transform(column, lambda x: sigmoid(x.cast("double"))))


def labelled_scores(scores: DataFrame, vocabulary: DataFrame, enabled: Sequence[str] | None = None) -> DataFrame:
    """``scores`` with ``labels``: ``array<struct<idx, name, category, prob>>`` in index order.

    The vocabulary, as long as one score vector, is one array value of the plan, so
    an asset's scores never leave their row.  Scores beyond the vocabulary, and
    labels beyond the scores, are dropped.
    """
    vocab = vocabulary.select("idx", "name", "category")
    if enabled is not None:
        vocab = vocab.where(F.col("category").isin(*enabled))
    entries = vocab.agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "name", "category")))).scalar()
    paired = F.transform(
        "_vocab",
        lambda e: F.struct(
            e["idx"].alias("idx"), e["name"].alias("name"), e["category"].alias("category"),
            F.get(F.col("scores"), e["idx"]).cast("double").alias("prob"),
        ),
    )
    rows = scores.withColumn("_vocab", entries)
    return rows.withColumn("labels", F.filter(paired, lambda e: e["prob"].isNotNull())).drop("_vocab")


def long_scores(scores: DataFrame, vocabulary: DataFrame, enabled: Sequence[str] | None = None) -> DataFrame:
    """``(asset_id, idx, name, category, prob)``: the labels of every asset as rows."""
    return label_rows(labelled_scores(scores, vocabulary, enabled), F.col("labels"))


def label_rows(labelled: DataFrame, labels: Column) -> DataFrame:
    rows = labelled.select("asset_id", F.explode_outer(labels).alias("_label")).where("_label is not null")
    return rows.select("asset_id", "_label.idx", "_label.name", "_label.category", "_label.prob")


def shown_name(name: Column, replace_underscore: bool = True) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" ")) if replace_underscore else name


def _not_excluded(label: Column, exclude: Sequence[str], replace_underscore: bool) -> Column:
    if not exclude:
        return F.lit(True)
    return ~(label["name"].isin(*exclude) | shown_name(label["name"], replace_underscore).isin(*exclude))


def pick_argmax(
    labels: Column,
    categories: Sequence[str] = ARGMAX_CATEGORIES,
    exclude: Sequence[str] = (),
    replace_underscore: bool = True,
) -> Column:
    """The best label of each category, lowest index on ties, as an array.

    Exclusion comes after the choice: nothing takes an excluded winner's place.
    """

    def best(category: str) -> Column:
        own = F.filter(labels, lambda e: e["category"] == category)
        return F.array_max(F.transform(own, lambda e: F.struct(e["prob"].alias("p"), (-e["idx"]).alias("i"), e.alias("label"))))["label"]

    chosen = F.array(*[best(c) for c in categories])
    return F.filter(chosen, lambda e: e.isNotNull() & _not_excluded(e, exclude, replace_underscore))


def pick_threshold(
    labels: Column,
    general: float = 0.35,
    character: float = 0.85,
    exclude: Sequence[str] = (),
    replace_underscore: bool = True,
) -> Column:
    """Labels at or above the threshold of their category."""

    def keep(e: Column) -> Column:
        over = (e["category"].isin(*GENERAL_LIKE) & (e["prob"] >= general)) | (
            e["category"].isin(*CHARACTER_LIKE) & (e["prob"] >= character)
        )
        return over & _not_excluded(e, exclude, replace_underscore)

    return F.filter(labels, keep)


def order_selected(labels: Column, replace_underscore: bool = True) -> Column:
    """``array<struct<name, category, prob>>`` in the fixed order of categories, best first."""
    order = T.literal_list(CATEGORY_ORDER)
    entries = F.transform(labels, lambda e: F.struct(
        F.array_position(order, e["category"]).alias("r"), (-e["prob"]).alias("p"), e["idx"].alias("idx"), e.alias("label")
    ))
    return F.transform(F.array_sort(entries), lambda s: F.struct(
        shown_name(s["label"]["name"], replace_underscore).alias("name"), s["label"]["category"].alias("category"), s["label"]["prob"].alias("prob")
    ))


def append_tags(selected: Column, extra: Sequence[str], position: str = "append") -> Column:
    """Put literal tags, as general ones of probability 1, behind or in front."""
    if not extra:
        return selected
    added = F.array(
        *[F.struct(F.lit(t).alias("name"), F.lit("general").alias("category"), F.lit(1.0).alias("prob")) for t in extra]
    )
    return F.concat(added, selected) if position == "prepend" else F.concat(selected, added)


def tags_to_text(selected: Column) -> Column:
    return T.join_tags(F.transform(selected, lambda s: s["name"]))


def select_tags(
    scores: DataFrame,
    vocabulary: DataFrame,
    general: float = 0.35,
    character: float = 0.85,
    enabled: Sequence[str] = ("general", "character"),
    exclude: Sequence[str] = (),
    extra: Sequence[str] = (),
    position: str = "append",
    replace_underscore: bool = True,
) -> DataFrame:
    """Scores to ordered tags per asset, assets with none included: one projection."""
    rows = labelled_scores(scores, vocabulary, enabled)
    chosen = F.concat(
        pick_argmax(F.col("labels"), ARGMAX_CATEGORIES, exclude, replace_underscore),
        pick_threshold(F.col("labels"), general, character, exclude, replace_underscore),
    )
    ordered = rows.select("asset_id", order_selected(chosen, replace_underscore).alias("selected"))
    return ordered.select("asset_id", append_tags(F.col("selected"), extra, position).alias("selected")).withColumn(
        "text", tags_to_text(F.col("selected"))
    )

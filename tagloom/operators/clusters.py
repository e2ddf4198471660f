"""Clustering of feature vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import materialize


def l2_normalize(vec: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec)


def _times(weight: float):
    return lambda x: x * F.lit(weight)


def fuse_features(parts: dict[str, float], normalized: frozenset[str] = frozenset({"color"})) -> Column:
    """Weighted concatenation of feature columns.

    Parts of weight zero or without a vector are left out; with none at all the
    result is null.  The color histogram comes normalized.
    """
    pieces = []
    for name, weight in parts.items():
        if weight > 0:
            vec = F.col(name) if name in normalized else l2_normalize(F.col(name))
            scaled = F.transform(vec, _times(float(weight)))
            pieces.append(F.coalesce(scaled, F.array().cast("array<double>")))
    if not pieces:
        return F.lit(None).cast("array<double>")
    joined = F.concat(*pieces)
    return F.when(F.size(joined) > 0, joined)


def _vectors(features: DataFrame) -> DataFrame:
    return features.withColumn("_v", array_to_vector(F.col("vec")))


def cluster_kmeans(features: DataFrame, k: int, seed: int = 42, starts: int = 10) -> DataFrame:
    """Add ``label``: the cheapest of several k-means runs; ``k`` at most the row count."""
    data = _vectors(features).persist()
    try:
        k = min(k, data.count())
        if k < 2:
            return features.withColumn("label", F.lit(0))
        runs = (KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="label").fit(data) for i in range(starts))
        best = min(runs, key=lambda m: m.summary.trainingCost)
        return materialize(best.transform(data).drop("_v"))
    finally:
        data.unpersist()


def reduce_pca(features: DataFrame, dims: int = 50) -> DataFrame:
    """Project ``vec`` to at most ``dims`` components when it is wider."""
    first = features.select(F.size("vec").alias("d")).first()
    if first is None or first["d"] <= dims:
        return features
    data = _vectors(features)
    out = PCA(k=dims, inputCol="_v", outputCol="_p").fit(data).transform(data)
    return out.withColumn("vec", vector_to_array("_p")).drop("_v", "_p")


def cluster_map(features: DataFrame, draw_w: int = 5792, draw_h: int = 3104, margin: int = 120) -> DataFrame:
    """Two components of each vector, to be scaled by :func:`to_canvas`."""
    flat = reduce_pca(features, 2)
    x, y = F.get("vec", F.lit(0)), F.coalesce(F.get("vec", F.lit(1)), F.lit(0.0))
    return to_canvas(flat.withColumns({"x": x, "y": y}).drop("vec"), draw_w, draw_h, margin)


def to_canvas(coords: DataFrame, draw_w: int = 5792, draw_h: int = 3104, margin: int = 120) -> DataFrame:
    """Canvas position of every ``(label, x, y)`` row and of its cluster's middle.

    The link of a row runs from one to the other; noise has none.  The ranges
    are scalar subqueries and there is one row per cluster to join.
    """

    def scalar(agg: Column) -> Column:
        return coords.select(agg).scalar()

    def placed(value: Column, lo: Column, hi: Column, size: int) -> Column:
        span = F.when(hi > lo, hi - lo).otherwise(1.0)
        return (F.lit(margin) + F.floor((value - lo) / span * size)).cast("long")

    x0, x1, y0, y1 = scalar(F.min("x")), scalar(F.max("x")), scalar(F.min("y")), scalar(F.max("y"))
    middles = coords.where(F.col("label") >= 0).groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    rows = coords.join(middles, "label", "left")
    return rows.withColumns({
        "cx": placed(F.col("x"), x0, x1, draw_w), "cy": placed(F.col("y"), y0, y1, draw_h),
        "center_x": placed(F.col("mx"), x0, x1, draw_w), "center_y": placed(F.col("my"), y0, y1, draw_h),
    })


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """Rows per label; noise, label -1, is its own row."""
    name = F.when(F.col("label") < 0, "noise").otherwise(F.concat(F.lit("cluster_"), F.col("label").cast("string")))
    return labelled.groupBy("label").agg(F.count("*").alias("n")).withColumn("cluster", name)

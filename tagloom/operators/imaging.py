"""Pixel work: Spark partitions the images, NumPy handles one at a time.

An image relation has ``height, width, channels, data`` next to its keys; large
images call for a small ``spark.sql.execution.arrow.maxRecordsPerBatch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from tagloom.functions import pixels as K
from tagloom.functions.geometry import tiles
from tagloom.operators.filters import skip_same_format
from tagloom.operators.ranking import file_stem

PARTS = ("data", "height", "width", "channels")


def _measure(kernel: Callable[[np.ndarray], object], kind: DataType) -> Column:
    @F.pandas_udf(kind)
    def run(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([kernel(K.to_array(*row)) for row in zip(data, height, width, channels)])

    return run(*[F.col(p) for p in PARTS])


def dhash() -> Column:
    return _measure(lambda a: K.dhash(K.to_luma(a)), LongType())


def phash() -> Column:
    return _measure(lambda a: K.phash(K.to_luma(a)), LongType())


def rgb_histogram() -> Column:
    return _measure(lambda a: K.rgb_histogram(a).tolist(), ArrayType(DoubleType()))


def has_transparency() -> Column:
    return _measure(K.is_transparent, BooleanType())


def fingerprint(images: DataFrame) -> DataFrame:
    """All three fingerprints in one pass over the pixels."""

    @F.pandas_udf("dhash long, phash long, hist array<double>")
    def run(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = []
        for row in zip(data, height, width, channels):
            img = K.to_array(*row)
            luma = K.to_luma(img)
            rows.append((K.dhash(luma), K.phash(luma), K.rgb_histogram(img).tolist()))
        return pd.DataFrame(rows, columns=["dhash", "phash", "hist"])

    rest = [c for c in images.columns if c not in PARTS]
    return images.withColumn("_f", run(*[F.col(p) for p in PARTS])).select(*rest, "_f.dhash", "_f.phash", "_f.hist")


def spread(images: DataFrame, key: str) -> DataFrame:
    """Even out images over as many tasks as a shuffle has.

    Worth its shuffle where a kernel takes far longer than moving the pixels and
    the input has few splits.
    """
    return images.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def transform_images(images: DataFrame, kernel: Callable[[np.ndarray, pd.Series], np.ndarray]) -> DataFrame:
    """Apply ``kernel(pixels, row)`` to every image; other columns pass through.

    A failing image keeps its row, with empty data and the message in ``error``.
    """
    kinds = {"height": IntegerType(), "width": IntegerType(), "channels": IntegerType(), "data": BinaryType(), "error": StringType()}
    columns = [*images.columns, *({"error"} - set(images.columns))]
    schema = StructType([StructField(c, kinds.get(c) or images.schema[c].dataType) for c in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.copy()
            results, errors = [], []
            for row in batch.itertuples(index=False):
                try:
                    img = np.ascontiguousarray(kernel(K.to_array(row.data, row.height, row.width, row.channels), row))
                    results.append((*img.shape, img.tobytes()))
                    errors.append(None)
                except Exception as problem:  # one bad image never ends the job
                    results.append((0, 0, 0, b""))
                    errors.append(f"{type(problem).__name__}: {problem}")
            for i, name in enumerate(("height", "width", "channels", "data")):
                out[name] = [r[i] for r in results]
            out["error"] = errors
            yield out

    return images.mapInPandas(run, schema)


def flip_images(images: DataFrame, mode: str) -> DataFrame:
    return transform_images(images, lambda img, row: K.flip(img, mode))


def crop_images(planned: DataFrame) -> DataFrame:
    """Crop to the columns ``x, y, w, h`` of a plan."""
    return transform_images(planned, lambda img, row: K.crop(img, row.x, row.y, row.w, row.h))


def resize_images(planned: DataFrame) -> DataFrame:
    """Resize to the columns ``w, h`` of a plan."""
    return transform_images(planned, lambda img, row: K.resize(img, int(row.w), int(row.h)))


def flatten_alpha(images: DataFrame, background: str = "white") -> DataFrame:
    return transform_images(images, lambda img, row: K.flatten_alpha(img, background))


def path_variant(path: Column) -> Column:
    """The path seed modulo 4, natively: 31 is 3 modulo 4, reduced at every step."""
    digits = F.transform(
        F.sequence(F.lit(0), F.octet_length(path) - 1),
        lambda i: F.conv(F.substr(F.hex(path), i * 2 + 1, F.lit(2)), 16, 10).cast("int"),
    )
    folded = F.aggregate(digits, F.lit(0), lambda acc, b: F.pmod(acc * 3 + b, F.lit(4)))
    return F.when(F.octet_length(path) > 0, folded).otherwise(0)


def path_seed(path: Column) -> Column:
    """Polynomial hash (base 31) of the UTF-8 bytes modulo 2^64, folded in two halves of 32 bits that a long can hold."""
    low32 = F.lit((1 << 32) - 1)
    digits = F.transform(
        F.sequence(F.lit(0), F.octet_length(path) - 1),
        lambda i: F.conv(F.substr(F.hex(path), i * 2 + 1, F.lit(2)), 16, 10).cast("long"),
    )

    def step(acc: Column, digit: Column) -> Column:
        low = acc["low"] * 31 + digit
        high = acc["high"] * 31 + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(low32).alias("high"), low.bitwiseAND(low32).alias("low"))

    zero = F.struct(F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))
    folded = F.aggregate(digits, zero, step, lambda acc: F.shiftleft(acc["high"], 32).bitwiseOR(acc["low"]))
    return F.when(F.octet_length(path) > 0, folded).when(path.isNotNull(), F.lit(0).cast("long"))


def perspective_warp(images: DataFrame, intensity: float, path: str = "name") -> DataFrame:
    def warp(img, row):
        return K.perspective(img, intensity, K.path_seed(getattr(row, path)) % 4)

    return transform_images(images, warp)


def gaussian_blur(images: DataFrame, radius: float) -> DataFrame:
    return transform_images(images, lambda img, row: K.blur(img, radius))


def gaussian_noise(images: DataFrame, strength: int, path: str = "name") -> DataFrame:
    return transform_images(images, lambda img, row: K.noise(img, strength, K.path_seed(getattr(row, path))))


def convert_format_plan(assets: DataFrame, target: str) -> DataFrame:
    """New name and whether color must be reduced to RGB."""
    plan = skip_same_format(assets, target)
    return plan.withColumn("renamed", F.concat(file_stem(F.col("name")), F.lit(f".{target.lower()}"))).withColumn(
        "force_rgb", F.lit(target.lower() in ("jpg", "jpeg", "bmp"))
    )


def tile_apply(
    images: DataFrame, fn: Callable[[np.ndarray], np.ndarray], scale: int = 1, tile: int = 0, pad: int = 10,
    key: str = "asset_id",
) -> DataFrame:
    """Run a user's function on overlapping tiles and put the valid parts together.

    Tiles are rows, so one large image is worked on by many tasks.  The valid
    part of each tile goes back as one run of pixels per output line; lines,
    then the image, are joined by ordered concatenation in the JVM.
    """
    plan = tiles(F.col("width"), F.col("height"), tile, pad, scale)
    planned = images.select(key, "height", "width", "channels", "data", F.explode_outer(plan).alias("t"))
    planned = planned.select(key, "height", "width", "channels", "data", "t.*")
    cut = transform_images(
        planned, lambda img, r: K.crop(img, r.in_x0, r.in_y0, r.in_x1 - r.in_x0, r.in_y1 - r.in_y0)
    )
    spread = cut.repartition(F.col(key), F.col("tile_y"), F.col("tile_x"))
    kind = images.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in (key, "channels", "tile_x", "out_x1", "y", "run")}
            for r in batch.itertuples(index=False):
                done = fn(K.to_array(r.data, r.height, r.width, r.channels))
                part = K.crop(done, r.crop_x0, r.crop_y0, r.crop_x1 - r.crop_x0, r.crop_y1 - r.crop_y0)
                for y, line in enumerate(part):
                    row = (getattr(r, key), part.shape[2], r.tile_x, r.out_x1, r.out_y0 + y, line.tobytes())
                    for column, value in zip(out.values(), row):
                        column.append(value)
            yield pd.DataFrame(out)

    runs = spread.mapInPandas(work, f"{key} {kind}, channels int, tile_x long, out_x1 long, y long, run binary")
    rows = runs.groupBy(key, "y").agg(
        F.max("out_x1").alias("width"), F.max("channels").alias("channels"),
        F.array_sort(F.collect_list(F.struct("tile_x", F.hex("run").alias("h")))).alias("runs"),
    )
    rows = rows.withColumn("hex", F.array_join(F.transform("runs", lambda s: s["h"]), ""))
    return (
        rows.groupBy(key)
        .agg(
            F.count("*").cast("int").alias("height"), F.max("width").cast("int").alias("width"),
            F.max("channels").cast("int").alias("channels"), F.array_sort(F.collect_list(F.struct("y", "hex"))).alias("rows"),
        )
        .select(key, "height", "width", "channels", F.unhex(F.array_join(F.transform("rows", lambda s: s["hex"]), "")).alias("data"))
    )


def tta_average(images: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Mean of a user's function over eight orientations of each image."""

    def run(img, row):
        views = [K.undo_view(i, np.asarray(fn(v), dtype=np.float64)) for i, v in enumerate(K.eight_views(img))]
        return np.clip(np.floor(np.mean(views, axis=0) + 0.5), 0, 255).astype(np.uint8)

    return transform_images(images, run)


def encode_images(images: DataFrame, fmt: str = "png") -> DataFrame:
    """Add ``content``: the image as a PNG or BMP file."""
    encode = {"png": K.encode_png, "bmp": K.encode_bmp}[fmt]

    @F.pandas_udf("binary")
    def run(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([encode(K.to_array(*row)) for row in zip(data, height, width, channels)])

    return images.withColumn("content", run(*[F.col(p) for p in PARTS]))

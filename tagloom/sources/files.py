"""Folders of images and sidecars as relations."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tagloom.functions import tags as T
from tagloom.operators.documents import parse_tag_docs
from tagloom.operators.ranking import file_extension, file_stem

# fixed values: extensions of image files
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp", "tiff", "tif", "gif")


def list_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """``(path, length, modified)`` of a folder's files; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def with_name(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).withColumn("ext", file_extension(F.col("name"))).withColumn(
        "stem", F.concat(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), file_stem(F.col("name")))
    )


def asset_rows(files: DataFrame, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Image files of a listing: path, stem, name, ext, size."""
    named = with_name(files)
    return named.where(F.col("ext").isin(*extensions)).select(
        "path", "stem", "name", "ext", F.col("length").alias("size_bytes")
    )


def scan_assets(
    spark: SparkSession, path: str, extensions: Sequence[str] = IMAGE_EXTENSIONS, recursive: bool = False
) -> DataFrame:
    return asset_rows(list_files(spark, path, recursive), extensions)


def read_contents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(path, content)`` as bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "content")


def read_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(path, name, stem, kind, content)`` of whole text files matching a glob.

    Read as bytes, so that names come unescaped; a file that is not UTF-8 has null
    content.  Spark lists no file of zero bytes: to a join it is a missing one.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = with_name(found.select("path", text.alias("content")))
    return rows.select("path", "name", "stem", F.col("ext").alias("kind"), "content")


# -- sidecars -------------------------------------------------------------------


def join_sidecars(assets: DataFrame, sidecars: DataFrame, kind: str) -> DataFrame:
    """Every asset with the content of its sidecar, or null."""
    side = sidecars.where(F.col("kind") == kind).select("stem", "content")
    return assets.join(side, "stem", "left")


def load_tags(assets: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Assets with their tag lists; no file, no tags."""
    joined = join_sidecars(assets, sidecars, "txt")
    return joined.withColumn("tags", T.split_tags(F.coalesce("content", F.lit("")))).drop("content")


def load_captions(assets: DataFrame, sidecars: DataFrame) -> DataFrame:
    joined = join_sidecars(assets, sidecars, "txt")
    return joined.withColumn("caption", F.coalesce("content", F.lit(""))).drop("content")


def load_tag_docs(assets: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Assets with ``doc``, ``format`` and ``has_json``."""
    return parse_tag_docs(join_sidecars(assets, sidecars, "json")).drop("content")


def load_tag_files(sidecars: DataFrame) -> DataFrame:
    """Text files of a sorting job; those without a tag are marked ``skipped``."""
    tags = T.split_tags(F.coalesce("content", F.lit("")))
    return sidecars.where(F.col("kind") == "txt").withColumn("tags", tags).withColumn(
        "status", F.when(F.size("tags") > 0, "ready").otherwise("skipped")
    )


# -- image headers ----------------------------------------------------------------


def _number(content: Column, start: int, width: int, little: bool) -> Column:
    order = range(width - 1, -1, -1) if little else range(width)
    digits = F.concat(*[F.hex(F.substring(content, start + i, 1)) for i in order])
    return F.conv(digits, 16, 10).cast("long")


def _walk(content: bytes) -> tuple[int, int] | None:
    """Sizes from a JPEG, WebP or TIFF header."""
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            if content[at] != 0xFF:
                return None
            mark = content[at + 1]
            if mark == 0xFF or 0xD0 <= mark <= 0xD8:
                at += 1 if mark == 0xFF else 2
                continue
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
        return None
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP" and len(content) >= 30:
        kind = content[12:16]
        if kind == b"VP8X":
            return tuple(int.from_bytes(content[i : i + 3], "little") + 1 for i in (24, 27))
        if kind == b"VP8L":
            bits = int.from_bytes(content[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8 ":
            return tuple(int.from_bytes(content[i : i + 2], "little") & 0x3FFF for i in (26, 28))
        return None
    if content[:4] in (b"II*\0", b"MM\0*"):
        order = "little" if content[:2] == b"II" else "big"
        at = int.from_bytes(content[4:8], order)
        found = {}
        for i in range(int.from_bytes(content[at : at + 2], order)):
            entry = content[at + 2 + 12 * i : at + 14 + 12 * i]
            width = 2 if int.from_bytes(entry[2:4], order) == 3 else 4
            found[int.from_bytes(entry[:2], order)] = int.from_bytes(entry[8 : 8 + width], order)
        return (found[256], found[257]) if 256 in found and 257 in found else None
    return None


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def _walked(content: pd.Series) -> pd.DataFrame:
    sizes = [(_walk(c) if c is not None else None) or (None, None) for c in content]
    return pd.DataFrame(sizes, columns=["width", "height"])


def probe_dimensions(files: DataFrame) -> DataFrame:
    """Add ``width, height, error`` from the header in ``content``.

    PNG, GIF and BMP are read by byte expressions; only the other formats go to
    a Python worker.  An unreadable header gives 0 x 0 and an error.
    """
    c = F.col("content")
    head = F.hex(F.substring(c, 1, 8))
    png, gif, bmp = head == "89504E470D0A1A0A", head.startswith("474946"), head.startswith("424D")
    known = png | gif | bmp
    walked = _walked(F.when(~known, c))
    return (
        files.withColumn("_w", walked)
        .withColumn("width", F.when(png, _number(c, 17, 4, False)).when(gif, _number(c, 7, 2, True))
                    .when(bmp, _number(c, 19, 4, True)).otherwise(F.col("_w.width")))
        .withColumn("height", F.when(png, _number(c, 21, 4, False)).when(gif, _number(c, 9, 2, True))
                    .when(bmp, F.abs(_number(c, 23, 4, True).cast("int")).cast("long")).otherwise(F.col("_w.height")))
        .withColumn("error", F.when(F.col("width").isNull() | F.col("height").isNull(), "unreadable header"))
        .withColumn("width", F.coalesce("width", F.lit(0).cast("long")))
        .withColumn("height", F.coalesce("height", F.lit(0).cast("long")))
        .drop("_w")
    )


def decode_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels by Spark's image source; broken files keep a row with an error."""
    rows = spark.read.format("image").option("dropInvalid", "false").load(path)
    bad = F.col("image.nChannels") < 1
    return rows.select(
        F.col("image.origin").alias("path"), F.element_at(F.split("image.origin", "/"), -1).alias("name"),
        "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data",
        F.when(bad, "cannot decode").alias("error"),
    )

"""Dictionaries, vocabularies and translation caches: text formats and snapshots."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.tags import strip
from tagloom.operators.ranking import number_rows
from tagloom.session import materialize

# fixed values: category numbers of a label vocabulary
LABEL_CATEGORIES = {
    0: "general", 1: "artist", 3: "copyright", 4: "character", 5: "meta", 6: "quality", 7: "model", 9: "rating",
}
# fixed values: languages of translations; start and mark of a dictionary file's name
LANGUAGES = ("zh-CN", "ja", "ko")
SNAPSHOT_PREFIX, SNAPSHOT_MARK = "danbooru_", "_pt20"
CSV_FIELD = r'(?:[^,"]|"[^"]*")*'


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line, cut at commas outside quotes; quotes still on."""
    return F.regexp_extract_all(line, F.lit(rf"(?:^|,)({CSV_FIELD})"), 1)


def unquote(field: Column) -> Column:
    """Doubled quotes become one, single ones go."""
    marked = F.replace(field, F.lit('""'), F.lit("\u0001"))
    return F.replace(F.replace(marked, F.lit('"'), F.lit("")), F.lit("\u0001"), F.lit('"'))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, file_line, line)`` of text files, numbered in the order of their paths.

    ``line_no`` counts over all files, ``file_line`` within one; both begin at 0.  Spark
    reads large files first and in pieces, so the order comes from path, piece and place.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"),
        F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\r$", "").alias("line"),
    )
    rows = materialize(number_rows(materialize(lines), [F.col("file"), F.col("piece"), F.col("place")], "line_no"))
    starts = rows.groupBy("file").agg(F.min("line_no").alias("start"))
    return rows.join(starts, "file").select("file", "line_no", (F.col("line_no") - F.col("start")).alias("file_line"), "line")


def with_files(lines: DataFrame) -> DataFrame:
    """Plain numbered lines count as those of one file."""
    if "file_line" in lines.columns:
        return lines
    return lines.withColumns({"file": F.lit(""), "file_line": F.col("line_no")})


def load_tag_dict(lines: DataFrame) -> DataFrame:
    """Dictionary from headerless ``name,category,post_count,aliases`` lines.

    Bad numbers count as zero, lines without a name are dropped, and the last
    line of a name wins, kept by an aggregation that shrinks before its shuffle.
    """
    f = csv_fields(strip(F.col("line")))
    plain = F.transform(f, lambda x: F.replace(x, F.lit('"'), F.lit("")))
    rows = lines.select("line_no", plain.alias("f")).select(
        "line_no",
        F.get("f", F.lit(0)).alias("name"),
        F.coalesce(F.get("f", F.lit(1)).try_cast("int"), F.lit(0)).alias("category"),
        F.coalesce(F.get("f", F.lit(2)).try_cast("long"), F.lit(0)).alias("post_count"),
        F.coalesce(F.get("f", F.lit(3)), F.lit("")).alias("aliases"),
    )
    last = F.max_by(F.struct("category", "post_count", "aliases"), "line_no").alias("v")
    return rows.where(F.col("name") != "").groupBy("name").agg(last).select("name", "v.*")


def load_label_vocab(lines: DataFrame) -> DataFrame:
    """Vocabulary from ``id,name,category`` lines; line 0 of each file is its header.

    ``idx`` follows line order; unknown category numbers mean ``general``.
    """
    f = F.transform(csv_fields(F.col("line")), unquote)
    names = F.create_map(*[F.lit(x) for pair in LABEL_CATEGORIES.items() for x in pair])
    rows = with_files(lines).where("file_line > 0").select("line_no", f.alias("f")).where(F.size("f") >= 3)
    number = F.get("f", F.lit(2)).try_cast("int")
    rows = rows.select(
        "line_no", F.get("f", F.lit(1)).alias("name"),
        F.coalesce(F.try_element_at(names, number), F.lit("general")).alias("category"),
    )
    return number_rows(rows, [F.col("line_no")], "idx").select(F.col("idx").cast("int").alias("idx"), "name", "category")


def load_label_vocab_json(text: DataFrame) -> DataFrame:
    """Vocabulary from ``{"0": {"tag":..., "category":...}}`` in a ``content`` column."""
    parsed = F.from_json("content", "map<string,struct<tag:string,category:string>>")
    rows = text.select(F.explode(parsed).alias("i", "v"))
    return rows.select(
        F.col("i").cast("int").alias("idx"), F.coalesce("v.tag", F.lit("")).alias("name"),
        F.lower(F.coalesce("v.category", F.lit("General"))).alias("category"),
    )


def vocab_categories(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select(F.lower("category").alias("category")).distinct()


def latest_snapshot(files: DataFrame, prefix: str = SNAPSHOT_PREFIX, mark: str = SNAPSHOT_MARK) -> DataFrame:
    """Newest dictionary file of a listing, by name."""
    name = F.col("name")
    fits = name.startswith(prefix) & name.contains(mark) & name.endswith(".csv")
    return files.where(fits).agg(F.max("name").alias("name"))


# -- translation CSV ------------------------------------------------------------


def check_header(lines: DataFrame) -> DataFrame:
    """Per file whether line 0 reads ``tag,translated,lang``, case, spaces and a BOM aside."""
    first = F.lower(F.replace(F.regexp_replace("line", "^﻿", ""), F.lit(" "), F.lit("")))
    return with_files(lines).where("file_line = 0").select((first == "tag,translated,lang").alias("header_ok"), "file")


def import_translations(lines: DataFrame) -> DataFrame:
    """Every non-blank line after the header, judged: ``reason`` is null if accepted.

    No line of a file with another header, or none, is accepted.
    """
    f = F.transform(csv_fields(strip(F.col("line"))), unquote)
    named = with_files(lines)
    rows = named.where((F.col("file_line") > 0) & (strip(F.col("line")) != "")).select("file", "line_no", f.alias("f"))
    rows = rows.join(check_header(named), "file", "left")
    rows = rows.select(
        "line_no", F.size("f").alias("columns"), F.coalesce("header_ok", F.lit(False)).alias("header_ok"),
        *[strip(F.get("f", F.lit(i))).alias(n) for i, n in enumerate(("tag", "translated", "lang"))],
    )
    reason = (
        F.when(~F.col("header_ok"), "wrong header").when(F.col("columns") < 3, "too few columns")
        .when((F.col("tag") == "") | (F.col("translated") == ""), "empty field")
        .when(~F.col("lang").isin(*LANGUAGES), "unknown language")
    )
    return rows.withColumn("reason", reason).drop("header_ok")


def import_summary(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason", F.lit("imported")).alias("outcome")).agg(F.count("*").alias("n"))


def csv_line(*fields: Column) -> Column:
    """One CSV line, quoting only where needed, quotes doubled."""

    def quoted(c: Column) -> Column:
        needs = c.rlike('[,"\n]')
        return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return F.concat_ws(",", *[quoted(f) for f in fields])


def export_translations(translations: DataFrame) -> DataFrame:
    """``(lang, tag, line)`` to be written in order of language and tag."""
    return translations.select("lang", "tag", csv_line(F.col("tag"), F.col("translated"), F.col("lang")).alias("line"))


def write_translations(translations: DataFrame, path: str, files: int | None = None) -> None:
    """CSV files whose name order is the row order; each starts with BOM and header."""
    rows = export_translations(translations)
    ranged = rows.repartitionByRange(files, "lang", "tag") if files else rows.repartitionByRange("lang", "tag")
    body = ranged.sortWithinPartitions("lang", "tag")
    header = "﻿tag,translated,lang"

    def with_header(batches):
        opened = False
        for batch in batches:
            if not opened and len(batch):
                yield pd.DataFrame({"line": [header]})
                opened = True
            yield batch

    body.select("line").mapInPandas(with_header, "line string").write.mode("overwrite").text(path)


# -- snapshots ------------------------------------------------------------------


def write_snapshot(df: DataFrame, root: str, name: str) -> str:
    """Write a new version next to the old ones, then enter it in the log.

    A version in use is never replaced, and one that was not finished is not in
    the log.
    """
    path = f"{root.rstrip('/')}/version={name}"
    df.write.mode("errorifexists").parquet(path)
    entry = df.sparkSession.range(1).select(F.lit(name).alias("version"), F.lit(time.time_ns()).alias("written"))
    entry.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/log")
    return path


def current_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The version that was logged last, whatever its name."""
    newest = spark.read.parquet(f"{root.rstrip('/')}/log").agg(F.max_by("version", "written")).first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/version={newest}")


def replace_dict(dictionary: DataFrame, root: str, name: str) -> str:
    """Full replacement of the dictionary, sorted so that searches skip row groups."""
    return write_snapshot(dictionary.sort(F.col("post_count").desc(), "name"), root, name)

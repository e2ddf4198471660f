"""Global numbering, renaming, paging and dictionary search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import materialize, spread

SAMPLES_PER_RANGE = 32
#: Longest query that is looked up as a piece of text.
WHOLE = 4


def _literal(value) -> Column:
    if hasattr(value, "__fields__"):
        return F.struct(*[_literal(value[f]).alias(f) for f in value.__fields__])
    return F.lit(value)


def _split_tree(key: Column, bounds: list, lo: int, hi: int) -> Column:
    """Which range ``key`` falls in, as nested comparisons of logarithmic depth."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key < _literal(bounds[mid]), _split_tree(key, bounds, lo, mid)).otherwise(
        _split_tree(key, bounds, mid + 1, hi)
    )


def number_rows(df: DataFrame, keys: Sequence[Column], name: str = "position") -> DataFrame:
    """Number all rows from 0 in the order of ``keys`` without a global window.

    ``keys`` must identify rows.  A hash-ordered sample of 32 keys per shuffle
    partition gives split points (one small job); rows are counted and numbered per range,
    and each range starts where the ones before it end.  Only the balance of
    the ranges depends on the sample, never the result.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    sample = keyed.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(SAMPLES_PER_RANGE * parts)
    found = sorted((tuple(r[0]), r[0]) for r in sample.collect())
    cuts = sorted({round(i * len(found) / parts) for i in range(1, parts)} - {0, len(found)})
    bounds = [found[i][1] for i in cuts]
    ranged = keyed.withColumn("_range", _split_tree(F.col("_key"), bounds, 0, len(bounds)))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per shuffle partition reaches this window
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_range")
        .withColumn(name, (F.col("_start") + F.col("_inside") - 1).cast("long"))
        .drop("_key", "_range", "_inside", "_start")
    )


def rank_in_group(df: DataFrame, group: Sequence[str], keys: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number rows from 0 within each group, however large a group is.

    Rows are numbered globally and the first number of their group is taken off,
    so a group that holds most rows is still sorted by many tasks.
    """
    numbered = number_rows(df, [F.col(g) for g in group] + list(keys), "_at")
    first = numbered.groupBy(*group).agg(F.min("_at").alias("_first"))
    return numbered.join(first, list(group)).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first")


def file_stem(name: Column) -> Column:
    """Name without its last extension; a leading dot does not start one."""
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def file_extension(name: Column) -> Column:
    """Lower-cased last extension, or the empty string."""
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def padded(number: Column, digits: int) -> Column:
    """Zero-padded; longer numbers are kept whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit("0"))


def _renamed(numbered: DataFrame, prefix: str, start: int, digits: int) -> DataFrame:
    ext = file_extension(F.col("name"))
    ext = F.when(ext == "", "png").otherwise(ext)
    number = padded(F.col("position") + start, digits)
    return numbered.withColumn("renamed", F.concat(F.lit(prefix), number, F.lit("."), ext))


def rename_plan(assets: DataFrame, prefix: str = "", start: int = 1, digits: int = 4) -> DataFrame:
    """New names numbered in file-name order."""
    return _renamed(number_rows(assets, [F.col("name")]), prefix, start, digits)


def shuffle_plan(assets: DataFrame, seed: int, prefix: str = "", start: int = 1, digits: int = 4) -> DataFrame:
    """As :func:`rename_plan` in a random order that ``seed`` reproduces, here and in other engines: that of MD5 of seed and name."""
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("name"))), F.col("name")]
    return _renamed(number_rows(assets, order), prefix, start, digits)


def chunk_rows(df: DataFrame, keys: Sequence[Column], size: int) -> DataFrame:
    """Number rows in order and cut them into batches of ``size``."""
    numbered = number_rows(df, keys)
    return numbered.withColumn("chunk", F.floor(F.col("position") / size).cast("long"))


def page_rows(df: DataFrame, keys: Sequence[Column], size: int) -> DataFrame:
    """Every row with its page and its place on the page."""
    numbered = number_rows(df, keys)
    return numbered.withColumn("page", F.floor(F.col("position") / size).cast("long")).withColumn(
        "slot", F.col("position") % size
    )


def one_page(df: DataFrame, keys: Sequence[Column], size: int, page: int) -> DataFrame:
    return df.orderBy(*keys).offset(page * size).limit(size)


# -- dictionary search --------------------------------------------------------


def query_key(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def _stage(name: Column, aliases: Column, query: Column) -> Column:
    """1 prefix, 2 contains, 3 an alias contains, null otherwise (ASCII case folded)."""
    n, a = F.lower(name), F.lower(aliases)
    return F.when(n.startswith(query), 1).when(n.contains(query), 2).when(a.contains(query), 3)


def _stage_like(name: Column, aliases: Column, query: str) -> Column:
    """The same with ``_`` and ``%`` in the query acting as wildcards."""
    n, a = F.lower(name), F.lower(aliases)
    q = query.replace("\\", "\\\\")
    return F.when(n.like(f"{q}%"), 1).when(n.like(f"%{q}%"), 2).when(a.like(f"%{q}%"), 3)


def search_tags(dictionary: DataFrame, query: str, limit: int = 10, like_wildcards: bool = False) -> DataFrame:
    """Ranked completion of one query: one filtered scan and a distributed top-k."""
    key = query.lower().replace(" ", "_")
    if not key:
        return dictionary.withColumn("stage", F.lit(None).cast("int")).limit(0)
    columns = (F.col("name"), F.col("aliases"))
    stage = _stage_like(*columns, key) if like_wildcards else _stage(*columns, F.lit(key))
    hits = dictionary.withColumn("stage", stage).where("stage is not null")
    return hits.orderBy("stage", F.col("post_count").desc(), "name").limit(limit)


def _pieces(entries: DataFrame, text: str, widths: Sequence[int]) -> DataFrame:
    """Every piece of a width of column ``text``, first places only, as ``gram`` with its place ``at``."""
    spots = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))
    at = entries.withColumn("at", F.explode_outer(spots)).where("at is not null")
    cut = F.array(*[F.struct(F.lit(w).alias("w"), F.substr(F.col(text), F.col("at"), F.lit(w)).alias("gram")) for w in widths])
    cuts = at.withColumn("_c", F.explode_outer(cut)).where(F.col("at") + F.col("_c.w") - 1 <= F.length(text))
    return cuts.withColumn("gram", F.col("_c.gram")).drop("_c")


def _holding(entries: DataFrame, grams: DataFrame, widths: Sequence[int]) -> DataFrame:
    """``entries`` with each of ``grams`` that they hold, once, with its place in the name (0: in an alias only)."""
    first = F.expr("instr(n, gram) = at")
    named = _pieces(entries, "n", widths).join(grams, "gram", "left_semi").where(first)
    called = _pieces(entries, "a", widths).join(grams, "gram", "left_semi").where(F.expr("instr(a, gram) = at and not contains(n, gram)"))
    return named.unionByName(called.withColumn("at", F.lit(0)))


def _top(hits: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows per key; tasks keep no more before anything is shuffled."""
    order = Window.partitionBy(*by).orderBy("stage", F.col("post_count").desc(), "name")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def search_tags_many(dictionary: DataFrame, queries: DataFrame, limit: int = 10, per_block: int = 4_096) -> DataFrame:
    """Completion of a whole relation of queries ``(query)``.

    A query of at most WHOLE characters is itself a piece of text.  Names that begin with it come first, and an
    entry has one beginning of each width, so most queries are full with those; only for the others
    are the entries cut into all their pieces, and pieces that no such query asks for go no further.  A longer
    query meets the entries that hold its first WHOLE characters, by an equi-join on
    that piece; entries of a piece that many hold are dealt to blocks of ``per_block``,
    the match itself is tested in full, and each block keeps ``limit`` rows per query.
    Entries, queries and the result are stored, so nobody derives them twice.
    """
    wanted = queries.select("query").distinct().withColumn("key", query_key(F.col("query"))).where("key <> ''")
    wanted = materialize(wanted)
    lengths = [r[0] for r in wanted.select(F.least(F.length("key"), F.lit(WHOLE + 1))).distinct().collect()]
    widths = sorted(w for w in lengths if w <= WHOLE)
    out = ["query", "rank", "stage", "name", "post_count"]
    if not lengths:
        return wanted.limit(0).join(dictionary.select("name", "post_count"), F.lit(False)).selectExpr("query", "1 rank", "1 stage", "name", "post_count")
    entries = dictionary.select("name", "post_count", F.lower("name").alias("n"), F.lower(F.coalesce("aliases", F.lit(""))).alias("a"))
    entries = materialize(spread(entries.where("name is not null")))
    found = []
    if widths:
        short = wanted.where(F.length("key") <= WHOLE)
        keys = short.select(F.col("key").alias("gram")).distinct()
        columns = ["gram", "stage", "name", "post_count"]
        begun = F.array(*[F.when(F.length("n") >= w, F.left("n", F.lit(w))) for w in widths])
        starts = entries.withColumn("gram", F.explode_outer(begun)).where("gram is not null").withColumn("stage", F.lit(1))
        starts = materialize(_top(starts.join(keys, "gram", "left_semi").select(*columns), ["gram"], limit).select(*columns))
        full = starts.groupBy("gram").agg(F.count("*").alias("held")).where(F.col("held") >= limit)
        unfilled = materialize(keys.join(full, "gram", "left_anti"))
        rest = _holding(entries, unfilled, widths).where("at <> 1").withColumn("stage", F.when(F.col("at") > 0, 2).otherwise(3))
        best = _top(starts.unionByName(rest.select(*columns)), ["gram"], limit)
        found.append(best.withColumnRenamed("gram", "key").join(short, "key").select(*out))
    if WHOLE + 1 in lengths:
        long = wanted.where(F.length("key") > WHOLE).withColumn("gram", F.left("key", F.lit(WHOLE)))
        pieces = materialize(_holding(entries, long.select("gram").distinct(), [WHOLE]).drop("at"))
        held = pieces.groupBy("gram").count()
        held = materialize(held.select("gram", F.ceil(F.col("count") / per_block).cast("int").alias("blocks")))
        asked = long.join(held, "gram").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        dealt = pieces.join(held, "gram").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
        key = F.col("key")
        stage = F.when(F.startswith("n", key), 1).when(F.contains("n", key), 2).when(F.contains("a", key), 3)
        hits = dealt.join(asked, ["gram", "block"]).withColumn("stage", stage).where("stage is not null")
        found.append(_top(_top(hits, ["query", "block"], limit), ["query"], limit).select(*out))
    return materialize(found[0] if len(found) == 1 else found[0].unionByName(found[1]))

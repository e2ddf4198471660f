"""What the operators of this subpackage share: stored intermediate tables and text folding."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.session import scratch_folder

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read from there.

    Later steps read columns of it as often as they like; a lost executor costs only its running tasks.
    """
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def folded(text: Column) -> Column:
    """Text with A-Z in lower case and everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def bounded_sample(rows: DataFrame, total: int, most: int, id_col: str) -> DataFrame:
    """At most ``most`` rows by a hash of their ids; rows without an id are not drawn.

    ``total`` is the number of rows they come from. A share of ids that gives about twice as many rows as
    are wanted is taken first, so no task meets more than that, however many rows there are.
    """
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    share = min(1.0, 2 * most / max(1, total))
    return rows.where(F.col(id_col).isNotNull() & (place < int(share * (1 << 30)))).orderBy(place, id_col).limit(most)


def power_of_two(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))


#: Keys with more than one in HOT_SHARE of all rows; there can be no more than HOT_SHARE of them.
HOT_SHARE = 4_096


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has each key once and its number of rows in ``size``.

    Keys of many rows reach their rows by a broadcast of at most HOT_SHARE groups, the others by a shuffle
    in which no key has more than that share of the rows.
    """
    hot = F.col(size) * HOT_SHARE > groups.agg(F.sum(size)).scalar()
    by_hot = rows.join(F.broadcast(groups.where(hot)), key, "left")
    by_key = by_hot.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(~hot), key)
    return by_hot.where(F.col(size).isNotNull()).unionByName(by_key)


def in_order(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` stored in the order of ``keys`` (nulls first), numbered from 0 in ``at``.

    Rows are dealt by ranges of all keys, so a group that holds most rows is sorted by many tasks as long as its
    rows differ in a later key. Each range starts where the ones before it end (one count per range). ``rows`` are
    read twice, first for the range bounds.
    """
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    kept = stored(ranged, name)
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("_part")).agg((F.max(inside) + 1).alias("_n"))
    # one row per shuffle partition reaches this window and the broadcast
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return kept.withColumn("_part", part).join(starts, "_part").withColumn("at", F.col("_start") + inside).drop("_at", "_part", "_start")


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null for null."""
    return F.crc32(F.encode(text, "UTF-8"))


def crc32_sql(ascii_text: str) -> str:
    """DuckDB has no CRC-32: an expression over the letters of an ASCII text, eight shifts each."""
    shift = "lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(c, b), [0::BIGINT for i in range(8)]), {shift})"
    letters = f"[ascii(z)::BIGINT for z in string_split({ascii_text}, '')]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda c, b: {byte}), 4294967295)"

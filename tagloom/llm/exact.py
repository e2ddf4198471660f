"""Exact copies by two passes over a Bloom filter; only possibly repeated rows are shuffled.

Texts are equal when they are identical after A-Z have been put in lower case; null counts as empty.
Pass 1 writes one narrow row per document (id, SHA-256 of the folded text) and counts how often each
bit of the filter is set; bits that are set once belong to texts that occur once. Pass 2 tests every narrow
row against the bits that were set repeatedly. A row with a bit that was set once passes straight
through as a group of its own; the rest (all copies and about 2 % of the others) are grouped by digest.
Texts do not take part in this. ``drop_copies`` then tests the documents against a second filter, of the
rows that have to go: what it does not hold passes straight through, only what it may hold meets the list of
those rows by key.

One plan serves every size. A filter has 16 bits per row up to MAX_BITS, which bounds its broadcast; with more
rows than that allows more of them look repeated and are shuffled (narrow ones in the first filter, documents in
the second), and results stay the same.

Defined results: of equal texts the largest id stays, a null id counting as the smallest; repeated rows
(same id, same text) are copies of each other, exactly one stays; empty and very long texts are compared whole
by their digest; an empty table gives an empty result; columns other than the two named ones are not looked at,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import folded, join_groups, power_of_two, stored

#: Bits of the filter per document, and hash functions.
BITS_PER_ROW, HASHES = 16, 2
#: A bitmap row holds this many bits (4 KB).
BITMAP = 32_768
#: Bits of a filter at most; it is broadcast (256 MB then).
MAX_BITS = 1 << 31


def _bits(digest: Column, m: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(m)) for k in range(HASHES)]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One stored row per document: doc_id, sha (of the folded text), and a row number that stays."""
    return stored(
        docs.select(
            F.col(id_col).alias("doc_id"), F.sha2(folded(F.col(text_col)), 256).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ), "digests",
    )


def repeated_bits(rows: DataFrame, m: int) -> DataFrame:
    """(slot, bitmap) of the filter bits that more than one row has set."""
    twice = rows.select(F.explode(F.array_distinct(F.array(*_bits(F.col("sha"), m)))).alias("bit")).groupBy("bit").count()
    return twice.where("count > 1").groupBy(F.shiftright("bit", 15).alias("slot")).agg(
        F.bitmap_construct_agg(F.col("bit").bitwiseAND(BITMAP - 1)).alias("bitmap")
    )


def filter_size(rows: int) -> int:
    return min(MAX_BITS, power_of_two(BITS_PER_ROW * max(rows, BITMAP // BITS_PER_ROW)))


def filter_bits(rows: DataFrame) -> tuple[DataFrame, int]:
    """Stored bitmaps of the repeated bits over all ``rows``, and the number of bits of the filter."""
    m = filter_size(rows.count())
    return stored(repeated_bits(rows, m), "bitmaps"), m


def with_maybe(rows: DataFrame, bitmaps: DataFrame, m: int, key: str = "sha") -> DataFrame:
    """``rows`` and ``maybe``: whether the filter holds every bit of ``key``."""
    names, maybe = rows.columns, F.lit(True)
    for k, bit in enumerate(_bits(F.col(key), m)):
        side = F.broadcast(bitmaps.select(F.col("slot").alias(f"slot{k}"), F.col("bitmap").alias(f"bitmap{k}")))
        rows = rows.withColumn(f"bit{k}", bit).withColumn(f"slot{k}", F.shiftright(f"bit{k}", 15)).join(side, f"slot{k}", "left")
        place = F.col(f"bit{k}").bitwiseAND(BITMAP - 1)
        byte = F.conv(F.hex(F.substring(F.col(f"bitmap{k}"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        maybe = maybe & F.coalesce(F.getbit(byte, F.col(f"bit{k}").bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return rows.select(*names, maybe.alias("maybe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = digests(docs, id_col, text_col)
    rows = stored(with_maybe(narrow, *filter_bits(narrow)), "tested")
    alone = rows.where("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    maybe = rows.where("maybe").drop("maybe")
    groups = stored(
        maybe.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")), "groups"
    )
    return alone.unionByName(join_groups(maybe, groups, "sha", "group_size").select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    ))


def _row_key(sha: Column, doc_id: Column) -> Column:
    """Names the rows of one text and one id."""
    return F.concat(sha, F.coalesce(F.concat(F.lit(":"), doc_id.cast("string")), F.lit("")))


def listed_rows(narrow: DataFrame) -> DataFrame:
    """Stored (key, top): rows of copies that do not simply stay.

    ``top`` is false for those that go, and true for the largest id of a text where several rows hold both.
    """
    maybe = with_maybe(narrow, *filter_bits(narrow)).where("maybe")
    ids = stored(maybe.groupBy("sha", "doc_id").agg(F.count("*").alias("n")), "copy_ids")
    tops = stored(
        ids.groupBy("sha").agg(F.max("doc_id").alias("top_id"), F.sum("n").alias("n_rows"), F.count("*").alias("n_ids")).where("n_rows > 1"), "tops"
    )
    joined = join_groups(ids, tops, "sha", "n_ids").withColumn("top", F.col("doc_id").eqNullSafe(F.col("top_id")))
    return stored(joined.where("NOT top OR n > 1").select(_row_key(F.col("sha"), F.col("doc_id")).alias("key"), "top"), "listed")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest id."""
    listed = listed_rows(digests(docs, id_col, text_col))
    m = filter_size(listed.count())
    set_bits = listed.select(F.explode(F.array(*_bits(F.col("key"), m))).alias("bit")).groupBy(F.shiftright("bit", 15).alias("slot"))
    bitmaps = stored(set_bits.agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(BITMAP - 1)).alias("bitmap")), "listed_bitmaps")
    key = _row_key(F.sha2(folded(docs[text_col]), 256), docs[id_col])
    rows = with_maybe(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), key.alias("key")), bitmaps, m, "key")
    perhaps = rows.where("maybe")
    stay = rows.where("NOT maybe").select("doc").unionByName(perhaps.join(listed, "key", "left_anti").select("doc"))
    # rows that repeat an id with its text are combined before their shuffle
    once = perhaps.dropDuplicates(["key"]).join(listed.where("top"), "key", "left_semi")
    return stay.unionByName(once.select("doc")).select(*[F.col("doc")[c].alias(c) for c in docs.columns])

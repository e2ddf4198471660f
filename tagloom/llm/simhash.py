"""Near copies by SimHash: a byte-position inverted index with count filtering over 64-bit fingerprints.

A fingerprint is taken from the XXH64 values (seed 42) of the word shingles of the folded text, repeats
included: a bit is one if more than half of the values have it. Two fingerprints are linked at DISTANCE or
fewer different bits, so at least 8 - DISTANCE = 5 of their 8 bytes are equal, each at its own place.

The index posts every different fingerprint under sets of byte positions with their bytes. The sets are the
fourteen 4-subsets of the positions 0..7 whose numbers cancel under exclusive or: any three positions lie in
exactly one such set, whose complement is another, so two fingerprints that differ in three bytes meet
under exactly one key, in two bytes under three, in one byte under seven. Fingerprints that meet share four
positional bytes; the tally of all shared bytes must reach five (count filter), then bits are counted.

Keys that hold one fingerprint are dropped by a count. The others are cut into blocks of about BLOCK
fingerprints by a hash, however many a key holds, and blocks of the same key are compared pairwise in
tasks; a comparison returns a spanning forest of its links, never all pairs. Equal fingerprints are one
node; components are found over nodes.

Defined results: null and empty texts and texts of blanks have the fingerprint zero and are linked like any
other; fewer words than a shingle make one shingle; repeated rows each get a row; the component of documents
whose ids are all null is null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.bpe import slices
from tagloom.llm.common import join_groups, stored
from tagloom.llm.graph import components

SHINGLE, SEED, DISTANCE, BLOCK = 3, 42, 3, 512
#: Sets of byte positions of which any two fingerprints with three or fewer different bytes share one.
POSITIONS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
MIN_EQUAL_BYTES = 8 - DISTANCE


def words_of(text: str) -> list[bytes]:
    """Words of the folded text: bytes.lower and bytes.split know just A-Z and the six blanks."""
    return text.encode().lower().split()


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 100_000):
        values = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 100_000], ends[at : at + 100_000], strict=True)]
        bits = np.unpackbits(np.array(values, dtype="<u8").view(np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id and fp (the fingerprint as a signed long)."""
    kind = docs.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            prints = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow_kind), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind.simpleString()}, fp bigint")


def near(x: np.ndarray, y: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which of ``x`` and ``y`` are linked: equal bytes tallied first, bits where the tally suffices."""
    apart = x[:, None] ^ y[None, :]
    equal = np.zeros(apart.shape, dtype=np.uint8)
    for k in range(8):
        equal += (apart >> np.uint64(8 * k)) & np.uint64(255) == 0
    linked = equal >= 8 - distance
    linked[linked] = np.bitwise_count(apart[linked]) <= distance
    return linked


def forest(x: np.ndarray, y: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected inside ``x``, or between ``x`` and ``y``: at most one per fingerprint."""
    nodes = x if y is None else np.concatenate([x, y])
    linked = near(x, x if y is None else y)
    if y is not None:
        square = np.zeros((len(nodes), len(nodes)), dtype=bool)
        square[: len(x), len(x) :], square[len(x) :, : len(x)] = linked, linked.T
        linked = square
    links, left = [], np.ones(len(nodes), dtype=bool)
    for first in np.flatnonzero(linked.sum(axis=1) > (y is None)).tolist():
        if not left[first]:
            continue
        left[first], front = False, [first]
        while front:
            node = front.pop()
            found = np.flatnonzero(linked[node] & left).tolist()
            left[found] = False
            links += [(node, other) for other in found]
            front += found
    signed = nodes.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in links]


def pair_links(values: list[int]) -> list[tuple[int, int]]:
    """Links among a few fingerprints."""
    found = []
    for a, b in combinations(values, 2):
        apart = (a ^ b) & 0xFFFFFFFFFFFFFFFF
        if sum(not byte for byte in apart.to_bytes(8, "little")) >= MIN_EQUAL_BYTES and apart.bit_count() <= DISTANCE:
            found.append((a, b))
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rights = batch.column(1) if batch.num_columns > 1 else [None] * batch.num_rows
        links: list[tuple[int, int]] = []
        for left, right in zip(batch.column(0), rights, strict=True):
            x = left.as_py()
            if right is not None:
                links += forest(np.array(x, dtype=np.int64).view(np.uint64), np.array(right.as_py(), dtype=np.int64).view(np.uint64))
            elif len(x) <= 6:
                links += pair_links(x)
            else:
                links += forest(np.array(x, dtype=np.int64).view(np.uint64))
        a, b = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all fingerprints (column fp, each once) within DISTANCE bits."""
    keys = F.array(*[
        F.concat(*[F.substring("bytes", p + 1, 1) for p in s], F.unhex(F.lit(f"{k:02x}"))) for k, s in enumerate(POSITIONS)
    ])
    posted = nodes.withColumn("bytes", F.unhex(F.lpad(F.hex("fp"), 16, "0"))).select("fp", F.explode(keys).alias("key"))
    posted = posted.select("fp", F.conv(F.hex("key"), 16, 10).cast("long").alias("key"))
    shared = posted.groupBy("key").count().where("count > 1")
    dealt = posted.join(shared, "key").withColumn("n_blocks", F.ceil(F.col("count") / block).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int")
    )
    blocks = stored(dealt.groupBy("key", "block", "n_blocks").agg(F.collect_list("fp").alias("fps")), "blocks")
    inside = blocks.where("size(fps) > 1").select("fps").mapInArrow(_links, "a bigint, b bigint")
    many = blocks.where("n_blocks > 1")
    left = many.select("key", F.col("block").alias("i"), F.col("fps").alias("x"), F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("j"))
    right = many.select("key", F.col("block").alias("j"), F.col("fps").alias("y"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
    across = left.where("i < j").join(right.where("i < j"), ["key", "i", "j"]).select("x", "y").mapInArrow(_links, "a bigint, b bigint")
    return inside.unionByName(across).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, fp (signed long), fingerprint (hexadecimal), component_id."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "nodes")
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    named = stored(join_groups(rooted, stored(ids, "components"), "root", "members").select("fp", "copies", "component_id"), "named")
    return join_groups(rows, named, "fp", "copies").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Rows that share an id are one document, of which one row stays; rows without an id all stay.
    """
    return keep_least(docs, groups(docs, id_col, text_col, shingle), id_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with the document of each component whose id is the component's, given (doc_id, component_id)."""
    columns = docs.columns
    found = stored(found.where("doc_id IS NOT NULL"), "members")
    marked = found.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("rows"))
    # only ids to drop or to reduce to one row are looked up
    marked = marked.where("least < doc_id OR rows > 1").select(F.col("doc_id").alias("marked_id"), (F.col("least") < F.col("doc_id")).alias("drop"))
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), docs[id_col].alias("doc_id"))
    rows = rows.join(stored(marked, "marked"), F.col("doc_id") == F.col("marked_id"), "left")
    once = rows.where("NOT drop").dropDuplicates(["doc_id"]).select("doc")
    return rows.where("drop IS NULL").select("doc").unionByName(once).select(*[F.col("doc")[c].alias(c) for c in columns])

"""Best-fit packing of tokenised documents into sequences of bounded length.

Tokenising yields one narrow row per piece. Pieces of full length are sequences of their own; the others are
dealt by a hash of id and piece to shards of about SHARD pieces, and each shard is packed by best fit
decreasing: longest piece first, each into the open sequence with the least room that still takes it. The
open sequences hang on the leaves of a segment tree over remaining capacities, so the tightest one is found
in about log2(capacity) steps. Shards are filled independently, which costs at most one badly filled
sequence per shard, whatever the number of documents; memory of a task is bounded by SHARD.

Defined results: null and empty texts are one piece with the end id alone; repeated rows are packed each;
longer documents than a sequence are cut so that only the first piece may be shorter; equal lengths are
taken by a hash of id and piece; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.bpe import Vocabulary, read_ranks, slices
from tagloom.llm.common import stored

SEQUENCE, SHARD = 2_048, 4_096


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than ``size``."""
    first = n % size or min(n, size)
    return [(0, first)] + [(start, size) for start in range(first, n, size)]


class OpenSequences:
    """A segment tree whose leaf ``c`` counts the open sequences with room for ``c`` more ids."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of a tightest open sequence that takes ``need``, removed; None if there is none."""
        count, at = self.count, need + self.base
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up, until something larger stands beside
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:  # down to its smallest
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.base
        self._change(room, -1)
        return room, self.open[room].pop()

    def _change(self, room: int, by: int) -> None:
        count, at = self.count, room + self.base
        while at:
            count[at] += by
            at >>= 1


def best_fit(lengths: list[int], size: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece; ``lengths`` come longest first."""
    tree, sequences, offsets, used = OpenSequences(size), [], [], 0
    for n in lengths:
        taken = tree.take(n)
        if taken is None:
            room, sequence = size, used
            used += 1
        else:
            room, sequence = taken
        sequences.append(sequence)
        offsets.append(size - room)
        if room > n:
            tree.add(room - n, sequence)
    return sequences, offsets


def pieces(docs: DataFrame, rank_file: str, pattern: str, end_id: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. ``added`` has texts that are tokens of their own."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(rank_file), pattern, added))
    kind = docs.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = vocabulary.value.ready(), end_id.to_bytes(4, "little")
        for keys, texts in slices(batches):
            rows: list[tuple] = []
            for key, ids in zip(keys, words.encode(texts), strict=True):
                packed = memoryview(ids.astype("<u4", copy=False).tobytes() + end)
                rows += [(key, k, start, n, zlib.crc32(packed[4 * start : 4 * (start + n)])) for k, (start, n) in enumerate(cut(len(ids) + 1, size))]
            kinds = (arrow_kind, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(cuts: DataFrame, size: int = SEQUENCE, shard: int = SHARD) -> DataFrame:
    """``cuts`` (columns doc_id, piece, length among others) with sequence_id and offset.

    Numbers of sequences are unique over all shards: full pieces count down from -1, the others are
    shard and number in the shard.
    """
    cuts = stored(cuts, "pieces")
    full = cuts.where(F.col("length") >= size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = cuts.where(F.col("length") < size)
    shards = max(1, -(-rest.count() // shard))
    dealt = rest.withColumn("_tie", F.xxhash64("doc_id", "piece")).withColumn("_shard", F.pmod(F.col("_tie"), F.lit(shards)).cast("int"))

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("_tie", "ascending"), ("doc_id", "ascending")])
        sequences, offsets = best_fit(rows.column("length").to_pylist(), size)
        numbers = np.array(sequences, dtype=np.int64) + (rows.column("_shard")[0].as_py() << 32)
        kept = rows.drop_columns(["_tie", "_shard"])
        return kept.append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema)
    packed = dealt.groupBy("_shard").applyInArrow(fill, f"{schema}, sequence_id bigint, offset bigint")
    return full.unionByName(packed)


def added_tokens(tokenizer_file: str) -> dict[str, int]:
    """Texts with ids of their own in a file of the tokenizers library; those with rules beyond their text are refused."""
    with open(tokenizer_file, encoding="utf-8") as f:
        listed = json.load(f).get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in listed):
        raise ValueError(f"{tokenizer_file}: added tokens look at their surroundings")
    return {t["content"]: t["id"] for t in listed}

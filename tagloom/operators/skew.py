"""Joins in which one key may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a sketch follows, and the most that count as heavy: those with more than one in HEAVY_SHARE of the rows.
TRACKED, HEAVIEST, HEAVY_SHARE = 8_192, 256, 512
#: Rows that any task can hold: no key of so few is heavy.
FEW = 16_384


def heavy_hashes(rows: DataFrame, on: Sequence[str]) -> list[int]:
    """Hashes of the keys with the largest shares of ``rows``, by a frequent-items sketch of bounded size."""
    top = F.expr(f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in on)}), {HEAVIEST}, {TRACKED})")
    found, total = rows.select(top.alias("top"), F.count("*").alias("n")).first()
    return [r["item"] for r in found if r["count"] * HEAVY_SHARE > total] if total > FEW else []


def estimated_bytes(rows: DataFrame) -> int:
    """Catalyst's estimate, from the sizes of files and upper bounds of what is made of them."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(rows: DataFrame) -> int:
    limit = rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(limit)


def never_broadcast(side: DataFrame) -> DataFrame:
    """``side`` for a join by shuffles. Catalyst counts an array column as one element and a packed file as its size, so
    it takes tables of histograms for small ones; the driver would hold them whole, several times."""
    return side.hint("merge")


def join_heavy(rows: DataFrame, side: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` joined (inner or left) with ``side``, which has few rows per key.

    Heavy keys, HEAVIEST at most, stay in their tasks: their rows of ``side`` are broadcast. All others go by their key,
    and none of those has more than one in HEAVY_SHARE of the rows.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left"):
        raise ValueError(f"cannot split a join of kind {how!r}")
    if estimated_bytes(side) <= broadcast_limit(side):  # Catalyst broadcasts it: no row of either kind moves
        return rows.join(side, on, how)
    heavy = heavy_hashes(rows, on)
    if not heavy:
        return rows.join(side, on, how)
    is_heavy = F.xxhash64(*on).isin(heavy)
    hot = rows.where(is_heavy).join(F.broadcast(side.where(is_heavy)), on, how)
    return hot.unionByName(rows.where(~is_heavy).join(side.where(~is_heavy), on, how))


def join_frequent(rows: DataFrame, side: DataFrame, on: str, frequent: DataFrame) -> DataFrame:
    """``rows`` left joined with ``side``, which has few rows per key.

    ``frequent`` lists the keys that most rows have, once each, and is of bounded size: their rows stay in their tasks, those of other
    keys go by key. No pass over ``rows`` looks for heavy keys.
    """
    if estimated_bytes(side) <= broadcast_limit(side):
        return rows.join(side, on, "left")
    known = frequent.select(on).join(side, on, "left").withColumn("_hot", F.lit(True))
    hot = rows.join(F.broadcast(known), on, "left").where("_hot").drop("_hot")
    cold = rows.join(F.broadcast(frequent.select(on)), on, "left_anti")
    return hot.unionByName(cold.join(side, on, "left"))

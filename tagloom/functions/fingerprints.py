"""Comparing perceptual fingerprints, and the bands that find candidates.

Two 64-bit hashes within distance ``t`` differ, in at least one of ``m`` bands,
by at most ``t // m`` bits.  A task that holds two blocks of fingerprints sorts
both by a band's value and looks up, for each way to move that many bits, the
right rows whose value is the moved left one: :func:`near_pairs`.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 64
#: Ways to move the bits of a band, at most; what one costs besides its rows; pairs that are compared at a time.
MOVES, MOVE_COST, MET = 20_000, 20_000, 1 << 17
#: Widest band whose values are looked up in a table.
TABLE_BITS = 22


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def color_similarity(a: Column, b: Column, per_channel_mean: bool = False) -> Column:
    """Bhattacharyya coefficient summed over all bins.

    Each of the three channels sums to one, so equal images score 3.0;
    ``per_channel_mean`` scales that back to 1.0.
    """
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, v: s + v)
    return total / 3.0 if per_channel_mean else total


def match_text(dhash_dist: Column, phash_dist: Column, color: Column) -> Column:
    return F.format_string("dHash:%d pHash:%d color:%.2f", dhash_dist, phash_dist, color)


def pack_dhash(grid: Column) -> Column:
    """Bit ``y*8+x`` is set where a 9-wide, 8-high luma grid falls to the right."""

    def bit(i: Column) -> Column:
        at = F.floor(i / 8) * 9 + i % 8
        falls = F.get(grid, at.cast("int")) > F.get(grid, (at + 1).cast("int"))
        return F.when(falls, F.expr("1L")).otherwise(F.expr("0L"))

    # bit 63 is reached by shifting, never by arithmetic, so nothing overflows
    bits = F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), bit)
    return F.aggregate(bits, F.expr("0L"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


@dataclass(frozen=True)
class Bands:
    """How one hash is cut up for a threshold."""

    column: str
    threshold: int
    count: int
    left: int
    right: int

    @property
    def spans(self) -> list[tuple[int, int]]:
        """``(offset, width)`` of each band."""
        cuts = [round(i * HASH_BITS / self.count) for i in range(self.count + 1)]
        return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]

    @property
    def reach(self) -> int:
        """Bits that some band of two near hashes differs in at most."""
        return self.left + self.right


def band_of(h: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    return (h >> np.uint64(span[0])) & np.uint64((1 << span[1]) - 1)


def _ball(width: int, radius: int) -> list[int]:
    masks = []
    for r in range(radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(width), r)]
    return masks


def choose_bands(rows: int, dhash_threshold: int, phash_threshold: int) -> Bands:
    """The cheaper hash and band count for blocks of ``rows`` fingerprints.

    Cost, as measured: 12 ns for every left row and moved value, 9 ns for every pair expected to meet, for even hashes.
    """
    best = None
    for column, t in (("dhash", dhash_threshold), ("phash", phash_threshold)):
        for m in range(2, 17):
            width, reach = HASH_BITS // m, max(t, 0) // m
            left = (reach + 1) // 2
            right = reach - left
            moves = sum(comb(width, i) for i in range(min(reach, width) + 1))
            if moves * m > MOVES:
                continue
            met = float(rows) * rows * m * moves / 2.0 ** width
            option = (12 * moves * m * (rows + MOVE_COST) + 9 * met, column, t, m, left, right)
            if best is None or option < best:
                best = option
    return Bands(best[1], best[2], best[3], best[4], best[5])


@dataclass
class Side:
    """Fingerprints of one block: ``place`` orders them, a pair is a row of a lower place with one of a higher place."""

    id: np.ndarray
    dhash: np.ndarray
    phash: np.ndarray
    place: np.ndarray

    def take(self, at: np.ndarray) -> Side:
        return Side(self.id[at], self.dhash[at], self.phash[at], self.place[at])

    def __len__(self) -> int:
        return len(self.id)


def _all_met(nl: int, nr: int):
    """All pairs of rows, some at a time, as :func:`_met_by_band` gives them."""
    step = max(1, MET // max(nr, 1))
    for at in range(0, nl, step):
        n = min(step, nl - at)
        yield np.arange(at, at + n), np.full(n, nr), np.tile(np.arange(nr, dtype=np.int32), n)


def _met_by_band(x: np.ndarray, y: np.ndarray, width: int, masks: list[int]):
    """Pairs of rows whose band values differ by one of ``masks``: left rows, how many each meets, and the right rows.

    ``x`` and ``y`` ascend.
    """
    values, starts, counts = np.unique(y, return_index=True, return_counts=True)
    starts, counts = starts.astype(np.int32), counts.astype(np.int32)
    if width <= TABLE_BITS:  # where a value begins, and how often it occurs
        starts, counts = (np.bincount(values.astype(np.int64), t, 1 << width).astype(np.int32) for t in (starts, counts))
    for mask in masks:
        at = x ^ np.uint64(mask)
        if width <= TABLE_BITS:
            n = counts.take(at.view(np.int64))
        else:
            wanted, at = at, np.searchsorted(values, at).clip(0, len(values) - 1).view(np.uint64)
            n = np.where(values[at] == wanted, counts[at], 0)
        rows = np.flatnonzero(n)
        n, start = n[rows], starts.take(at[rows].view(np.int64))
        ends, first = np.cumsum(n, dtype=np.int64), 0
        while first < len(rows):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + MET, side="right")))
            some = n[first:last]
            shift = (start[first:last] - (ends[first:last] - some - before)).astype(np.int32)
            yield rows[first:last], some, np.repeat(shift, some) + np.arange(int(ends[last - 1] - before), dtype=np.int32)
            first = last


def near_pairs(left: Side, right: Side, bands: Bands, band: int, dhash_max: int, phash_max: int):
    """Rows ``(left, right, dhash_dist, phash_dist)`` of the pairs whose first close band is ``band``, in pieces."""
    x, y = getattr(left, bands.column), getattr(right, bands.column)
    span = bands.spans[band]
    masks = _ball(span[1], min(bands.reach, span[1]))
    plain = len(left) * len(right) <= 16 * len(masks) * (len(left) + MOVE_COST)
    by_left, by_right = (np.argsort(band_of(v, span), kind="stable") for v in (x, y))
    x, y = x[by_left], y[by_right]
    met = _all_met(len(x), len(y)) if plain else _met_by_band(band_of(x, span), band_of(y, span), span[1], masks)
    limit = dhash_max if bands.column == "dhash" else phash_max
    for rows, n, j in met:
        apart = np.repeat(x[rows], n) ^ y.take(j)
        hit = np.flatnonzero(np.bitwise_count(apart) <= limit)
        i = rows[np.searchsorted(np.cumsum(n), hit, side="right")]
        apart, i, j = apart[hit], by_left[i], by_right[j[hit]]
        ok = left.place[i] < right.place[j]
        for k in range(band + 1):
            close = np.bitwise_count(band_of(apart, bands.spans[k])) <= bands.reach
            ok &= close if k == band else ~close
        i, j = i[ok], j[ok]
        d, p = np.bitwise_count(left.dhash[i] ^ right.dhash[j]), np.bitwise_count(left.phash[i] ^ right.phash[j])
        ok = (d <= dhash_max) & (p <= phash_max)
        if ok.any():
            yield i[ok], j[ok], d[ok].astype(np.int32), p[ok].astype(np.int32)


def first_pairs(left: Side, right: Side, bands: Bands, band: int, dhash_max: int, phash_max: int):
    """One of those pairs, if there is any, for each row of the right side.

    Left rows come in growing numbers and right rows leave when they are met, so a dense group is not paired with itself.
    """
    order, todo, at, size = np.argsort(left.place, kind="stable"), np.arange(len(right)), 0, 64
    while at < len(order) and len(todo):
        some, rest = order[at : at + size], right.take(todo)
        met = np.zeros(len(todo), dtype=bool)
        for i, j, d, p in near_pairs(left.take(some), rest, bands, band, dhash_max, phash_max):
            j, once = np.unique(j, return_index=True)
            new = ~met[j]
            met[j] = True
            once = once[new]
            yield some[i[once]], todo[j[new]], d[once], p[once]
        todo, at, size = todo[~met], at + size, size * 4

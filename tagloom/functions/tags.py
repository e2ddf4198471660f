"""Tag-list algebra on ``array<string>`` columns.

Everything here is a native higher-order expression: no shuffle, no Python
worker, and the size of the plan does not grow with the number of tags given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def literal_list(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def split_tags(text: Column) -> Column:
    """Comma text to a trimmed list; blanks dropped, duplicates and order kept."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda t: t != "")


def normalize_tags(text: Column) -> Column:
    """As :func:`split_tags`, lower-cased, with underscores shown as spaces."""
    shown = F.transform(F.split(text, ","), lambda t: F.replace(F.lower(strip(t)), F.lit("_"), F.lit(" ")))
    return F.filter(shown, lambda t: t != "")


def join_tags(tags: Column, sep: str = ", ") -> Column:
    return F.array_join(tags, sep)


def _without_index(tags: Column, pos: Column) -> Column:
    """Drop the element at 1-based ``pos``."""
    p = pos.cast("int")
    return F.concat(F.slice(tags, F.lit(1), p - 1), F.slice(tags, p + 1, F.size(tags)))


def add_tags(tags: Column, new: Column, position: str = "end", overwrite: bool = False) -> Column:
    """Add each tag of ``new`` in turn at the start or the end.

    A tag already present is left where it is, or, with ``overwrite``, its first
    occurrence is taken out and it is added again.  Adding at the start puts
    every tag in front of the one before it, so the list arrives reversed.
    """
    if position not in ("start", "end"):
        raise ValueError(f"position must be 'start' or 'end', not {position!r}")

    def put(acc: Column, tag: Column) -> Column:
        return F.concat(F.array(tag), acc) if position == "start" else F.concat(acc, F.array(tag))

    def step(acc: Column, tag: Column) -> Column:
        held = F.array_contains(acc, tag)
        again = put(_without_index(acc, F.array_position(acc, tag)), tag) if overwrite else acc
        return F.when(held, again).otherwise(put(acc, tag))

    return F.aggregate(new, tags, step)


def remove_tags(tags: Column, gone: Column) -> Column:
    """Remove every occurrence of the listed tags; other duplicates stay."""
    return F.filter(tags, lambda t: ~F.array_contains(gone, t))


def replace_tag(tags: Column, old: str, new: str) -> Column:
    """Rename the first occurrence of ``old``; the result may hold duplicates."""
    old, new = old.strip(), new.strip().lower()
    if not old or not new or old == new:
        return tags
    p = F.array_position(tags, old).cast("int")
    swapped = F.concat(F.slice(tags, F.lit(1), p - 1), F.array(F.lit(new)), F.slice(tags, p + 1, F.size(tags)))
    return F.when(p > 0, swapped).otherwise(tags)


def move_tag(tags: Column, src: Column, dst: Column) -> Column:
    """Move the element at 0-based ``src`` to ``dst``; out of range is a no-op."""
    rest = _without_index(tags, src + 1)
    moved = F.concat(
        F.slice(rest, F.lit(1), dst),
        F.slice(tags, src + 1, F.lit(1)),
        F.slice(rest, dst + 1, F.size(tags)),
    )
    ok = (src >= 0) & (dst >= 0) & (src < F.size(tags)) & (dst < F.size(tags)) & (src != dst)
    return F.when(ok, moved).otherwise(tags)


def union_tags(tags: Column, new: Column) -> Column:
    """Append the tags of ``new`` that are missing, in order, each once."""
    return F.concat(tags, F.array_except(new, tags))


def contains_all(tags: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, tags)) == 0


def ordered_union(first: Column, second: Column) -> Column:
    """``first`` as it is, then what ``second`` adds, in order, each once."""
    return F.concat(first, F.filter(F.array_distinct(second), lambda t: ~F.array_contains(first, t)))


def missing_tags(original: Column, revised: Column) -> Column:
    return F.array_sort(F.array_except(original, revised))


def added_tags(original: Column, revised: Column) -> Column:
    return F.array_sort(F.array_except(revised, original))

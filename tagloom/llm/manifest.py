"""A Merkle manifest of a dataset: one hash over all rows, and for each row a proof that it belongs to it.

Method (slot pivot): rows of a group are numbered; of a node at place p the parent is p // 8 and the slot p % 8.
A conditional aggregate per slot spreads the children of a parent into eight columns. Their concatenation is
hashed to the parent, the same columns without a node's own slot are its siblings. Levels are stored one after
another; each has an eighth of the rows of the one below. Downwards, parents hand their path (the siblings left
and right of it, level by level) to their children, so a row meets its proof in one join on (tree, parent), a
key of at most eight rows. Everything is built from DataFrame functions; no group comes together in one task.

A leaf is the SHA-256 (lower-case hex) of the named columns, each ``-`` for null, else its number of UTF-8 bytes,
``:`` and the value. Within a group leaves go up by id; the groups' roots are the leaves of a last tree.

Defined results: nulls are hashed as nulls, a null group is the first tree, a null id stands before all others;
equal ids are ordered by leaf, so repeated rows change places with themselves only; a single row is its tree's
root and a single tree the whole root, with the hash of nothing as proof; texts of any length are hashed whole;
an empty table gives an empty result; columns that are not named are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import folded, in_order, join_groups, stored

FANOUT = 8
#: Columns of ``documents`` in a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def _parents(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, at, n, hash) of trees with more than one node to their parents, with the slots as columns."""
    slots = [F.max(F.when(F.col("at") % FANOUT == k, F.col("hash"))).alias(f"c{k}") for k in range(FANOUT)]
    up = nodes.where("n > 1").groupBy("tree", F.floor(F.col("at") / FANOUT).alias("at"), F.ceil(F.col("n") / FANOUT).alias("n")).agg(*slots)
    return up.withColumn("hash", F.sha2(F.concat_ws("", *[f"c{k}" for k in range(FANOUT)]), 256))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the stored levels above them, up to the last root."""
    levels, largest = [nodes], nodes.agg(F.max("n")).first()[0]
    while largest is not None and largest > 1:
        levels.append(stored(_parents(levels[-1]), "level"))
        largest = -(-largest // FANOUT)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of the single node that each tree ends in."""
    tops = [level.where("n = 1").select("tree", "hash") for level in levels]
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return out


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level with ``path`` and the other columns of ``tops``, which has one row (tree, path, ...) per tree.

    ``path`` lists for each level, from the leaf upwards, what stands left and right of the node's ancestor.
    """
    carried = [c for c in tops.columns if c != "tree"]
    above = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        names = level.columns
        rows = level.where("n = 1").join(tops, "tree").select(*names, *carried)
        if above is not None:
            slots = F.array(*[f"c{i}" for i in range(FANOUT)])
            side = above.select("tree", F.col("at").alias("_up"), slots.alias("_slots"), *[F.col(c).alias(f"_{c}") for c in carried])
            slot = (F.col("at") % FANOUT).cast("int")
            own = F.struct(
                F.concat_ws("", F.slice("_slots", F.lit(1), slot)).alias("left"),
                F.concat_ws("", F.slice("_slots", slot + 2, F.greatest(F.lit(FANOUT - 1) - slot, F.lit(0)))).alias("right"),
            )
            lower = level.where("n > 1").withColumn("_up", F.floor(F.col("at") / FANOUT)).join(side, ["tree", "_up"])
            values = [F.concat(F.array(own), "_path").alias(c) if c == "path" else F.col(f"_{c}").alias(c) for c in carried]
            rows = rows.unionByName(lower.select(*names, *values))
        above = stored(rows, "paths") if k else rows
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def prove(docs: DataFrame, leaf: Column, seen: Column, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """Per row: the id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` is the hash in the manifest, ``seen`` the hash that is found at checking time.
    """
    group = F.col(group_col)
    leaves = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.when(group.isNull(), "-").otherwise(F.concat(F.lit("="), group.cast("string"))).alias("group"),
        leaf.alias("hash"), seen.alias("_seen"),
    ).select("doc_id", "group", "hash", F.nullif("_seen", F.col("hash")).alias("seen"), F.monotonically_increasing_id().alias("row")), "leaves")
    # "-" stands before every "=...", and the rest in the order of its bytes
    numbered = in_order(leaves, ["group", "doc_id", "hash", "row"], "ordered")
    groups = stored(in_order(
        numbered.groupBy("group").agg(F.min("at").alias("start"), F.count("*").alias("n")), ["group"], "groups"
    ).withColumnRenamed("at", "tree"), "trees")
    placed = join_groups(numbered, groups, "group", "n").select("doc_id", "tree", (F.col("at") - F.col("start")).alias("at"), "n", "hash", "seen")
    levels = climb(placed)

    trees = stored(roots(levels), "subroots")
    several = trees.count()
    upper = climb(trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(several).cast("long").alias("n"), "hash"))
    top = roots(upper).select("tree", F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = stored(descend(upper, top).select(F.col("at").alias("tree"), F.col("hash").alias("subroot"), "root", "path"), "tops")

    siblings = F.concat_ws("", F.transform("path", lambda step: F.concat(step["left"], step["right"])))
    rows = descend(levels, tops).select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.coalesce("seen", "hash"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, tampered: Column, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """As :func:`prove`, where rows under ``tampered`` are checked with A-Z of their text in lower case."""
    changed = F.when(F.col(text_col).isNotNull() & tampered, folded(F.col(text_col))).otherwise(F.col(text_col))
    leaf = leaf_hash([F.col(c) for c in columns])
    seen = F.when(tampered, leaf_hash([changed if c == text_col else F.col(c) for c in columns])).otherwise(leaf)
    return prove(docs, leaf, seen, id_col, group_col)

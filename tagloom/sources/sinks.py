"""File actions: a manifest that can be checked first, and one executor for it.

A manifest has ``action`` (copy, move, delete or write), ``src``, ``dst`` and,
for writes, ``content``.  Every action can be repeated safely, so a retried
task does no harm: a copy is renamed into place when whole, and a move or
delete whose source is gone but whose work is done counts as done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import tags as T
from tagloom.operators.filters import changed_rows
from tagloom.operators.ranking import file_stem, rank_in_group
from tagloom.session import materialize


COPY_CHUNK = 8 << 20


LOCAL = pafs.LocalFileSystem()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return LOCAL, "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (LOCAL, path)


def _exists(path: str) -> bool:
    files, inner = _open(path)
    return files.get_file_info(inner).type != pafs.FileType.NotFound


def _put(path: str, pieces: Iterable[bytes]) -> None:
    files, inner = _open(path)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    try:  # the folder is there for all files but the first
        stream = files.open_output_stream(part)
    except FileNotFoundError:
        files.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        stream = files.open_output_stream(part)
    with stream as out:
        for piece in pieces:
            out.write(piece)
    files.move(part, inner)


def _act(action: str, src: str | None, dst: str | None, content: bytes | None) -> None:
    if action == "write":
        _put(dst, [content])
        return
    files, inner = _open(src)
    if action == "delete":
        if _exists(src):
            files.delete_file(inner)
        return
    if action == "move":
        target, to = _open(dst)
        try:
            files.move(inner, to)
        except FileNotFoundError:  # done before, or the first file of its folder
            if not _exists(src) and _exists(dst):
                return
            target.create_dir(to.rsplit("/", 1)[0], recursive=True)
            files.move(inner, to)
        return
    if action == "copy":
        with files.open_input_stream(inner) as stream:
            _put(dst, iter(lambda: stream.read(COPY_CHUNK), b""))
        return
    raise ValueError(f"unknown action {action!r}")


def apply_manifest(manifest: DataFrame, partitions: int | None = None) -> DataFrame:
    """Carry the manifest out; returns ``action, src, dst, ok, error``, already run."""
    rows = manifest
    for name, kind in (("src", "string"), ("dst", "string"), ("content", "binary")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.select("action", "src", "dst", F.col("content").cast("binary").alias("content"))
    rows = rows.repartition(partitions) if partitions else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            problems = []
            for r in batch.itertuples(index=False):
                try:
                    _act(r.action, r.src, r.dst, r.content)
                    problems.append(None)
                except Exception as problem:
                    problems.append(f"{type(problem).__name__}: {problem}")
            out = batch[["action", "src", "dst"]].copy()
            out["ok"] = [p is None for p in problems]
            out["error"] = problems
            yield out

    return materialize(rows.mapInPandas(run, "action string, src string, dst string, ok boolean, error string"))


def tally(results: DataFrame) -> DataFrame:
    return results.groupBy("action").agg(
        F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("fail_count"), F.count("*").alias("total")
    )


def sibling(path: Column, name: Column) -> Column:
    return F.concat(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), name)


def apply_renames(plan: DataFrame, token: str) -> DataFrame:
    """Rename ``path`` to ``renamed`` in its folder, in two phases.

    All files first take a temporary name made of ``token`` and their number, so
    new names may be old names of other files.
    """
    temp = sibling(F.col("path"), F.concat(F.lit(f"__{token}_"), F.col("position").cast("string")))
    steps = materialize(plan.select("path", temp.alias("temp"), sibling(F.col("path"), F.col("renamed")).alias("dst")))
    move = F.lit("move").alias("action")
    first = apply_manifest(steps.select(move, F.col("path").alias("src"), F.col("temp").alias("dst")))
    moved = steps.join(first.where("ok").select(F.col("dst").alias("temp")), "temp")
    second = apply_manifest(moved.select(move, F.col("temp").alias("src"), "dst"))
    return first.where(~F.col("ok")).unionByName(second)


# -- manifests ------------------------------------------------------------------


def _write(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    return rows.select(F.lit("write").alias("action"), path.alias("dst"), content.alias("content"))


def write_tags(edits: DataFrame, before: str = "old_tags", after: str = "tags") -> DataFrame:
    """Writes for the rows whose tags changed."""
    changed = changed_rows(edits, before, after)
    return _write(changed, F.concat("stem", F.lit(".txt")), T.join_tags(F.col(after)))


def write_captions(edits: DataFrame) -> DataFrame:
    return _write(edits, F.concat("stem", F.lit(".txt")), F.col("caption"))


def write_tag_docs(docs: DataFrame, json: Column) -> DataFrame:
    return _write(docs, F.concat("stem", F.lit(".json")), json)


def write_images(encoded: DataFrame, folder: str, fmt: str = "png") -> DataFrame:
    """Writes for images whose ``content`` holds the encoded file."""
    target = F.concat(F.lit(folder.rstrip("/") + "/"), file_stem(F.col("name")), F.lit(f".{fmt}"))
    return _write(encoded, target, F.col("content"))


def copy_matching(matched: DataFrame, action: str, folder: str = "") -> DataFrame:
    """Copy to a folder or delete every row that a filter kept."""
    if action not in ("copy", "delete"):
        raise ValueError(f"unknown action {action!r}")
    target = F.concat(F.lit(folder.rstrip("/") + "/"), "name") if action == "copy" else F.lit(None).cast("string")
    return matched.select(F.lit(action).alias("action"), F.col("path").alias("src"), target.alias("dst"))


def export_clusters(labelled: DataFrame, folder: str) -> DataFrame:
    place = F.when(F.col("label") < 0, "noise").otherwise(F.concat(F.lit("cluster_"), F.col("label").cast("string")))
    target = F.concat_ws("/", F.lit(folder.rstrip("/")), place, F.col("name"))
    return labelled.select(F.lit("copy").alias("action"), F.col("path").alias("src"), target.alias("dst"))


def export_buckets(assigned: DataFrame, summary: DataFrame, folder: str) -> DataFrame:
    """Copies into one folder per bucket.

    A name met again in its bucket gets ``_1``, ``_2``, ... in path order; where
    a file is already called like that, numbering goes on behind it.
    """
    folders = summary.select(
        "bw", "bh", F.format_string("Bucket %d - %dx%d (count %d)", "bucket", "bw", "bh", "total_count").alias("place")
    )
    stem = file_stem(F.col("name"))
    rows = rank_in_group(assigned, ["bw", "bh", "name"], [F.col("path")])
    rows = rows.withColumns({"stem_": stem, "dot_ext": F.substr("name", F.length(stem) + 1)})
    base, number = F.regexp_extract(F.col("stem_"), r"^(.*)_(\d{1,9})$", 1), F.regexp_extract(F.col("stem_"), r"^(.*)_(\d{1,9})$", 2)
    used = (
        rows.select("bw", "bh", base.alias("stem_"), "dot_ext", F.nullif(number, F.lit("")).cast("long").alias("n"))
        .where("n is not null")
        .groupBy("bw", "bh", "stem_", "dot_ext")
        .agg(F.max("n").alias("used"))
    )
    rows = rows.join(used, ["bw", "bh", "stem_", "dot_ext"], "left").join(folders, ["bw", "bh"])
    suffix = F.concat(F.lit("_"), (F.col("rank") + F.coalesce("used", F.lit(0))).cast("string"))
    final = F.when(F.col("rank") == 0, F.col("name")).otherwise(F.concat("stem_", suffix, "dot_ext"))
    return rows.select(
        F.lit("copy").alias("action"), F.col("path").alias("src"),
        F.concat_ws("/", F.lit(folder.rstrip("/")), "place", final).alias("dst"),
    )


def route_outcomes(outcomes: DataFrame, folder: str, errors: str = "_errors", warnings: str = "_warnings") -> DataFrame:
    """Copies of the sources that failed or were warned about."""
    place = F.when(F.col("status") == "error", errors).when(F.size("warnings") > 0, warnings)
    routed = outcomes.withColumn("place", place).where("place is not null")
    target = F.concat_ws("/", F.lit(folder.rstrip("/")), "place", "name")
    return routed.select(F.lit("copy").alias("action"), F.col("path").alias("src"), target.alias("dst"))

"""Merkle manifest against a plain implementation."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tagloom.llm import manifest
from tagloom.llm.common import crc32_of

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, **other):
    values = [other.get(c, row[c]) for c in FIELDS]
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(leaves):
    """Root, and for each leaf its steps (left, right)."""
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, place in enumerate(at):
            run, slot = runs[place // 8], place % 8
            steps[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        at, nodes = [place // 8 for place in at], [digest(r) for r in runs]
    return nodes[0], steps


def plain(rows, is_tampered):
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = []
    for lang in langs:
        group = sorted((r for r in rows if r["lang"] == lang), key=lambda r: ((r["doc_id"] is not None, r["doc_id"] or 0), leaf_of(r)))
        groups.append((group, *climb([leaf_of(r) for r in group])))
    root, upper = climb([g[1] for g in groups]) if groups else (None, [])
    out = []
    for (group, subroot, steps), above in zip(groups, upper, strict=True):
        for r, own in zip(group, steps, strict=True):
            path = own + above
            node = leaf_of(r)
            if is_tampered(r) and r["text"] is not None:
                node = leaf_of(r, text="".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            for left, right in path:
                node = digest([left, node, right])
            out.append((r["doc_id"], leaf_of(r), subroot, root, digest(x for step in path for x in step), node, node == root))
    return out


def tampered(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0


def flag():
    return F.coalesce(crc32_of(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))

key = lambda t: tuple(str(x) for x in t)


def test_equals_plain_implementation(docs):
    got = [tuple(r) for r in manifest.manifest(docs, flag()).collect()]
    assert sorted(got, key=key) == sorted(plain(docs.collect(), tampered), key=key)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_sizes_around_the_fanout(spark, docs, n):
    few = spark.createDataFrame([(i, "s", None, 1, f"Text {i}") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string")
    got = [tuple(r) for r in manifest.manifest(few, flag()).collect()]
    assert sorted(got, key=key) == sorted(plain(few.collect(), tampered), key=key)


def test_many_groups_and_empty_table(spark, empty):
    rows = [(i, "s", f"l{i % 70:02}", 1, "T") for i in range(150)]
    many = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [tuple(r) for r in manifest.manifest(many, flag()).collect()]
    assert sorted(got, key=key) == sorted(plain(many.collect(), tampered), key=key)
    assert manifest.manifest(empty, flag()).collect() == []


def test_one_changed_row_changes_the_root_and_only_its_own_proof_fails(spark):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(30)]
    kinds = "doc_id long, source string, lang string, n_chars long, text string"
    got = manifest.manifest(spark.createDataFrame(rows, kinds), F.col("doc_id") == 7).collect()
    assert [r["doc_id"] for r in got if not r["verified"]] == [7]
    rows[7] = (7, "s", "en", 1, "text 7")
    assert manifest.manifest(spark.createDataFrame(rows, kinds), F.lit(False)).first()["root"] != got[0]["root"]

"""Exact and near copies against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tagloom.llm import exact, simhash
from tagloom.llm.graph import components
from tests.conftest import plan_of
from tests.llm.conftest import SCHEMA, row

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(text):
    return (text or "").translate(LOWER)


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_groups(docs, rows, empty):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[fold(text)].append(doc_id)
    got = exact.exact_groups(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["doc_id"] in ids and r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    assert exact.exact_groups(empty).collect() == []


def test_filter_lets_no_copy_pass(spark):
    frame = spark.createDataFrame([row(k, f"text {k % 3_000}") for k in range(5_000)], SCHEMA)
    narrow = exact.digests(frame)
    tested = exact.with_maybe(narrow, *exact.filter_bits(narrow)).groupBy("maybe").count().collect()
    counts = {r["maybe"]: r["count"] for r in tested}
    assert counts[True] >= 4_000 and counts[False] >= 800  # 1,000 texts occur once, a few of them look repeated


def test_many_ids_of_one_text(spark):
    frame = spark.createDataFrame([row(k, "same" if k % 3 else f"other {k}") for k in range(9_000)], SCHEMA)
    got = exact.exact_groups(frame).where("kept").collect()
    assert len(got) == 3_001 and max(r["group_size"] for r in got) == 6_000


def test_drop_copies(docs, rows, empty):
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(fold(r["text"]) for r in got.collect()) == sorted({fold(r[1]) for r in rows})
    ids = {fold(r["text"]): r["doc_id"] for r in got.collect()}
    assert ids["one"] == 5 and ids[""] == 103
    assert exact.drop_copies(empty).collect() == []


def test_results_do_not_depend_on_the_filter(docs, rows, spark, monkeypatch):
    """A filter far too small for its rows only lets more of them look repeated."""
    many = docs.unionByName(spark.createDataFrame([row(1_000 + k, f"single {k}") for k in range(40_000)], SCHEMA))
    want = sorted(map(str, exact.exact_groups(many).collect()))
    monkeypatch.setattr(exact, "MAX_BITS", exact.BITMAP)
    narrow = exact.digests(many)
    share = exact.with_maybe(narrow, *exact.filter_bits(narrow)).where("maybe").count() / narrow.count()
    assert share > 0.5 and sorted(map(str, exact.exact_groups(many).collect())) == want
    assert sorted(fold(r["text"]) for r in exact.drop_copies(many).collect()) == sorted({fold(r[1]) for r in rows} | {f"single {k}" for k in range(40_000)})


def test_repeated_rows_of_one_id(spark):
    frame = spark.createDataFrame([row(7, "same")] * 3_000 + [row(None, "none")] * 500 + [row(k, "same") for k in range(6)] + [row(8, "other")], SCHEMA)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in exact.drop_copies(frame).collect()) == [(-1, "none"), (7, "same"), (8, "other")]


def test_documents_shuffle_only_if_the_filter_holds_them(docs):
    listed = exact.listed_rows(exact.digests(docs))
    assert "doc" not in listed.columns and "text" not in listed.columns
    docs.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(exact.drop_copies(docs))
    finally:
        docs.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    _, straight, perhaps, once = re.split(r"\n   [:+]- ", plan)
    assert "NOT coalesce((getbit(" in straight and "hashpartitioning" not in straight
    # the other two move what the filter may hold, and the list, once each
    assert perhaps.count("Exchange hashpartitioning") == once.count("Exchange hashpartitioning") == 2
    assert all("coalesce((getbit(" in part and "SortMergeJoin" in part for part in (perhaps, once))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_positions_cover_three_bytes():
    assert len(simhash.POSITIONS) == 14
    for a in range(8):
        for b in range(8):
            for c in range(8):
                assert any(not {a, b, c} & set(s) for s in simhash.POSITIONS)


def test_groups(docs, rows, empty):
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    values = sorted({p for _, p in prints})
    linked = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    root = roots(values, linked)
    least = defaultdict(list)
    for doc_id, p in prints:
        least[root[p]] += [doc_id] if doc_id is not None else []
    want = Counter((doc_id, f"{p:016x}", min(least[root[p]], default=None)) for doc_id, p in prints)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.groups(docs).collect())
    assert got == want
    assert simhash.groups(empty).collect() == []


@pytest.mark.parametrize("block", [512, 3])
def test_links_in_blocks(spark, block):
    rng = random.Random(3)
    values = set()
    for _ in range(12):  # dense groups of near fingerprints, and chains
        centre = rng.getrandbits(64)
        for _ in range(25):
            value = centre
            for _ in range(rng.randint(0, 3)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
        for _ in range(10):
            centre ^= 7 << rng.randrange(61)
            values.add(centre)
    array = np.array(sorted(values), dtype=np.uint64)
    linked = [(int(array[i]), int(b)) for i in range(len(array)) for b in array[i + 1 :][np.bitwise_count(array[i + 1 :] ^ array[i]) <= 3]]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    want = roots([signed(v) for v in values], [(signed(a), signed(b)) for a, b in linked])
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    found = simhash.links(frame, block=block).collect()
    assert all((a ^ b) & ((1 << 64) - 1) and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in found)
    assert roots(list(want), [tuple(r) for r in found]) == want


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(400)] + [(k, k) for k in range(500, 510)] + [(1000, 999), (999, 1000)]
    random.Random(1).shuffle(links)
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(401), 0), 999: 999, 1000: 999}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_keep_one(docs, rows, empty):
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    want = {r["component_id"] for r in simhash.groups(docs).collect() if r["doc_id"] is not None}
    assert sorted(r["doc_id"] for r in got.where("doc_id IS NOT NULL").collect()) == sorted(want)
    assert got.where("doc_id IS NULL").count() == sum(r[0] is None for r in rows)
    assert simhash.keep_one(empty).collect() == []

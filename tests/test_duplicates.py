"""Banded search and grouping against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import fingerprints as P
from tagloom.functions.pixels import signed64
from tagloom.operators import duplicates as D
from tagloom.streaming.ingest import match_leaders

SCHEMA = "name string, dhash bigint, phash bigint, hist array<double>"


def planted(seed, groups=40, copies=4, reach=12):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        d, p = rng.getrandbits(64), rng.getrandbits(63)
        for _ in range(rng.randint(1, copies)):
            dd, pp = d, p
            for _ in range(rng.randint(0, reach)):
                dd ^= 1 << rng.randrange(64)
            for _ in range(rng.randint(0, reach // 2)):
                pp ^= 1 << rng.randrange(63)
            hist = [0.0] * 48
            hist[rng.randrange(16)] = hist[16] = hist[32] = 1.0
            rows.append((f"{rng.randrange(10**6):06d}_{len(rows)}", signed64(dd), pp, hist))
            if rng.random() < 0.2:
                rows.append((f"{rng.randrange(10**6):06d}_{len(rows)}", signed64(dd), pp, hist))
    return rows


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def alike(a, b, d, p, c):
    color = sum((x * y) ** 0.5 for x, y in zip(a[3], b[3]))
    return bits(a[1], b[1]) <= d and bits(a[2], b[2]) <= p and color >= c


def walk(rows, d, p, c):
    rows, used, out = sorted(rows), set(), set()
    for i, a in enumerate(rows):
        if a[0] in used:
            continue
        hit = [b for b in rows[i + 1:] if b[0] not in used and alike(a, b, d, p, c)]
        if hit:
            for b in [a, *hit]:
                used.add(b[0])
                out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize("seed,d,p,c", [(1, 10, 10, 0.85), (3, 16, 5, 0.0), (4, 20, 20, 2.0), (6, 8, 10, 3.5)])
def test_groups_match_the_sequential_walk(spark, seed, d, p, c):
    rows = planted(seed)
    got = D.duplicate_members(spark.createDataFrame(rows, SCHEMA), d, p, c).collect()
    assert {(r.leader, r.name) for r in got} == walk(rows, d, p, c)
    assert len(got) == len({r.name for r in got})


def test_a_chain_is_not_transitive(spark):
    hist = [1.0] + [0.0] * 15
    rows = [(f"n{i}", (1 << (6 * i)) - 1, 0, hist * 3) for i in range(8)]
    rows = [(n, signed64(h), p, x) for n, h, p, x in rows]
    got = D.duplicate_members(spark.createDataFrame(rows, SCHEMA), 10, 10, 0.85).collect()
    assert {(r.leader, r.name) for r in got} == walk(rows, 10, 10, 0.85)


def test_a_dense_group_with_many_copies(spark):
    """A third of all rows equal, another third within a few bits of one hash."""
    rng = random.Random(9)
    hist = ([1.0] + [0.0] * 15) * 3
    rows = [(f"a{i:04d}", 7, 7, hist) for i in range(200)]
    rows += [(f"b{i:04d}", (1 << rng.randrange(40)) | (1 << rng.randrange(40)), 7, hist) for i in range(200)]
    rows += [(f"c{i:04d}", signed64(rng.getrandbits(64)), rng.getrandbits(63), hist) for i in range(200)]
    got = D.duplicate_members(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.leader, r.name) for r in got} == walk(rows, 10, 10, 0.85)


@pytest.mark.parametrize("t", [0, 7, 10, 20])
def test_every_near_pair_meets_exactly_once(spark, t):
    rng = random.Random(t)
    base = [rng.getrandbits(64) for _ in range(25)]
    hashes = list(dict.fromkeys(base + [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 20))) for h in base for _ in range(4)]))
    rows = [(f"{i:04d}", signed64(h), 0, ([1.0] + [0.0] * 15) * 3) for i, h in enumerate(hashes)]
    nodes, search = D._prepare(spark.createDataFrame(rows, SCHEMA), t, 0, 0.85, False)
    found = [(r.a.id, r.b.id) for r in search.candidates(nodes, nodes).collect()]
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and bits(a[1], b[1]) <= t}
    assert len(found) == len(set(found)) and set(found) == want


def test_heavy_keys_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    rows = planted(11, groups=60)
    rows = [(n, d & 0xFFFF, p, h) for n, d, p, h in rows]  # three of four bands are equal for all
    got = D.duplicate_members(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.leader, r.name) for r in got} == walk(rows, 10, 10, 0.85)


def rounds_of(monkeypatch):
    """Counts the rounds of walks."""
    rounds, kept = [], D.number_rows
    monkeypatch.setattr(D, "number_rows", lambda *a: rounds.append(1) or kept(*a))  # once at first, once for every further round
    return rounds


@pytest.mark.parametrize("span", [7, 64, 1000])
def test_frames_that_hang_on_one_another(spark, monkeypatch, span):
    """Each frame is like the next few, so that every leader waits for the one before."""
    monkeypatch.setattr(D, "SPAN", span)
    rng = random.Random(8)
    hist, h, rows = ([1.0] + [0.0] * 15) * 3, rng.getrandbits(64), []
    for i in range(60):
        h ^= sum(1 << b for b in rng.sample(range(64), 3))
        rows.append((f"f{i:04d}", signed64(h), 0, hist))
    rounds = rounds_of(monkeypatch)
    got = D.duplicate_members(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.leader, r.name) for r in got} == walk(rows, 10, 10, 0.85)
    assert len(rounds) <= -(-60 // span) + 1


@pytest.mark.parametrize("span", [20, 90])
def test_many_blocks_match_the_sequential_walk(spark, monkeypatch, span):
    monkeypatch.setattr(D, "SPAN", span)
    rows = planted(5, groups=60, copies=6)
    got = D.duplicate_members(spark.createDataFrame(rows, SCHEMA), 12, 10, 0.85).collect()
    assert {(r.leader, r.name) for r in got} == walk(rows, 12, 10, 0.85)


def test_a_long_film_in_few_rounds(spark, monkeypatch):
    """20,000 different frames, each like the next hundred and more."""
    hist, h, rows = ([1.0] + [0.0] * 15) * 3, 0, []
    rng = random.Random(2)
    for i in range(20_000):
        if i % 12 == 0:
            h ^= 1 << rng.randrange(64)
        rows.append((f"f{i:05d}", signed64(h), i % 12, hist))
    rounds = rounds_of(monkeypatch)
    got = {r.name: r.leader for r in D.duplicate_members(spark.createDataFrame(rows, SCHEMA)).collect()}
    heads, want = [], {}
    for name, d, p, _ in rows:
        own = next((k[0] for k in heads if bits(k[1], d) <= 10 and bits(k[2], p) <= 10), None)
        if own is None:
            heads.append((name, d, p))
        want[name] = own or name
    alone = {k for k in want.values() if list(want.values()).count(k) == 1} if len(heads) < 400 else set()
    assert got == {n: k for n, k in want.items() if k not in alone} and len(rounds) <= 3


def test_summary_and_pruning(spark):
    hist = ([1.0] + [0.0] * 15) * 3
    rows = [("a", 0, 0, hist), ("b", 1, 0, hist), ("c", 3, 0, hist), ("x", -1, 5, hist), ("y", -1, 5, hist)]
    fp = spark.createDataFrame(rows, SCHEMA)
    members = D.duplicate_members(fp)
    groups = {r.leader: r for r in D.duplicate_groups(members).collect()}
    assert groups["a"].size == 3 and groups["a"].method == "dHash:1 pHash:0 color:3.00"
    assert D.dedup_summary(fp, members).first().asDict() == {"images": 5, "groups": 2, "redundant": 3}
    assert {r.name for r in D.keep_first(members).collect()} == {"b", "c", "y"}
    links = {(r.name_a, r.name_b, r.dhash_dist) for r in D.similar_pairs(fp).collect()}
    assert links == {("a", "b", 1), ("a", "c", 2), ("x", "y", 0)}
    left = D.prune_groups(members, spark.createDataFrame([("y",), ("c",)], "name string")).collect()
    assert {r.name for r in left} == {"a", "b"}


def test_color_scale(spark):
    hist = ([0.5, 0.5] + [0.0] * 14) * 3
    df = spark.createDataFrame([(hist,)], "h array<double>")
    h = F.col("h")
    assert df.select(P.color_similarity(h, h)).first()[0] == pytest.approx(3.0)
    assert df.select(P.color_similarity(h, h, True)).first()[0] == pytest.approx(1.0)


def test_new_images_join_the_first_similar_leader(spark):
    rows = planted(21)
    leaders, new = rows[::2], rows[1::2]
    got = match_leaders(spark.createDataFrame(leaders, SCHEMA), spark.createDataFrame(new, SCHEMA), 10, 10, 0.85)
    want = set()
    for b in new:
        hits = [a[0] for a in leaders if alike(a, b, 10, 10, 0.85)]
        if hits:
            want.add((min(hits), b[0]))
    assert {(r.leader, r.name) for r in got.collect()} == want


def test_histograms_are_never_broadcast(spark):
    """Catalyst takes a table with arrays for a small one; whole histograms would pass through the driver."""
    nodes, search = D._prepare(spark.createDataFrame(planted(2), SCHEMA), 10, 10, 0.85, False)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    slim = nodes.select("id", "dhash", "phash")
    plan = search.colored(search.candidates(slim, slim))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [a_id" in plan and "SortMergeJoin [b_id" in plan
    assert "BroadcastHashJoin [a_id" not in plan and "BroadcastHashJoin [b_id" not in plan


@pytest.mark.parametrize("least,copies", [(10, 2), (10_000, 4_096)])
def test_every_similar_pair_is_given(spark, monkeypatch, least, copies):
    """Also pairs of followers, and all pairs of copies, over several blocks of fingerprints and of copies."""
    monkeypatch.setattr(D, "LEAST_BLOCK", least)
    monkeypatch.setattr(D, "COPIES", copies)
    rows = planted(7, groups=25, copies=5)
    rows += [(f"{i * 99991 % 10**6:06d}_copy{i}", *rows[3][1:]) for i in range(9)]  # many copies of one
    apart = [0.1] * 3 + [0.0] * 45  # not even similar to itself
    rows += [(f"apart{i}", *rows[5][1:3], apart) for i in range(2)]
    got = D.every_similar_pair(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {(a[0], b[0], bits(a[1], b[1]), bits(a[2], b[2])) for a in rows for b in rows if a[0] < b[0] and alike(a, b, 10, 10, 0.85)}
    assert {(r.name_a, r.name_b, r.dhash_dist, r.phash_dist) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("span", [20, 1000])
def test_blocks_of_a_task_lose_nothing(spark, monkeypatch, span):
    monkeypatch.setattr(D, "LEAST_BLOCK", 12)
    monkeypatch.setattr(D, "SPAN", span)
    rows = planted(15, groups=60, copies=6)
    got = D.duplicate_members(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.leader, r.name) for r in got} == walk(rows, 10, 10, 0.85)


@pytest.mark.parametrize("d,p,rows", [(10, 10, 3_000), (3, 20, 400), (0, 0, 3_000), (40, 64, 60)])
def test_near_pairs_of_two_blocks(d, p, rows):
    """By each band once, by look-ups as well as by comparing all, and one for each right row."""
    rng = np.random.default_rng(rows + d)
    one = rng.integers(0, 1 << 63, size=(2, rows), dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, size=(2, rows, 7), dtype=np.uint64), axis=2) * rng.integers(0, 2, size=(2, rows), dtype=np.uint64)
    left = P.Side(np.arange(rows), one[0], one[1], np.arange(rows))
    right = P.Side(np.arange(rows), one[0] ^ flips[0], one[1] ^ flips[1], np.arange(rows) + 1)
    near = (np.bitwise_count(left.dhash[:, None] ^ right.dhash) <= d) & (np.bitwise_count(left.phash[:, None] ^ right.phash) <= p)
    want = set(zip(*(x.tolist() for x in np.nonzero(near & (left.place[:, None] < right.place))), strict=True))
    for bands in (P.choose_bands(rows, d, p), P.choose_bands(10**6, d, p)):
        found = [(i, j) for b in range(bands.count) for x in P.near_pairs(left, right, bands, b, d, p) for i, j in zip(x[0].tolist(), x[1].tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == want
        first = [(i, j) for b in range(bands.count) for x in P.first_pairs(left, right, bands, b, d, p) for i, j in zip(x[0].tolist(), x[1].tolist(), strict=True)]
        assert set(first) <= want and {j for _, j in first} == {j for _, j in want}


def test_fingerprints_enter_the_join_in_blocks(spark, monkeypatch):
    """A row for each block, none for each way to move the bits of a band."""
    monkeypatch.setattr(D, "LEAST_BLOCK", 20)
    nodes, search = D._prepare(spark.createDataFrame(planted(12), SCHEMA), 10, 10, 0.85, False)
    assert nodes.count() > 40 and search.packed(nodes, "id").count() == search.blocks == D.PARTS


def test_equal_histograms_are_not_moved(spark):
    rows = [(n, h, p, ([1.0] + [0.0] * 15) * 3) for n, h, p, _ in planted(13)]
    nodes, search = D._prepare(spark.createDataFrame(rows, SCHEMA), 10, 10, 0.85, False)
    near = search.near(nodes, nodes)
    assert near.where("color is null").isEmpty() and {r.color for r in near.select("color").distinct().collect()} == {3.0}

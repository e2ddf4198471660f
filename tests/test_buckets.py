"""Bucket assignment three ways: literal search, slices, and a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import geometry as G
from tagloom.operators import buckets as B
from tagloom.operators import ranking as R


def grid(res_w, res_h, low, high, step):
    """Every aligned size that no aligned size of the same width or height within the area exceeds."""
    area, steps = res_w * res_h, range(low, high + 1, step)
    tall = {(w, max(h for h in range(0, high + step, step) if h <= high and w * h <= area)) for w in steps}
    tall |= {(w, high) for w in steps if high % step and w * high <= area}
    square = max(s for s in range(0, res_w + res_h, step) if s * s <= area)
    kept = {(w, h) for w, h in tall if h >= low}
    return sorted(kept | {(h, w) for w, h in kept} | {(square, square)})


def by_hand(w, h, sizes):
    if (w, h) in sizes:
        return w, h
    return min((abs(a / b - w / h), a, b) for a, b in sizes)[1:]


@pytest.fixture(scope="module")
def assets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([256, 512, 640, 832, rng.randint(1, 4000)]), rng.choice([256, 512, 704, rng.randint(1, 4000)])) for i in range(800)]
    return spark.createDataFrame(rows, "asset_id long, width long, height long").cache()


@pytest.mark.parametrize("sizes", [
    grid(1024, 1024, 256, 1024, 64), grid(512, 768, 256, 768, 32), [(512, 512)], [(512, 512), (1024, 1024), (640, 480), (480, 640)],
])
def test_assignment(spark, assets, sizes):
    buckets = spark.createDataFrame([(int(a), int(b)) for a, b in sizes], "bw long, bh long")
    want = {(r.width, r.height): by_hand(r.width, r.height, sizes) for r in assets.collect()}
    near = {(r.width, r.height): (r.bw, r.bh) for r in B.assign_bucket(assets, buckets).collect()}
    cut = {(r.width, r.height): (r.bw, r.bh) for r in B.nearest_by_slices(assets.select("width", "height").distinct(), buckets).collect()}
    assert near == want and cut == want


def test_more_buckets_than_a_list_takes(spark, assets):
    sizes = [(64 + 8 * i, 64 + 8 * j) for i in range(60) for j in range(60)]
    buckets = spark.createDataFrame(sizes, "bw long, bh long")
    got = B.assign_bucket(assets, buckets).collect()
    assert len(got) == 800 and all((r.bw, r.bh) == by_hand(r.width, r.height, sizes) for r in got)


def test_grid_table(spark):
    setting = (960, 1216, 320, 1536, 64)
    table = spark.createDataFrame([setting], "res_w long, res_h long, min_size long, max_size long, step long")
    assert sorted((r.bw, r.bh) for r in B.bucket_grid(table).collect()) == grid(*setting)


def test_unreadable_sizes_are_skipped(spark):
    rows = spark.createDataFrame([(1, 500, 500), (2, 0, 0), (3, None, None)], "asset_id long, width long, height long")
    for mode, flag in (("legacy", False), ("legacy", True), ("nearest_only", True)):
        placed, skipped = B.analyze_buckets(rows, 512, 512, mode=mode, no_upscale=flag)
        assert [r.asset_id for r in placed.collect()] == [1]
        assert {r.asset_id for r in skipped.collect()} == {2, 3}
    with pytest.raises(ValueError):
        B.analyze_buckets(rows, 512, 512, mode="other")


def test_nearest_only_ignores_no_upscale(spark, assets):
    one, _ = B.analyze_buckets(assets, 768, 768, mode="nearest_only", no_upscale=True)
    two, _ = B.analyze_buckets(assets, 768, 768, mode="nearest_only")
    assert sorted(one.collect()) == sorted(two.collect())


def test_plans(spark):
    df = spark.createDataFrame([(1000, 800)], "w long, h long")
    w, h = F.col("w"), F.col("h")
    row = df.select(
        G.crop_center(w, h, 2000, 2000).alias("a"), G.crop_aspect(w, h, 1.25).alias("b"), G.crop_edges(w, h, 0, 0, 0, 0).alias("c"),
        G.crop_edges(w, h, 400, 400, 0, 0).alias("d"), G.scale_size(w, h, "upscale", (64, 64)).alias("e"), G.scale_size(w, h, "both", (2000, 2000), (64, 64)).alias("f"),
        G.fit_max_side(w, h, 500).alias("g"),
    ).first()
    assert [row[k]["status"] for k in "abcde"] == ["skip", "skip", "skip", "error", "skip"]
    assert (row.f.w, row.f.h) == (64, 64) and (row.g.w, row.g.h) == (500, 400)


def test_numbering_matches_a_sort_whatever_the_skew(spark):
    rows = [(n % 7 if n > 300 else 3, f"k{n:04d}") for n in range(1000)]
    df = spark.createDataFrame(rows, "g long, name string")
    got = {r.name: r.position for r in R.number_rows(df, [-F.col("g"), F.col("name")]).collect()}
    assert got == {name: i for i, (_, name) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    inside = R.rank_in_group(df, ["g"], [F.col("name")]).collect()
    seen = {}
    for r in sorted(inside, key=lambda r: r.name):
        assert r["rank"] == seen.get(r.g, 0)
        seen[r.g] = r["rank"] + 1
    assert R.number_rows(df.limit(0), [F.col("name")]).count() == 0


def test_renaming(spark):
    df = spark.createDataFrame([("b.PNG",), ("a.jpeg",), ("noext",), (".hid",)], "name string")
    got = {r.name: r.renamed for r in R.rename_plan(df, "p_", 99, 2).collect()}
    assert got == {".hid": "p_99.png", "a.jpeg": "p_100.jpeg", "b.PNG": "p_101.png", "noext": "p_102.png"}
    one = R.shuffle_plan(df, 1).collect()
    assert sorted(one) == sorted(R.shuffle_plan(df, 1).collect())
    assert len({r.renamed.split(".")[0] for r in one}) == 4


def test_search_ranks_and_wildcards(spark):
    rows = [("long_hair", 0, 50, "lh"), ("hair", 0, 90, "x"), ("hat", 0, 99, "HAIRY"), ("lon%", 0, 1, ""), ("longxhair", 0, 10, "")]
    d = spark.createDataFrame(rows, "name string, category int, post_count long, aliases string")
    assert [r.name for r in R.search_tags(d, "Hair").collect()] == ["hair", "long_hair", "longxhair", "hat"]
    assert [r.name for r in R.search_tags(d, "long hair").collect()] == ["long_hair"]
    assert [r.name for r in R.search_tags(d, "long hair", like_wildcards=True).collect()] == ["long_hair", "longxhair"]
    assert R.search_tags(d, "").collect() == []
    asked = spark.createDataFrame([("Hair",), ("long hair",), ("h",), ("",)], "query string")
    many = R.search_tags_many(d, asked, 3).orderBy("query", "rank").collect()
    assert [(r.query, r.name) for r in many] == [
        ("Hair", "hair"), ("Hair", "long_hair"), ("Hair", "longxhair"), ("h", "hat"), ("h", "hair"), ("h", "long_hair"), ("long hair", "long_hair"),
    ]

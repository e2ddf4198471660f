"""Tag algebra against plain list code, and the points where the rules surprise."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import tags as T
from tagloom.operators import filters, statistics

WORDS = st.lists(st.sampled_from(["a", "b", "c", "d e", "f_g", "H"]), max_size=7)
QUIET = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def evaluate(spark, tags, column):
    return spark.createDataFrame([(tags,)], "tags array<string>").select(column(F.col("tags"))).first()[0]


def add_by_hand(tags, new, position, overwrite):
    out = list(tags)
    for t in new:
        if t in out:
            if not overwrite:
                continue
            out.remove(t)
        out.insert(0, t) if position == "start" else out.append(t)
    return out


@QUIET
@given(WORDS, WORDS, st.sampled_from(["start", "end"]), st.booleans())
def test_add(spark, tags, new, position, overwrite):
    got = evaluate(spark, tags, lambda c: T.add_tags(c, T.literal_list(new), position, overwrite))
    assert got == add_by_hand(tags, new, position, overwrite)


@QUIET
@given(WORDS, WORDS)
def test_remove_union_contains(spark, tags, other):
    lit = T.literal_list(other)
    assert evaluate(spark, tags, lambda c: T.remove_tags(c, lit)) == [t for t in tags if t not in other]
    once = list(dict.fromkeys(t for t in other if t not in tags))
    assert evaluate(spark, tags, lambda c: T.union_tags(c, lit)) == tags + once
    assert evaluate(spark, tags, lambda c: T.ordered_union(c, lit)) == tags + once
    assert evaluate(spark, tags, lambda c: T.contains_all(c, lit)) == (set(other) <= set(tags))
    assert evaluate(spark, tags, lambda c: T.missing_tags(c, lit)) == sorted(set(tags) - set(other))


@QUIET
@given(WORDS, st.integers(-1, 7), st.integers(-1, 7))
def test_move(spark, tags, src, dst):
    want = list(tags)
    if 0 <= src < len(want) and 0 <= dst < len(want):
        want.insert(dst, want.pop(src))
    assert evaluate(spark, tags, lambda c: T.move_tag(c, F.lit(src), F.lit(dst))) == want


def test_replace_takes_only_the_first_and_may_repeat(spark):
    got = evaluate(spark, ["x", "a", "b", "a"], lambda c: T.replace_tag(c, "a", " X "))
    assert got == ["x", "x", "b", "a"]
    assert evaluate(spark, ["a"], lambda c: T.replace_tag(c, "b", "z")) == ["a"]


def test_normalize(spark):
    df = spark.createDataFrame([(" Long_Hair,, Ünï ,\t, a b \n",)], "t string")
    assert df.select(T.normalize_tags(F.col("t"))).first()[0] == ["long hair", "ünï", "a b"]


def test_search_does_not_fold_tags(spark):
    df = spark.createDataFrame([("ABC.png", ["Hat"]), ("x.png", ["hat"])], "name string, tags array<string>")
    assert [r.name for r in filters.search_assets(df, "HAT").collect()] == ["x.png"]
    assert [r.name for r in filters.search_assets(df, "abc").collect()] == ["ABC.png"]


def test_a_repeated_tag_can_fake_a_common_one(spark):
    rows = spark.createDataFrame([(["a", "a"],), (["b"],), ([],)], "tags array<string>")
    assert [r.tag for r in statistics.common_tags(rows).collect()] == ["a"]
    assert statistics.common_tags(rows, distinct_per_asset=True).collect() == []
    assert statistics.common_tags(rows.where("size(tags) = 0")).collect() == []

"""What the plans must and must not contain."""

import re

from pyspark.sql import functions as F

from tagloom.functions.fingerprints import choose_bands
from tagloom.operators import buckets, duplicates, ranking, statistics
from tagloom.plans.views import Views
from tests.conftest import SF, plan_of

def test_similar_pairs_is_an_equi_join(spark):
    v = Views(spark, SF)
    nodes, search = duplicates._prepare(v.fingerprints(), 10, 10, 0.85, False)
    plan = plan_of(search.candidates(nodes, nodes))
    assert re.search(r"(SortMerge|BroadcastHash|ShuffledHash)Join \[band", plan)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(statistics.tag_stats(Views(spark, SF).tag_rows()))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sorted(schemas) == ["l_partkey:bigint", "p_partkey:bigint,p_name:string"]
    assert "PushedFilters: [IsNotNull(l_partkey)]" in plan


def test_counts_are_combined_before_their_shuffle(spark):
    plan = plan_of(statistics.tag_stats(Views(spark, SF).words()))
    assert plan.count("partial_count") == 1 and plan.count("hashpartitioning(tag") == 1


def test_assignment_needs_no_shuffle(spark):
    placed, _ = buckets.analyze_buckets(Views(spark, SF).assets(), 1024, 1024)
    assert "Exchange" not in plan_of(placed)


def test_numbering_never_sorts_in_one_task(spark):
    plan = plan_of(ranking.number_rows(Views(spark, SF).assets().select("name"), [ranking.F.col("name")]))
    single = plan.split("SinglePartition")[1:] if "SinglePartition" in plan else []
    # the only single task sums one row per range
    assert len(single) <= 1 and "hashpartitioning(_range" in plan


def test_band_choice_follows_size_and_threshold():
    small, large = choose_bands(1_000, 10, 10), choose_bands(10**9, 10, 10)
    assert large.count <= small.count
    assert choose_bands(1_000, 20, 3).column == "phash"
    for rows in (10, 10**4, 10**7):
        for t in range(0, 65):
            b = choose_bands(rows, t, t)
            assert b.left + b.right == t // b.count and sum(w for _, w in b.spans) == 64


def test_scores_stay_in_their_row(spark):
    from tagloom.operators import scoring

    v = Views(spark, SF)
    rows = scoring.labelled_scores(v.probs(), v.vocab())
    for df in (
        scoring.select_tags(v.probs(), v.vocab()), scoring.label_rows(rows, scoring.pick_argmax(F.col("labels"))),
        scoring.label_rows(rows, scoring.pick_threshold(F.col("labels"))), rows.select("asset_id", scoring.order_selected(F.col("labels"))),
    ):
        plan = plan_of(df)
        assert plan.count("embeddings.parquet") == 1 and "Join" not in plan
        assert not re.search(r"Exchange hashpartitioning\((idx|asset_id)", plan)


def test_phash_reads_its_pixels_once(spark):
    import __spark_entry__ as entry

    plan = plan_of(entry.queries()["phash"](spark, SF))
    # inside the function of the 1,024 places nothing is computed from the embedding
    assert "lpad(" in plan and not re.search(r"lpad\([^\n]*embedding", plan)

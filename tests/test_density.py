"""Density clustering against a direct single-machine computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.operators import density as D


def direct(x, mcs):
    """Labels by walking the whole tree: sets of members per label."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, mcs - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    n = len(x)
    weights = sorted({reach[i, j] for i in range(n) for j in range(i)})

    def parts(members, limit):
        left, out = set(members), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                i = todo.pop()
                seen.add(i)
                near = {j for j in left if reach[i, j] <= limit}
                left -= near
                todo += near
            out.append(frozenset(seen))
        return [p for p in out if len(p) >= mcs]

    def walk(members, top):
        """(mass, kept sets) of the cluster that appears below weight number ``top``."""
        mass, k, now = 0.0, top, members
        while True:
            k -= 1
            if k < 0:
                return mass, [members]
            inner = parts(now, weights[k])
            birth = 1 / weights[k + 1] if k + 1 < len(weights) else 0.0
            if len(inner) != 1:
                below = [walk(p, k + 1) for p in inner]
                total = sum(m for m, _ in below)
                return (total, [s for _, kept in below for s in kept]) if total > mass else (mass, [members])
            now = inner[0]
            mass += len(now) * (1 / weights[k] - birth)

    k, now = len(weights), frozenset(range(n))
    while k:
        k -= 1
        inner = parts(now, weights[k])
        if len(inner) > 1:
            return {s for p in inner for s in walk(p, k + 1)[1]}
        if not inner:
            return set()
        now = inner[0]
    return set()


@pytest.mark.parametrize("seed", [0, 1])
def test_against_the_direct_walk(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (m, 2)) for c, s, m in ((0, 0.3, 25), (4, 0.5, 20), (8, 0.2, 12))] + [rng.uniform(-5, 12, (8, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "asset_id long, vec array<double>")
    got = {}
    for r in D.cluster_density(df, min_cluster_size=5, levels=10_000).collect():
        got.setdefault(r.label, set()).add(r.asset_id)
    got.pop(-1, None)
    assert {frozenset(s) for s in got.values()} == direct(x, 5)
    assert [min(got[k]) for k in sorted(got)] == sorted(min(s) for s in got.values())


def test_many_cells_and_few_levels(spark, monkeypatch):
    monkeypatch.setattr(D, "CELL", 40)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(10 * c, 0.2, (60, 3)) for c in range(3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "asset_id long, vec array<double>")
    got = {r.asset_id: r.label for r in D.cluster_density(df, min_cluster_size=8, levels=12).collect()}
    for c in range(3):
        mine = {got[i] for i in range(60 * c, 60 * c + 60)} - {-1}
        assert mine and not mine & {got[i] for i in range(180) if i // 60 != c}


def planted_vectors(n, dims, size, seed=1):
    rng = np.random.default_rng(seed)
    return rng.uniform(-10, 10, (n // size, dims)).repeat(size, axis=0) + rng.standard_normal((n // size * size, dims))


def recall(spark, x, k, asked, **options):
    """Share of the true nearest neighbours of the rows in ``asked`` that are found."""
    frame = pd.DataFrame({"id": np.arange(len(x)), "vec": list(x)})
    nodes = D.materialize(spark.createDataFrame(frame, "id long, vec array<double>"))
    found = D.neighbours(nodes, D._cells(nodes, len(x), x.shape[1]), k, **options)
    got = found.where(F.col("id").isin([int(i) for i in asked])).toPandas().groupby("id")["other"].apply(set)
    hits = 0
    for i in asked:
        d = ((x - x[i]) ** 2).sum(axis=1)
        hits += len(got[i] & set(np.argpartition(d, k - 1)[:k].tolist()) - {i})
    return hits / len(asked) / (k - 1)


def test_neighbours_are_found_across_many_cells(spark, monkeypatch):
    """Five levels of cells; without the lists of neighbours and with one tree most would be lost."""
    monkeypatch.setattr(D, "CELL", 640)
    x = planted_vectors(20_000, 20, 100)
    assert D.forest_shape(len(x), 640) == (4, 5)
    assert recall(spark, x, 9, range(0, 20_000, 97)) >= 0.95


def test_one_cell_is_exact(spark):
    x = planted_vectors(3_000, 8, 50, seed=4)
    assert recall(spark, x, 6, range(0, 3_000, 31)) == 1.0


def test_a_large_table_against_planted_clusters(spark, monkeypatch):
    """Many cells: no cluster mixes two planted ones that lie apart, few vectors are noise."""
    monkeypatch.setattr(D, "CELL", 800)
    rng = np.random.default_rng(3)
    x = rng.uniform(-100, 100, (12, 10)).repeat(500, axis=0) + rng.standard_normal((6_000, 10))
    frame = pd.DataFrame({"asset_id": np.arange(len(x)), "vec": list(x)})
    got = D.cluster_density(spark.createDataFrame(frame, "asset_id long, vec array<double>"), min_cluster_size=100, levels=8).toPandas().set_index("asset_id")["label"]
    owners = got[got >= 0].groupby(got).apply(lambda g: {i // 500 for i in g.index})
    assert all(len(o) == 1 for o in owners) and len(owners) >= 12 and (got < 0).mean() < 0.25


def test_fallback(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "asset_id long, vec array<double>")
    out = D.cluster_fallback(df, min_cluster_size=5)
    assert {r.label for r in out.collect()} == {0, 1}
    with pytest.raises(ValueError):
        D.cluster_fallback(df.limit(1))


def test_no_cluster_of_more_than_half_is_searched(spark, monkeypatch):
    """Two groups of more than half of all vectors don't exist: no lists of as many neighbours are made."""
    def fail(*_, **__):
        raise AssertionError("neighbours are listed")

    x = np.concatenate([np.random.default_rng(c).normal(20 * c, 0.1, (10, 2)) for c in range(2)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "asset_id long, vec array<double>")
    assert {r.label for r in D.cluster_density(df, min_cluster_size=10).collect()} == {0, 1}
    assert direct(x, 11) == set()
    monkeypatch.setattr(D, "neighbours", fail)
    assert sorted((r.asset_id, r.label) for r in D.cluster_density(df, min_cluster_size=11).collect()) == [(i, -1) for i in range(20)]


def test_components(spark):
    edges = [(0, i, i + 1) for i in range(30)] + [(0, 50, 40), (0, 40, 45), (1, 3, 9)]
    df = spark.createDataFrame(edges, "grp int, a long, b long")
    got = {(r.grp, r.id): r.comp for r in D.components(df).collect()}
    assert got == {**{(0, i): 0 for i in range(31)}, (0, 40): 40, (0, 45): 40, (0, 50): 40, (1, 3): 3, (1, 9): 3}


def test_links_connect_as_all_edges_do_and_are_few(spark):
    """Random edges over two cells with a hub: the same components at every level, one link a vector, cell and level at most."""
    rng = np.random.default_rng(6)
    rows = [(int(min(p)), int(max(p)), int(max(p)), int(rng.integers(0, 4))) for p in rng.integers(0, 60, (400, 2)) if p[0] != p[1]]
    rows += [(0, i, i, 2) for i in range(1, 60, 7)]
    edges = spark.createDataFrame(rows, "a long, b long, own long, `from` int")
    cells = spark.createDataFrame([(i % 2 * 2 + t, i) for i in range(60) for t in range(2)], "cell long, id long")
    links = D.materialize(D._links(edges, cells, 2, 4))
    every = edges.select(F.explode(F.sequence("from", F.lit(3))).alias("grp"), "a", "b")
    assert sorted(map(tuple, D.components(links).collect())) == sorted(map(tuple, D.components(every).collect()))
    assert links.groupBy("grp").count().agg(F.max("count")).first()[0] <= 2 * 59 < every.where("grp = 3").count()
    assert all(r.a < r.b for r in links.collect())


def test_equal_vectors_own_few_edges(spark):
    """All copies list the same ones, which would own the edges of all if the smaller end did."""
    x = np.concatenate([np.zeros((300, 3)), np.random.default_rng(2).normal(size=(40, 3))])
    nodes = D.materialize(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"))
    cells = D._cells(nodes, len(x), 3)
    found = D.neighbours(nodes, cells, 9)
    edges = D._edges(nodes, cells, found, D._cores(found, 5)).toPandas()
    assert edges.groupby("own").size().max() <= 9 + 1
    assert ((edges.own == edges.a) | (edges.own == edges.b)).all()

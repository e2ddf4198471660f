"""Density clustering with noise, on a forest of bounded cells and a graph.

A forest of random-projection trees cuts the vectors into cells: every level halves all
cells of all trees at the median along a random direction, by one numbering of
narrow rows, until a cell has at most CELL of them.  Number of levels and of trees grow
with the logarithm of the rows.  A task finds the nearest neighbours in its cell
exactly and a spanning tree of mutual reachability; lists of neighbours are then
completed by the neighbours of neighbours, over joins, so that a cell's border cuts
nothing off.  Trees and lists make one sparse graph.  Clusters are
followed through the graph's components at a series of distances, and those
with the greatest excess of mass are kept; a split is seen if a level lies between its
distances.  Before the components are joined up, a task connects the edges that the vectors of a
cell own and gives one link per vector and level, not all edges of a level.  The path is the same at every size: with at most CELL vectors there is
one cell, and neighbours and tree are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.clusters import cluster_kmeans, reduce_pca
from tagloom.operators.ranking import number_rows
from tagloom.session import materialize

#: Vectors of a cell; distances that a task holds at a time; neighbours listed at least, the vector itself included.
CELL, HELD, LISTED = 16_384, 4 << 20, 9


def forest_shape(n: int, cell: int) -> tuple[int, int]:
    """(trees, levels): each level of a tree parts close vectors with some chance, so deeper trees need company."""
    levels = max(0, math.ceil(math.log2(max(1, n) / cell)))
    return 1 + min(levels, 1 + levels // 2), levels


def _cells(nodes: DataFrame, n: int, width: int) -> DataFrame:
    """``(cell, id)``: every row in one cell of each tree."""
    trees, levels = forest_shape(n, CELL)
    if not levels:
        return nodes.select(F.lit(0).cast("long").alias("cell"), "id")
    axes = np.random.default_rng(0).standard_normal((trees * levels, width))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            along = np.stack(batch["vec"].to_numpy()) @ axes.T
            yield pd.DataFrame({"id": batch["id"], "along": list(along)})

    rows = nodes.select("id", "vec").mapInPandas(project, "id long, along array<double>")
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = rows.withColumn("tree", tree).select(
        "tree", "id", F.slice("along", F.col("tree") * levels + 1, levels).alias("along"), F.lit(0).cast("long").alias("half")
    )
    for level in range(levels):
        # cells of a tree have equal sizes, so a place in the order of (tree, cell, projection) names the half
        placed = number_rows(materialize(rows), [F.col("tree"), F.col("half"), F.get("along", F.lit(level)), F.col("id")], "at")
        place = F.col("at") - F.col("tree") * n
        rows = placed.withColumn("half", F.floor(place * (2 << level) / n)).select("tree", "id", "along", "half")
    return materialize(rows.select((F.col("half") * trees + F.col("tree")).alias("cell"), "id"))


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``k`` nearest rows of every row, itself included."""
    n, sq = len(x), (x * x).sum(axis=1)
    places, near = np.empty((n, k), dtype=np.int64), np.empty((n, k))
    step = max(1, HELD // n)
    for a in range(0, n, step):
        d = np.maximum(sq[a : a + step, None] + sq[None, :] - 2.0 * (x[a : a + step] @ x.T), 0.0)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = 0.0
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        places[a : a + step], near[a : a + step] = best, np.sqrt(np.take_along_axis(d, best, axis=1))
    return places, near


def _shortest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each vector's neighbours; lists are combined before they are ranked."""
    found = found.groupBy("id", "other").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def neighbours(nodes: DataFrame, cells: DataFrame, k: int, rounds: int = 1) -> DataFrame:
    """``(id, other, d)``: the ``k`` nearest vectors of each, itself included.

    First those in the cells of each tree, then, ``rounds`` times, what the neighbours' lists add.
    """

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = pdf["id"].to_numpy(), min(k, len(pdf))
        places, d = _nearest(np.stack(pdf["vec"].to_numpy()), m)
        return pd.DataFrame({"id": np.repeat(ids, m), "other": ids[places].ravel(), "d": d.ravel()})

    vectors = nodes.select("id", "vec")
    found = materialize(_shortest(cells.join(vectors, "id").groupBy("cell").applyInPandas(nearest, "id long, other long, d double"), k))
    square = F.aggregate(F.zip_with("va", "vb", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    for _ in range(rounds if forest_shape(nodes.count(), CELL)[1] else 0):
        hop = found.select(F.col("id").alias("other"), F.col("other").alias("far"))
        pairs = found.select("id", "other").join(hop, "other").select("id", F.col("far").alias("other")).distinct()
        fresh = pairs.join(found.select("id", "other"), ["id", "other"], "left_anti")
        far = fresh.join(vectors.withColumnRenamed("vec", "va"), "id").join(vectors.select(F.col("id").alias("other"), F.col("vec").alias("vb")), "other")
        found = materialize(_shortest(found.unionByName(far.select("id", "other", F.sqrt(square).alias("d"))), k))
    return found


def _cores(found: DataFrame, k: int) -> DataFrame:
    """Distance to the ``k``-th nearest vector, the vector itself being the first."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return found.withColumn("r", rank).where(F.col("r") <= k).groupBy("id").agg(F.max("d").alias("core"))


def _edges(nodes: DataFrame, cells: DataFrame, found: DataFrame, cores: DataFrame) -> DataFrame:
    """``(a, b, own, w)``: a minimum spanning tree of mutual reachability in every cell, and the listed neighbours.

    ``own`` is the end that listed the other one or was the later one of a tree, so a vector owns a bounded number.
    """

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, core = pdf["id"].to_numpy(), pdf["core"].to_numpy()
        x = np.stack(pdf["vec"].to_numpy())
        n, sq = len(ids), (x * x).sum(axis=1)
        # rows outside the tree are in front, each with its nearest one inside; a row that enters gives its place to the last
        x, sq, core, row = x.copy(), sq.copy(), core.copy(), np.arange(n)
        best, link = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
        p, q, w, at = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1), 0
        for k in range(n - 1):
            last = n - 1 - k
            mine, mine_sq, mine_core, mine_row = x[at].copy(), sq[at], core[at], row[at]
            for column in (x, sq, core, row, best, link):
                column[at] = column[last]
            reach = np.sqrt(np.maximum(sq[:last] + mine_sq - 2.0 * (x[:last] @ mine), 0.0))
            reach = np.maximum(reach, np.maximum(core[:last], mine_core))
            nearer = reach < best[:last]
            best[:last][nearer], link[:last][nearer] = reach[nearer], mine_row
            at = int(np.argmin(best[:last]))
            p[k], q[k], w[k] = ids[row[at]], ids[link[at]], best[at]
        return pd.DataFrame({"p": p, "q": q, "w": w})

    known = nodes.select("id", "vec").join(cores, "id")
    edges = cells.join(known, "id").groupBy("cell").applyInPandas(tree, "p long, q long, w double")
    ends = found.where("id <> other").join(cores, "id").join(cores.select(F.col("id").alias("other"), F.col("core").alias("far")), "other")
    listed = ends.select(F.col("id").alias("p"), F.col("other").alias("q"), F.greatest("d", "core", "far").alias("w"))
    both = edges.unionByName(listed)
    return both.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.max("p").alias("own"), F.min("w").alias("w"))


def _links(edges: DataFrame, cells: DataFrame, trees: int, levels: int) -> DataFrame:
    """``(grp, a, b)``: what connects at each level the same as all ``edges`` (a, b, own, from) that start at it or below.

    Those owned in one cell of the first tree are connected in a task, level by level; of a level every vector
    that is not the first of its part gives a link to that one.
    """

    def connect(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, places = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        places, start = places.reshape(-1, 2), pdf["from"].to_numpy()
        first, found = np.arange(len(ids)), []
        for level in range(int(start.min()), levels):
            u, v = first[places[start == level]].T
            while (apart := u != v).any():  # the later part follows the earliest one that it meets
                u, v = u[apart], v[apart]
                np.minimum.at(first, np.maximum(u, v), np.minimum(u, v))
                while (first[first] != first).any():
                    first = first[first]
                u, v = first[u], first[v]
            inner = np.flatnonzero(first != np.arange(len(ids)))
            found.append((np.full(len(inner), level, dtype=np.int32), ids[first[inner]], ids[inner]))
        grp, a, b = map(np.concatenate, zip(*found, strict=True))
        return pd.DataFrame({"grp": grp, "a": a, "b": b})

    home = cells.where(F.col("cell") % trees == 0).select(F.col("id").alias("own"), "cell")
    return edges.join(home, "own").select("cell", "a", "b", "from").groupBy("cell").applyInPandas(connect, "grp int, a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(grp, a, b)`` graphs: ``(grp, id, comp)``, the least id leading.

    Alternates linking every node's larger neighbours, then its smaller ones, to
    the least neighbour, until all that is left are stars.  Isolated nodes have
    no row.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("grp", "u").agg(F.min("v").alias("m"))

    now = edges.select("grp", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = now.unionByName(now.select("grp", F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), ["grp", "u"]).where("v > u").select("grp", F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.distinct()
        joined = large.join(least(large), ["grp", "u"])
        small = joined.where("v <> m").select("grp", F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(joined.select("grp", "u", F.col("m").alias("v"))).distinct()
        now = materialize(small)
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("grp", "u", "v"))).first()
        if mark == before:
            break
        before = mark
    stars = now.select("grp", F.col("u").alias("id"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select("grp", F.col("comp").alias("id"), "comp").distinct())


def _levels(edges: DataFrame, most: int) -> list[float]:
    """Rising distances: ``most`` evenly spread ones of the different edge weights."""
    marks = [i / most for i in range(1, most + 1)]
    cut, top = edges.select("w").distinct().agg(F.percentile_approx("w", marks, 10_000), F.max("w")).first()
    return [] if top is None else sorted({*cut, top})


def cluster_density(
    features: DataFrame, key: str = "asset_id", min_cluster_size: int = 5, levels: int = 32, dims: int = 50, rounds: int = 1
) -> DataFrame:
    """``(key, label)``: clusters of at least a size, numbered by first key; -1 is noise."""
    n = features.count()
    if n < 2 * min_cluster_size:  # a cluster parts from another one of that size, so all is noise
        return features.select(key, F.lit(-1).alias("label"))
    slim = reduce_pca(features.select(key, "vec"), dims)
    nodes = materialize(number_rows(slim, [F.col(key)], "id"))
    first = nodes.select(F.size("vec").alias("d")).first()
    cells = _cells(nodes, n, first["d"])
    found = neighbours(nodes, cells, max(min_cluster_size, LISTED), rounds)
    cores = materialize(_cores(found, min_cluster_size))
    edges = materialize(_edges(nodes, cells, found, cores))
    steps = _levels(edges, levels)
    if not steps:
        return nodes.select(key, F.lit(-1).alias("label"))

    marks = F.lit(steps).cast("array<double>")
    from_level = F.size(F.filter(marks, lambda t: t < F.col("w")))
    cut = materialize(_links(edges.select("a", "b", "own", from_level.alias("from")), cells, forest_shape(n, CELL)[0], len(steps)))
    comps = materialize(components(cut).withColumnRenamed("grp", "level"))
    sizes = comps.groupBy("level", "comp").agg(F.count("*").alias("size")).where(F.col("size") >= min_cluster_size)

    # one row per live component and level; `up` is the component it lies in one level on
    wider = comps.select((F.col("level") - 1).alias("level"), F.col("id").alias("comp"), F.col("comp").alias("up"))
    live = sizes.join(wider, ["level", "comp"], "left")
    children = live.where("up is not null").groupBy((F.col("level") + 1).alias("level"), F.col("up").alias("comp")).agg(F.count("*").alias("parts"))
    density = [1.0 / max(t, 1e-12) for t in steps] + [0.0]
    gain = F.lit([a - b for a, b in zip(density, density[1:])]).cast("array<double>")
    node = F.struct("level", "comp")
    live = live.join(children.select(F.col("level").alias("pl"), F.col("comp").alias("pc"), "parts"),
                     (F.col("pl") == F.col("level") + 1) & (F.col("pc") == F.col("up")), "left")
    live = materialize(live.select(
        node.alias("node"), F.when(F.col("up").isNotNull(), F.struct((F.col("level") + 1).alias("level"), F.col("up").alias("comp"))).alias("parent"),
        "parts", (F.col("size") * F.get(gain, F.col("level"))).alias("mass"),
    ))

    # a component that is its parent's only live part is the same cluster, seen earlier
    link = live.select("node", F.when(F.col("parts") == 1, F.col("parent")).otherwise(F.col("node")).alias("top"))
    for _ in range(max(1, (len(steps) - 1).bit_length())):
        hop = link.select(F.col("node").alias("top"), F.col("top").alias("further"))
        link = materialize(link.join(hop, "top").select("node", F.col("further").alias("top")))
    mass = live.join(link, "node").groupBy("top").agg(F.sum("mass").alias("mass"))
    above = live.where("parts > 1").select(F.col("node").alias("top"), "parent").join(
        link.select(F.col("node").alias("parent"), F.col("top").alias("over")), "parent"
    ).select("top", "over")
    tree = materialize(mass.join(above, "top", "left"))

    # from the finest births on: a cluster's worth is its own mass or that of its parts
    worth = tree.limit(0).select("top", "over", F.lit(0.0).alias("worth"), F.lit(True).alias("kept"))
    births = sorted(r[0] for r in tree.select("top.level").distinct().collect())
    for level in births:
        below = worth.where("over is not null").groupBy("over").agg(F.sum("worth").alias("parts")).withColumnRenamed("over", "top")
        here = tree.where(F.col("top.level") == level).join(below, "top", "left")
        own = (F.col("mass") >= F.coalesce("parts", F.lit(0.0))) & F.col("over").isNotNull()
        value = F.when(own, F.col("mass")).otherwise(F.coalesce("parts", F.lit(0.0)))
        worth = materialize(worth.unionByName(here.select("top", "over", value.alias("worth"), own.alias("kept"))))

    # a vector belongs to the widest kept cluster that held it at its birth
    kept = worth.where("kept").select(F.col("top.level").alias("level"), F.col("top.comp").alias("comp"))
    held = comps.join(kept, ["level", "comp"]).groupBy("id").agg(F.max(F.struct("level", "comp")).alias("c"))
    names = number_rows(held.groupBy("c").agg(F.min("id").alias("first")), [F.col("first")], "label")
    labelled = held.join(names, "c").select("id", F.col("label").cast("int").alias("label"))
    return nodes.select(key, "id").join(labelled, "id", "left").select(key, F.coalesce("label", F.lit(-1)).alias("label"))


def cluster_fallback(features: DataFrame, key: str = "asset_id", min_cluster_size: int = 5, **options) -> DataFrame:
    """Density clustering, or k-means with a few clusters when it finds none."""
    n = features.count()
    if n < 2:
        raise ValueError("clustering needs at least two vectors")
    found = materialize(cluster_density(features, key, min_cluster_size, **options))
    if not found.where("label >= 0").isEmpty():
        return found
    return cluster_kmeans(features.select(key, "vec"), max(2, min(8, n // 3))).select(key, "label")

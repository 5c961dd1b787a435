"""Clusterings by cosine distance: average linkage, density, and projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from purselight.functions import numbers
from purselight.operators import vectors
from purselight.plans.scratch import components, written


#: Clusters that one task takes in any case, and those it takes once a round joins less than a sixth of them.
FEW, MANY = 16_384, 200_000
_TILE = 512


def _means(rows: pd.DataFrame) -> np.ndarray:
    """The mean vector of each cluster. rows: s (sum of its unit vectors), n."""
    v = np.stack(rows.s).astype(float) / rows.n.to_numpy()[:, None]
    if not np.isfinite(v).all():
        raise ValueError("a vector that is not finite")
    return v


def _top(t: np.ndarray, best: np.ndarray, other: np.ndarray, where: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> None:
    """Takes the products t of `mine` (rows) and `theirs` into each one's best, where it is, and the second best (other)."""
    better = np.nonzero(t.max(1) > other[mine])[0]
    t, mine = t[better], mine[better]
    at, k = t.argmax(1), np.arange(len(better))
    first = t[k, at]
    t[k, at] = -9
    won = first > best[mine]
    other[mine] = np.maximum(np.where(won, best[mine], first), t.max(1))
    where[mine[won]], best[mine[won]] = theirs[at[won]], first[won]


def _error(dim: int) -> float:
    """Most error of a product of vectors of length 1 or less in single precision."""
    return (dim + 4) * 2.0**-24


def linkage(v: np.ndarray, size: np.ndarray, height: np.ndarray, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges (node, the lesser node it joins, height) of clusters with means v, in an order in which heights of one cluster rise.

    The mean distance of two clusters is 1 less the product of their means, so no matrix of distances is kept. A merge brings
    no cluster closer to a third than the closer of its parts was. So clusters that are nearest to each other may merge in any
    order, a neighbour holds until it merges itself, and the next best distance of a search (`second`) stays a lower bound
    for all other clusters: where the merged neighbour is within it, no search is needed. Distances that differ by rounding
    count as equal there.
    """
    n, dim = v.shape
    right = np.hstack([v, np.zeros((n, 1))])  # the last column puts merged clusters out of reach
    size, height, label, live = size.astype(float), height.astype(float), np.arange(n), np.ones(n, bool)
    near, dist, second = np.zeros(n, int), np.zeros(n), np.zeros(n)

    def search(todo: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best, other, where = np.full(len(todo), -9.0), np.full(len(todo), -9.0), np.zeros(len(todo), int)
        for x in range(0, len(todo), _TILE):
            rows = todo[x : x + _TILE]
            left = right[rows]
            left[:, -1] = 1
            for y in range(0, len(right), _TILE):
                t = left @ right[y : y + _TILE].T
                own = np.nonzero((rows >= y) & (rows < y + _TILE))[0]
                t[own, rows[own] - y] = -9
                _top(t, best, other, where, np.arange(x, x + len(rows)), np.arange(y, y + t.shape[1]))
        return best, other, where

    def refresh(todo: np.ndarray) -> None:
        """Searches in single precision; where the two best are too close to tell apart in it, again in double precision."""
        if len(todo) > 64:
            best, other, where = search(todo, right.astype(np.float32))
            near[todo], second[todo] = where, 1 - other - _error(dim)
            dist[todo] = 1 - np.einsum("ij,ij->i", right[todo, :dim], right[where, :dim])
            todo = todo[best - other <= 2 * _error(dim)]
        if len(todo):
            best, other, where = search(todo, right)
            near[todo], dist[todo], second[todo] = where, 1 - best, 1 - other

    todo, out = np.arange(n), []
    while live.sum() > 1:
        refresh(todo)
        i = np.arange(len(live))
        below = live if threshold is None else live & (dist < threshold)
        a = i[below & (near[near] == i) & (i < near)]
        b = near[a]
        if not len(a):  # neighbours at equal distances, but for rounding, may point in a ring
            if not below.any():
                break
            k = i[below][dist[below].argmin()]
            a, b = np.array([min(k, near[k])]), np.array([max(k, near[k])])
        h = np.maximum(dist[a], np.maximum(height[a], height[b]))
        out.append((label[b], label[a], h))
        total = size[a] + size[b]
        right[a, :dim] = (right[a, :dim] * size[a, None] + right[b, :dim] * size[b, None]) / total[:, None]
        size[a], height[a], live[b], right[b, -1] = total, h, False, -4
        into, again = i.copy(), np.zeros(len(live), bool)
        into[b], again[a] = a, True
        touched = ~live | again
        moved = i[live & ~again & touched[near]]
        near[moved] = into[near[moved]]
        d = 1 - np.einsum("ij,ij->i", right[moved, :dim], right[near[moved], :dim])
        again[moved] = d > second[moved] + 1e-12
        dist[moved] = d
        stay = live if threshold is None else live & (again | (dist < threshold))
        if stay.sum() < 0.9 * len(stay):
            place = np.where(stay, np.cumsum(stay) - 1, 0)
            again |= ~stay[near]
            right, size, height, label, dist, second, again = right[stay], size[stay], height[stay], label[stay], dist[stay], second[stay], again[stay]
            near, live = place[near[stay]], np.ones(len(label), bool)
        todo = np.nonzero(again & live)[0]
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def average_linkage(v: np.ndarray, threshold: float | None = None, k: int | None = None) -> np.ndarray:
    """Cluster numbers of unit vectors: the closest two clusters merge while their mean distance is below threshold, or more than k remain."""
    n = len(v)
    node, parent, h = linkage(v, np.ones(n), np.zeros(n), threshold)
    owner = np.arange(n)
    kept = np.argsort(h, kind="stable")[: None if k is None else max(0, n - max(k, 1))]
    owner[node[kept]] = parent[kept]
    while (owner != owner[owner]).any():
        owner = owner[owner]
    return owner


def _nearest(active: DataFrame, n: int) -> DataFrame:
    """c, other, d: the nearest other cluster of each, ties by its number. active: c, s, n; a task holds two blocks of it."""
    blocks = max(1, min(-(-n // 1024), max(5, -(-n // 16_384))))
    block = F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = active.select("c", "s", "n", block.alias("block"), other.alias("other"))
    rows = rows.select("c", "s", "n", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def f(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c", ignore_index=True)
        v, ids, block = _means(rows), rows.c.to_numpy(), rows.block.to_numpy()
        left, right = (np.nonzero(block == k)[0] for k in key)
        same = key[0] == key[1]
        best, other, where = np.full(len(v), -9.0), np.full(len(v), -9.0), np.full(len(v), -1)
        single = v.astype(np.float32)
        for x in range(0, len(left), _TILE):
            for y in range(x if same else 0, len(right), _TILE):
                a, b = left[x : x + _TILE], right[y : y + _TILE]
                t = single[a] @ single[b].T
                if same and x == y:
                    t[np.tril_indices(len(a))] = -9
                _top(t, best, other, where, a, b)
                _top(t.T, best, other, where, b, a)
        found = np.nonzero(where >= 0)[0]
        d = np.full(len(v), np.inf)
        d[found] = 1 - np.einsum("ij,ij->i", v[found], v[where[found]])
        close = found[best[found] - other[found] <= 2 * _error(v.shape[1])]
        for mine, theirs in ((left, right),) if same else ((left, right), (right, left)):  # what single precision cannot tell apart
            mine = np.intersect1d(mine, close)
            for x in range(0, len(mine), _TILE):
                rows_of = mine[x : x + _TILE]
                t = v[rows_of] @ v[theirs].T
                t[rows_of[:, None] == theirs[None]] = -9
                at = t.argmax(1)
                where[rows_of], d[rows_of] = theirs[at], 1 - t[np.arange(len(rows_of)), at]
        return pd.DataFrame({"c": ids[found], "other": ids[where[found]], "d": d[found]})

    found = rows.groupBy("x", "y").applyInPandas(f, "c long, other long, d double")
    return found.groupBy("c").agg(F.min(F.struct("d", "other")).alias("near")).select("c", "near.other", "near.d")


def _clusters(df: DataFrame, threshold: float | None = None, k: int | None = None) -> DataFrame:
    """id, cluster (least id of it) by average linkage of all vectors.

    Equal vectors join first, at height 0; zero vectors, at distance 1 from all, join each other before anything else at that
    distance. Then, in rounds, the clusters that are nearest to each other merge, which gives the tree of merging the closest
    two each time (see `linkage`); clusters with nothing below the threshold leave. Searches are dealt by pairs of blocks until
    what is left fits one task, which holds the mean of each cluster, not their distances.
    """
    rows = df.select("id", numbers.unit(F.col("v")).alias("s")).orderBy(F.asc_nulls_last("id")).select(F.monotonically_increasing_id().alias("node"), "id", "s")
    rows = written(rows, "vectors")
    same = Window.partitionBy("s")
    height = F.when(F.exists("s", lambda x: x != 0), F.lit(0.0)).otherwise(F.lit(1.0))
    copies = F.lit(True) if threshold is None else F.col("h") < threshold
    rows = rows.select("node", "id", "s", height.alias("h"))
    rows = rows.select("node", "id", "s", "h", F.when(copies, F.min("node").over(same)).otherwise(F.col("node")).alias("c"), F.when(copies, F.count("*").over(same)).otherwise(F.lit(1)).alias("n"))
    rows = written(rows, "copies")
    schema = "node long, parent long, h double, step int, place long"
    merges = [rows.where("node <> c").select("node", F.col("c").alias("parent"), "h", F.lit(0).alias("step"), F.col("node").alias("place"))]
    active = rows.where("node = c").select("c", F.transform("s", lambda x: x * F.col("n")).alias("s"), "n", F.when(F.col("n") > 1, F.col("h")).otherwise(F.lit(0.0)).alias("h"))
    left, step = active.count(), 0
    before = joined = left
    while left > MANY or (left > FEW and joined >= before / 6):
        before, step = left, step + 1
        near = written(_nearest(active, left), "near")
        if threshold is not None:
            near = near.where(F.col("d") < threshold)
            active = active.join(near.select("c"), "c", "left_semi")
        back = near.select(F.col("c").alias("other"), F.col("other").alias("c"))
        pairs = near.where("c < other").join(back, ["c", "other"]).select("c", "other", "d")
        found = pairs.select("c", F.col("c").alias("to"), "d").unionByName(pairs.select(F.col("other").alias("c"), F.col("c").alias("to"), "d"))
        rows_of = active.join(found, "c", "left").groupBy(F.coalesce("to", "c").alias("to")).agg(F.collect_list("s").alias("x"), F.sum("n").alias("n"), F.greatest(F.max("h"), F.max("d")).alias("h"), F.max("c").alias("last"))
        total = F.when(F.size("x") == 2, F.zip_with(F.get("x", F.lit(0)), F.get("x", F.lit(1)), lambda a, b: a + b)).otherwise(F.get("x", F.lit(0)))
        new = written(rows_of.select(F.col("to").alias("c"), total.alias("s"), "n", "h", "last"), "clusters")
        merges.append(new.where("last <> c").select(F.col("last").alias("node"), F.col("c").alias("parent"), "h", F.lit(step).alias("step"), F.col("last").alias("place")))
        active = new.drop("last")
        left, joined = new.agg(F.count("*"), F.count_if(F.col("last") != F.col("c"))).first()
        if not joined:
            break

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c", ignore_index=True)
        node, parent, h = linkage(_means(rows), rows.n.to_numpy(), rows.h.to_numpy(), threshold)
        # Merges that surely stay are followed here, so that paths are short below.
        surely = np.argsort(h, kind="stable")[: None if k is None else max(0, len(h) + 1 - max(k, 1))]
        to = np.arange(len(rows))
        to[node[surely]] = parent[surely]
        while (to != to[to]).any():
            to = to[to]
        ids = rows.c.to_numpy()
        return pd.DataFrame({"node": ids[node], "parent": ids[to[parent]], "h": h, "step": step + 1, "place": np.arange(len(h))})

    merges.append(active.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(f, schema))
    tree = merges[0]
    for x in merges[1:]:
        tree = tree.unionByName(x)
    tree = written(tree, "merges")
    if k is not None:
        tree = tree.join(tree.orderBy(F.desc("h"), F.desc("step"), F.desc("place")).limit(max(k, 1) - 1).select("node"), "node", "left_anti")
    tree = tree.select("node", "parent")
    while True:
        far = tree.select(F.col("node").alias("parent"), F.col("parent").alias("far"))
        new = written(tree.join(far, "parent", "left").select("node", F.coalesce("far", "parent").alias("parent"), F.col("far").isNotNull().alias("moved")), "tree")
        tree = new.select("node", "parent")
        if new.where("moved").isEmpty():
            break
    names = rows.select(F.col("node").alias("parent"), F.col("id").alias("name"))
    out = rows.select("node", "id").join(tree, "node", "left").join(names, "parent", "left")
    return out.select("id", F.coalesce("name", "id").alias("cluster"))


def agglomerative(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    """id, cluster (least id of it) by average linkage cut at `threshold`. df: id, v."""
    return _clusters(df, threshold)


def agglomerative_k(df: DataFrame, k: int = 10) -> DataFrame:
    """id, cluster (least id of it): average linkage down to k clusters. df: id, v."""
    return _clusters(df, k=k)


def dbscan(df: DataFrame, eps: float = 0.1, min_samples: int = 2) -> DataFrame:
    """id, cluster (least core id of it, -1 for noise): density clusters; a border point joins its least core neighbour's. df: id, v."""
    df = written(df.select("id", "v"), "vectors")
    near = written(vectors.close_pairs(df, np.nextafter(eps, 2)).select("a", "b"), "near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("a").alias("node"))
    core = df.select(F.col("id").alias("node")) if min_samples <= 1 else core
    links = near.join(core.withColumnRenamed("node", "a"), "a", "left_semi").join(core.withColumnRenamed("node", "b"), "b", "left_semi")
    parts = components(core, links)
    border = both.join(parts.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min_by("component", "b").alias("near"))
    out = df.select("id").join(parts.withColumnRenamed("node", "id"), "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("component", "near", F.lit(-1)).alias("cluster"))


def project(df: DataFrame, k: int = 50) -> DataFrame:
    """id, v: standardised vectors on their first k principal components. df: id, v."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    size = df.select(F.size("v")).first()
    rows = df.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("v"))
    if size is None:
        return df.select("id", F.col("v").cast("array<double>"))
    steps = Pipeline(stages=[StandardScaler(inputCol="v", outputCol="s", withMean=True), PCA(k=min(k, size[0]), inputCol="s", outputCol="p")])
    return steps.fit(rows).transform(rows).select("id", vector_to_array("p").alias("v"))

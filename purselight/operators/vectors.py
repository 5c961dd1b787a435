"""Embeddings: exact neighbours in blocks, outliers by label, clusters, centroids, features from clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from purselight.functions import numbers
from purselight.plans.scratch import written


def _blocks(df: DataFrame, size: int) -> tuple[DataFrame, int]:
    """id, v (unit vector), block: blocks of about `size` rows by a hash of the id."""
    n = max(1, -(-df.count() // size))
    return df.select("id", numbers.unit(F.col("v")).alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def _block_pairs(df: DataFrame, size: int, f: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over each ordered pair of blocks: rows id, v, block, side. A task holds two blocks, never a whole table."""
    rows, n = _blocks(df, size)
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "v", F.col("block").alias("x"), other.alias("y"), F.lit(0).alias("side"))
    right = rows.select("id", "v", F.col("block").alias("y"), other.alias("x"), F.lit(1).alias("side")).select("id", "v", "x", "y", "side")
    return left.unionByName(right).groupBy("x", "y").applyInPandas(f, schema)


def neighbours(df: DataFrame, k: int, size: int = 2048) -> DataFrame:
    """id, other, distance, rank: the k nearest others by cosine distance, ties by id. df: id, v."""

    def f(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows[rows.side == s].sort_values("id") for s in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "other": [], "distance": []}).astype({"id": "int64", "other": "int64", "distance": "float64"})
        d = 1 - np.stack(a.v) @ np.stack(b.v).T
        d[a.id.to_numpy()[:, None] == b.id.to_numpy()[None]] = np.inf
        best = np.argsort(d, 1, kind="stable")[:, :k]
        out = pd.DataFrame({"id": np.repeat(a.id.to_numpy(), best.shape[1]), "other": b.id.to_numpy()[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()})
        return out[np.isfinite(out.distance)]

    found = _block_pairs(df, size, f, "id long, other long, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def close_pairs(df: DataFrame, most: float, size: int = 2048) -> DataFrame:
    """a, b (a < b), distance below `most`. df: id, v."""

    def f(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows[rows.side == s] for s in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "distance": []}).astype({"a": "int64", "b": "int64", "distance": "float64"})
        d = 1 - np.stack(a.v) @ np.stack(b.v).T
        i, j = np.nonzero((d < most) & (a.id.to_numpy()[:, None] < b.id.to_numpy()[None]))
        return pd.DataFrame({"a": a.id.to_numpy()[i], "b": b.id.to_numpy()[j], "distance": d[i, j]})

    return _block_pairs(df, size, f, "a long, b long, distance double")


def label_outliers(df: DataFrame, k: int = 5) -> DataFrame:
    """id, label, n_same, is_outlier: fewer than k / 2 of the k nearest others share the label. df: id, v, label."""
    near = neighbours(df.select("id", "v"), k)
    labels = df.select("id", "label")
    rows = near.join(labels, "id").join(labels.select(F.col("id").alias("other"), F.col("label").alias("other_label")), "other")
    counts = rows.groupBy("id").agg(F.count_if(F.col("label") == F.col("other_label")).alias("n_same"))
    return labels.join(counts, "id", "left").select("id", "label", F.coalesce("n_same", F.lit(0)).alias("n_same"), (2 * F.coalesce("n_same", F.lit(0)) < k).alias("is_outlier"))


def cluster_spread(rows: DataFrame, n_labels: int, min_diff: float = 0.02, min_size: int = 1) -> DataFrame:
    """cluster, size, spread, kept: whether class shares differ by min_diff or more. rows: cluster (-1: none), label."""
    shares = [F.count_if(F.col("label") == k) / F.count("*") for k in range(n_labels)]
    spread = (F.greatest(*shares) - F.least(*shares)) if n_labels > 1 else F.lit(0.0)
    out = rows.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("size"), spread.alias("spread"))
    return out.withColumn("kept", (F.col("spread") >= min_diff) & (F.col("size") >= min_size))


def centroids(rows: DataFrame) -> DataFrame:
    """cluster, centroid (mean, put to length 1). rows: cluster, v."""
    mean = rows.where("cluster >= 0").groupBy("cluster").agg(Summarizer.mean(array_to_vector(F.col("v").cast("array<double>"))).alias("v")).select("cluster", vector_to_array("v").alias("v"))
    return mean.select("cluster", numbers.unit(F.col("v")).alias("centroid"))


def assign_nearest(df: DataFrame, centres: DataFrame, most: float = 0.45, limit: int = 100_000) -> DataFrame:
    """id, cluster (-1 beyond `most`), distance to the nearest centroid, ties by cluster. df: id, v.

    The centroids go to every task as one matrix; there may be `limit` of them at most.
    """
    found = centres.orderBy("cluster").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} centroids")
    if not found:
        return df.select("id", F.lit(-1).cast("long").alias("cluster"), F.lit(None).cast("double").alias("distance"))
    ids, matrix = np.array([r.cluster for r in found]), np.array([r.centroid for r in found], float)
    sizes = np.linalg.norm(matrix, axis=1)
    matrix = matrix / np.where(sizes > 0, sizes, 1)[:, None]

    def f(batches):
        for rows in batches:
            if len(rows):
                v = np.stack(rows.v).astype(float)
                n = np.linalg.norm(v, axis=1)
                d = 1 - (v / np.where(n > 0, n, 1)[:, None]) @ matrix.T
                best = d.argmin(1)
                least = d[np.arange(len(d)), best]
                yield pd.DataFrame({"id": rows.id, "cluster": np.where(least <= most, ids[best], -1), "distance": least})

    return df.select("id", "v").mapInPandas(f, "id long, cluster long, distance double")


def cluster_counts(clients: DataFrame, rows: DataFrame, clusters: list[int]) -> DataFrame:
    """customer_id, label and cot_cluster_<id>: how many claims a client has in each cluster. rows: customer_id, cluster."""
    cells = [F.count_if(F.col("cluster") == c).cast("double").alias(f"cot_cluster_{c}") for c in clusters]
    wide = rows.groupBy("customer_id").agg(*cells) if cells else rows.select("customer_id").distinct()
    return clients.select("customer_id", "label").join(wide, "customer_id", "left").na.fill(0.0, [f"cot_cluster_{c}" for c in clusters])


def cluster_meta(rows: DataFrame, examples: int = 10) -> DataFrame:
    """cluster, size, label_counts (map), examples (first by id). rows: id, cluster, label, claim."""
    rows = rows.where("cluster >= 0")
    counts = rows.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.sum("n").alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where(F.col("k") <= examples)
    texts = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "claim"))).alias("x")).select("cluster", F.col("x.claim").alias("examples"))
    return counts.join(texts, "cluster")


def tfidf(docs: DataFrame, features: int = 384, pattern: str = r"(?u)\b\w\w+\b") -> DataFrame:
    """id, term, weight: tf * (ln((1 + n) / (1 + df)) + 1) of the most frequent terms, each document at length 1. docs: id, text.

    Of equally frequent terms the first in order of text are taken.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(pattern.replace("(?u)", "(?U)")), F.lit(0))
    counts = written(docs.select("id", F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")), "counts")
    stats = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features)
    n = docs.agg(F.count("*").alias("n"))
    idf = stats.crossJoin(n).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    rows = counts.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))  # `features` rows at most
    size = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return rows.join(size, "id").select("id", "term", (F.col("w") / F.col("size")).alias("weight"))


def tfidf_vectors(docs: DataFrame, features: int = 384) -> DataFrame:
    """id, v: tfidf() as dense vectors over the sorted terms; documents without a term have zeros."""
    rows = tfidf(docs, features)
    terms = [r.term for r in rows.select("term").distinct().orderBy("term").collect()]  # `features` rows at most
    place = F.create_map(*(F.lit(x) for i, t in enumerate(terms) for x in (t, i))) if terms else F.create_map().cast("map<string,int>")
    cells = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(place[F.col("term")].alias("i"), "weight"))).alias("m"))
    out = docs.select("id").join(cells, "id", "left")
    return out.select("id", F.transform(F.sequence(F.lit(0), F.lit(max(len(terms) - 1, 0))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))


def embed(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """id, v from an encoder, made once in each task, of batches of texts; vectors are put to length 1. texts: id, text."""

    def f(batches):
        encode = encoder()
        for rows in batches:
            for a in range(0, len(rows), batch):
                part = rows.iloc[a : a + batch]
                yield pd.DataFrame({"id": part.id, "v": [x.tolist() for x in np.asarray(encode(part.text.tolist()), float)]})

    out = texts.select("id", "text").mapInPandas(f, "id long, v array<double>")
    return out.select("id", numbers.unit(F.col("v")).alias("v"))


def hash_encoder(size: int = 32) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A deterministic stand-in for a sentence model: hashed character trigrams."""

    def make() -> Callable[[list[str]], np.ndarray]:
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for row, text in zip(out, texts, strict=True):
                text = f"  {(text or '').lower()} "
                for i in range(len(text) - 2):
                    row[zlib.crc32(text[i : i + 3].encode()) % size] += 1
            return out

        return encode

    return make

"""Reproducible splits and samples of clients, ranked by a hash of the id and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(key: str = "customer_id", seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def assign(clients: DataFrame, train: float = 0.7, val: float = 0.1, by: str | None = "label", seed: int = 42) -> DataFrame:
    """clients with column split: by hash rank, the first share is train, the next val, the rest test.

    With `by`, shares hold within each of its values. Ranks are counted within hash prefixes whose sizes are summed
    before, so that no task sorts all clients.
    """
    group = [by] if by else []
    rows = clients.withColumn("draw", draw(seed=seed)).withColumn("prefix", F.substring("draw", 1, 3))
    sizes = rows.groupBy(*group, "prefix").agg(F.count("*").alias("size"))
    part = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = part.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("total", F.sum("size").over(part)).drop("size")
    rank = F.row_number().over(Window.partitionBy(*group, "prefix").orderBy("draw", "customer_id")) + F.col("before")
    place = (rank - 1) / F.col("total")
    out = rows.join(sizes, [*group, "prefix"]).withColumn("split", F.when(place < train, "train").when(place < train + val, "val").otherwise("test"))
    return out.select(*clients.columns, "split")


def members(trx: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    return trx.join(splits.where(F.col("split") == split).select("customer_id"), "customer_id", "left_semi")


def others(trx: DataFrame, clients: DataFrame) -> DataFrame:
    return trx.join(clients.select("customer_id"), "customer_id", "left_anti")


def leakage(splits: DataFrame) -> DataFrame:
    """customer_id, n_splits of clients in several splits."""
    return splits.groupBy("customer_id").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def capped(clients: DataFrame, most: int, n_labels: int, seed: int = 42) -> DataFrame:
    """`most` clients: an equal number of each label first, then others by hash rank.

    Only the first `most` clients of each label by hash can be among them. They are ranked within hash prefixes, whose
    sizes are summed before, so that no task sorts all clients of a label.
    """
    each = max(1, most // max(n_labels, 1))
    rows = clients.withColumn("draw", draw(seed=seed)).withColumn("prefix", F.substring("draw", 1, 4))
    before = Window.partitionBy("label").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows a label
    sizes = rows.groupBy("label", "prefix").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    near = rows.join(sizes.where(F.col("before") < most).withColumnRenamed("label", "of"), (F.col("label").eqNullSafe(F.col("of"))) & (rows["prefix"] == sizes["prefix"])).drop("of", "size").drop(sizes["prefix"])
    ranked = near.withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("label", "prefix").orderBy("draw", "customer_id")))
    return ranked.orderBy(F.when(F.col("k") <= each, 0).otherwise(1), "draw", "customer_id").limit(most).select(*clients.columns)


def few_shot(clients: DataFrame, per_class: int, seed: int = 42) -> DataFrame:
    """The first clients of each label by hash rank."""
    ranked = clients.where("label >= 0").withColumn("draw", draw(seed=seed)).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("draw", "customer_id")))
    return ranked.where(F.col("k") <= per_class).drop("draw", "k")

"""Written intermediate tables, and connected components over them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_TOPS: set[str] = set()
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        where = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="purselight-")
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    top = f"{shared_dir(spark)}/purselight-plans-{spark.sparkContext.applicationId}"
    if top not in _TOPS and top.startswith(("file:", "/")):
        _TOPS.add(top)
        atexit.register(shutil.rmtree, top.removeprefix("file:").replace("//", "/"), ignore_errors=True)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what follows does not depend on lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (least node reached) for nodes (node) under undirected edges (a, b).

    Every round a node takes the least label around it, and the label of that label.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(nodes.select("node", F.col("node").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", "component", F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        new = written(step.join(jump, "new", "left").select("node", "component", F.least("new", "far").alias("new")), "labels")
        labels = new.select("node", F.col("new").alias("component"))
        if new.where("component <> new").isEmpty():
            return labels
    raise RuntimeError("components did not settle")

"""Classification metrics over a table of labels y, predictions p and scores."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from purselight.functions import numbers


def confusion(df: DataFrame, labels: list[int]) -> DataFrame:
    """y, p, n for every pair of labels, also those that do not occur."""
    pairs = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "y int, p int")
    counts = df.groupBy(F.col("y").cast("int").alias("y"), F.col("p").cast("int").alias("p")).agg(F.count("*").alias("n"))
    return pairs.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))


def by_class(matrix: DataFrame) -> DataFrame:
    """label, support, predicted, hits, precision, recall, f1 (0 where undefined)."""
    rows = matrix.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    cols = matrix.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    out = rows.join(cols, "label").withColumns({"precision": numbers.share(F.col("hits"), F.col("predicted")), "recall": numbers.share(F.col("hits"), F.col("support"))})
    return out.withColumn("f1", numbers.share(2 * F.col("hits"), F.col("support") + F.col("predicted")))


def summary(matrix: DataFrame) -> DataFrame:
    """One row: n, accuracy, balanced accuracy, F1 (macro and weighted), Matthews correlation, Cohen's kappa.

    Classes without rows and predictions are left out of macro means; those without rows of balanced accuracy.
    """
    c = by_class(matrix).where("support + predicted > 0")
    total, hits = F.sum("support").cast("double"), F.sum("hits").cast("double")
    chance = F.sum(F.col("support").cast("double") * F.col("predicted").cast("double"))
    yy, pp = F.sum(F.col("support").cast("double") * F.col("support")), F.sum(F.col("predicted").cast("double") * F.col("predicted"))
    out = c.agg(
        F.sum("support").alias("n"), (hits / total).alias("accuracy"), (F.sum("recall") / F.count_if(F.col("support") > 0)).alias("balanced_accuracy"), (F.sum("f1") / F.count("*")).alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1_weighted"), hits.alias("h"), total.alias("t"), chance.alias("c"), yy.alias("yy"), pp.alias("pp"),
    )
    h, t, ch = F.col("h"), F.col("t"), F.col("c")
    mcc = numbers.share(h * t - ch, F.sqrt(t * t - F.col("pp")) * F.sqrt(t * t - F.col("yy")))
    kappa = F.coalesce(F.try_divide(h * t - ch, t * t - ch), F.lit(0.0))
    return out.select("n", "accuracy", "balanced_accuracy", "f1_macro", "f1_weighted", mcc.alias("mcc"), kappa.alias("kappa"))


def roc_auc(df: DataFrame, pieces: int = 64) -> DataFrame:
    """One row: roc_auc of y (0 or 1) and score, equal scores counted half; null and an error text with one class only.

    Scores are counted first; their cumulative counts are taken within ranges of scores, whose sums are added before,
    so that no task sorts all scores.
    """
    counts = df.where("score is not null").groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    cuts = counts.agg(F.percentile_approx("score", [i / pieces for i in range(1, pieces)], 1000).alias("q")).first().q or []
    piece: Column = F.lit(0)
    for q in sorted(set(cuts)):
        piece = piece + (F.col("score") > F.lit(q)).cast("int")
    rows = counts.withColumn("piece", piece)
    sums = rows.groupBy("piece").agg(F.sum("neg").alias("size"))
    before = sums.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")  # `pieces` rows
    inside = Window.partitionBy("piece").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("lower", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(before), "piece")  # `pieces` rows
    wins = F.sum(F.col("pos") * (2 * (F.col("lower") + F.col("before")) + F.col("neg")))
    out = ranked.agg(wins.alias("w"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))
    auc = F.try_divide(F.col("w").cast("double"), 2.0 * F.col("n_pos") * F.col("n_neg"))
    return out.select("n_pos", "n_neg", auc.alias("roc_auc"), F.when(auc.isNull(), "only one class has rows").alias("roc_auc_error"))


def roc_auc_ovr(df: DataFrame, labels: list[int]) -> DataFrame:
    """One row: mean over labels of the AUC of label against the rest; column scores is an array by label. One class without rows gives null."""
    parts = [roc_auc(df.select((F.col("y") == k).cast("int").alias("y"), F.col("scores")[i].alias("score"))) for i, k in enumerate(labels)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.when(F.count("roc_auc") == len(labels), F.avg("roc_auc")).alias("roc_auc_ovr_macro"))


METRICS = ("accuracy", "roc_auc", "balanced_accuracy", "f1_macro", "f1_weighted", "mcc", "n", "coverage")


def flatten(document: dict, family: str, method: str | None = None) -> list[tuple]:
    """Rows (family, method, split, *METRICS) of a document split -> metrics; coverage is 1 where only accuracy is known."""
    rows = []
    for split, m in document.items():
        cover = m.get("coverage", 1.0 if m.get("accuracy") is not None else None)
        n = m.get("n") or m.get("n_scored_clients")
        rows.append((family, method, split, *(m.get(k) for k in METRICS[:-2]), n, cover))
    return rows


def results(rows: DataFrame) -> DataFrame:
    """Result rows (place, family, method, split, ...) without repetitions: the first by place stays; sort with result_order()."""
    first = F.row_number().over(Window.partitionBy("family", "method", "split").orderBy("place"))
    return rows.withColumn("k", first).where("k = 1").drop("k", "place")


def result_order() -> list[Column]:
    return [F.col("split"), F.desc_nulls_last("accuracy")]


def adapter_metric(document: dict, split: str, name: str):
    """A metric that runs stored under one of several keys: <split>_<name>, <split>.eval_<name>, eval_<name>, <name>."""
    part = document.get(split) if isinstance(document.get(split), dict) else {}
    for value in (document.get(f"{split}_{name}"), part.get(f"eval_{name}"), part.get(name), document.get(f"eval_{name}") if not part else None):
        if value is not None:
            return value
    return None


def adapter_rows(folder: str, splits: tuple[str, ...] = ("val", "test"), name: str = "metrics.json") -> list[tuple]:
    """Result rows of trained adapters: <folder>/<run>/<name> for each run, else the runs of <folder>/summary.json."""
    found = {p.parent.name: json.loads(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob(f"*/{name}"))}
    whole = Path(folder) / "summary.json"
    if not found and whole.exists():
        found = {r["name"]: r["metrics"] for r in json.loads(whole.read_text(encoding="utf-8")) if r.get("metrics")}
    rows = []
    for run, document in found.items():
        for split in splits:
            values = {m: adapter_metric(document, split, m) for m in METRICS}
            if any(v is not None for v in values.values()):
                rows += flatten({split: {k: v for k, v in values.items() if v is not None}}, "adapter", run)
    return rows

"""The whole course: splits, profiles, prompts, answers, claims, cluster features, models, results.

Each step takes and returns DataFrames; steps that fit something fit it on the training split only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselight.functions import text
from purselight.operators import claims, clustering, features, hooks, metrics, models, pivot, profile, splits, summary, vectors
from purselight.plans.scratch import written
from purselight.schema import Settings

#: Labelled splits of a course.
SPLITS = ("train", "val", "test")


def split_transactions(trx: DataFrame, seed: int = 42) -> DataFrame:
    """trx with column split: 70, 10 and 20 percent of the clients of each label."""
    parts = splits.assign(features.client_labels(trx), seed=seed).select("customer_id", "split")
    return trx.join(parts, "customer_id")


def statistics(trx: DataFrame, settings: Settings) -> tuple[str, DataFrame]:
    """The training split's class summary, and profiles of all clients with their split."""
    train = trx.where("split = 'train'").drop("split")
    text_of = summary.summary_text(train, settings.label_names, settings.category_label, settings.churn_profile)
    known = trx.select("customer_id", "split").distinct()
    return text_of, profile.profiles(trx.drop("split"), settings).join(known, "customer_id")


def few_shot(profiles: DataFrame, per_class: int = 1, seed: int = 42) -> str:
    """Examples of the training split, some of each class."""
    chosen = splits.few_shot(profiles.where("split = 'train'"), per_class, seed).orderBy("label", splits.draw(seed=seed), "customer_id")
    return claims.few_shot_text([(r.label_name, r.client_stats) for r in chosen.collect()])  # per_class rows of each class


def explanations(profiles: DataFrame, template: str, system: str, summary_text: str, examples: str, client: Callable, settings: Settings, samples: int = 1, concurrent: int = 16) -> DataFrame:
    """customer_id, label, label_name, split, sample_id, explanation, predicted_raw, predicted, execution_time, error."""
    rows = claims.dialogues(claims.prompts(profiles, template, system, summary_text, examples), samples)
    said = hooks.complete(rows.select("customer_id", "label", "label_name", "split", "sample_id", "messages"), client, concurrent)
    raw = text.boxed(F.col("explanation"))
    return said.withColumn("predicted_raw", raw).withColumn("predicted", text.label_of(F.col("predicted_raw"), settings.label_names))


def extracted_claims(answers: DataFrame, template: str, system: str, client: Callable, samples: int | None = None, concurrent: int = 16) -> DataFrame:
    """customer_id, label, claims: asked for each non-empty explanation (of the first samples), merged per client."""
    rows = answers.where("explanation is not null and explanation <> ''")
    rows = rows.where(F.col("sample_id") < samples) if samples else rows
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    asked = rows.select("customer_id", "label", "sample_id", F.array(message("system", F.lit(system)), message("user", F.replace(F.lit(template), F.lit("{COT}"), F.col("explanation")))).alias("messages"))
    said = hooks.complete(asked, client, concurrent).withColumn("claims", text.claims_of(F.col("explanation")))
    return claims.merge_claims(said)


@dataclass
class Clusters:
    """Clusters of training claims that separate the classes: their centroids and members."""

    centroids: DataFrame
    members: DataFrame  #: id, customer_id, label, claim, v, cluster (-1: none)
    clusters: list[int]


def embedded(rows: DataFrame, encoder: Callable) -> DataFrame:
    """Flat claims with id and unit vector v."""
    rows = rows.withColumn("id", F.xxhash64("customer_id", "place", "claim"))
    return rows.join(vectors.embed(rows.select("id", F.col("claim").alias("text")), encoder), "id")


def fit_clusters(rows: DataFrame, encoder: Callable, num_labels: int, threshold: float = 0.01, min_size: int = 2, min_diff: float = 0.02, drop_outliers: bool = False) -> Clusters:
    """Clusters of the flat training claims; with drop_outliers, claims that disagree with their neighbours are left out first."""
    rows = written(embedded(rows, encoder), "claims")
    if drop_outliers:
        odd = vectors.label_outliers(rows.select("id", "v", "label")).where("is_outlier")
        rows = rows.join(odd.select("id"), "id", "left_anti")
    rows = written(rows.join(clustering.agglomerative(rows.select("id", "v"), threshold), "id"), "clustered")
    # Clusters are named by the id of a member, which is any number: number them.
    kept = rows.withColumn("cluster", F.abs("cluster"))
    good = vectors.cluster_spread(kept, num_labels, min_diff, min_size).where("kept").select("cluster")
    names = [r.cluster for r in good.orderBy("cluster").collect()]
    if not names:
        raise ValueError("no cluster separates the classes; lower the thresholds")
    kept = kept.join(good.withColumn("good", F.lit(True)), "cluster", "left").withColumn("cluster", F.when(F.col("good"), F.col("cluster")).otherwise(-1)).drop("good")
    kept = written(kept, "members")
    return Clusters(written(vectors.centroids(kept), "centroids"), kept, names)


def cluster_features(fitted: Clusters, clients: DataFrame, rows: DataFrame | None = None, encoder: Callable | None = None, most: float = 0.45) -> DataFrame:
    """customer_id, label and cot_cluster_<id> counts: of the members, or of other flat claims by nearest centroid."""
    if rows is None:
        return vectors.cluster_counts(clients, fitted.members.select("customer_id", "cluster"), fitted.clusters)
    other = embedded(rows, encoder)
    near = vectors.assign_nearest(other.select("id", "v"), fitted.centroids, most)
    return vectors.cluster_counts(clients, other.select("id", "customer_id").join(near, "id").select("customer_id", "cluster"), fitted.clusters)


def evaluate(predicted: DataFrame, labels: list[int]) -> dict:
    """Metrics of predictions (y, p, score, scores) of labelled rows, as one document."""
    rows = written(predicted.where("y >= 0"), "predicted")
    out = metrics.summary(metrics.confusion(rows, labels)).first().asDict()
    out = {k: round(v, 4) if isinstance(v, float) else v for k, v in out.items()}
    matrix = {(r.y, r.p): r.n for r in metrics.confusion(rows, labels).collect()}
    out["confusion_matrix"] = [[matrix[(a, b)] for b in labels] for a in labels]
    if len(labels) == 2:
        auc = metrics.roc_auc(rows).first()
        out |= {"roc_auc": round(auc.roc_auc, 4)} if auc.roc_auc is not None else {"roc_auc_error": auc.roc_auc_error}
    elif "scores" in rows.columns:
        out["roc_auc_ovr_macro"] = metrics.roc_auc_ovr(rows, labels).first()[0]
    return out


def ml_baseline(tables: dict[str, dict[str, DataFrame]], num_labels: int, tune: bool = False, metric: str = "accuracy") -> dict:
    """Metrics by feature set, model and split. tables: feature set -> split -> features, with a split train in each.

    Splits without labels are predicted for, but not measured.
    """
    out: dict = {}
    for name, parts in tables.items():
        for kind, fit in (("boosted", models.boosted), ("tree", models.tree)):
            model = fit(parts["train"], num_labels=num_labels, tune=tune, metric=metric)
            for split, rows in parts.items():
                if split == "train":
                    continue
                found = out.setdefault(name, {}).setdefault(kind, {})
                measured = rows.where("label >= 0").isEmpty()
                found[split] = {"metrics_skipped": "no labels"} if measured else evaluate(model.predict(rows), list(range(num_labels)))
    return out


def concat_tables(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Both feature sets side by side, split by split."""
    return {split: pivot.concat_features(left[split], right[split]) for split in left if split in right}


def handcrafted_tables(trx: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Handcrafted features by split, with the training split's categories."""
    values = pivot.frozen_categories(trx.where("split = 'train'"))
    out = {}
    for split in SPLITS:
        rows = trx.where(F.col("split") == split).drop("split")
        out[split] = pivot.handcrafted(rows, features.add_features(rows), values, settings.churn_profile)
    return out

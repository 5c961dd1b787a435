"""Classifiers on feature tables: boosted trees and a decision tree, tuned or with fixed parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselight.operators import pivot


@dataclass
class Fitted:
    """A model and the columns it was fitted on; other tables are aligned with them."""

    model: PipelineModel
    columns: list[str]
    num_labels: int

    def predict(self, features: DataFrame) -> DataFrame:
        """customer_id, y, p, score (of label 1) and scores (by label)."""
        rows = self.model.transform(pivot.align(features, self.columns))
        scores = vector_to_array("probability")
        return rows.select("customer_id", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"), F.try_element_at(scores, F.lit(2)).alias("score"), scores.alias("scores"))

    def tree_text(self, size: int = 4000) -> str:
        return self.model.stages[-1].toDebugString[:size]


def _columns(train: DataFrame) -> list[str]:
    columns = pivot.feature_columns(train)
    if not columns:
        raise ValueError("no feature columns")
    return columns


def _fit(train: DataFrame, classifier, columns: list[str], grid: list | None, folds: int, metric: str, num_labels: int, seed: int) -> Fitted:
    rows = pivot.align(pivot.labelled(train), columns).withColumn("label", F.col("label").cast("double"))
    steps = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), classifier])
    if not grid:
        return Fitted(steps.fit(rows), columns, num_labels)
    judge = BinaryClassificationEvaluator(metricName="areaUnderROC") if num_labels == 2 and metric == "roc_auc" else MulticlassClassificationEvaluator(metricName="accuracy")
    best = CrossValidator(estimator=steps, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed, parallelism=2).fit(rows)
    return Fitted(best.bestModel, columns, num_labels)


def boosted(train: DataFrame, num_labels: int = 2, tune: bool = False, metric: str = "accuracy", folds: int = 3, seed: int = 42, depth: int = 4, iterations: int = 20) -> Fitted:
    """Boosted trees for two classes, a random forest for more."""
    if num_labels == 2:
        model = GBTClassifier(maxDepth=depth, maxIter=iterations, stepSize=0.1, seed=seed)
        grid = ParamGridBuilder().addGrid(model.maxDepth, [3, 5]).addGrid(model.maxIter, [10, 30]).build()
    else:
        model = RandomForestClassifier(maxDepth=depth, numTrees=iterations, seed=seed)
        grid = ParamGridBuilder().addGrid(model.maxDepth, [4, 8]).addGrid(model.numTrees, [20, 60]).build()
    return _fit(train, model, _columns(train), grid if tune else None, folds, metric, num_labels, seed)


def tree(train: DataFrame, num_labels: int = 2, tune: bool = False, metric: str = "accuracy", folds: int = 3, seed: int = 42, depth: int = 5, leaf: int = 5, impurity: str = "gini") -> Fitted:
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=leaf, impurity=impurity, seed=seed)
    grid = ParamGridBuilder().addGrid(model.maxDepth, [2, 4, 8]).addGrid(model.minInstancesPerNode, [1, 10]).addGrid(model.impurity, ["gini", "entropy"]).build()
    return _fit(train, model, _columns(train), grid if tune else None, folds, metric, num_labels, seed)


def majority(clients: DataFrame, label: int) -> DataFrame:
    """customer_id, y, p with one label for all."""
    return clients.select("customer_id", F.col("label").alias("y"), F.lit(label).alias("p"))

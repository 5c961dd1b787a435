import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from purselight import schema
from purselight.operators import claims, clustering, features, metrics, models, pivot, profile, splits, summary, vectors

TRX = "customer_id long, tr_datetime timestamp, amount double, mcc_code_desc string, label int"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def one(df):
    (row,) = df.collect()
    return row.asDict()


def test_expense_percentile_keeps_the_smallest_expenses(spark):
    rows = [(1, at(1), v, c, 0) for c, v in (("food", -10.0), ("rent", -500.0), ("taxi", -50.0), ("kids", -5.0), ("pay", -90.0))]
    spent = profile.categories(spark.createDataFrame(rows, TRX), only=F.col("amount") < 0)
    (row,) = profile.top_percentile(spent, "total", 0.8).collect()
    assert row.category == "kids" and row.threshold == pytest.approx(-9.0)


def test_missing_time(spark):
    row = one(features.add_features(spark.createDataFrame([(1, None, 5.0, "a", 0)], TRX)))
    assert (row["hour"], row["weekday"], row["day"], row["period_of_day"], row["weekday_name"], row["is_weekend"]) == (0, 0, 0, "ночь", "Пн", 0)
    two = spark.createDataFrame([(1, at(3), 5.0, "a", 0), (1, None, 1.0, "a", 0)], TRX)
    legacy = one(pivot.legacy_features(two, ["a"]))
    assert (legacy["active_months"], legacy["active_days"]) == (2, 1)
    assert one(profile.core(two))["active_months"] == 1


def test_single_transaction(spark):
    df = spark.createDataFrame([(1, at(3), 5.0, "a", 0)], TRX)
    assert one(profile.amounts(df))["amount_std"] == 0.0
    assert profile.dynamics(df, types=False).count() == 0
    assert one(summary.client_features(df))["recency_ratio"] == 1.0
    same = spark.createDataFrame([(1, at(3), 5.0, "a", 0)] * 2, TRX)
    assert profile.dynamics(same, types=False).count() == 0


def test_null_amounts_count_as_rows_only(spark):
    df = spark.createDataFrame([(1, at(3), None, "a", 0)], TRX)
    assert one(pivot.category_features(df, ["a"]))["cnt_a"] == 0
    assert one(summary.category_means(df))["mean"] == 1.0
    row = one(profile.core(df))
    assert row["n_txn"] == 1 and row["avg_income"] is None and row["total_income"] == 0.0


def test_category_features_add_up_names_that_collide(spark):
    df = spark.createDataFrame([(1, at(3), 2.0, "a b", 0), (1, at(3), 3.0, "a/b", 0)], TRX)
    row = one(pivot.category_features(df))
    assert row["cnt_a_b"] == 2 and row["sum_a_b"] == 5.0
    with pytest.raises(ValueError):
        pivot.legacy_features(spark.createDataFrame([(1, at(3), 2.0, "a!b", 0), (1, at(3), 3.0, "a?b", 0)], TRX))


def test_frozen_schema(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 9.0)], "customer_id long, label int, x double, extra double")
    assert one(pivot.align(df, ["missing", "x"])) == {"customer_id": 1, "label": 0, "missing": 0.0, "x": 2.0}


def test_labels(spark):
    df = spark.createDataFrame([(1, at(3), 2.0, "a", 0), (1, at(2), 2.0, "a", 1), (2, at(2), 2.0, "a", 1)], TRX)
    assert [tuple(r) for r in features.inconsistent_clients(df).collect()] == [(1, 2)]
    with pytest.raises(Exception, match="several labels of client 1"):
        features.client_labels(df).collect()
    assert schema.id_and_label(["target", "client_ID"]) == ("client_ID", "target")
    with pytest.raises(ValueError, match="missing columns"):
        schema.require(df.drop("amount"))


def test_raw_export(spark):
    rows = [(7, 5411, 810, "21OCT17:13:08:28", "10.5", "POS", 1), (8, 1, 5, "bad", "x", "NEW", 0), (9, None, None, None, None, "BACK", 0)]
    got = features.prepare_churn(spark.createDataFrame(rows, "cl_id long, MCC int, currency int, TRDATETIME string, amount string, trx_category string, target_flag int")).orderBy("customer_id").collect()
    assert (got[0].mcc_code_desc, got[0].currency_name, got[0].amount) == ("Супермаркеты [оплата картой]", "Рубль", 10.5)
    assert (got[1].mcc_code_desc, got[1].currency_name, got[1].amount, got[1].tr_datetime) == ("Категория 1 [NEW]", "Валюта 5", 0.0, None)
    assert (got[2].mcc_code_desc, got[2].currency_name) == ("Категория nan [возврат средств]", "неизвестная валюта")


def test_profile_text(spark):
    rows = [(1, at(1, 10), 100.0, "зарплата", 1), (1, at(2, 11), -30.5, "еда", 1), (1, at(3), -1.0, "еда", 1)]
    names = schema.Settings(label_names={"0": "активный клиент", "1": "отток"})
    row = one(profile.profiles(spark.createDataFrame(rows, TRX), names))
    assert row["label_name"] == "отток"
    assert row["client_stats"] == (
        "* Период активности: 3 дней\n* Всего операций: 3\n* Среднее число операций в день: 1.0\n* Распределение по категории трат:\nеда = 2\n\n"
        "* Объем расходов по категории трат:\nеда = -32\n\n* Общий доход: 100.0\n* Средний доход на операцию: 100.0\n* Общие расходы: -31.5\n* Средний расход на операцию: -15.75"
    )
    churn = schema.Settings(label_names=names.label_names, churn_profile=True)
    trx = spark.createDataFrame(rows, TRX).withColumns({"trx_cat_ru": F.lit("оплата картой"), "currency_name": F.lit("Рубль")})
    text = one(profile.profiles(trx, churn))["client_stats"]
    assert "* Валюты операций: Рубль: 3\n" in text and "  - Последние месячные количества операций: 2024-01: 3" in text and text.endswith("* Максимальная сумма операции: 100.0")


def test_summary_text(spark):
    rows = [(c, at(d), 5.0, cat, c % 2) for c in range(4) for d in (1, 2) for cat in ("a", "b")]
    df = spark.createDataFrame(rows, TRX)
    text = summary.summary_text(df, {"0": "активный клиент", "1": "отток", "2": "нет"}, "категории", False)
    assert text.startswith("# Активный клиент\n## Среднее число транзакций по категории (активный клиент, 90-й перцентиль)\n| Категории |") and "| a | 2 |" in text and "# Нет" not in text
    assert "* recency_ratio: mean=1.000, median=1.000" in summary.summary_text(df, {"0": "x"}, "категории", True)


@settings(max_examples=4, deadline=None)
@given(st.integers(3, 200))
def test_splits_are_disjoint_and_sized(spark, n):
    clients = spark.range(n).selectExpr("id as customer_id", "cast(id % 2 as int) as label")
    rows = splits.assign(clients).collect()
    assert len({r.customer_id for r in rows}) == len(rows) == n
    for label in (0, 1):
        size = sum(r.label == label for r in rows)
        assert abs(sum(r.label == label and r.split == "train" for r in rows) - 0.7 * size) <= 1
    assert splits.leakage(splits.assign(clients)).count() == 0
    assert splits.capped(clients, 3, 2).count() == min(3, n)


def test_votes(spark):
    rows = [(1, 0, 0, 1, "b", None), (1, 0, 1, 0, "a", "e"), (2, 1, 3, None, None, "x"), (3, 1, 2, 1, "q", None), (3, 1, 1, 1, "p", None)]
    df = spark.createDataFrame(rows, "customer_id long, label int, sample_id int, predicted int, predicted_raw string, error string")
    got = {r.customer_id: r for r in claims.majority_vote(df).collect()}
    assert (got[1].prediction, got[1].score) == (0, 0.5) and (got[2].prediction, got[2].score) == (-1, None) and got[3].prediction == 1
    single = {r.customer_id: r for r in claims.single_sample(df).collect()}
    assert (single[3].sample_id_used, single[1].sample_id_used, single[2].prediction) == (1, 0, -1)
    raw = {r.customer_id: r for r in claims.raw_answers(df).collect()}
    assert raw[3].raw_answers == ["p", "q"] and raw[1].errors == ["e"]
    assert tuple(claims.coverage(claims.single_sample(df)).first()) == (3, 2, 1, pytest.approx(2 / 3))


def test_claims(spark):
    rows = [(1, 0, 1, ["Снимает", "покупает"]), (1, 0, 0, ["Покупает", "Клиент "])]
    df = spark.createDataFrame(rows, "customer_id long, label int, sample_id int, claims array<string>")
    merged = claims.merge_claims(df)
    assert one(merged)["claims"] == ["Покупает", "Клиент ", "Снимает"]
    assert [r.claim for r in claims.flatten_claims(merged, cyrillic_only=True, labelled_only=True).orderBy("place").collect()] == ["Покупает", "Снимает"]
    facts = spark.createDataFrame([(1, "f1", "мужчина"), (1, "f2", "женщина"), (1, "f3", None)], "customer_id long, fact string, gender string")
    assert one(claims.majority_facts(facts))["fact"] == "f2"
    prompts = spark.createDataFrame([(1, "s", "u")], "customer_id long, system_prompt string, user_prompt string")
    asked = claims.dialogues(prompts, 3).collect()
    assert sorted(r.sample_id for r in asked) == [0, 1, 2] and [(m.role, m.content) for m in asked[0].messages] == [("system", "s"), ("user", "u")]


def test_cluster_spread(spark):
    rows = [(0, i % 2) for i in range(10)] + [(1, int(i < 48)) for i in range(100)] + [(-1, 0)]
    got = {r.cluster: r.kept for r in vectors.cluster_spread(spark.createDataFrame(rows, "cluster int, label int"), 2).collect()}
    assert got == {0: False, 1: True}


def test_label_outliers(spark):
    v = lambda *x: [float(i) for i in x]
    rows = [(0, v(1, 0), 0), (1, v(1, 0.01), 0), (2, v(1, 0.02), 0), (3, v(0, 1), 1), (4, v(0.01, 1), 1), (5, v(1, 0.03), 1), (6, v(0, 0), 1)]
    got = {r.id: r.is_outlier for r in vectors.label_outliers(spark.createDataFrame(rows, "id long, v array<double>, label int"), 2).collect()}
    assert got[5] and not got[0] and not got[3]


def naive_linkage(v, threshold):
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        best = min(((np.mean([1 - v[a] @ v[b] for a in x for b in y]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j))
        if best[0] >= threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_agglomerative_equals_naive_linkage(spark):
    rng = np.random.default_rng(0)
    for threshold in (0.1, 0.3):
        v = rng.normal(size=(24, 3))
        v /= np.linalg.norm(v, axis=1)[:, None]
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
        groups = {}
        for r in clustering.agglomerative(df, threshold).collect():
            groups.setdefault(r.cluster, set()).add(r.id)
        assert {frozenset(g) for g in groups.values()} == naive_linkage(v, threshold)
    assert len(set(clustering.average_linkage(v, k=4))) == 4


def odd_vectors():
    """Copies, zero vectors, near copies around one vector, and vectors of no group; at length 1."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=5)
    near = centre + rng.normal(size=(15, 5)) * np.linspace(0.01, 0.1, 15)[:, None]
    v = np.vstack([rng.normal(size=(25, 5)), np.tile(rng.normal(size=5), (6, 1)), centre, near])
    v = np.vstack([v / np.linalg.norm(v, axis=1)[:, None], np.zeros((2, 5))])
    return v[rng.permutation(len(v))]


def grouped(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    assert all(min(g) == c for c, g in groups.items())
    return {frozenset(g) for g in groups.values()}


def many_vectors(spark):
    angle = np.radians([0, 1, 2, 40, 41, 120])
    places = F.array(*(F.array(F.lit(float(np.cos(a))), F.lit(float(np.sin(a)))) for a in angle))
    return spark.range(20_001).select("id", F.get(places, (F.col("id") % 6).cast("int")).alias("v"))


def test_agglomerative_in_rounds_equals_naive_linkage(spark, monkeypatch):
    monkeypatch.setattr(clustering, "FEW", 25)
    monkeypatch.setattr(clustering, "MANY", 25)
    v = odd_vectors()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    for threshold in (0.02, 0.4):
        assert grouped(clustering.agglomerative(df, threshold)) == naive_linkage(v, threshold)
    assert grouped(clustering.agglomerative(df, 0.0)) == {frozenset([i]) for i in range(len(v))}
    assert clustering.agglomerative(df.limit(0), 0.4).count() == 0


def test_agglomerative_of_many_vectors(spark):
    want = [0, 0, 0, 3, 3, 5]
    got = clustering.agglomerative(many_vectors(spark), 0.1).collect()
    assert len(got) == 20_001 and all(r.cluster == want[r.id % 6] for r in got)


def test_agglomerative_k_in_rounds_equals_naive_linkage(spark, monkeypatch):
    v = odd_vectors()
    v = v[np.linalg.norm(v, axis=1) > 0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    heights = np.linspace(0.001, 1.5, 400)
    sizes = [len(set(clustering.average_linkage(v, h))) for h in heights]
    for few, k in ((25, 9), (1000, 3)):
        monkeypatch.setattr(clustering, "FEW", few)
        monkeypatch.setattr(clustering, "MANY", few)
        assert grouped(clustering.agglomerative_k(df, k)) == naive_linkage(v, heights[sizes.index(k)])
    assert len(grouped(clustering.agglomerative_k(df, len(v) - 2))) == len(v) - 2
    assert len(grouped(clustering.agglomerative_k(df, len(v) + 5))) == len(v)


def test_agglomerative_k_of_many_vectors(spark):
    want = [0, 0, 0, 3, 3, 5]
    got = clustering.agglomerative_k(many_vectors(spark), 3).collect()
    assert len(got) == 20_001 and all(r.cluster == want[r.id % 6] for r in got)
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert sorted(map(tuple, clustering.agglomerative_k(twice, 2).collect())) == [(1, 1), (1, 1), (2, 1)]


def test_zero_vectors_join_each_other_first(spark):
    angle = np.radians([0, 120, 240, 1])
    v = [[float(np.cos(a)), float(np.sin(a))] for a in angle]
    df = spark.createDataFrame([(i, v[i] if i < 4 else [0.0, -0.0]) for i in range(12)], "id long, v array<double>")
    zeros = frozenset(range(4, 12))
    assert grouped(clustering.agglomerative_k(df, 4)) == {frozenset([0, 3]), frozenset([1]), frozenset([2]), zeros}
    assert len(grouped(clustering.agglomerative_k(df, 6))) == 6
    assert grouped(clustering.agglomerative(df, 1.0)) == {frozenset([0, 3])} | {frozenset([i]) for i in range(1, 12) if i != 3}
    assert len(grouped(clustering.agglomerative_k(df, 1))) == 1


def test_agglomerative_k_of_many_zero_vectors(spark):
    df = many_vectors(spark).withColumn("v", F.when(F.col("id") < 20_000, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.col("v")))
    assert grouped(clustering.agglomerative_k(df, 2)) == {frozenset(range(20_000)), frozenset([20_000])}


def test_dbscan(spark):
    angle = np.radians([0, 2, 4, 40, 42, 90])
    df = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)], "id long, v array<double>")
    got = {r.id: r.cluster for r in clustering.dbscan(df, 0.001, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: -1}


def test_centroids_and_assignment(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [0.0, -1.0], 7)], "id long, v array<double>, cluster int")
    centres = vectors.centroids(rows)
    got = {r.cluster: r.centroid for r in centres.collect()}
    assert got[5] == pytest.approx([2**-0.5, 2**-0.5]) and got[7] == [0.0, -1.0]
    found = {r.id: r.cluster for r in vectors.assign_nearest(rows, centres, 0.3).collect()}
    assert found == {0: 5, 1: 5, 2: 7}
    assert {r.cluster for r in vectors.assign_nearest(rows, centres.limit(0)).collect()} == {-1}
    meta = {r.cluster: r for r in vectors.cluster_meta(rows.withColumns({"label": F.lit(1), "claim": F.col("id").cast("string")})).collect()}
    assert (meta[5].size, meta[5].label_counts, meta[5].examples) == (2, {1: 2}, ["0", "1"])


def test_embedding_and_tfidf(spark):
    docs = spark.createDataFrame([(0, "aa bb bb"), (1, "aa cc"), (2, "")], "id long, text string")
    got = {r.id: r.v for r in vectors.embed(docs, vectors.hash_encoder(8)).collect()}
    assert np.linalg.norm(got[0]) == pytest.approx(1) and len(got[2]) == 8
    dense = {r.id: r.v for r in vectors.tfidf_vectors(docs, 3).collect()}
    assert np.linalg.norm(dense[0]) == pytest.approx(1) and dense[2] == [0.0, 0.0, 0.0]
    idf = {t: np.log(4 / (1 + d)) + 1 for t, d in (("aa", 2), ("bb", 1))}
    raw = np.array([idf["aa"], 2 * idf["bb"], 0])
    assert dense[0] == pytest.approx(list(raw / np.linalg.norm(raw)))


def test_metrics(spark):
    y, p = [0, 0, 0, 1, 1, 2], [0, 1, 0, 1, 2, 2]
    df = spark.createDataFrame(list(zip(y, p, strict=True)), "y int, p int")
    row = one(metrics.summary(metrics.confusion(df, [0, 1, 2, 3])))
    assert row["accuracy"] == pytest.approx(4 / 6) and row["balanced_accuracy"] == pytest.approx((2 / 3 + 1 / 2 + 1) / 3)
    assert row["f1_macro"] == pytest.approx((0.8 + 0.5 + 2 / 3) / 3)
    n, c, rows, cols = 6, 4, [3, 2, 1], [2, 2, 2]
    top = c * n - sum(a * b for a, b in zip(rows, cols, strict=True))
    assert row["mcc"] == pytest.approx(top / np.sqrt((n * n - sum(a * a for a in rows)) * (n * n - sum(a * a for a in cols))))
    assert row["kappa"] == pytest.approx(top / (n * n - sum(a * b for a, b in zip(rows, cols, strict=True))))
    one_class = one(metrics.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, score double")))
    assert one_class["roc_auc"] is None and one_class["roc_auc_error"]


def test_roc_auc_over_many_pieces(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 200, 500) / 10, rng.integers(0, 2, 500)
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    df = spark.createDataFrame(pd.DataFrame({"y": y, "score": s}))
    assert one(metrics.roc_auc(df, 16))["roc_auc"] == pytest.approx(want)


def test_result_rows(spark):
    rows = metrics.flatten({"val": {"accuracy": 0.5, "n": 3}, "test": {"n_scored_clients": 2, "coverage": 0.4}}, "llm", "m")
    assert rows[0][3] == 0.5 and rows[0][-2:] == (3, 1.0) and rows[1][-2:] == (2, 0.4)
    assert metrics.adapter_metric({"val_accuracy": 0.7}, "val", "accuracy") == 0.7
    assert metrics.adapter_metric({"test": {"eval_accuracy": 0.6}}, "test", "accuracy") == 0.6


def test_models(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(x > 0) if i % 10 else -1, float(x), float(rng.normal())) for i, x in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "customer_id long, label int, a double, b double")
    for fitted in (models.tree(df), models.boosted(df, iterations=3)):
        got = fitted.predict(df.drop("b")).where("y >= 0")
        assert got.where("y = p").count() / got.count() > 0.95
    assert "If" in models.tree(df).tree_text()
    assert one(models.majority(df.limit(1), 1))["p"] == 1

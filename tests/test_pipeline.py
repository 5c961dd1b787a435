from pyspark.sql import functions as F

from purselight import schema
from purselight.operators import claims, hooks, vectors
from purselight.plans import pipeline, queries

NAMES = {"0": "активный клиент", "1": "отток"}


def test_whole_course(spark):
    settings = schema.Settings(label_names=NAMES, category_label="категории операций", churn_profile=True)
    trx = queries.trx_o(spark, "/root/testdata/sf0.001").where("customer_id < 60").drop("o_orderkey")
    trx = pipeline.split_transactions(trx.withColumn("amount", F.col("amount").cast("double"))).cache()
    summary, profiles = pipeline.statistics(trx, settings)
    assert summary.startswith("# Активный клиент") and "# Отток" in summary
    profiles = profiles.cache()
    examples = pipeline.few_shot(profiles)
    assert examples.count("Клиент ") == 2
    answers = pipeline.explanations(profiles, "{SUMMARY_TRANSACTIONAL_STATS}{FEW_SHOT_EXAMPLES}{CLIENT_STATS}", "s", summary, examples, hooks.stub_client, settings).cache()
    assert answers.count() == profiles.count() and answers.where("predicted is null").count() == 0
    train = answers.where("split = 'train'")
    merged = pipeline.extracted_claims(train, "{COT}", "s", hooks.stub_client)
    flat = claims.flatten_claims(merged, cyrillic_only=True, labelled_only=True).cache()
    assert flat.count() > 0 and flat.where("claim like '%Клиент%'").count() == 0
    fitted = pipeline.fit_clusters(flat, vectors.hash_encoder(16), 2, 0.05, 1, 0.0)
    clients = train.select("customer_id", "label").distinct()
    counts = pipeline.cluster_features(fitted, clients)
    names = [c for c in counts.columns if c.startswith("cot_cluster_")]
    total = counts.agg(*(F.sum(f"`{c}`") for c in names)).first()
    assert counts.count() == clients.count() and sum(total) == flat.count()
    again = pipeline.cluster_features(fitted, clients, flat, vectors.hash_encoder(16))
    assert sum(again.agg(*(F.sum(f"`{c}`") for c in names)).first()) == flat.count()
    hand = pipeline.handcrafted_tables(trx, settings)
    both = pipeline.concat_tables({"train": counts}, hand)
    assert both["train"].count() == clients.count()
    result = pipeline.ml_baseline({"handcrafted": {k: hand[k] for k in ("train", "test")}}, 2)
    assert 0 <= result["handcrafted"]["tree"]["test"]["accuracy"] <= 1 and len(result["handcrafted"]["boosted"]["test"]["confusion_matrix"]) == 2

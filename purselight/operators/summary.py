"""Class summaries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from purselight.operators import profile

#: Client features that class summaries describe.
FEATURES = ("n_txn", "active_days", "txn_per_day", "total_amount", "avg_amount", "unique_categories", "share_pos", "share_atm", "share_deposit", "share_c2c_out", "recency_ratio")


def client_features(trx: DataFrame) -> DataFrame:
    """FEATURES per labelled client; the recency ratio is 1 where a client has no span of time."""
    trx = trx.where("label >= 0")
    rows = profile.core(trx).select("customer_id", "label", "n_txn", "active_days", "txn_per_day")
    sums = profile.amounts(trx).select("customer_id", F.coalesce("amount_sum", F.lit(0.0)).alias("total_amount"), F.coalesce("amount_mean", F.lit(0.0)).alias("avg_amount"), F.col("n_categories").alias("unique_categories"))
    rows = rows.join(sums, "customer_id")
    if "trx_cat_ru" in trx.columns and "currency_name" in trx.columns:
        rows = rows.join(profile.shares(trx).select("customer_id", "share_pos", "share_atm", "share_deposit", "share_c2c_out"), "customer_id")
    else:
        rows = rows.withColumns({c: F.lit(0.0) for c in ("share_pos", "share_atm", "share_deposit", "share_c2c_out")})
    span = profile.dynamics(trx, types=False).select("customer_id", "recency_ratio")
    return rows.join(span, "customer_id", "left").withColumn("recency_ratio", F.coalesce("recency_ratio", F.lit(1.0)))


def feature_summary(features: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """label, feature, clients, mean, median."""
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))
    rows = features.select("label", F.explode(pairs).alias("x")).select("label", "x.*")
    return rows.groupBy("label", "feature").agg(F.count("*").alias("clients"), F.avg("value").alias("mean"), F.median("value").alias("median"))


def category_means(trx: DataFrame) -> DataFrame:
    """label, category, mean: transactions per client, over the clients of the class that have the category."""
    counts = trx.where(F.col("mcc_code_desc").isNotNull()).groupBy("label", "customer_id", F.col("mcc_code_desc").alias("category")).agg(F.count("*").alias("n"))
    return counts.groupBy("label", "category").agg((F.sum("n") / F.count("*")).alias("mean"))


def summary_text(trx: DataFrame, label_names: dict[str, str], category_label: str, churn: bool) -> str:
    """The summary of all classes as Markdown, from aggregates of classes x features or categories."""
    capital = lambda s: s[:1].upper() + s[1:].lower()
    means = category_means(trx)
    if churn:
        best = profile.top_n(means, "mean", 20, "label")
        stats = {(r.label, r.feature): r for r in feature_summary(client_features(trx)).collect()}
    else:
        best = profile.top_n(profile.top_percentile(means, "mean", 0.9, "label"), "mean", 25, "label")
        stats = {}
    rounded = best.withColumn("most", F.max("mean").over(Window.partitionBy("label")))
    table: dict[int, list[str]] = {}
    for r in rounded.orderBy("label", F.desc("mean"), "category").collect():
        value = round(r["mean"], 2) if r.most < 1 else round(r["mean"])
        table.setdefault(r.label, []).append(f"| {r.category} | {value} |")
    out = []
    for key, name in label_names.items():
        k = int(key)
        if k not in table:
            continue
        out.append(f"# {capital(name)}")
        if churn:
            out.append(f"Клиентов в train: {stats[(k, 'n_txn')].clients}")
            out += [f"* {f}: mean={stats[(k, f)]['mean']:.3f}, median={stats[(k, f)]['median']:.3f}" for f in FEATURES]
        out.append(f"## Среднее число транзакций по {category_label} ({name}{'' if churn else ', 90-й перцентиль'})")
        out += [f"| {capital(category_label)} | Среднее число транзакций |", "|---|---|", *table[k], ""]
    return "\n".join(out)


def split_report(trx: DataFrame) -> DataFrame:
    """split, rows, clients, min_date, max_date, positive_rate (mean label of clients), label_counts (label -> clients)."""
    clients = trx.groupBy("split", "customer_id").agg(F.count("*").alias("n"), F.min("tr_datetime").alias("lo"), F.max("tr_datetime").alias("hi"), profile.label().alias("label"))
    totals = clients.groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("clients"), F.min("lo").alias("min_date"), F.max("hi").alias("max_date"), (F.sum("label") / F.count("label")).alias("positive_rate"))
    counts = clients.where("label is not null").groupBy("split", "label").agg(F.count("*").alias("n")).groupBy("split")
    counts = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))
    return totals.join(counts, "split", "left")


def class_counts(trx: DataFrame) -> DataFrame:
    """label, clients."""
    return trx.groupBy("customer_id").agg(profile.label().alias("label")).groupBy("label").agg(F.count("*").alias("clients"))


def all_labelled(trx: DataFrame) -> DataFrame:
    """One row: whether every client has a label of 0 or more."""
    return trx.groupBy("customer_id").agg(profile.label().alias("label")).agg(F.coalesce(F.bool_and(F.coalesce(F.col("label") >= 0, F.lit(False))), F.lit(True)).alias("all_labelled"))


def majority(trx: DataFrame) -> DataFrame:
    """majority_label (the least of equals) and its share of clients."""
    counts = class_counts(trx).where("label is not null")
    return counts.agg(F.max_by("label", F.struct("clients", -F.col("label"))).alias("majority_label"), (F.max("clients") / F.sum("clients")).alias("majority_share"))


def feature_report(features: DataFrame, prefix: str = "cot_cluster_") -> DataFrame:
    """rows, clients, n_features, nonzero_rows, zero_rows, total_mass of the columns that start with prefix."""
    names = [c for c in features.columns if c.startswith(prefix)]
    mass = sum((F.col(f"`{c}`").cast("double") for c in names), F.lit(0.0))
    return features.withColumn("mass", mass).agg(
        F.count("*").alias("rows"), F.count_distinct("customer_id").alias("clients"), F.lit(len(names)).alias("n_features"), F.count_if(F.col("mass") > 0).alias("nonzero_rows"),
        F.count_if(F.col("mass") == 0).alias("zero_rows"), F.coalesce(F.sum("mass"), F.lit(0.0)).alias("total_mass"),
    )

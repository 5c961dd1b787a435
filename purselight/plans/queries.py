"""Queries over the test tables, each with its SQL counterpart where SQL can express it.

Transactions are derived: `trx_o` from orders and customer (long histories), `trx_e` from events (dense histories).
Amounts are decimals here, so that sums do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purselight.functions import numbers, text
from purselight.operators import claims, clustering, features, hooks, metrics, models, pivot, profile, splits, summary, vectors
from purselight.plans import scratch
from purselight.schema import Settings
from purselight.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Categories of the derived transactions, which stand for a frozen training schema.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

TRX_O = """trx as (
    select o_custkey as customer_id, o_orderdate as tr_datetime, cast(case when o_orderstatus = 'F' then o_totalprice else -o_totalprice end as decimal(18, 2)) as amount,
        o_orderpriority as mcc_code_desc, case o_orderstatus when 'F' then 'оплата картой' when 'O' then 'снятие наличных через кассу' else 'пополнение счета' end as trx_cat_ru,
        case when o_orderkey % 7 = 0 then 'EUR' else 'Рубль' end as currency_name, c_nationkey % 2 as label, o_orderkey
    from orders join customer on o_custkey = c_custkey)"""
TRX_E = """trx as (
    select user_id as customer_id, ts as tr_datetime, cast(case when event_type in ('purchase', 'error') then -value else value end as decimal(18, 2)) as amount,
        event_type as mcc_code_desc, cast(user_id % 2 as integer) as label, event_id
    from events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    kind = F.when(status == "F", "оплата картой").when(status == "O", "снятие наличных через кассу").otherwise("пополнение счета")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("tr_datetime"), F.when(status == "F", price).otherwise(-price).cast("decimal(18,2)").alias("amount"), F.col("o_orderpriority").alias("mcc_code_desc"),
        kind.alias("trx_cat_ru"), F.when(F.col("o_orderkey") % 7 == 0, "EUR").otherwise("Рубль").alias("currency_name"), "o_orderkey",
    )


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), (F.col("c_nationkey") % 2).alias("label"))


def trx_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.join_labels(_orders(spark, sf_dir), _labels(spark, sf_dir))


def trx_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer_id"), F.col("ts").alias("tr_datetime"), F.when(kind.isin("purchase", "error"), -value).otherwise(value).cast("decimal(18,2)").alias("amount"), kind.alias("mcc_code_desc"), (F.col("user_id") % 2).cast("int").alias("label"), "event_id"
    )


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# --- files ------------------------------------------------------------------------------------------------------------


@query(f"""with {TRX_O} select customer_id, tr_datetime::date as day, amount::double as amount, mcc_code_desc, label::int as label, currency_name, trx_cat_ru, '"' || o_orderkey || '", ' || chr(10) || 'x' as mcc_desc from trx""")
def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split with all optional columns, in an order of its own, written as CSV and read by name."""
    note = F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('", \nx'))
    rows = trx_o(spark, sf_dir).select(F.col("label").alias("target"), "currency_name", note.alias("mcc_desc"), "mcc_code_desc", F.col("tr_datetime").cast("string").alias("when"), "trx_cat_ru", "amount", F.col("customer_id").alias("cl_id"))
    path = scratch.new_path(spark, "split")
    sinks.write_csv(rows, path)
    read = files.read_transactions(spark, path, Settings(columns={"customer_id": "cl_id", "datetime": "when", "label": "target"}))
    return read.withColumn("day", F.to_date("tr_datetime")).drop("tr_datetime")


# --- preparation and calendar -------------------------------------------------------------------------------------


@query(f"with {TRX_O} select o_orderkey, customer_id, label, amount::double as amount from trx")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trx_o(spark, sf_dir).select("o_orderkey", "customer_id", "label", F.col("amount").cast("double").alias("amount"))


@query(f"""with {TRX_E}
select event_id, (amount > 0)::int as is_positive, (amount < 0)::int as is_negative, (case when amount > 0 then amount else 0 end)::double as amount_positive, (case when amount < 0 then amount else 0 end)::double as amount_negative,
    hour(tr_datetime)::int as hour, (isodow(tr_datetime) - 1)::int as weekday, datediff('day', date '2000-01-01', tr_datetime::date)::int as day, (isodow(tr_datetime) >= 6)::int as is_weekend,
    ['Пн', 'Вт', 'Ср', 'Чт', 'Пт', 'Сб', 'Вс'][isodow(tr_datetime)] as weekday_name,
    case when hour(tr_datetime) between 6 and 11 then 'утро' when hour(tr_datetime) between 12 and 17 then 'день' when hour(tr_datetime) >= 18 then 'вечер' else 'ночь' end as period_of_day,
    (max(datediff('day', date '2000-01-01', tr_datetime::date)) over (partition by customer_id) - datediff('day', date '2000-01-01', tr_datetime::date))::int as days_since_last_txn
from trx""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.add_features(trx_e(spark, sf_dir))
    names = ["is_positive", "is_negative", "hour", "weekday", "day", "is_weekend", "weekday_name", "period_of_day", "days_since_last_txn"]
    return rows.select("event_id", *names, *(F.col(c).cast("double").alias(c) for c in ("amount_positive", "amount_negative")))


@query(f"""with {TRX_E}, days as (select customer_id, datediff('day', date '2000-01-01', tr_datetime::date) as day from trx)
select customer_id, max(day)::int as last_day, max(d.m - day)::int as longest from days join (select customer_id, max(day) as m from days group by 1) d using (customer_id) group by customer_id""")
def days_since_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_features(trx_e(spark, sf_dir)).groupBy("customer_id").agg(F.max("day").alias("last_day"), F.max("days_since_last_txn").alias("longest"))


@query("""select o_orderkey, 'Категория ' || (o_custkey % 10) || ' [' || case o_orderstatus when 'F' then 'оплата картой' when 'O' then 'пополнение счета' else 'P' end || ']' as mcc_code_desc,
    case o_orderkey % 3 when 0 then 'Рубль' when 1 then 'Евро' else 'Валюта 1' end as currency_name, o_custkey as customer_id, (o_custkey % 2)::int as label from orders""")
def churn_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cl_id"), (F.col("o_custkey") % 10).alias("MCC"), F.when(key % 3 == 0, 810).when(key % 3 == 1, 978).otherwise(1).alias("currency"), key.cast("string").alias("TRDATETIME"),
        key.alias("amount"), F.when(status == "F", "POS").when(status == "O", "DEPOSIT").otherwise(status).alias("trx_category"), (F.col("o_custkey") % 2).alias("target_flag"),
    )
    return features.prepare_churn(raw).select(F.col("amount").cast("long").alias("o_orderkey"), "mcc_code_desc", "currency_name", "customer_id", "label")


@query("select doc_id, (quality + 1 - case when (select min(quality + 1) from labels) = 1 then 1 else 0 end)::int as label from labels")
def label_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1).alias("label"))
    return features.shift_labels(labels).select("doc_id", F.col("label").cast("int").alias("label"))


@query(f"with {TRX_O} select customer_id, min(label)::int as label from trx group by customer_id having count(distinct label) = 1")
def client_distinct_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.client_labels(trx_o(spark, sf_dir)).select("customer_id", F.col("label").cast("int").alias("label"))


@query("select o_custkey as customer_id, count(distinct o_orderstatus)::bigint as n_labels from orders group by 1 having count(distinct o_orderstatus) > 1")
def inconsistent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("label"))
    return features.inconsistent_clients(rows)


# --- profiles ---------------------------------------------------------------------------------------------------------

CORE = """select customer_id, min(label)::int as label, count(*) as n_txn, greatest(count(distinct tr_datetime::date), 1) as active_days, greatest(count(distinct date_trunc('month', tr_datetime)), 1) as active_months,
    coalesce(sum(amount) filter (where amount > 0), 0)::double as total_income, coalesce(sum(amount) filter (where amount < 0), 0)::double as total_expense,
    (sum(amount) filter (where amount > 0))::double / nullif(count(*) filter (where amount > 0), 0) as avg_income, (sum(amount) filter (where amount < 0))::double / nullif(count(*) filter (where amount < 0), 0) as avg_expense,
    count(*) filter (where amount > 0) / count(*) as share_income, count(*) filter (where amount < 0) / count(*) as share_expense,
    count(*) / greatest(count(distinct tr_datetime::date), 1) as txn_per_day, count(*) / greatest(count(distinct date_trunc('month', tr_datetime)), 1) as txn_per_month
    from trx group by customer_id"""


@query(f"with {TRX_O} {CORE}")
def client_profile_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.core(trx_o(spark, sf_dir)).withColumn("label", F.col("label").cast("int"))


@query(f"with {TRX_E} {CORE}")
def client_profile_core_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.core(trx_e(spark, sf_dir))


@query(f"""with {TRX_O} select customer_id, count(amount) as amount_count, sum(amount)::double as amount_sum, sum(amount)::double / count(amount) as amount_mean, median(amount::double) as amount_median, min(amount)::double as amount_min, max(amount)::double as amount_max,
    round(coalesce(stddev_samp(amount::double), 0), 2) as amount_std, count(distinct mcc_code_desc) as n_categories, count(distinct mcc_code_desc) / count(*) as diversity from trx group by customer_id""")
def amount_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.amounts(trx_o(spark, sf_dir)), {"amount_std": 2})


STATS = "stats as (select customer_id, mcc_code_desc as category, count(*) as n, sum(amount) as total from trx group by 1, 2)"


@query(f"with {TRX_E}, {STATS} select customer_id, category, n, total::double as total, row_number() over (partition by customer_id order by n desc, category)::int as rank from stats qualify rank <= 3")
def category_freq_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_n(profile.categories(trx_e(spark, sf_dir)), "n", 3).withColumn("total", F.col("total").cast("double"))


@query(f"with {TRX_E}, {STATS} select customer_id, category, n, quantile_cont(n, 0.8) over (partition by customer_id) as threshold from stats qualify n >= threshold")
def category_p80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_percentile(profile.categories(trx_e(spark, sf_dir)), "n", 0.8).drop("total")


@query(f"""with {TRX_E}, spent as (select customer_id, mcc_code_desc as category, sum(amount)::double as total from trx where amount < 0 group by 1, 2)
select customer_id, category, total from spent qualify total >= quantile_cont(total, 0.8) over (partition by customer_id)""")
def expense_p80(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = profile.categories(trx_e(spark, sf_dir), only=F.col("amount") < 0).withColumn("total", F.col("total").cast("double"))
    return profile.top_percentile(spent, "total", 0.8).select("customer_id", "category", "total")


SHARES = """count(*) filter (where trx_cat_ru = 'оплата картой') / count(*) as share_pos, count(*) filter (where trx_cat_ru like '%снятие%') / count(*) as share_atm, count(*) filter (where trx_cat_ru = 'пополнение счета') / count(*) as share_deposit,
    count(*) filter (where trx_cat_ru = 'перевод на карту') / count(*) as share_c2c_out"""


@query(f"""with {TRX_O} select customer_id, {SHARES}, count(*) filter (where trx_cat_ru = 'входящий перевод с карты') / count(*) as share_c2c_in, count(distinct currency_name) as n_currencies,
    count(*) filter (where currency_name = 'Рубль') / count(*) as share_rub, (count(distinct currency_name) > 1)::int as has_foreign_curr from trx group by customer_id""")
def type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shares(trx_o(spark, sf_dir))


@query(f"with {TRX_O} select customer_id, trx_cat_ru as category, count(*) as n, sum(amount)::double as total from trx group by 1, 2")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.categories(trx_o(spark, sf_dir), "trx_cat_ru").withColumn("total", F.col("total").cast("double"))


@query(f"""with {TRX_E} select customer_id, count(*) filter (where hour(tr_datetime) between 6 and 11) / count(*) as share_morning, count(*) filter (where hour(tr_datetime) between 12 and 17) / count(*) as share_day,
    count(*) filter (where hour(tr_datetime) >= 18) / count(*) as share_evening, count(*) filter (where hour(tr_datetime) < 6) / count(*) as share_night, count(*) filter (where isodow(tr_datetime) >= 6) / count(*) as share_weekend from trx group by customer_id""")
def daypart_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.calendar_shares(features.add_features(trx_e(spark, sf_dir)))


SPAN = "span as (select *, epoch_us(tr_datetime) as tm, min(epoch_us(tr_datetime)) over (partition by customer_id) as lo, max(epoch_us(tr_datetime)) over (partition by customer_id) as hi from trx)"
HALVES = f"""{SPAN}, parts as (select customer_id, label, count(*) as n, min(lo) as lo, max(hi) as hi,
    count(*) filter (where 2 * (tm - lo) <= hi - lo) as first_half_txn, count(*) filter (where 2 * (tm - lo) > hi - lo) as second_half_txn, count(*) filter (where 4 * (tm - lo) <= hi - lo) as early_quarter_txn, count(*) filter (where 4 * (hi - tm) <= hi - lo) as recent_quarter_txn,
    coalesce(sum(amount) filter (where 2 * (tm - lo) <= hi - lo), 0)::double as first_half_amount, coalesce(sum(amount) filter (where 2 * (tm - lo) > hi - lo), 0)::double as second_half_amount,
    count(distinct mcc_code_desc) filter (where 2 * (tm - lo) <= hi - lo) as first_half_categories, count(distinct mcc_code_desc) filter (where 2 * (tm - lo) > hi - lo) as second_half_categories
    from span group by customer_id, label)"""


@query(f"""with {TRX_E}, {HALVES} select customer_id, first_half_txn, second_half_txn, early_quarter_txn, recent_quarter_txn, first_half_amount, second_half_amount, first_half_categories, second_half_categories,
    (second_half_txn - first_half_txn) / greatest(first_half_txn, 1) as txn_change, (second_half_amount - first_half_amount) / greatest(first_half_amount, 1) as amount_change,
    second_half_categories - first_half_categories as diversity_change, recent_quarter_txn / greatest(early_quarter_txn, 1) as recency_ratio from parts where n > 1 and hi > lo""")
def period_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["first_half_txn", "second_half_txn", "early_quarter_txn", "recent_quarter_txn", "first_half_amount", "second_half_amount", "first_half_categories", "second_half_categories", "txn_change", "amount_change", "diversity_change", "recency_ratio"]
    return profile.dynamics(trx_e(spark, sf_dir), types=False).select("customer_id", *names)


@query(f"with {TRX_O} select customer_id, strftime(tr_datetime, '%Y-%m') as month, count(*) as n from trx group by 1, 2 qualify row_number() over (partition by customer_id order by month desc) <= 6")
def monthly_tail6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.monthly(trx_o(spark, sf_dir))


# --- classes ----------------------------------------------------------------------------------------------------------


@query(f"""with {TRX_O}, counts as (select label, customer_id, mcc_code_desc as category, count(*) as n from trx group by 1, 2, 3), means as (select label::int as label, category, sum(n) / count(*) as mean from counts group by 1, 2)
select *, row_number() over (partition by label order by mean desc, category)::int as rank from means qualify rank <= 25""")
def class_category_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = summary.category_means(trx_o(spark, sf_dir)).withColumn("label", F.col("label").cast("int"))
    return profile.top_n(means, "mean", 25, "label")


@query(f"""with {TRX_O}, core as ({CORE}), more as (select customer_id, sum(amount)::double as total_amount, sum(amount)::double / count(amount) as avg_amount, count(distinct mcc_code_desc) as unique_categories, {SHARES} from trx group by 1), {HALVES},
clients as (select core.*, more.* exclude (customer_id), case when n > 1 and hi > lo then recent_quarter_txn / greatest(early_quarter_txn, 1) else 1 end as recency_ratio from core join more using (customer_id) join parts using (customer_id)),
long as (select label, unnest([{", ".join(repr(c) for c in summary.FEATURES)}]) as feature, unnest([{", ".join(f"{c}::double" for c in summary.FEATURES)}]) as value from clients)
select label, feature, count(*) as clients, round(avg(value), 3) as mean, round(median(value), 3) as median from long group by 1, 2""")
def class_feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.feature_summary(summary.client_features(trx_o(spark, sf_dir)))
    return rounded(rows, {"mean": 3, "median": 3}).withColumn("label", F.col("label").cast("int"))


@query(f"with {TRX_O}, clients as (select customer_id, min(label)::int as label from trx group by 1) select label, count(*) as clients from clients group by 1")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.class_counts(trx_o(spark, sf_dir)).withColumn("label", F.col("label").cast("int"))


@query(f"with {TRX_O}, clients as (select customer_id, min(label)::int as label from trx group by 1), counts as (select label, count(*) as n from clients group by 1) select label as majority_label, n / (select sum(n) from counts) as majority_share from counts order by n desc, label limit 1")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.majority(trx_o(spark, sf_dir)).withColumn("majority_label", F.col("majority_label").cast("int"))


@query(f"with {TRX_O} select bool_and(label >= 0) as all_labelled from trx")
def all_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.all_labelled(trx_o(spark, sf_dir))


# --- wide tables ------------------------------------------------------------------------------------------------------


@query(f"with {TRX_E} select customer_id, " + ", ".join(f"count(amount) filter (where mcc_code_desc = '{c}') as cnt_{c}, coalesce(sum(amount) filter (where mcc_code_desc = '{c}'), 0)::double as sum_{c}" for c in EVENT_TYPES) + " from trx group by customer_id")
def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot.category_features(trx_e(spark, sf_dir), EVENT_TYPES)


def _legacy_sql() -> str:
    cells = []
    for c in EVENT_TYPES:
        where = f"filter (where mcc_code_desc = '{c}')"
        name = f"mcc_code_desc_{c}"
        cells += [
            f"count(amount) {where} as {name}_count", f"coalesce((sum(amount) {where})::double, 0) as {name}_sum", f"coalesce((sum(amount) {where})::double / nullif(count(amount) {where}, 0), 0) as {name}_mean",
            f"coalesce((min(amount) {where})::double, 0) as {name}_min", f"coalesce((max(amount) {where})::double, 0) as {name}_max", f"coalesce(median(amount::double) {where}, 0) as {name}_median",
        ]
    return f"""with {TRX_E} select customer_id, min(label)::int as label, count(amount) as amount_count, sum(amount)::double as amount_sum, sum(amount)::double / count(amount) as amount_mean, min(amount)::double as amount_min, max(amount)::double as amount_max,
    median(amount::double) as amount_median, round(coalesce(stddev_samp(amount::double), 0), 2) as amount_std, count(distinct tr_datetime::date) as active_days, count(distinct strftime(tr_datetime, '%Y-%m')) as active_months,
    count(amount) / count(distinct tr_datetime::date) as txn_per_day, count(amount) / count(distinct strftime(tr_datetime, '%Y-%m')) as txn_per_month, {", ".join(cells)} from trx group by customer_id"""


@query(_legacy_sql())
def legacy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pivot.legacy_features(trx_e(spark, sf_dir), EVENT_TYPES), {"amount_std": 2})


@query(f"""with {TRX_E} select customer_id, min(label)::int as label, count(amount) filter (where mcc_code_desc = 'view')::double as cnt_view, 0.0::double as cnt_absent, (count(amount) filter (where mcc_code_desc = 'click'))::double as cnt_click from trx group by 1""")
def frozen_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    trx = trx_e(spark, sf_dir)
    wide = pivot.category_features(trx, EVENT_TYPES).join(features.client_labels(trx), "customer_id")
    return pivot.align(wide, ["cnt_view", "cnt_absent", "cnt_click"])


@query(f"""with {TRX_E}, a as (select customer_id, min(label)::int as label, count(*) as n, count(amount) filter (where mcc_code_desc = 'view') as cnt_view from trx group by 1)
select customer_id, label, n, cnt_view, cnt_view as cnt_view_hc, n as n_hc from a""")
def feature_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    trx = trx_e(spark, sf_dir)
    left = trx.groupBy("customer_id").agg(profile.label().alias("label"), F.count("*").alias("n"), F.count(F.when(F.col("mcc_code_desc") == "view", F.col("amount"))).alias("cnt_view"))
    return pivot.concat_features(left, left)


@query(f"with {TRX_E}, c as (select customer_id, count(*) filter (where mcc_code_desc = 'signup') as x, count(*) filter (where mcc_code_desc = 'error' and amount < -90) as y from trx group by 1) select count(*) as rows, count(distinct customer_id) as clients, 2 as n_features, count(*) filter (where x + y > 0) as nonzero_rows, count(*) filter (where x + y = 0) as zero_rows, sum(x + y)::double as total_mass from c")
def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trx_e(spark, sf_dir).groupBy("customer_id").agg(F.count_if(F.col("mcc_code_desc") == "signup").alias("cot_cluster_0"), F.count_if((F.col("mcc_code_desc") == "error") & (F.col("amount") < -90)).alias("cot_cluster_1"))
    return summary.feature_report(rows)


# --- splits -----------------------------------------------------------------------------------------------------------

CLIENTS = f"{TRX_O}, clients as (select customer_id, min(label)::int as label from trx group by 1)"
SPLIT = f"""{CLIENTS}, places as (select *, (row_number() over (partition by label order by md5(customer_id || '-42'), customer_id) - 1) / count(*) over (partition by label) as place from clients),
split as (select customer_id, label, case when place < 0.7::double then 'train' when place < 0.7::double + 0.1::double then 'val' else 'test' end as split from places)"""


def _clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.client_labels(trx_o(spark, sf_dir)).withColumn("label", F.col("label").cast("int"))


@query(f"with {SPLIT} select * from split")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(_clients(spark, sf_dir))


@query(f"with {CLIENTS}, places as (select *, (row_number() over (order by md5(customer_id || '-42'), customer_id) - 1) / count(*) over () as place from clients) select customer_id, label, case when place < 0.7::double then 'train' when place < 0.7::double + 0.1::double then 'val' else 'test' end as split from places")
def plain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(_clients(spark, sf_dir), by=None)


@query(f"with {SPLIT} select split, count(*) as rows, count(distinct customer_id) as clients, min(tr_datetime)::date as min_date, max(tr_datetime)::date as max_date, (select sum(label) / count(*) from split s where s.split = split.split) as positive_rate, (select string_agg(l || ':' || n, ',' order by l) from (select label as l, count(*) as n from split s where s.split = split.split group by 1)) as label_counts from trx join split using (customer_id) group by split")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trx_o(spark, sf_dir).join(splits.assign(_clients(spark, sf_dir)).select("customer_id", "split"), "customer_id")
    pairs = F.transform(F.array_sort(F.map_entries("label_counts")), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string")))
    return summary.split_report(rows).withColumns({c: F.to_date(c) for c in ("min_date", "max_date")}).withColumn("label_counts", F.array_join(pairs, ","))


@query(f"with {SPLIT} select 'semi' as part, count(*) as n, sum(amount)::double as total from trx where customer_id in (select customer_id from split where split = 'train') union all select 'anti', count(*), sum(amount)::double from trx where customer_id not in (select customer_id from split where split = 'train')")
def split_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    trx, parts = trx_o(spark, sf_dir), splits.assign(_clients(spark, sf_dir))
    total = lambda df, name: df.agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total")).select(F.lit(name).alias("part"), "n", "total")
    return total(splits.members(trx, parts, "train"), "semi").unionByName(total(splits.others(trx, parts.where("split = 'train'")), "anti"))


@query(f"with {SPLIT} select customer_id, split from split where split in ('val', 'test')")
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = splits.assign(_clients(spark, sf_dir)).select("customer_id", "split")
    return parts.where("split = 'val'").unionByName(parts.where("split = 'test'"))


@query(f"with {SPLIT} select count(*) as n from (select customer_id from split where split = 'train' intersect select customer_id from split where split <> 'train')")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leakage(splits.assign(_clients(spark, sf_dir))).agg(F.count("*").alias("n"))


@query(f"""with {CLIENTS}, ranked as (select *, md5(customer_id || '-42') as draw, row_number() over (partition by label order by md5(customer_id || '-42'), customer_id) as k from clients)
select customer_id, label from ranked order by (k > 51)::int, draw, customer_id limit 103""")
def client_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.capped(_clients(spark, sf_dir), 103, 2)


@query(f"with {CLIENTS} select customer_id, label from clients qualify row_number() over (partition by label order by md5(customer_id || '-42'), customer_id) <= 2")
def few_shot_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.few_shot(_clients(spark, sf_dir), 2)


# --- text and claims --------------------------------------------------------------------------------------------------


@query(r"""select conv_id, turn, regexp_replace(regexp_replace('Transactions ' || text || ' transaction', '(?i)\btransactions?\b', '', 'g'), '^\s+|\s+$', '', 'g') as cleaned, regexp_matches(text, '[а-яА-ЯёЁ]') as cyrillic from conversations""")
def boilerplate_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.clean_claim(F.concat(F.lit("Transactions "), "text", F.lit(" transaction"))).alias("cleaned"), text.has_cyrillic(F.col("text")).alias("cyrillic"))


@query(r"""select p_partkey, substr(replace(replace(replace(p_name || ', a/b', ' ', '_'), '/', '_'), ',', ''), 1, 80) as short_name, regexp_replace(regexp_replace(regexp_replace('--' || p_name || ' (x)', '[^0-9a-zA-Zа-яА-Я_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') as safe_name from part""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.short_name(F.concat(name, F.lit(", a/b"))).alias("short_name"), text.safe_name(F.concat(F.lit("--"), name, F.lit(" (x)"))).alias("safe_name"))


@query(r"""select doc_id, case when quality = 1 then 'Активный_клиент' else 'Отток.' end as answer, (1 - quality)::int as predicted from labels""")
def boxed_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("quality") == 1, r"x \boxed{a} y \boxed{ Активный_клиент }").otherwise(r"\boxed{Отток.} z")
    rows = table(spark, sf_dir, "labels").select("doc_id", text.boxed(said).alias("answer"))
    return rows.withColumn("predicted", text.label_of(F.col("answer"), {"0": "активный клиент", "1": "отток"}))


@query("select event_id, 'a' || (event_id % 10) || '|b' as claims from events")
def json_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("note ["), F.get_json_object("props", "$.k"), F.lit('] then ["a'), (F.col("event_id") % 10).cast("string"), F.lit('", " b ", ""] end [x'))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text.claims_of(said), "|").alias("claims"))


@query("""select conv_id, turn, len(u)::int as n, array_to_string(u, '|') as claims from (select conv_id, turn, list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i) as u
    from (select conv_id, turn, string_split(text || ' ' || translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ') as a from conversations))""")
def claim_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.concat("text", F.lit(" "), F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), " ", -1)
    rows = claims.unique_claims(table(spark, sf_dir, "conversations").select("conv_id", "turn", parts.alias("u")), "u")
    return rows.select("conv_id", "turn", F.size("u").alias("n"), F.array_join("u", "|").alias("claims"))


@query(f"with {TRX_O}, n as (select customer_id, count(*) as n from trx group by 1) select customer_id, 'Сводка: всё' || chr(10) || 'Примеры: {{}}' || chr(10) || 'Клиент: n = ' || n || chr(10) || '\\boxed{{отток}}' as user_prompt, 'система' as system_prompt from n")
def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trx_o(spark, sf_dir).groupBy("customer_id").agg(F.concat(F.lit("n = "), F.count("*").cast("string")).alias("client_stats"))
    template = "Сводка: {SUMMARY_TRANSACTIONAL_STATS}\nПримеры: {FEW_SHOT_EXAMPLES}\nКлиент: {CLIENT_STATS}\n\\boxed{отток}"
    return claims.prompts(rows, template, "система", "всё", "{}").drop("client_stats")


ANSWERS = "answers as (select conv_id as customer_id, (conv_id % 2)::int as label, turn::int as sample_id, case turn % 3 when 0 then 0 when 1 then 1 end as predicted from conversations where turn > 0 or conv_id % 3 > 0)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").where("turn > 0 or conv_id % 3 > 0")
    return rows.select(F.col("conv_id").alias("customer_id"), (F.col("conv_id") % 2).cast("int").alias("label"), turn.cast("int").alias("sample_id"), F.when(turn % 3 == 0, 0).when(turn % 3 == 1, 1).alias("predicted"))


@query(f"""with {ANSWERS} select customer_id, label, coalesce(predicted, -1)::int as prediction, predicted::double as score, sample_id as sample_id_used, count(*) over (partition by customer_id) as n_available_samples
from answers qualify row_number() over (partition by customer_id order by (sample_id <> 0)::int, sample_id) = 1""")
def single_sample_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.single_sample(_answers(spark, sf_dir))


@query(f"""with {ANSWERS}, v as (select customer_id, min(label) as label, count(*) filter (where predicted = 1) as a, count(*) filter (where predicted = 0) as b, count(*) as n_samples from answers group by 1)
select customer_id, label, (case when a + b = 0 then -1 when a > b then 1 else 0 end)::int as prediction, case when a + b > 0 then a / (a + b) end as score, n_samples, a + b as n_valid, (a + b) / n_samples as valid_rate from v""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.majority_vote(_answers(spark, sf_dir))


@query(f"""with {ANSWERS}, p as (select *, row_number() over (partition by customer_id order by (sample_id <> 0)::int, sample_id) as k from answers) select count(*) as n_total, count(predicted) as n_scored, count(*) - count(predicted) as n_unscored, count(predicted) / count(*) as coverage from p where k = 1""")
def answer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.coverage(claims.single_sample(_answers(spark, sf_dir)))


@query("select 'code ' || (event_id % 7) as error, count(*) as n from events where event_type = 'error' group by 1 order by n desc, error limit 5")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", F.concat(F.lit("code "), (F.col("event_id") % 7).cast("string"))).alias("error"))
    return claims.error_histogram(rows)


@query("""with facts as (select conv_id as customer_id, turn, case role when 'user' then 'мужчина' when 'assistant' then 'женщина' end as gender from conversations), n as (select customer_id, gender, count(*) as n from facts where gender is not null group by 1, 2),
best as (select customer_id, gender from n qualify row_number() over (partition by customer_id order by n desc, gender) = 1) select customer_id, gender, turn as fact from facts join best using (customer_id, gender)""")
def majority_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("customer_id"), F.col("turn").alias("fact"), text.gender(F.when(role == "user", "M").when(role == "assistant", "f")).alias("gender"))
    return claims.majority_facts(rows)


# --- metrics ----------------------------------------------------------------------------------------------------------

PREDICTIONS = "d as (select l.quality as y, 1 - l.toxic as p, n_chars::double as score from labels l join documents using (doc_id))"
MATRIX = f"{PREDICTIONS}, k as (select unnest([0, 1]) as v), m as (select a.v as y, b.v as p, (select count(*) from d where d.y = a.v and d.p = b.v) as n from k a, k b)"
BY_CLASS = f"""{MATRIX}, c as (select v as label, (select sum(n) from m where y = v)::bigint as support, (select sum(n) from m where p = v)::bigint as predicted, (select sum(n) from m where y = v and p = v)::bigint as hits from k),
s as (select *, coalesce(hits / nullif(predicted, 0), 0) as precision, coalesce(hits / nullif(support, 0), 0) as recall, coalesce(2 * hits / nullif(support + predicted, 0), 0) as f1 from c)"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("quality").alias("y"), (1 - F.col("toxic")).alias("p"), F.col("n_chars").cast("double").alias("score"))


@query(f"with {MATRIX} select * from m")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, sf_dir), [0, 1])


@query(f"with {BY_CLASS} select * from s")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_class(metrics.confusion(_predictions(spark, sf_dir), [0, 1]))


@query(f"""with {BY_CLASS}, t as (select sum(support)::double as t, sum(hits)::double as h, sum(support * predicted)::double as c, sum(support * support)::double as yy, sum(predicted * predicted)::double as pp from s)
select t::bigint as n, round(h / t, 9) as accuracy, round((select avg(recall) from s), 9) as balanced_accuracy, round((select avg(f1) from s), 9) as f1_macro, round((select sum(f1 * support) from s) / t, 9) as f1_weighted,
    round((h * t - c) / (sqrt(t * t - pp) * sqrt(t * t - yy)), 9) as mcc, round((h * t - c) / (t * t - c), 9) as kappa from t""")
def kappa_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = metrics.summary(metrics.confusion(_predictions(spark, sf_dir), [0, 1]))
    return rounded(row, {c: 9 for c in row.columns if c != "n"})


AUC = "select count(*) filter (where y = 1) as n_pos, count(*) filter (where y = 0) as n_neg, (sum(r) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2) / (count(*) filter (where y = 1) * count(*) filter (where y = 0)) as auc"


@query(f"with {PREDICTIONS}, r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as r from d) select n_pos, n_neg, round(auc, 9) as roc_auc, null::varchar as roc_auc_error from ({AUC} from r)")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(_predictions(spark, sf_dir)), {"roc_auc": 9})


@query("""with d as (select label % 3 as y, [embedding[1], embedding[2], embedding[3]]::double[] as s from embeddings), k as (select unnest([0, 1, 2]) as k),
r as (select k, (y = k)::int as y, rank() over (partition by k order by s[k + 1]) + (count(*) over (partition by k, s[k + 1]) - 1) / 2 as r from d, k), a as (select k, (sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) as auc from r group by k)
select round(avg(auc), 9) as roc_auc_ovr_macro from a""")
def roc_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("y"), F.slice("embedding", 1, 3).cast("array<double>").alias("scores"))
    return rounded(metrics.roc_auc_ovr(rows, [0, 1, 2]), {"roc_auc_ovr_macro": 9})


@query("select vec_id, round(exp(a) / (exp(a) + exp(b)), 9) as p0, (b > a)::int as predicted from (select vec_id, embedding[1]::double as a, embedding[2]::double as b from embeddings)")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.slice("embedding", 1, 2).cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", numbers.softmax(logits).alias("p"), numbers.argmax(logits).alias("predicted"))
    return rows.select("vec_id", F.round(F.col("p")[0], 9).alias("p0"), "predicted")


@query("""with r as (select row_number() over (order by o_orderkey) as place, o_orderstatus as family, o_orderpriority as method, case when o_orderkey % 2 = 0 then 'val' else 'test' end as split, o_totalprice as accuracy from orders)
select family, method, split, accuracy from r qualify row_number() over (partition by family, method, split order by place) = 1""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("method"), F.when(F.col("o_orderkey") % 2 == 0, "val").otherwise("test").alias("split"), F.col("o_totalprice").alias("accuracy"))
    return metrics.results(rows)


# --- vectors and clusters -------------------------------------------------------------------------------------------

UNIT = "u as (select vec_id as id, label, embedding::double[] as v from embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


@query(f"""with {UNIT}, near as (select a.id, a.label, b.label as other from u a join u b on a.id <> b.id qualify row_number() over (partition by a.id order by list_cosine_distance(a.v, b.v), b.id) <= 5)
select id, label, count(*) filter (where label = other) as n_same, 2 * count(*) filter (where label = other) < 5 as is_outlier from near group by 1, 2""")
def knn_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.label_outliers(_vectors(spark, sf_dir), 5)


@query("""with c as (select vec_id % 20 as cluster, label % 2 as label from embeddings), s as (select cluster, count(*) as size, greatest(avg((label = 0)::int), avg((label = 1)::int)) - least(avg((label = 0)::int), avg((label = 1)::int)) as spread from c group by 1)
select cluster, size, round(spread, 9) as spread, spread >= 0.02 as kept from s""")
def cluster_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("cluster"), (F.col("label") % 2).alias("label"))
    return rounded(vectors.cluster_spread(rows, 2), {"spread": 9})


CENTRES = """m as (select vec_id % 20 as cluster, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) as t(i) where vec_id % 5 > 0 group by 1, 2), norms as (select cluster, sqrt(sum(x * x)) as n from m group by 1),
centres as (select cluster, i, x / n as x from m join norms using (cluster))"""


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).withColumn("cluster", F.col("id") % 20)


@query(f"with {CENTRES} select cluster, (i - 1)::int as i, round(x, 6) as x from centres")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.centroids(_clustered(spark, sf_dir).where("id % 5 > 0"))
    return rows.select("cluster", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""with {CENTRES}, packed as (select cluster, list(x order by i) as c from centres group by 1), d as (select vec_id as id, cluster, list_cosine_distance(embedding::double[], c) as distance from embeddings, packed where vec_id % 5 = 0)
select id, case when distance <= 0.9 then cluster else -1 end as cluster, round(distance, 6) as distance from d qualify row_number() over (partition by id order by distance, cluster) = 1""")
def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clustered(spark, sf_dir)
    found = vectors.assign_nearest(rows.where("id % 5 = 0"), vectors.centroids(rows.where("id % 5 > 0")), 0.9)
    return rounded(found, {"distance": 6})


@query("""with a as (select vec_id // 5 as customer_id, min(label)::int as label, """ + ", ".join(f"count(*) filter (where vec_id % 7 = {c})::double as cot_cluster_{c}" for c in (0, 2, 5)) + " from embeddings group by 1) select * from a")
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("customer_id"), (F.col("vec_id") % 7).alias("cluster"), "label")
    clients = rows.groupBy("customer_id").agg(F.min("label").alias("label"))
    return vectors.cluster_counts(clients, rows, [0, 2, 5])


@query("""with c as (select vec_id as id, vec_id % 20 as cluster, label from embeddings) select cluster, count(*) as size, (select array_to_string(list(l || ':' || n order by l), ',') from (select label as l, count(*) as n from c x where x.cluster = c.cluster group by 1)) as label_counts,
    array_to_string(list('claim ' || id order by id)[1:10], '|') as examples from c group by cluster""")
def cluster_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clustered(spark, sf_dir).withColumn("claim", F.concat(F.lit("claim "), F.col("id").cast("string")))
    pairs = F.transform(F.array_sort(F.map_entries("label_counts")), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string")))
    return vectors.cluster_meta(rows).select("cluster", "size", F.array_join(pairs, ",").alias("label_counts"), F.array_join("examples", "|").alias("examples"))


@query(r"""with c as (select doc_id as id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from documents) group by 1, 2), t as (select term, sum(tf) as total, count(*) as df from c group by 1 order by total desc, term limit 384),
w as (select id, term, tf * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as w from c join t using (term)) select id, term, round(w / sqrt(sum(w * w) over (partition by id)), 6) as weight from w""")
def tfidf_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return rounded(vectors.tfidf(docs, 384, r"[\p{L}\p{N}_]{2,}"), {"weight": 6})


@query()
def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.agglomerative(_vectors(spark, sf_dir), 0.6)


@query()
def agglomerative_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.agglomerative_k(_vectors(spark, sf_dir), 10)


@query()
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.dbscan(_vectors(spark, sf_dir), 0.5, 3)


@query()
def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components; their signs are free, so values go without."""
    return clustering.project(_vectors(spark, sf_dir), 8).select("id", F.transform("v", lambda x: F.round(F.abs(x), 4)).alias("v"))


# --- models and texts ---------------------------------------------------------------------------------------------


def _model_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    trx = trx_e(spark, sf_dir)
    rows = pivot.legacy_features(trx, EVENT_TYPES).withColumn("label", (F.col("amount_sum") > 0).cast("int"))
    parts = splits.assign(rows.select("customer_id", "label"))
    return tuple(rows.join(parts.where(F.col("split") == s).select("customer_id"), "customer_id", "left_semi") for s in ("train", "test"))


@query()
def gbt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _model_rows(spark, sf_dir)
    return models.boosted(train).predict(test)


@query()
def tree_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _model_rows(spark, sf_dir)
    return models.tree(train).predict(test)


def _settings(churn: bool) -> Settings:
    return Settings(label_names={"0": "активный клиент", "1": "отток"}, category_label="категории операций", churn_profile=churn)


@query()
def profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profiles(trx_e(spark, sf_dir), _settings(False))


@query()
def churn_profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profiles(trx_o(spark, sf_dir), _settings(True))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = trx_o(spark, sf_dir).groupBy("customer_id").agg(profile.label().alias("label"), F.concat(F.lit("n = "), F.count("*").cast("string")).alias("client_stats"))
    rows = claims.dialogues(claims.prompts(clients, "{CLIENT_STATS}", "s", "", ""), 2)
    return hooks.complete(rows.select("customer_id", "label", "sample_id", "messages"), hooks.stub_client)


@query()
def stub_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the stand-in for a language model, two samples of each client."""
    said = _asked(spark, sf_dir).withColumn("predicted_raw", text.boxed(F.col("explanation")))
    return said.withColumn("predicted", text.label_of(F.col("predicted_raw"), {"0": "активный клиент", "1": "отток"})).drop("execution_time")


@query()
def stub_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of those answers, merged by client, cleaned, one in a row."""
    merged = claims.merge_claims(_asked(spark, sf_dir).withColumn("claims", text.claims_of(F.col("explanation"))))
    return claims.flatten_claims(merged, cyrillic_only=True, labelled_only=True)


@query()
def claim_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of conversation turns from the stand-in for a sentence encoder."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return vectors.embed(rows, vectors.hash_encoder(16)).select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))

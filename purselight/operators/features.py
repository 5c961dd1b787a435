"""Row-level features of transactions, and preparation of raw exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purselight.functions import dates, numbers
from purselight.schema import CURRENCIES, MERCHANT_CODES, OPERATION_TYPES, RAW_CHURN, require


def lookup(values: dict, key: Column) -> Column:
    """The value of a small fixed table; null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def prepare_churn(raw: DataFrame) -> DataFrame:
    """A raw churn export as the internal table: codes decoded, unknown codes kept in the text, bad amounts 0."""
    require(raw, RAW_CHURN)
    currency = F.when(F.col("currency").isNull(), "неизвестная валюта").otherwise(F.coalesce(lookup(CURRENCIES, F.col("currency").cast("int")), F.concat(F.lit("Валюта "), F.col("currency").cast("string"))))
    kind = F.coalesce(lookup(OPERATION_TYPES, F.col("trx_category")), F.col("trx_category"))
    code = F.coalesce(lookup(MERCHANT_CODES, F.col("MCC").cast("int")), F.concat(F.lit("Категория "), F.coalesce(F.col("MCC").cast("string"), F.lit("nan"))))
    return raw.select(
        F.col("cl_id").cast("long").alias("customer_id"), dates.parse_churn(F.col("TRDATETIME")).alias("tr_datetime"), numbers.number(F.col("amount").cast("string")).alias("amount"),
        currency.alias("currency_name"), kind.alias("trx_cat_ru"), code.alias("mcc_desc"), F.concat(code, F.lit(" ["), kind, F.lit("]")).alias("mcc_code_desc"), F.col("target_flag").cast("int").alias("label"),
    )


def join_labels(trx: DataFrame, labels: DataFrame, key: str = "customer_id", label: str = "label") -> DataFrame:
    """Transactions of labelled clients, with the label; labels may have further columns, which are left out."""
    return trx.join(labels.select(key, F.col(label).alias("label")), key)


def shift_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels that start at 1 made to start at 0."""
    least = labels.agg(F.min(label).alias("least"))
    return labels.crossJoin(F.broadcast(least)).withColumn(label, F.when(F.col("least") == 1, F.col(label) - 1).otherwise(F.col(label))).drop("least")  # one row


def client_labels(trx: DataFrame) -> DataFrame:
    """One row per client with its label; an error if a client has several."""
    out = trx.groupBy("customer_id").agg(F.coalesce(F.min_by("label", "tr_datetime"), F.min("label")).alias("label"), F.count_distinct("label").alias("n"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several labels of client "), F.col("customer_id").cast("string"))).cast("int")).otherwise(F.col("label"))
    return out.select("customer_id", checked.alias("label"))


def inconsistent_clients(trx: DataFrame) -> DataFrame:
    return trx.groupBy("customer_id").agg(F.count_distinct("label").alias("n_labels")).where("n_labels > 1")


def add_features(trx: DataFrame) -> DataFrame:
    """Sign flags, sign-split amounts, calendar features, days to the client's last transaction.

    The last day comes from an aggregate that is joined back, so that one client's rows need not meet in a task.
    """
    amount, ts = F.col("amount"), F.col("tr_datetime")
    hour, weekday, day = dates.hour(ts), dates.weekday(ts), dates.day_number(ts)
    rows = trx.withColumns(
        {
            "is_positive": (F.coalesce(amount, F.lit(0)) > 0).cast("int"), "is_negative": (F.coalesce(amount, F.lit(0)) < 0).cast("int"),
            "amount_positive": F.when(amount > 0, amount).otherwise(F.lit(0)), "amount_negative": F.when(amount < 0, amount).otherwise(F.lit(0)),
            "hour": hour, "weekday": weekday, "day": day, "is_weekend": weekday.isin(5, 6).cast("int"), "weekday_name": dates.weekday_name(weekday), "period_of_day": dates.period_of_day(hour),
        }
    )
    last = trx.groupBy("customer_id").agg(F.max(day).alias("last_day"))
    return rows.join(last, "customer_id").withColumn("days_since_last_txn", F.col("last_day") - F.col("day")).drop("last_day")

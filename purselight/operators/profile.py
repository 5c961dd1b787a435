"""Per-client profiles: totals, categories, types, calendar shares, dynamics, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from purselight.functions import dates, numbers
from purselight.schema import C2C_IN, C2C_OUT, CASH, DEPOSIT, NO_CATEGORY, PERIODS, POS, RUB, Settings

#: Column names of the shares of PERIODS.
PERIOD_COLUMNS = ("share_morning", "share_day", "share_evening", "share_night")


def label() -> Column:
    """The client's label: that of its first dated transaction."""
    return F.coalesce(F.min_by("label", "tr_datetime"), F.min("label"))


def active(unit: Column) -> Column:
    return F.greatest(F.count_distinct(unit), F.lit(1))


def mean(cond: Column, value: Column) -> Column:
    """Mean over rows with cond, null without any; from sum and count, so that decimals stay exact."""
    return F.sum(F.when(cond, value)).cast("double") / F.nullif(F.count(F.when(cond, value)), F.lit(0))


def core(trx: DataFrame) -> DataFrame:
    """Counts, active days and months, income and expense (a mean without rows is null).

    Days are summed up first: what is shuffled is a row per client and day, and no distinct count multiplies rows.
    """
    amount, ts = F.col("amount"), F.col("tr_datetime")
    income, expense = amount > 0, amount < 0
    days = trx.groupBy("customer_id", F.to_date(ts).alias("day")).agg(
        F.min(F.when(ts.isNotNull(), F.struct(ts.alias("ts"), "label"))).alias("first"), F.min("label").alias("label"), F.count("*").alias("n"), F.count_if(income).alias("n_income"), F.count_if(expense).alias("n_expense"),
        F.sum(F.when(income, amount)).alias("income"), F.sum(F.when(expense, amount)).alias("expense"),
    )
    total = lambda c: F.sum(c).cast("double")
    out = days.groupBy("customer_id").agg(
        F.coalesce(F.min("first")["label"], F.min("label")).alias("label"), F.sum("n").alias("n_txn"), F.greatest(F.count("day"), F.lit(1)).alias("active_days"), active(F.trunc("day", "MM")).alias("active_months"),
        F.coalesce(total("income"), F.lit(0.0)).alias("total_income"), F.coalesce(total("expense"), F.lit(0.0)).alias("total_expense"), (total("income") / F.nullif(F.sum("n_income"), F.lit(0))).alias("avg_income"),
        (total("expense") / F.nullif(F.sum("n_expense"), F.lit(0))).alias("avg_expense"), (F.sum("n_income") / F.sum("n")).alias("share_income"), (F.sum("n_expense") / F.sum("n")).alias("share_expense"),
    )
    return out.withColumns({"txn_per_day": F.col("n_txn") / F.col("active_days"), "txn_per_month": F.col("n_txn") / F.col("active_months")})


def active_units(trx: DataFrame) -> DataFrame:
    """customer_id, days, months with transactions; a missing time is no day, but a month of its own."""
    days = trx.groupBy("customer_id", F.to_date("tr_datetime").alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy("customer_id").agg(F.count("day").alias("active_days"), F.count_distinct(F.coalesce(dates.month(F.col("day")), F.lit("NaT"))).alias("active_months"))


def amounts(trx: DataFrame) -> DataFrame:
    """Sum, mean, median, least, largest and deviation (0 for one row) of amounts; categories and their diversity."""
    out = trx.groupBy("customer_id").agg(
        F.count("amount").alias("amount_count"), F.sum("amount").cast("double").alias("amount_sum"), mean(F.lit(True), F.col("amount")).alias("amount_mean"), F.median("amount").alias("amount_median"),
        F.min("amount").cast("double").alias("amount_min"), F.max("amount").cast("double").alias("amount_max"), F.coalesce(F.stddev_samp(F.col("amount").cast("double")), F.lit(0.0)).alias("amount_std"),
        F.count_distinct("mcc_code_desc").alias("n_categories"), F.count("*").alias("n"),
    )
    return out.withColumn("diversity", F.col("n_categories") / F.col("n")).drop("n")


def categories(trx: DataFrame, by: str = "mcc_code_desc", only: Column | None = None) -> DataFrame:
    """customer_id, category, n (rows), total (amount) of non-null categories."""
    rows = trx.where(F.col(by).isNotNull())
    rows = rows if only is None else rows.where(only)
    return rows.groupBy("customer_id", F.col(by).alias("category")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


def top_percentile(stats: DataFrame, value: str, q: float, group: str = "customer_id") -> DataFrame:
    """Rows whose value reaches the group's q-quantile (linear between ranks)."""
    return stats.withColumn("threshold", F.percentile(value, F.lit(q)).over(Window.partitionBy(group))).where(F.col(value) >= F.col("threshold"))


def top_n(stats: DataFrame, value: str, n: int, group: str = "customer_id", key: str = "category") -> DataFrame:
    """The n rows of each group with the largest values, with their rank; ties by key."""
    return stats.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), key))).where(F.col("rank") <= n)


def shares(trx: DataFrame) -> DataFrame:
    """Shares of operation types and currencies; cash is every type that speaks of withdrawal."""
    kind, money = F.col("trx_cat_ru"), F.col("currency_name")
    part = lambda cond: F.count_if(cond) / F.count("*")
    return trx.groupBy("customer_id").agg(
        part(kind == POS).alias("share_pos"), part(F.lower(kind).contains(CASH)).alias("share_atm"), part(kind == DEPOSIT).alias("share_deposit"), part(kind == C2C_OUT).alias("share_c2c_out"), part(kind == C2C_IN).alias("share_c2c_in"),
        F.count_distinct(money).alias("n_currencies"), part(money == RUB).alias("share_rub"), (F.count_distinct(money) > 1).cast("int").alias("has_foreign_curr"),
    )


def calendar_shares(enriched: DataFrame) -> DataFrame:
    """Shares of the parts of the day and of weekends, of a table with add_features()."""
    part = lambda cond: F.count_if(cond) / F.count("*")
    named = (part(F.col("period_of_day") == p).alias(c) for p, c in zip(PERIODS, PERIOD_COLUMNS, strict=True))
    return enriched.groupBy("customer_id").agg(*named, part(F.col("is_weekend") == 1).alias("share_weekend"))


def with_span(trx: DataFrame) -> DataFrame:
    """Adds at, lo, hi: a transaction's time and its client's first and last, in microseconds."""
    at = dates.micros(F.col("tr_datetime"))
    bounds = trx.groupBy("customer_id").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    return trx.withColumn("at", at).join(bounds, "customer_id")


def bucket(name: str) -> Column:
    """Whether a transaction falls into a half or quarter of its client's time, in exact integers."""
    at, lo, hi = F.col("at"), F.col("lo"), F.col("hi")
    return {"first_half": 2 * (at - lo) <= hi - lo, "second_half": 2 * (at - lo) > hi - lo, "early_quarter": 4 * (at - lo) <= hi - lo, "recent_quarter": 4 * (hi - at) <= hi - lo}[name]


def dynamics(trx: DataFrame, types: bool = True) -> DataFrame:
    """Counts, sums, categories and type shares by half and quarter, and the changes between them.

    For clients with more than one row and different times; all others have no row here. Categories are summed up
    first, so that counting them needs no distinct aggregate.
    """
    rows = with_span(trx)
    kind, cols, sums = F.col("trx_cat_ru"), [], []
    for name in ("first_half", "second_half", "early_quarter", "recent_quarter"):
        inside = bucket(name)
        cols += [F.count_if(inside).alias(f"{name}_txn"), F.sum(F.when(inside, F.col("amount"))).alias(f"{name}_amount")]
        sums += [F.sum(f"{name}_txn").alias(f"{name}_txn"), F.coalesce(F.sum(f"{name}_amount").cast("double"), F.lit(0.0)).alias(f"{name}_amount"), F.count_if((F.col(f"{name}_txn") > 0) & F.col("mcc_code_desc").isNotNull()).alias(f"{name}_categories")]
        for part, cond in (("pos", kind == POS), ("atm", F.lower(kind).contains(CASH)), ("deposit", kind == DEPOSIT)) if types else ():
            cols.append(F.count_if(inside & cond).alias(f"{name}_{part}"))
            sums.append(numbers.share(F.sum(f"{name}_{part}"), F.sum(f"{name}_txn")).alias(f"{name}_{part}_share"))
    by_category = rows.groupBy("customer_id", "mcc_code_desc").agg(F.count("*").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), *cols)
    out = by_category.groupBy("customer_id").agg(F.sum("n").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), *sums).where("n > 1 and hi > lo").drop("n", "hi", "lo")
    c, one = F.col, F.lit(1)
    return out.withColumns(
        {
            "txn_change": numbers.share(c("second_half_txn") - c("first_half_txn"), F.greatest(c("first_half_txn"), one)), "amount_change": numbers.share(c("second_half_amount") - c("first_half_amount"), F.greatest(c("first_half_amount"), one.cast("double"))),
            "diversity_change": c("second_half_categories") - c("first_half_categories"), "recency_ratio": c("recent_quarter_txn") / F.greatest(c("early_quarter_txn"), one), "second_to_first_ratio": c("second_half_txn") / F.greatest(c("first_half_txn"), one),
        }
    )


def monthly(trx: DataFrame, last: int = 6) -> DataFrame:
    """customer_id, month, n of each client's last months with transactions."""
    counts = trx.where("tr_datetime is not null").groupBy("customer_id", dates.month(F.col("tr_datetime")).alias("month")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("month")))).where(F.col("rank") <= last).drop("rank")


def lines(stats: DataFrame, value: str, group: str = "customer_id") -> DataFrame:
    """group, block: lines "category = value", largest first, values rounded adaptively."""
    rounded = numbers.adaptive(F.col(value).cast("double"), Window.partitionBy(group))
    whole = F.max(F.abs(F.col(value))).over(Window.partitionBy(group)) >= 1
    text = F.when(whole, rounded.cast("long").cast("string")).otherwise(numbers.as_text(rounded))
    rows = stats.withColumn("line", F.concat("category", F.lit(" = "), text))
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), "category", "line"))).alias("x")).select(group, F.array_join("x.line", "\n").alias("block"))


def profiles(trx: DataFrame, settings: Settings) -> DataFrame:
    """customer_id, label, label_name, client_stats (the profile's text), in the plain or the churn form."""
    rows = core(trx)
    if settings.churn_profile:
        rows = rows.join(amounts(trx), "customer_id").join(dynamics(trx, "trx_cat_ru" in trx.columns), "customer_id", "left")
        stats = categories(trx)
        blocks = {"freq": (top_n(stats, "n", 15), "n"), "total": (top_n(stats, "total", 15), "total")}
        if "trx_cat_ru" in trx.columns:
            blocks["types"] = (categories(trx, "trx_cat_ru"), "n")
        months = monthly(trx).groupBy("customer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", "n"))), lambda x: F.concat(x["month"], F.lit(": "), x["n"].cast("string"))), ", ").alias("months"))
        rows = rows.join(months, "customer_id", "left")
        if "currency_name" in trx.columns:
            money = categories(trx, "currency_name").groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category", "n"))).alias("x"))
            rows = rows.join(money.select("customer_id", F.array_join(F.transform("x", lambda x: F.concat(x["category"], F.lit(": "), x["n"].cast("string"))), ", ").alias("currencies")), "customer_id", "left")
    else:
        spent = categories(trx, only=F.col("amount") < 0)
        blocks = {"freq": (top_percentile(categories(trx), "n", 0.8), "n"), "total": (top_percentile(spent, "total", 0.8), "total")}
    for name, (stats, value) in blocks.items():
        rows = rows.join(lines(stats, value).withColumnRenamed("block", name), "customer_id", "left")
    render = _churn_text if settings.churn_profile else _plain_text
    named = F.lit("unknown")
    for key, value in settings.label_names.items():
        named = F.when(F.col("label") == int(key), value).otherwise(named)
    return rows.select("customer_id", "label", named.alias("label_name"), render(settings.category_label, rows.columns).alias("client_stats"))


def _line(title: str, value: Column) -> Column:
    return F.concat(F.lit(f"* {title}: "), value)


def _block(title: str, name: str) -> Column:
    return F.concat(F.lit(f"* {title}:\n"), F.coalesce(F.col(name), F.lit(NO_CATEGORY)), F.lit("\n"))


# The wording of profiles, which prompts and models rely on.
def _plain_text(label: str, columns: list[str]) -> Column:
    count = lambda c: F.col(c).cast("string")
    return F.concat_ws(
        "\n", F.concat(F.lit("* Период активности: "), count("active_days"), F.lit(" дней")), _line("Всего операций", count("n_txn")), _line("Среднее число операций в день", numbers.as_text(F.col("txn_per_day"))),
        _block(f"Распределение по {label}", "freq"), _block(f"Объем расходов по {label}", "total"), _line("Общий доход", numbers.as_text(F.col("total_income"))), _line("Средний доход на операцию", numbers.as_text(F.col("avg_income"))),
        _line("Общие расходы", numbers.as_text(F.col("total_expense"))), _line("Средний расход на операцию", numbers.as_text(F.col("avg_expense"))),
    )


def _churn_text(label: str, columns: list[str]) -> Column:
    count = lambda c: F.col(c).cast("string")
    part = lambda c: numbers.as_text(F.bround(F.col(c), 4))
    dynamic = F.concat_ws(
        "\n", F.lit("* Динамика активности:"), F.concat(F.lit("  - Операций в первой половине периода: "), count("first_half_txn")), F.concat(F.lit("  - Операций во второй половине периода: "), count("second_half_txn")),
        F.concat(F.lit("  - Относительное изменение числа операций: "), part("txn_change")), F.concat(F.lit("  - Относительное изменение суммы операций: "), part("amount_change")),
        F.concat(F.lit("  - Изменение разнообразия категорий: "), count("diversity_change")), F.concat(F.lit("  - Отношение активности в последней четверти к первой: "), numbers.as_text(F.col("recency_ratio"))),
        F.concat(F.lit("  - Последние месячные количества операций: "), F.coalesce("months", F.lit(""))),
    )
    parts = [
        F.concat(F.lit("* Период активности: "), count("active_days"), F.lit(" дней")), _line("Активных месяцев", count("active_months")), _line("Всего операций", count("n_txn")),
        _line("Среднее число операций в день", numbers.as_text(F.col("txn_per_day"))), _line("Среднее число операций в месяц", numbers.as_text(F.col("txn_per_month"))),
    ]
    if "currencies" in columns:
        parts.append(_line("Валюты операций", F.coalesce("currencies", F.lit(""))))
    if "types" in columns:
        parts.append(_block("Распределение по типам операций", "types"))
    parts += [_block(f"Распределение по {label}", "freq"), _block(f"Сумма операций по {label}", "total"), F.when(F.col("first_half_txn").isNotNull(), dynamic)]
    parts += [_line("Общая сумма операций", numbers.as_text(F.col("amount_sum"))), _line("Средняя сумма операции", numbers.as_text(F.col("amount_mean"))), _line("Медианная сумма операции", numbers.as_text(F.col("amount_median"))), _line("Максимальная сумма операции", numbers.as_text(F.col("amount_max")))]
    return F.concat_ws("\n", *parts)

"""Answers and claims of a language model: choice of samples, votes, merging, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from purselight.functions import text


def single_sample(answers: DataFrame) -> DataFrame:
    """One answer per client: sample 0, else the one of least number. A prediction other than 0 or 1 becomes -1."""
    rank = F.row_number().over(Window.partitionBy("customer_id").orderBy((F.col("sample_id") != 0).cast("int"), "sample_id"))
    rows = answers.withColumn("rank", rank).withColumn("n_available_samples", F.count("*").over(Window.partitionBy("customer_id"))).where("rank = 1")
    scored = F.col("predicted").isin(0, 1)
    return rows.select("customer_id", "label", F.when(scored, F.col("predicted")).otherwise(-1).alias("prediction"), F.when(scored, F.col("predicted").cast("double")).alias("score"), F.col("sample_id").alias("sample_id_used"), "n_available_samples")


def coverage(chosen: DataFrame) -> DataFrame:
    """n_total, n_scored, n_unscored, coverage."""
    scored = F.count_if(F.col("prediction").isin(0, 1))
    return chosen.agg(F.count("*").alias("n_total"), scored.alias("n_scored"), (F.count("*") - scored).alias("n_unscored"), F.coalesce(F.try_divide(scored, F.count("*")), F.lit(0.0)).alias("coverage"))


def majority_vote(answers: DataFrame) -> DataFrame:
    """Per client: 1 only if it has more votes than 0; score is the share of 1; -1 and null without valid votes."""
    ones, zeros = F.count_if(F.col("predicted") == 1), F.count_if(F.col("predicted") == 0)
    valid = ones + zeros
    return answers.groupBy("customer_id").agg(
        F.min("label").alias("label"), F.when(valid == 0, -1).when(ones > zeros, 1).otherwise(0).alias("prediction"), F.try_divide(ones, valid).alias("score"), F.count("*").alias("n_samples"), valid.alias("n_valid"), (valid / F.count("*")).alias("valid_rate")
    )


def raw_answers(answers: DataFrame, errors: int = 3) -> DataFrame:
    """Per client, answers in order of sample and the first errors."""
    rows = answers.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", "predicted_raw", "error"))).alias("x"))
    return rows.select("customer_id", F.col("x.predicted_raw").alias("raw_answers"), F.slice(F.filter(F.col("x.error"), lambda e: e.isNotNull() & (e != "")), 1, errors).alias("errors"))


def unique_claims(rows: DataFrame, column: str = "claims") -> DataFrame:
    """rows, with no claims in the array `column` that differ from an earlier one in case only.

    Claims are sorted by their lower-case form and place, so that each is compared with the one before it only; the
    sorted array is a column of its own, as an expression inside a lambda would be evaluated anew for each element.
    """
    held = rows.withColumn("_sorted", F.array_sort(F.transform(column, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("at"), x.alias("claim")))))
    first = F.filter("_sorted", lambda x, i: (i == 0) | ~F.get(F.col("_sorted"), i - 1)["low"].eqNullSafe(x["low"]))
    order = F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["claim"].alias("claim"))))
    return held.withColumn(column, F.transform(order, lambda x: x["claim"])).drop("_sorted")


def merge_claims(rows: DataFrame) -> DataFrame:
    """Claims (array) of all samples of a client in order of sample, without repetitions."""
    merged = rows.groupBy("customer_id").agg(F.min("label").alias("label"), F.array_sort(F.collect_list(F.struct("sample_id", "claims"))).alias("x"))
    return unique_claims(merged.select("customer_id", "label", F.flatten("x.claims").alias("claims")))


def flatten_claims(rows: DataFrame, cyrillic_only: bool = False, labelled_only: bool = False) -> DataFrame:
    """customer_id, label, place, claim: cleaned claims that are not empty."""
    out = rows.select("customer_id", "label", F.posexplode("claims").alias("place", "claim")).withColumn("claim", text.clean_claim(F.col("claim"))).where(F.length("claim") > 0)
    out = out.where(text.has_cyrillic(F.col("claim"))) if cyrillic_only else out
    return out.where("label >= 0") if labelled_only else out


def majority_facts(facts: DataFrame) -> DataFrame:
    """Facts (customer_id, fact, gender) of each client's most frequent gender; of equals the first in order of text."""
    known = facts.where("gender is not null and gender <> ''")
    best = known.groupBy("customer_id", "gender").agg(F.count("*").alias("n")).groupBy("customer_id").agg(F.min_by("gender", F.struct(-F.col("n"), "gender")).alias("gender"))
    return known.join(best, ["customer_id", "gender"])


def error_histogram(rows: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent errors."""
    return rows.where("error is not null").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(most)


def prompts(clients: DataFrame, template: str, system: str, summary: str, few_shot: str) -> DataFrame:
    """clients (with client_stats) and their system_prompt and user_prompt."""
    user = text.fill(F.lit(template), SUMMARY_TRANSACTIONAL_STATS=F.lit(summary), FEW_SHOT_EXAMPLES=F.lit(few_shot), CLIENT_STATS=F.col("client_stats"))
    return clients.withColumns({"system_prompt": F.lit(system), "user_prompt": user})


def dialogues(prompts: DataFrame, samples: int) -> DataFrame:
    """A row for each sample, with the messages to send."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    rows = prompts.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return rows.withColumn("messages", F.array(message("system", "system_prompt"), message("user", "user_prompt")))


def few_shot_text(examples: list[tuple[str, str]]) -> str:
    """Examples as (label name, profile)."""
    return "\n".join(["Примеры клиентов из обучающей выборки:\n", *(f"\nКлиент {i} — {name}:\n{stats}\n" for i, (name, stats) in enumerate(examples, 1))])


def model_text(system: Column, stats: Column, label_names: dict[str, str]) -> Column:
    """Input of a sequence classifier: instruction, profile, options."""
    options = ", ".join(f"{k} ({v})" for k, v in sorted(label_names.items(), key=lambda x: int(x[0])))
    return F.concat(system, F.lit("\n\nДанные клиента:\n"), stats, F.lit(f"\n\nВарианты ответа: {options}."))

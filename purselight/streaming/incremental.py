"""Client profiles kept up to date over a stream of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_profiles(events: DataFrame) -> DataFrame:
    """customer_id, n_txn, total_income, total_expense, last_seen so far: one state row per client."""
    amount = F.col("amount")
    return events.groupBy("customer_id").agg(F.count("*").alias("n_txn"), F.sum(F.when(amount > 0, amount).otherwise(0)).alias("total_income"), F.sum(F.when(amount < 0, amount).otherwise(0)).alias("total_expense"), F.max("tr_datetime").alias("last_seen"))


def daily_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """customer_id, day, n: transactions per day, final once the watermark has passed the day."""
    days = events.withWatermark("tr_datetime", late).groupBy("customer_id", F.window("tr_datetime", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return days.select("customer_id", F.to_date("w.start").alias("day"), "n")


def write_profiles(profiles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the table at path equal to the profiles: every batch replaces it."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return profiles.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace).trigger(availableNow=True).start()

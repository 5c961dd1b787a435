"""Readers: transaction splits, JSON lines, feature tables, settings, templates."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purselight.functions import dates, numbers
from purselight.schema import OPTIONAL, REQUIRED, Settings, rename_roles, require


def load_settings(path: str) -> Settings:
    """Settings from YAML with sections dataset, pipeline and others; keys of label_names become text."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    data = raw.get("dataset", {})
    names = {str(k): v for k, v in data.get("label_names", {}).items()}
    rest = {k: v for k, v in raw.items() if k != "dataset"}
    return Settings(data.get("name", "default"), data.get("columns", {}), names, data.get("category_label", "категории трат"), bool(data.get("churn_profile", False)), data.get("splits", {}), rest)


def expand_env(value: str) -> str:
    """${NAME} and $NAME from the environment; unknown names stay."""
    return os.path.expandvars(value)


def load_template(base: str, name: str) -> str:
    path = os.path.join(base, name)
    if not os.path.exists(path):
        raise FileNotFoundError(f"no template at {path}")
    with open(path, encoding="utf-8") as f:
        return f.read()


#: How split files quote: a quote inside quotes is doubled.
CSV = {"header": True, "escape": '"'}


def typed(df: DataFrame) -> DataFrame:
    """Internal columns in their types: bad time stamps are null, bad amounts 0, a missing or bad label -1."""
    ts = F.col("tr_datetime")
    ts = dates.parse(ts) if dict(df.dtypes)["tr_datetime"] == "string" else ts
    whole = lambda c, kind: F.coalesce(F.col(c).try_cast(kind), F.col(c).try_cast("double").try_cast(kind))  # noqa: E731  also 1.0
    return df.withColumns({"customer_id": whole("customer_id", "long"), "tr_datetime": ts, "amount": numbers.number(F.col("amount")), "label": F.coalesce(whole("label", "int"), F.lit(-1))})


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file, or folder of files with one header, as text columns named by that header.

    With multi_line, quoted values may hold line ends, and a file is not split among tasks; without, it is.
    """
    reader = spark.read.options(**CSV, multiLine=multi_line)
    names = reader.csv(path).columns
    # Every file's header must be the first one's: a column in another place is an error, not another column's value.
    return reader.option("enforceSchema", False).schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(path)


def read_transactions(spark: SparkSession, path: str, settings: Settings | None = None, multi_line: bool = True) -> DataFrame:
    """A split in CSV as the internal table: its columns are found by the names in the header, in any order.

    The optional columns come along where the file has them; others are not read.
    """
    rows = require(rename_roles(read_csv(spark, path, multi_line), (settings or Settings()).columns))
    return typed(rows.select(*REQUIRED, *(c for c in OPTIONAL if c in rows.columns)))


def read_splits(spark: SparkSession, settings: Settings, multi_line: bool = True) -> DataFrame:
    """All splits, with their name in column split; an optional column that a split lacks is null there."""
    parts = [read_transactions(spark, path, settings, multi_line).withColumn("split", F.lit(name)) for name, path in settings.splits.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_jsonl_grouped(spark: SparkSession, path: str, schema: T.StructType, order: str = "sample_id") -> DataFrame:
    """JSON lines by customer_id: column rows holds them in order."""
    rows = read_jsonl(spark, path, schema)
    key = F.struct(F.col(order), *(c for c in rows.columns if c != order))
    return rows.groupBy("customer_id").agg(F.array_sort(F.collect_list(key)).alias("rows"))


def read_features(spark: SparkSession, folder: str, split: str, fallback: str | None = None) -> DataFrame:
    """The split's feature table, else the rows of that split in the fallback, which must have a column split."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(split_path(f"{folder}/cot_features.parquet", split))
    except AnalysisException:
        if fallback is None:
            raise
        return require(spark.read.parquet(fallback), ("split",)).where(F.col("split") == split).drop("split")


def read_with_fallback(first, *others):
    """The first reader (a function without parameters) that works; the first one's error if none does."""
    try:
        return first()
    except Exception as error:
        for other in others:
            try:
                return other()
            except Exception:  # noqa: S112  the first error is the one that says what was asked for
                continue
        raise error


def split_path(path: str, split: str | None) -> str:
    """stem.suffix -> stem_split.suffix."""
    return path if split is None else re.sub(r"(\.[^./]+)?$", rf"_{split}\1", path, count=1)

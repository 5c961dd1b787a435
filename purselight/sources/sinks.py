"""Writers: tables, JSON documents, text, Markdown."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame

from purselight.sources.files import CSV


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV that read_csv() takes back, quotes and line ends included; with `order`, rows are sorted over all files."""
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").options(**CSV).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, in a folder for each value of column `by` if given."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def write_text(text: str, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def write_document(value: dict | list, path: str) -> None:
    write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str), path)


def merge_document(value: dict, path: str) -> dict:
    """Put the entries of value into the document at path, which keeps its others."""
    old = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
    write_document(old | value, path)
    return old | value


def markdown(df: DataFrame, order: list) -> str:
    """A small result table in Markdown, sorted; a sentence if it is empty."""
    rows = df.orderBy(*order).collect()
    if not rows:
        return "No metrics found.\n"
    cell = lambda x: "" if x is None else str(x)
    lines = [df.columns, ["---"] * len(df.columns), *([cell(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"

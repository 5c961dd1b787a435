"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is the written result of the stage before (at first, documents), and
returns a DataFrame; all but the last return the columns of documents:

1. quality rules: documents that a base rule or a forest rejects go;
2. line dedup: later copies of repeated runs of lines go, and documents of which no word is left through that;
3. MinHash near-dedup: of each group of near-duplicates the document with the least doc_id stays;
4. benchmark decontamination: documents that hold a benchmark item, also edited, go;
5. best-fit packing: the pieces of what is left, with sequence and offset.

Defined results: null and empty texts go in stage 1, as they have less than 50 words; very long texts pass every stage
whole; rows with a null doc_id are judged like others in stages 1, 2 and 4, but stay in stage 3, as no id tells them
apart; repeated rows stay or go together in stages 1, 3 and 4 and lose the same lines in stage 2; ties are settled as
the operators say; an empty table gives an empty result; further columns of documents pass through the first four
stages, whatever their names, and are not in the result of the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from purselight.llm import bin_completion, common, decontaminate, line_suffix, minhash_hamming, quality_forest, queries
from purselight.plans.ship import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_forest.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality_forest.filter_documents(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_suffix.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_hamming.filter_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.filter_documents(docs, common.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_completion.pack(docs, queries.tokenizer_path())


def _tidy(stage: Stage) -> Stage:
    """The stage; first it deletes tables that an earlier stage left in the shared folder, whose result is written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        common.release_stage(spark)
        with common.stage_scratch(spark):
            return stage(spark, docs, sf_dir)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


STAGES: list[tuple[str, Stage]] = [(f.__name__, _tidy(f)) for f in (quality_rules, line_dedup, near_dedup, decontamination, packing)]

#: SQL cannot express the isolation forests of the first stage; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result written to the shared folder as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return docs

"""The training-data pipeline over ``documents``: filter, clean, deduplicate, decontaminate, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and reads it again as the next
stage's input. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, packing, quality, signature_join
from tidemark.llm._shared import fresh, scratch, stage, table, unstage
from tidemark.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier calls good; it learns from the labelled rows of ``documents`` that may be learnt from."""
    model = quality.fit(docs, quality.taught(table(spark, sf_dir, "labels")))
    names = fresh("score", docs.columns), fresh("predicted", docs.columns)
    return quality.score(docs, model, docs.columns, names).filter(F.col(names[1]) == 1).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut runs of lines that stand earlier as well; texts of which nothing is left go."""
    removed = fresh("removed_lines", docs.columns)
    # written first: a filter on the new text would be pushed below it and cut every text anew for each use
    cut = stage(line_dedup.deduplicate(docs, removed), "cut-lines")
    left = cut.filter((F.col(removed) == 0) | (F.trim(F.col("text"), F.lit(" \n\r\t")) != ""))
    changed = F.col(removed) > 0
    return left.select(*(F.when(changed, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id."""
    return signature_join.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.remove_leaked(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece of a document, with its place."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: a trained network, shingle components and a tokenizer are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = stage(step(spark, before, sf_dir), name.replace(" ", "-"))
            keep(docs)
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)

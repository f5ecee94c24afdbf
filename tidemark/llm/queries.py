"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import signature_join

    return signature_join.similarity_components(table(spark, sf_dir, "documents"))


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import transport_stream

    return transport_stream.round_trip(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import decontaminate

    return decontaminate.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import line_dedup

    return line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import token_store
    from tidemark.llm._shared import staged_path

    path = staged_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_store.digest(token_store.read(spark, path))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import chat_format

    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(said))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.round_trip(rows, tokenizer_path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm import line_dedup, signature_join

    return {"op1_signature_join": signature_join.SQL, "op6_line_dedup": line_dedup.SQL}

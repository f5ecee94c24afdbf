"""Token ids as Parquet list columns that allow selective reads (operator 8).

``write`` encodes every text, appends the end id, and lets Spark's Parquet writer
lay the ids out: rows in ascending ``doc_id`` order over range partitions, format
version 2 (so integer columns without a useful dictionary become delta-packed),
row groups and pages of stated sizes, and page indexes. A reader that wants the
metadata only, or a few documents, skips the id pages altogether.

Defined results: a null text is the empty text and holds the end id alone; rows
that repeat a ``doc_id`` stay, ordered by the hash of their texts; a null
``doc_id`` sorts first; a text of any length is one row; other input columns are
ignored; an empty table makes an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import bounded_batches, partitions_for, text_of
from tidemark.llm._tokens import END_ID

ENCODED = "doc_id long, n_tokens long, text_crc32 long, part int, before long, ids array<int>"

#: Writer settings: dictionary where it pays, else delta packing; 32 MB row groups, 256 kB pages.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "20000",
    "compression": "zstd",
}


#: Files of a store: a reader broadcasts 16 bytes for each.
MOST_FILES = 1 << 17


def encode_partition(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, part -> the rows of the store; ``before`` counts the ids before a row in its partition."""
    from tidemark.llm._tokens import tokenizer

    encoder, before = tokenizer(path), 0
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        if not batch.num_rows:
            continue
        packed = [encoder.ids(x) + end for x in text_of(batch.column(1))]
        sizes = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
        ends = np.cumsum(sizes)
        flat = pa.array(np.frombuffer(b"".join(packed), "<u4").view(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), flat)
        crc = pa.array([zlib.crc32(x) for x in packed], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), crc, batch.column(2), pa.array(before + ends - sizes), lists],
            ["doc_id", "n_tokens", "text_crc32", "part", "before", "ids"],
        )
        before += int(ends[-1])


def write(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode ``documents`` (doc_id, text) and write the store to ``path``."""
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    if (partitions or 0) > MOST_FILES:
        raise ValueError(f"at most {MOST_FILES} partitions")
    placed = (
        rows.repartitionByRange(partitions or min(partitions_for(rows), MOST_FILES), F.col("doc_id"), tie)
        .sortWithinPartitions("doc_id", tie)
        .withColumn("part", F.spark_partition_id())
    )
    encoded = placed.mapInArrow(lambda b: encode_partition(b, tokenizer_path, end_id), ENCODED)
    writer = encoded.write
    for key, value in LAYOUT.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The store, with ``start``: the ids of all documents before this one.

    ``columns`` keeps the scan to what is asked for; ids are read only if named.
    """
    raw = spark.read.schema(ENCODED).parquet(path)
    # one row per partition of the writer, MOST_FILES at most: broadcast, so that no ids are shuffled
    totals = raw.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("ids_here"))
    from pyspark.sql import Window

    offsets = totals.select(
        F.col("part").alias("_part"),
        F.coalesce(F.sum("ids_here").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
    )
    out = raw.join(F.broadcast(offsets), raw["part"] == offsets["_part"]).withColumn("start", F.col("_offset") + F.col("before"))
    return out.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def _crc_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        bounds = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids read back (little-endian unsigned 32-bit)."""
    bounded_batches(store.sparkSession)
    return store.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc_partition, "doc_id long, start long, n_tokens long, ids_crc32 long")

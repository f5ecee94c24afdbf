"""File sources and sinks: CSV and Parquet with stated schemas, object listings, copies."""

from __future__ import annotations

import atexit
import logging
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, check_header: bool = False) -> DataFrame | None:
    """CSV with a header; a missing trailing column becomes null. None if the path can't be read.

    ``check_header`` compares the header with the schema by position, so that a
    reordered file fails instead of shifting its columns.
    """
    try:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", not check_header).csv(path if isinstance(path, str) else list(path))
    except Exception:
        log.exception("can't read %s", path)
        return None


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose columns are matched by name: any order, missing ones as typed nulls."""
    raw = spark.read.option("header", True).csv(path)
    have = set(raw.columns)
    return raw.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """Parquet; with a schema, columns that older files lack are null. None if the path can't be read."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except Exception:
        log.exception("can't read %s", path)
        return None


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", files: int | None = None, partition_by: Sequence[str] = ()) -> bool:
    """Overwrite a Parquet directory; ``files`` bounds the number of files for small results."""
    try:
        out = df.coalesce(files) if files else df
        writer = out.write.mode("overwrite").option("compression", compression)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    except Exception:
        log.exception("can't write %s", path)
        return False
    return True


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); where there is one process only, in a temporary folder."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        shared = f"file://{shared}"
    return f"{shared.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: cast, and typed nulls where absent."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def schema_drift(df: DataFrame, schema: T.StructType) -> dict[str, list[str]]:
    """Columns missing, unexpected, or of another type."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    return {
        "missing": [c for c in want if c not in have],
        "unexpected": [c for c in have if c not in want],
        "retyped": [c for c in want if c in have and have[c] != want[c]],
    }


LISTING = T.StructType().add("key", "string").add("size_bytes", "long").add("storage_class", "string").add("last_modified", "timestamp_ntz")


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects under a path with size and time; contents are not read (S7). Empty if the path can't be listed.

    File systems don't tell the storage class; it is null, and filled by joining an inventory that has it.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return files.select(F.col("path").alias("key"), F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("storage_class"), F.col("modificationTime").cast("timestamp_ntz").alias("last_modified"))
    except Exception:
        log.exception("can't list %s", path)
        return spark.createDataFrame([], LISTING)


def list_files(spark: SparkSession, bucket: str, prefix: str = "") -> list[str]:
    """Keys under ``bucket`` (any URI Hadoop can open) that begin with ``prefix``, in order; an empty list if it can't be listed."""
    root = bucket.rstrip("/") + "/"
    folder = prefix.rpartition("/")[0]
    keys = (r["key"] for r in list_objects(spark, root + folder).select("key").toLocalIterator())
    plain = re.compile(r"^\w+:/*")
    base = plain.sub("/", root)
    return sorted(k for k in (plain.sub("/", key).removeprefix(base) for key in keys) if k.startswith(prefix))


def _copy(spark: SparkSession, source: str, target: str) -> bool:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    try:
        a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
        return bool(jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf))
    except Exception:
        log.exception("can't copy %s to %s", source, target)
        return False


def upload_file(spark: SparkSession, file_path: str, bucket: str, key: str) -> bool:
    """Copy a local file to ``bucket`` (any URI Hadoop can open) under ``key``."""
    return _copy(spark, f"file://{file_path}" if file_path.startswith("/") else file_path, f"{bucket.rstrip('/')}/{key}")


def download_file(spark: SparkSession, bucket: str, key: str, file_path: str) -> bool:
    """Copy an object to a local file."""
    return _copy(spark, f"{bucket.rstrip('/')}/{key}", f"file://{file_path}" if file_path.startswith("/") else file_path)

"""Session and settings (Q10)."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Where data lives; ports, users and passwords are no part of it. The names are fixed values of the contract."""

    aws_region: str = "us-east-1"
    aws_account_id: str = ""
    s3_bucket_raw: str = ""
    s3_bucket_processed: str = ""
    s3_bucket_analytics: str = ""
    data_raw_path: str = "data/raw"
    data_processed_path: str = "data/processed"
    redshift_host: str = ""
    redshift_database: str = ""


def get_config(prefix: str = "") -> dict[str, str]:
    """The nine settings, each from the environment variable of its name in capitals (after ``prefix``) or its default."""
    return {name: os.environ.get(prefix + name.upper(), default) for name, default in asdict(Settings()).items()}


def session(name: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, zone-free timestamps and adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=conf).getOrCreate()

"""Tables that are replaced as a whole, atomically: versioned Parquet directories and a pointer."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.merge import require_unique
from tidemark.operators.merge import upsert as merge_upsert
from tidemark.sources.files import with_schema


class VersionedTable:
    """``path`` holds ``v=N`` directories; the file ``_CURRENT`` names the one to read.

    A commit writes the next directory, then renames a new pointer over the old
    one, so readers see the old or the new version. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> str | None:
        """What the pointer file says."""
        pointer = self._fs_path(f"{self.path}/_CURRENT")
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return stream.readLine()
        finally:
            stream.close()

    def _point(self, text: str) -> None:
        """Swap the pointer file atomically."""
        fresh, pointer = self._fs_path(f"{self.path}/_NEXT"), self._fs_path(f"{self.path}/_CURRENT")
        out = self._fs.create(fresh, True)
        out.write(bytearray(f"{text}\n".encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.valueOf("OVERWRITE")
        context.rename(fresh, pointer, over)

    def version(self) -> int | None:
        said = self._pointer()
        return None if said is None else int(said)

    def create(self) -> None:
        """Make an empty first version unless the table exists."""
        if self.version() is None:
            self.commit(self.spark.createDataFrame([], self.schema))

    def read(self, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        if at is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={at}")

    def commit(self, df: DataFrame) -> int:
        now = self.version()
        after = 0 if now is None else now + 1
        with_schema(df, self.schema).write.mode("overwrite").parquet(f"{self.path}/v={after}")
        self._point(str(after))
        return after

    def update(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Commit ``change`` of the current version."""
        return self.commit(change(self.read()))

    def drop_old(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions."""
        now = self.version()
        for at in range(0, 0 if now is None else now + 1 - keep):
            self._fs.delete(self._fs_path(f"{self.path}/v={at}"), True)


class BucketedTable(VersionedTable):
    """A versioned table in buckets by the hash of its key; an upsert reads and rewrites only the buckets it touches (M1).

    The pointer names, for every bucket, the version that holds it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int):
        super().__init__(spark, path, schema)
        self.keys, self.number = list(keys), buckets

    def _state(self) -> tuple[int, dict[int, int]]:
        said = self._pointer()
        if said is None:
            return -1, {}
        state = json.loads(said)
        return state["version"], {int(b): v for b, v in state["buckets"].items()}

    def version(self) -> int | None:
        at = self._state()[0]
        return None if at < 0 else at

    def buckets(self) -> dict[int, int]:
        """Bucket -> the version that holds it."""
        return self._state()[1]

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        held = self.buckets()
        chosen = [f"{self.path}/v={held[b]}/_b={b}" for b in (held if buckets is None else buckets) if b in held]
        return self.spark.read.schema(self.schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], self.schema)

    def upsert(self, source: DataFrame) -> int:
        """Rows of ``source`` replace those of equal key; the new version, or the old one if there is nothing to do."""
        require_unique(source, self.keys)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.number)).cast("int")
        version, held = self._state()
        touched = [r["b"] for r in source.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return max(version, 0)
        rows = merge_upsert(self.read(touched), with_schema(source, self.schema), self.keys, check=False)
        rows.withColumn("_b", bucket).repartition(min(len(touched), self.number), "_b").write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/v={version + 1}")
        self._point(json.dumps({"version": version + 1, "buckets": held | dict.fromkeys(touched, version + 1)}))
        return version + 1

    def commit(self, df: DataFrame) -> int:
        raise NotImplementedError("a bucketed table changes by upserts")

    def drop_old(self, keep: int = 2) -> None:
        """Delete versions that hold no bucket any more; ``keep`` doesn't matter, older states can't be read."""
        version, held = self._state()
        for at in set(range(version)) - set(held.values()):
            self._fs.delete(self._fs_path(f"{self.path}/v={at}"), True)


def compact(df: DataFrame, total_bytes: int, target_mb: int = 256) -> DataFrame:
    """``df`` dealt to as many partitions as files of the target size would take."""
    return df.repartition(max(1, math.ceil(total_bytes / (target_mb * 1024 * 1024))))

"""Helpers that the operators of this package share: tables, staging, Arrow batches, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_STAGE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store it can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    where = tempfile.mkdtemp(prefix="tidemark-ship-")  # the driver serves it for as long as it lives
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    archive = Path(where) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def bounded_batches(spark: SparkSession, records: int = 1000, size: str = "16m") -> None:
    """Keep the Arrow batches that Python workers get small: rows and bytes are both bounded."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset and Spark runs inside one process, a temporary folder
    stands in; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_STAGE:
        _LOCAL_STAGE[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _LOCAL_STAGE[context.applicationId], ignore_errors=True)
    return _LOCAL_STAGE[context.applicationId]


#: Paths of staged tables that haven't been deleted.
_STAGED: set[str] = set()


def staged_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    _STAGED.add(path)
    return path


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts lineage and keeps costly Python output from being computed twice; it
    survives lost executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    writer = df.write.option("compression", "zstd")
    for key, value in (options or {}).items():
        writer = writer.option(key, value)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _STAGED.discard(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table once nothing will read it again."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        _delete(df.sparkSession, path)


def unstage_all(spark: SparkSession) -> None:
    """Delete all staged tables: results that haven't been written elsewhere are lost. Runs when the driver ends."""
    for path in list(_STAGED):
        _delete(spark, path)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _STAGED else None
    if spark is not None:
        with suppress(Exception):  # the session may be gone already
            unstage_all(spark)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """What is staged inside is deleted at the end, but for tables named through the function it gives."""
    before, kept = set(_STAGED), set()
    yield lambda df: kept.add(df._tidemark_path)
    for path in _STAGED - before - kept:
        _delete(spark, path)


#: Bytes of input that a task of a shuffle with a stated number of partitions gets, about.
TASK_BYTES = 64 << 20


def expected_bytes(rows: DataFrame) -> int:
    """What Spark expects ``rows`` to hold, 0 where it can't tell; meant for scans, not for joins."""
    expected = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return expected if expected < 1 << 60 else 0


def partitions_for(rows: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Partitions for a shuffle of what comes of ``rows``: as configured, or more where Spark expects many bytes."""
    return max(shuffle_partitions(rows.sparkSession), min(-(-expected_bytes(rows) // task_bytes), 1 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column of ``taken`` is called so (case aside)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def text_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def pieces_by_bytes(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column holds about ``limit`` bytes each, one row at least."""
    array = batch.column(column)
    sizes = np.zeros(len(array), np.int64)
    if len(array):
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(array):
        yield batch.slice(start)


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer over an array of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the odd step and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_STEP, _STEP_INVERSE)):
            full = np.full(max(n, 2 * len(_POWERS[0]) if k == 0 else len(_POWERS[0])), _U(base))
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0], _POWERS[1]


#: ASCII white space of the word rule; a byte's weight: A-Z as a-z, white space as nothing.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_WEIGHT = np.arange(1, 257, dtype=_U)
_WEIGHT[65:91] += _U(32)
_WEIGHT[_SPACE] = 0

#: Bytes hashed at a time; a longer text goes on in further blocks cut between words.
_BLOCK = 1 << 20


def _block_hashes(raw: np.ndarray) -> np.ndarray:
    gap = _SPACE[raw]
    begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    if not gap[0]:
        begin = np.concatenate(([0], begin))
    if not len(begin):
        return np.empty(0, _U)
    up, down = _powers(len(raw))
    weighed = _WEIGHT[raw]
    weighed *= up[: len(raw)]
    # a word's sum, freed from where it stands; the mixing makes all 64 bits depend on it
    return mix64(np.add.reduceat(weighed, begin) * down[begin])


def word_hashes(text: str | bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased, in order.

    A word is a run of characters other than ASCII white space; its hash is a
    polynomial over its UTF-8 bytes modulo 2**64, then mixed.
    """
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, _U)
    with np.errstate(over="ignore"):
        if len(raw) <= _BLOCK:
            return _block_hashes(raw)
        out, at = [], 0
        while at < len(raw):
            end = min(at + _BLOCK, len(raw))
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
            out.append(_block_hashes(raw[at:end]))
            at = end
        return np.concatenate(out)


_PLACE = mix64(np.arange(1, 65, dtype=_U)) | _U(1)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the ``size``-word shingles of a word sequence, in order, repeats kept.

    Fewer words than ``size`` make one shingle of the whole sequence; none make none.
    """
    if not len(words):
        return words
    width = min(size, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, _U(width))
        for j in range(width):
            out += words[j : j + n] * _PLACE[j]
        return mix64(out)

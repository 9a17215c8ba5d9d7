"""Staging, table access and size-checked broadcasts shared by the operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is at most this many bytes; beyond it the join shuffles.
BROADCAST_LIMIT = 32 * 1024 * 1024
#: A key of over 1 / HOT of a table's rows (and of over LEAST_HOT) is hot: its rows are split over several tasks.
HOT, LEAST_HOT = 1024, 1000
_local: list[str] = []


class _Staged(threading.local):
    """The paths that this thread has staged."""

    def __init__(self):
        self.paths: list[str] = []


_staged = _Staged()


#: Rows and bytes handed to a Python worker at a time: they bound its memory where single texts reach hundreds of kB.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bounded(spark: SparkSession) -> None:
    for k, v in BATCH.items():
        spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a private temporary folder only for a local master without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="narrata-stage-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = f"{stage_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow; when a task ends, memory it has freed goes back to the system, as workers are used again for others."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def staged_so_far() -> int:
    """A mark for clear_staged."""
    return len(_staged.paths)


def clear_staged(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes what this thread has staged after a mark, but for the last `keep` tables.

    For when results are written: they read staged tables until then.
    """
    conf = spark._jsc.hadoopConfiguration()
    end = len(_staged.paths) - keep
    for name in _staged.paths[since:end]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _staged.paths[since:end]


def small(df: DataFrame, n_bytes: int) -> DataFrame:
    """df with a broadcast hint if its size, measured by the caller, is within BROADCAST_LIMIT."""
    return F.broadcast(df) if n_bytes <= BROADCAST_LIMIT else df


def hot_keys(counts: DataFrame, key: str, n: int) -> DataFrame:
    """key, _salts: the keys of over 1 / HOT of n rows, of which there can't be more than HOT; and how many tasks to split them over.

    counts: key, and its number of rows in n.
    """
    least = max(n // HOT, LEAST_HOT)
    return counts.where(F.col("n") > least).select(key, F.ceil(F.col("n") / least).cast("int").alias("_salts"))


def salted(rows: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """rows with _salt: the part of a hot key (see hot_keys) that a hash of `by` puts a row in, 0 for other keys."""
    parts = F.coalesce(F.col("_salts"), F.when(F.col(key).isNull(), F.lit(HOT)).otherwise(F.lit(1)))
    return rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_salts")


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows (salted) joined with lookup (one row for each key), whose row of a hot key is repeated for each of its parts."""
    lookup = lookup.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return rows.join(lookup, [key, "_salt"], how).drop("_salt")


def hot_join(rows: DataFrame, lookup: DataFrame, key: str, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with lookup by key; the rows of a hot key that meet in one task are about 1 / HOT of all at most."""
    return salted_join(salted(rows, key, by, hot), lookup, key, hot, how)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift, multiply), in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_key() -> "F.Column":
    """16 bytes that stand for a row: of its doc_id and its text (null: empty). Only repeated rows share it."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce("text", F.lit("")))))

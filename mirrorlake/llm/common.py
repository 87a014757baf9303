"""Helpers shared by the training-data operators.

Work tables go to the folder named in ``spark.checkpoint.dir``, which every
executor and the driver share; a private temporary folder is used only where
that setting is absent (tests on one machine).
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.deploy import ship

_own_dir: list[str] = []
#: Paths of the work tables written since each scratch() began.
_scratch: list[list[str]] = []
#: Numbers of a vector in one row, so that no buffer between tasks and driver holds a long vector whole; numbers that the driver adds up itself.
PIECE, HELD = 1 << 15, 1 << 18


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder shared by driver and executors."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="mirrorlake-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = ship(df.sparkSession)
    path = new_dir(spark, name)
    for made in _scratch[-1:]:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Remove the work tables written within when it is left, but for those handed to the function that it gives.

    Whatever is computed later must not read them. After a failure nothing is removed.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(made[-1:])
        return df

    _scratch.append(made)
    try:
        yield keep
    finally:
        _scratch.remove(made)
    for path in made:
        if path not in kept:
            remove(spark, path)
    release(spark)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that are written and done with; else they stay until the driver happens to collect garbage."""
    for _ in range(2):  # what the first round frees may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that clash with the ones an operator adds (any letter case)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def crc_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def binary_values(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, one value at a time."""
    for value in column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary()):
        yield value.as_py()


def _pieces(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["at", "blob"])


def tree_sum(parts: DataFrame, size: int, fan_in: int = 8) -> np.ndarray | None:
    """Sum float64 vectors of ``size`` numbers held as rows (``at``, ``blob``): the bytes of those from place ``at`` on.

    Every task hands in one vector. They are added up in rounds of about
    ``fan_in`` vectors a task, so the driver receives at most ``fan_in``, and a
    single one of those so long that fewer than two are ``HELD`` numbers. None when there is no vector.
    """

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(value.as_py())
                if at in total:
                    total[at] += x
                else:
                    total[at] = x.copy()
        if total:
            yield _pieces(total)

    n = parts.rdd.getNumPartitions()
    while n > min(fan_in, max(1, HELD // size)):
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(add, "at int, blob binary")
    total = None
    for at, blob in parts.collect():
        total = np.zeros(size) if total is None else total
        x = np.frombuffer(bytes(blob))
        total[at : at + len(x)] += x
    return total


def per_task_vector(df: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray | None:
    """Fold all rows into one float64 vector: a partial per task, then ``tree_sum``."""

    def fold(batches):
        total = np.zeros(size)
        some = False
        for batch in batches:
            if batch.num_rows:
                some = True
                add(total, batch)
        if some:
            yield _pieces({at: total[at : at + PIECE] for at in range(0, size, PIECE)})

    return tree_sum(df.mapInArrow(fold, "at int, blob binary"), size)

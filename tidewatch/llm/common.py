"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step works on; arrays of a few times this size are held.
STEP_BYTES = 2 << 20


_LARGE: dict[Hashable, Any] = {}


def _forget() -> None:
    if _LARGE:
        _LARGE.clear()
        gc.collect()
        release()


def only(key: Hashable, make: Callable[[], Any]) -> Any:
    """A large object that this process keeps between tasks (a model, a table of words); making another one lets it go."""
    if key not in _LARGE:
        _forget()
        _LARGE[key] = make()
    return _LARGE[key]


#: Bytes that Spark hands to a Python worker at once; both ends hold a few such batches.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _bytes(size: str) -> int:
    """A size as Spark writes it: 67108864, 64m, 64MB."""
    number, unit = re.match(r"\s*(-?\d+)\s*([a-z]?)", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit if unit in tuple("kmgtp") else " ")


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded size, so that long texts don't fill the workers' memory."""
    conf = df.sparkSession.conf
    if not 0 < _bytes(conf.get(BATCH_KEY)) <= BATCH_BYTES:  # the plan reads it when it runs, so it can't be set back here
        conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def release() -> None:
    """Give memory that is free in this process back to the machine (workers live on between tasks)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoint(), set if it isn't yet: the one that the cluster names, a local one only where all runs on this machine.

    What lies in it goes when the driver ends.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    folder = sc._jsc.sc().getCheckpointDir().get()
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, n: int, column: str) -> DataFrame:
    """The same rows, kept like cut() in n hash partitions of a column; joins by it then need no further exchange of them."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan doesn't tell how its rows lie
    try:
        return cut(df.repartition(n, column))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared checkpoint folder: smaller than a checkpoint, and read by column."""
    folder = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def settled(df: DataFrame) -> DataFrame:
    """df itself if it reads files or a checkpoint row by row, else its rows as a table: their order is then the same however often they are read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stored(df) if "Exchange" in plan or "Limit" in plan else df


def keepable(keep: list[str] | None, results: str) -> list[str]:
    """Columns to keep beside an operator's results; those that are named like a result give way to it."""
    return [c for c in keep or [] if c not in results.split()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as UTF-8 bytes, null as empty."""
    col = batch.column(name)
    return (col if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else col.cast(pa.binary())).fill_null(b"")


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array, and where each value starts (with the end behind them)."""
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of values that hold about `limit` bytes together; a longer value has a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES, name: str = "text", keep: bool = False) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with about `limit` bytes of a text column, and that column as bytes.

    keep: whether the process's large object is for this work; else it is let go.
    """
    if not keep:
        _forget()
    for batch in batches:
        if batch.num_rows:
            col = binary(batch, name)
            for lo, hi in by_bytes(flat(col)[1], limit):
                yield batch.slice(lo, hi - lo), col.slice(lo, hi - lo)
            del col
            release()


def spaced(size: np.ndarray, each: np.ndarray) -> np.ndarray:
    """For counts `size`: each value of `each` repeated, plus 0, 1, 2, ... within its run."""
    ends = np.cumsum(size)
    return np.repeat(each - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

"""Tables in the shared folder, and small helpers for Arrow-batched functions."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: crc32 of the id as text modulo this; documents with remainder 0 are held out of training.
FOLDS = 5
#: Most bytes of a batch of rows on their way to Python.
BATCH_BYTES = 4 << 20
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where it is unset and all of Spark is one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder: on a cluster, tables between steps need one that all machines share")
        root = tempfile.mkdtemp(prefix="stratafold-")
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/stratafold-{uuid.uuid4().hex[:12]}-{name}"
    if not _made:
        atexit.register(_drop_all)
    _made.append((spark, path))
    return path


#: Tables that stored() made within scratch(): path by the frame's identity.
_scratch: ContextVar[dict[int, tuple[DataFrame, str]] | None] = ContextVar("scratch", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_table"] = path
    if (made := _scratch.get()) is not None:
        made[id(out)] = out, path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that stored() gave, once nothing reads it any more; other frames are left alone."""
    if (path := df.__dict__.pop("_table", None)) is not None:
        drop(path, df.sparkSession)


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Tables that are stored within go at its end, but for those given to the function it yields; these belong to the scratch() around it."""
    made: dict[int, tuple[DataFrame, str]] = {}
    around, token = _scratch.get(), _scratch.set(made)
    kept: set[int] = set()
    try:
        yield lambda *frames: kept.update(map(id, frames))
    finally:
        _scratch.reset(token)
        for key, (df, path) in made.items():
            if key not in kept:
                drop(path, df.sparkSession)
            elif around is not None:
                around[key] = df, path


def drop(path: str, spark: SparkSession) -> None:
    """Delete a table, once nothing reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for spark, path in _made:
        try:
            drop(path, spark)
        except Exception:  # noqa: BLE001, PERF203  the session may be gone by now
            return


def fold(key: Column, n: int = FOLDS) -> Column:
    """crc32 of the key as text modulo n; 0 for a null key, so that such rows never train."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of each value, None for null."""
    return column.cast(pa.binary()).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, to have fewer texts as Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    # Workers are used again by later stages; what this task freed goes back to the system.
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Have Arrow batches of BATCH_BYTES at most in this session, so that a task holds a few MB of texts on either side, and not 64."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if now is None or int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the size of `df`; from file sizes for tables that are read from files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def unnamed(df: DataFrame) -> DataFrame:
    """The frame with columns _in0, _in1, ..., so that names of our own clash with none of its."""
    return df.toDF(*(f"_in{i}" for i in range(len(df.columns))))


def with_fields(schema: T.StructType, more: str) -> T.StructType:
    """A schema and further columns, declared as in `a bigint, b string`."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(more).fields])


def kept(docs: DataFrame, run: Callable[..., DataFrame], keep: Column, **columns: str) -> DataFrame:
    """The rows of `docs` for which `keep` holds after run(docs, **columns), with the columns of `docs` and no others.

    run() sees columns under names of our own, so those it adds clash with none.
    """
    inner = unnamed(docs)
    names = {k: inner.columns[docs.columns.index(c)] for k, c in columns.items()}
    return run(inner, **names).filter(keep).select(*inner.columns).toDF(*docs.columns)

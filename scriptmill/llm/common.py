"""What several operators share: scratch tables, Arrow views of texts, checksums."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than these (fixed values).
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_own: dict[str, str] = {}
_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called by a worker's function before it uses tables that outlive it; other owners' tables are released first.

    Workers are used again by later stages, so what is free goes back to the machine: a task begins with little.
    """
    others = [o for o in _held if o != owner]
    for other in others:
        _held.pop(other)()
    if others:
        gc.collect()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc's
        trim(0)
    if release is not None:
        _held[owner] = release


def uncollected(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function without collections of cycles, which would walk its tables; they are on again after it."""

    def held(batches: Iterator) -> Iterator:
        on = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if on:
                gc.enable()

    return held


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of this session's own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="scriptmill-")
    return _own[app]


def scratch_path(spark: SparkSession) -> str:
    """A new place in this application's part of the shared folder."""
    return f"{scratch_root(spark)}/scratch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete this application's scratch tables. Results that weren't written anywhere yet read them: call it last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/scratch-{spark.sparkContext.applicationId}")
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that hold more rows than HOT_ROWS, and more than one row in HOT_SHARE or than HOT_MOST, are joined apart: at any size a
#: task gets at most HOT_MOST rows of one key, and hot keys are fewer than one in HOT_MOST rows or HOT_SHARE.
HOT_ROWS, HOT_SHARE, HOT_MOST = 1000, 1000, 1_000_000


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys of many rows."""
    least = min(max(HOT_ROWS, rows.count() // HOT_SHARE), HOT_MOST)
    return [r[0] for r in rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least).select(key).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: list | None = None) -> DataFrame:
    """A left join with a table whose key is unique. Rows of hot keys stay where they are, and their partners come to them."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, "left")
    named = F.when(F.col(key).isNull(), F.lit(None in hot)).otherwise(F.col(key).isin([k for k in hot if k is not None]))
    near = left.where(named).join(F.broadcast(right.where(named)), key, "left")
    return near.unionByName(left.where(~named).join(right.where(~named), key, "left"))


#: Rows and bytes that go to a worker at once, where the session would send more: texts are long.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES, _BATCH_BYTES = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(df: DataFrame) -> DataFrame:
    """The same table; its session sends at most BATCH_ROWS rows, and no more rows once it has BATCH_BYTES, at a time from here on,
    which bounds memory on both sides."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    own = conf.get(_BATCH_BYTES).lower()  # bytes where the number has no unit
    if not own.rstrip("b").lstrip("-").isdigit() or not 0 < int(own.rstrip("b")) <= BATCH_BYTES:
        conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return df


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = at.astype(np.int64)
    return body[at[0] : at[-1]], at - at[0]


def utf8_texts(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8 bytes; nulls are empty."""
    body, at = utf8_view(column)
    view = body.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield view[a:b]

"""Session helpers: shipping the package to executors."""

from __future__ import annotations

import os
import re
import shutil
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Workers start in the driver's folder with its PYTHONPATH. Where neither holds the package, a zip
    of it goes out through Spark's own file server, once per application.
    """
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == ROOT for p in paths):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    base = os.path.join(tempfile.mkdtemp(prefix="scriptmill-"), "scriptmill")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", ROOT, "scriptmill"))
    _shipped.add(app)


def scratch(spark: SparkSession) -> str:
    """A new place in the folder that spark.checkpoint.dir names; in a folder of the session's own only where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if app not in _folders:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            _folders[app] = "file://" + tempfile.mkdtemp(prefix="scriptmill-")
        root = _folders[app]
    return f"{root.rstrip('/')}/rounds-{app}/{uuid.uuid4().hex}"


#: Tables of more rows are never sent whole to the driver and all executors to be joined.
BROADCAST_ROWS = 20_000


def shuffled(df: DataFrame, rows: int) -> DataFrame:
    """The same table, whose joins are by shuffling if it has many rows. Spark judges a table by the size of its files, and facts
    take less than a byte a column in theirs: left to that, tables of millions of rows would be broadcast through the driver."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from it: rounds of an iteration stay short, and lost executors cost
    no earlier round."""
    return counted(df)[0]


def counted(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """Like written, with the number of rows (those of which a condition holds), counted by the job that writes them."""
    seen, path = Observation(), scratch(df.sparkSession)
    df.observe(seen, F.count("*").alias("rows"), F.count("*" if which is None else F.when(which, 1)).alias("n")).write.parquet(path)
    return shuffled(df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]), seen.get["n"]


def build(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and local runs."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    return (
        SparkSession.builder.master(master)
        .appName("scriptmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )

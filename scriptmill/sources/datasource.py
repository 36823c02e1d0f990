"""Folders of scripts as a Spark data source: ``register(spark)``, then format("scripts").

Reading gives path (below the folder), source, size and modified for each file. Planning lists the folder; the options prefix,
minSize, maxSize, modifiedAfter and modifiedBefore (ISO times) choose files before any is opened, and files go to tasks in groups of
about ``bytesPerTask``. With the option pushdown, conditions of a query on path, size and modified choose too. It is off unless
asked for: Spark 4.1 keeps a frame's first pushed conditions for its later uses, so a frame that was loaded with it is good for one
query; load another for the next. As a stream a folder
is an order of files by time and path; an offset is a place in that order, so each file comes once, also after a restart.

Writing takes path and source and is committed in two steps: each task writes below a staging folder of its own and reports what
it wrote; the commit moves just those files to their places and then writes the list of them, ``_COMMITTED``. What failed or
repeated tasks leave is never moved, and goes with the staging folder. A path that two rows have fails the commit. mode("append")
adds to the folder's files, and replaces those of the same path; mode("overwrite") removes other files as the last step.

Paths are local or any URI that pyarrow's file systems open (hdfs://, s3://, gs://). Further options: suffix (".js"), filesPerBatch
(streams). Tasks read whole files: a file is a row. Files that are no UTF-8 keep replacement characters.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, source string, size long, modified timestamp"
BYTES_PER_TASK, FILES_PER_BATCH = 64 << 20, 10_000
COMMITTED = "_COMMITTED"


@dataclass(frozen=True)
class File:
    path: str
    size: int
    time: int  # nanoseconds

    @property
    def modified(self) -> datetime.datetime:
        return datetime.datetime.fromtimestamp(self.time / 1e9)


@dataclass
class Files(InputPartition):
    files: tuple[File, ...]


@dataclass
class Wrote(WriterCommitMessage):
    staged: tuple[tuple[str, str], ...]  # (staged place, path), both below the folder


class Folder:
    """A folder and its file system."""

    def __init__(self, path: str):
        from pyarrow import fs

        if "://" in path or path.startswith("file:"):
            self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        else:
            self.fs, self.root = fs.LocalFileSystem(), path
        self.root = self.root.rstrip("/")

    def at(self, path: str) -> str:
        return f"{self.root}/{path}"

    def files(self, suffix: str) -> list[File]:
        """All files below, but of hidden folders and names, by path."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True, recursive=True))
        out = [File(i.path[len(self.root) + 1 :], i.size, i.mtime_ns or 0) for i in found if i.type == fs.FileType.File and i.path.endswith(suffix)]
        return sorted((f for f in out if not any(p.startswith(("_", ".")) for p in f.path.split("/"))), key=lambda f: f.path)

    def read(self, path: str) -> str:
        with self.fs.open_input_stream(self.at(path)) as f:
            return f.read().decode("utf-8", "replace")

    def write(self, path: str, text: str) -> None:
        self.fs.create_dir(self.at(path).rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(self.at(path)) as f:
            f.write(text.encode("utf-8", "replace"))


def chosen(files: list[File], filters: list[Filter]) -> list[File]:
    """Files that may fulfil all filters; filters are of the kinds in ``plannable``."""
    tests = {
        EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
        LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
    }

    def holds(f: File, c: Filter) -> bool:
        if isinstance(c, Not):
            return not holds(f, c.child)
        if isinstance(c, IsNotNull):
            return True
        x = getattr(f, c.attribute[0])
        v = c.value
        if isinstance(v, datetime.datetime) and v.tzinfo is not None:
            v = v.astimezone().replace(tzinfo=None)
        return tests[type(c)](x, v)

    return [f for f in files if all(holds(f, c) for c in filters)]


def plannable(c: Filter) -> bool:
    """Conditions on what planning knows; a null value never chooses anything, and is left to Spark."""
    if isinstance(c, Not):
        return plannable(c.child)
    known = (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains, IsNotNull)
    if not isinstance(c, known) or c.attribute not in (("path",), ("size",), ("modified",)):
        return False
    values = getattr(c, "value", 0)
    return values is not None and not (isinstance(c, In) and any(v is None for v in values))


def grouped(files: list[File], n_bytes: int) -> list[Files]:
    """Neighbours together up to a size; a larger file alone."""
    out: list[list[File]] = []
    size = 0
    for f in files:
        if not out or size + f.size > n_bytes:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f.size + 1024  # opening one costs too
    return [Files(tuple(x)) for x in out]


def _rows(options: dict, part: Files) -> Iterator[tuple]:
    folder = Folder(options["path"])
    for f in part.files:
        yield f.path, folder.read(f.path), f.size, f.modified


def wanted(options: dict) -> list[Filter]:
    """The conditions that options stand for."""
    time = lambda name: datetime.datetime.fromisoformat(options[name])
    out: list[Filter] = [StringStartsWith(("path",), options["prefix"])] if "prefix" in options else []
    out += [GreaterThanOrEqual(("size",), int(options["minSize"]))] if "minSize" in options else []
    out += [LessThanOrEqual(("size",), int(options["maxSize"]))] if "maxSize" in options else []
    out += [GreaterThan(("modified",), time("modifiedAfter"))] if "modifiedAfter" in options else []
    return out + ([LessThan(("modified",), time("modifiedBefore"))] if "modifiedBefore" in options else [])


class ScriptReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.filters = options, wanted(options)

    def partitions(self) -> list[Files]:
        files = chosen(Folder(self.options["path"]).files(self.options.get("suffix", ".js")), self.filters)
        return grouped(files, int(self.options.get("bytesPerTask", BYTES_PER_TASK))) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from _rows(self.options, partition)


class PushedReader(ScriptReader):
    """For one query: its conditions choose files as options do."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for c in filters:
            if plannable(c):
                self.filters.append(c)
            else:
                yield c


class ScriptStream(DataSourceStreamReader):
    """Offsets are (time, path) of the last file of a batch, which the order of files by both makes a place."""

    def __init__(self, options: dict):
        self.options = options
        self.last: tuple[int, str] = (-1, "")

    def _ordered(self) -> list[File]:
        files = chosen(Folder(self.options["path"]).files(self.options.get("suffix", ".js")), wanted(self.options))
        return sorted(files, key=lambda f: (f.time, f.path))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        new = [f for f in self._ordered() if (f.time, f.path) > self.last][: int(self.options.get("filesPerBatch", FILES_PER_BATCH))]
        if new:
            self.last = (new[-1].time, new[-1].path)
        return {"time": self.last[0], "path": self.last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        lo, hi = (start["time"], start["path"]), (end["time"], end["path"])
        self.last = max(self.last, hi)  # after a restart: what was planned before comes again, and nothing before it
        return grouped([f for f in self._ordered() if lo < (f.time, f.path) <= hi], int(self.options.get("bytesPerTask", BYTES_PER_TASK)))

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from _rows(self.options, partition)

    def commit(self, end: dict) -> None:
        """Files stay."""


class ScriptWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        if not {"path", "source"} <= set(columns):
            raise ValueError("scripts are written from the columns path and source")
        self.options, self.overwrite = options, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Wrote:
        """One attempt of a task: its files go to a folder that no other attempt has."""
        folder, own, staged = Folder(self.options["path"]), uuid.uuid4().hex, []
        for n, row in enumerate(iterator):
            if row["path"] is None or row["source"] is None:
                raise ValueError("a script without path or source can't be written")
            parts = row["path"].split("/")
            if not row["path"] or any(p in ("", ".", "..") or p.startswith(("_", ".")) for p in parts):
                raise ValueError(f"{row['path']!r} is no path below the folder")
            place = f"{self.staging}/{own}/{n}"
            folder.write(place, row["source"])
            staged.append((place, row["path"]))
        return Wrote(tuple(staged))

    def commit(self, messages: list[Wrote | None]) -> None:
        folder = Folder(self.options["path"])
        staged = [s for m in messages if m is not None for s in m.staged]
        paths = [p for _, p in staged]
        if len(set(paths)) < len(paths):
            self.abort(messages)
            raise ValueError(f"two rows have the path {next(p for p in paths if paths.count(p) > 1)!r}")
        before = folder.files("") if self.overwrite else []
        for place, path in staged:
            folder.fs.create_dir(folder.at(path).rpartition("/")[0], recursive=True)
            folder.fs.move(folder.at(place), folder.at(path))
        folder.write(COMMITTED, json.dumps(sorted(paths)))
        for f in before:
            if f.path not in set(paths):
                folder.fs.delete_file(folder.at(f.path))
        self._clear(folder)

    def abort(self, messages: list[Wrote | None]) -> None:
        self._clear(Folder(self.options["path"]))

    def _clear(self, folder: Folder) -> None:
        from pyarrow import fs

        if folder.fs.get_file_info(folder.at(self.staging)).type == fs.FileType.Directory:
            folder.fs.delete_dir(folder.at(self.staging))


class ScriptSource(DataSource):
    """Registered by ``register``, which also lets the session push conditions down to Python sources that ask for it."""

    @classmethod
    def name(cls) -> str:
        return "scripts"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        options = dict(self.options)
        if not options.get("path"):
            raise ValueError("scripts need a path")
        named = {k.lower(): k for k in ("path", "suffix", "bytesPerTask", "filesPerBatch", "prefix", "minSize", "maxSize", "modifiedAfter", "modifiedBefore", "pushdown")}
        return {named.get(k.lower(), k): v for k, v in options.items()}

    def reader(self, schema: StructType) -> ScriptReader:
        options = self._options()
        return (PushedReader if str(options.get("pushdown", "")).lower() == "true" else ScriptReader)(options)

    def streamReader(self, schema: StructType) -> ScriptStream:  # noqa: N802
        return ScriptStream(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> ScriptWriter:
        return ScriptWriter(self._options(), [f.name for f in schema.fields], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ScriptSource)

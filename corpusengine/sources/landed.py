"""Landed text files as a Spark data source (S6, S7, S9, K1): ``landed_files``.

*Reading.* Daily index files and filing artifacts carry their date in the file
name. Filters on ``file_date`` (=, IN, <, <=, >, >=) are taken over by the source:
folders of other years and quarters are not listed, files of other days are not
opened. Small files share a task up to ``BATCH_BYTES``.

*Writing.* Rows (name, text) become files. A task writes into a hidden folder of
its own attempt; the commit moves the folders of the successful attempts to
``load=<load>``, an abort removes them. So a failed run leaves nothing that a
reader sees, a second attempt of a task leaves no second copy, and a load that is
sent again replaces itself.

Paths are local or those of a store that Arrow's file systems reach (s3, gs, hdfs).
"""

from __future__ import annotations

import datetime as dt
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

FORMAT = "landed_files"
SCHEMA = "file_date string, name string, text string"
BATCH_BYTES = 32 << 20
# Dates in file names, by kind of file.
DATES = {
    "index": re.compile(r"^master\.(\d{4})(\d{2})(\d{2})\.idx$"),
    "artifact": re.compile(r"^(\d{4})-(\d{2})-(\d{2})__.*\.txt$"),
}
YEAR = re.compile(r"^\d{4}$")
QUARTER = re.compile(r"^QTR([1-4])$")
TESTS = {
    EqualTo: lambda day, value: day == value,
    In: lambda day, value: day in value,
    GreaterThan: lambda day, value: day > value,
    GreaterThanOrEqual: lambda day, value: day >= value,
    LessThan: lambda day, value: day < value,
    LessThanOrEqual: lambda day, value: day <= value,
}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def index_name(day: dt.date) -> str:
    """Where the index of a day lies below its folder."""
    return f"{day.year}/QTR{(day.month - 1) // 3 + 1}/master.{day:%Y%m%d}.idx"


class DateTest:
    """The taken filters on ``file_date``: which days, and which spans of days, can match."""

    def __init__(self) -> None:
        self.filters: list[Filter] = []

    def take(self, f: Filter) -> bool:
        """Whether a filter is one on the date that the names can answer."""
        if type(f) not in TESTS or f.attribute != ("file_date",):
            return False
        values = f.value if isinstance(f, In) else [f.value]
        if not all(isinstance(v, str) for v in values):
            return False
        self.filters.append(f)
        return True

    def day(self, day: str) -> bool:
        return all(TESTS[type(f)](day, f.value) for f in self.filters)

    def span(self, first: str, last: str) -> bool:
        """Whether some day from ``first`` to ``last`` can match: false is certain."""
        for f in self.filters:
            values = f.value if isinstance(f, In) else [f.value]
            if isinstance(f, (EqualTo, In)):
                possible = any(first <= v <= last for v in values)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                possible = TESTS[type(f)](last, f.value)
            else:
                possible = TESTS[type(f)](first, f.value)
            if not possible:
                return False
        return True


@dataclass
class Files(InputPartition):
    """The files of one task: (file_date, path)."""

    files: list[tuple[str, str]]


class LandedReader(DataSourceReader):
    def __init__(self, path: str, kind: str, batch_bytes: int):
        self.path, self.kind, self.batch_bytes = path, kind, batch_bytes
        self.test = DateTest()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.test.take(f):
                yield f

    def found(self) -> Iterator[tuple[str, str, int]]:
        """(date, path, size) of the files whose date can match."""
        store, root = _store(self.path)
        folders: list[tuple[str, str | None, str | None]] = [(root, None, None)]
        while folders:
            at, year, day = folders.pop()
            for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                name = info.base_name
                if name.startswith(("_", ".")):
                    continue
                dated = DATES[self.kind].match(name)
                own = "-".join(dated.groups()) if dated else day
                if own is not None and not self.test.day(own):
                    continue
                if info.type == fs.FileType.File:
                    if own is not None:
                        yield own, info.path, info.size or 0
                elif self._open(name, year):
                    folders.append((info.path, name if YEAR.match(name) else year, own))

    def _open(self, name: str, year: str | None) -> bool:
        if YEAR.match(name):
            return self.test.span(f"{name}-01-01", f"{name}-12-31")
        quarter = QUARTER.match(name)
        if year is None or quarter is None:
            return True
        last = 3 * int(quarter[1])
        return self.test.span(f"{year}-{last - 2:02d}-01", f"{year}-{last:02d}-31")

    def partitions(self) -> list[Files]:
        tasks, size = [Files([])], 0
        for day, path, n in sorted(self.found()):
            if tasks[-1].files and size + n > self.batch_bytes:
                tasks.append(Files([]))
                size = 0
            tasks[-1].files.append((day, path))
            size += n
        return tasks

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = _store(self.path)
        for day, path in partition.files:
            with store.open_input_file(path) as f:
                text = f.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays(
                [pa.array([day]), pa.array([posixpath.relpath(path, root)]), pa.array([text], pa.string())],
                names=["file_date", "name", "text"])


@dataclass
class Written(WriterCommitMessage):
    """What one successful attempt wrote: its folder and its number."""

    folder: str
    partition: int
    files: int


class LandedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, load: str, overwrite: bool):
        self.path, self.load, self.overwrite = path, load, overwrite
        _, root = _store(path)
        self.hidden = f"{root}/_tmp-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _ = _store(self.path)
        context = TaskContext.get()
        folder = f"{self.hidden}/{context.partitionId():06d}-{context.taskAttemptId()}"
        store.create_dir(folder)
        made, files = {folder}, 0
        for batch in iterator:
            for name, text in zip(batch.column("name"), batch.column("text")):
                path = f"{folder}/{checked_name(name.as_py())}"
                if posixpath.dirname(path) not in made:
                    store.create_dir(posixpath.dirname(path))
                    made.add(posixpath.dirname(path))
                with store.open_output_stream(path) as f:
                    f.write((text.as_py() or "").encode("utf-8", "surrogatepass"))
                files += 1
        return Written(folder, context.partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        """One move per task. Readers that list the load at this moment may miss
        it; they never see files of a failed attempt."""
        store, root = _store(self.path)
        done = f"{root}/load={self.load}"
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            old = info.base_name.startswith("load=") if self.overwrite else info.base_name == posixpath.basename(done)
            if old and info.type == fs.FileType.Directory:
                store.delete_dir(info.path)
        store.create_dir(done)
        for m in messages:
            if m is not None and m.files:
                store.move(m.folder, f"{done}/part-{m.partition:06d}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """The hidden folder goes, with all that any attempt left in it."""
        store, _ = _store(self.path)
        if store.get_file_info(self.hidden).type == fs.FileType.Directory:
            store.delete_dir(self.hidden)


def checked_name(name: str | None) -> str:
    """A relative file name that stays inside its folder; others raise."""
    parts = (name or "").split("/")
    if not all(parts) or any(p in (".", "..") or p.startswith(("_", ".")) for p in parts):
        raise ValueError(f"not a relative file name: {name!r}")
    return name


class LandedFiles(DataSource):
    """Options: ``path``; ``kind`` (``index`` or ``artifact``) and ``batchBytes`` to
    read; ``load`` to write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options["path"], self.options.get("kind", "index"),
                            int(self.options.get("batchBytes", BATCH_BYTES)))

    def writer(self, schema, overwrite: bool) -> LandedWriter:
        missing = {"name", "text"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"landed files need the columns {sorted(missing)}")
        return LandedWriter(self.options["path"], self.options.get("load") or uuid.uuid4().hex, overwrite)


def register_landed_files(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedFiles)


def read_landed(spark: SparkSession, path: str, kind: str = "index") -> DataFrame:
    """(file_date, name, text), one row per landed file of a kind; ``name`` is
    relative to ``path``. A missing folder is empty, files of other names, and
    hidden ones, are passed over. Filter on ``file_date`` (yyyy-MM-dd) to open the
    files of those days alone. Bytes that are not UTF-8 are replaced."""
    register_landed_files(spark)
    return spark.read.format(FORMAT).option("kind", kind).load(path)


def write_landed(df: DataFrame, path: str, load: str | None = None, mode: str = "append") -> None:
    """``df(name, text)`` as files below ``path/load=<load>``; other columns are not
    written. A load of the same name is replaced, mode ``overwrite`` replaces all
    loads. Null texts are empty files; a name that is null, absolute, hidden or
    leaves its folder fails the run. Names are expected to be distinct."""
    register_landed_files(df.sparkSession)
    out = df.select("name", "text").write.format(FORMAT).mode(mode)
    (out if load is None else out.option("load", load)).save(path)

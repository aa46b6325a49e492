"""Files read by ranges: a data source that opens only the bytes it is asked for.

``spark.read.format("byte_ranges")`` (see ``register``) lists the files under ``path`` and reads of each what its options
name: ``head`` bytes, ``tail`` bytes, every ``window`` of so many bytes, or ``length`` bytes from ``offset`` on; without
any, only sizes.  A head and a tail that meet are one range.  Ranges are dealt to tasks by bytes, so a long file is many
tasks and many small ones are one; conditions on ``path``, ``offset`` and ``size`` are taken over where the session
pushes filters to Python sources, and then prune ranges before anything is opened.

The driver lists one folder at a time and holds what it has dealt packed.  Where only sizes are asked, nothing needs to be
dealt by bytes: the driver stops at the first level that has ``FOLDERS`` folders, and tasks list what is below.  A folder's
own files are always listed at once, so a great many files belong in many folders.

As a stream it reads the same ranges of files that are new: those modified after the last ones seen, or at the same time
and not among them.

Files are opened by Arrow's file systems (local paths and every scheme that those know).

Defined cases: a range past a file's end is empty and yields no row, but a file without a range in it has one row without
bytes; an empty folder gives no rows; hidden files (``.`` and ``_``) are left out.
"""

from __future__ import annotations

import fnmatch
import pickle
import posixpath
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from quarrystone.functions.arrow import arrow_function, slices
from quarrystone.functions.detection import LOOKED, classified, look, looked_frame

NAME = "byte_ranges"
SCHEMA = "path string, size long, modified timestamp, offset long, length long, content binary"
#: Bytes of a task's ranges.
PARTITION_BYTES = 64 << 20
#: Folders beside each other that are left to tasks, and tasks that they are dealt to at most.
FOLDERS, FOLDER_TASKS = 32, 1024


def file_system(path: str):
    """(Arrow file system, path in it, what to put before its paths)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    whole = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    system, inner = fs.FileSystem.from_uri(whole)
    return system, inner, whole[: len(whole) - len(inner)] if whole.endswith(inner) else ""


def listed(path: str, glob: str | None = None, left: list[str] | None = None) -> Iterator[tuple]:
    """(path, size, modified) of the files at or under ``path``, level by level, one folder held at a time.

    With ``left``, a level of ``FOLDERS`` folders or more is not opened: its folders are put there instead.
    """
    from pyarrow import fs

    system, inner, lead = file_system(path)
    own = system.get_file_info(inner)
    if own.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    wanted = lambda f: f.type == fs.FileType.File and (glob is None or fnmatch.fnmatch(f.base_name, glob))
    if own.type == fs.FileType.File:
        yield from ((lead + f.path, f.size, f.mtime) for f in [own] if wanted(f))
        return
    level = [inner]
    while level:
        if left is not None and len(level) >= FOLDERS:
            left += [lead + folder for folder in level]
            return
        below = []
        for folder in level:
            for f in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
                if f.base_name[0] in "._":
                    continue
                if f.type == fs.FileType.Directory:
                    below.append(f.path)
                elif wanted(f):
                    yield lead + f.path, f.size, f.mtime
        level = below


@dataclass(frozen=True)
class Asked:
    """Which ranges of a file are wanted."""

    head: int = 0
    tail: int = 0
    window: int = 0
    offset: int | None = None
    length: int = 0

    @staticmethod
    def of(options: dict) -> Asked:
        get = lambda k: int(options[k]) if k in options else 0
        return Asked(get("head"), get("tail"), get("window"), int(options["offset"]) if "offset" in options else None, get("length"))

    @property
    def sizes_only(self) -> bool:
        return not self.head and not self.tail and not self.window and self.offset is None

    def ranges(self, size: int) -> list[tuple[int, int]]:
        """(offset, length), at least one."""
        found = []
        if self.window:
            found = [(at, min(self.window, size - at)) for at in range(0, size, self.window)]
        elif self.offset is not None:
            found = [(self.offset, min(self.length, size - self.offset))] if self.offset < size else []
        elif self.head or self.tail:
            head, tail = min(self.head, size), min(self.tail, size)
            found = [(0, size)] if head and tail and head + tail >= size else [x for x in ((0, head), (size - tail, tail)) if x[1]]
        return found or [(0, 0)]


class Ranges(InputPartition):
    """Pieces (path, size, modified, offset, length) of a task, packed, as the driver holds those of all tasks."""

    def __init__(self, pieces: list[tuple]):
        super().__init__(None)
        self.packed = zlib.compress(pickle.dumps(list(zip(*pieces, strict=True))), 1)

    @property
    def pieces(self) -> list[tuple]:
        return list(zip(*pickle.loads(zlib.decompress(self.packed)), strict=True))


class Folders(InputPartition):
    """Folders that a task lists."""

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def dealt(pieces: Iterable[tuple], most: int) -> list[Ranges]:
    """Pieces (path, size, modified, offset, length) in tasks of about ``most`` bytes; opening a file counts as 4 KiB."""
    tasks, own, held = [], [], 0
    for piece in pieces:
        cost = piece[4] + 4096
        if own and held + cost > most:
            tasks.append(Ranges(own))
            own, held = [], 0
        own.append(piece)
        held += cost
    return [*tasks, Ranges(own)] if own else tasks


def opened(pieces: Iterable[tuple]) -> Iterator[tuple]:
    """Rows of pieces; a file is opened once for successive pieces, and only their bytes are read."""
    path, file = None, None
    try:
        for own, size, modified, offset, length in pieces:
            if length == 0:
                yield own, size, modified, offset, 0, b""
                continue
            if own != path:
                if file is not None:
                    file.close()
                system, inner, _ = file_system(own)
                path, file = own, system.open_input_file(inner)
            content = file.read_at(length, offset)
            yield own, size, modified, offset, len(content), content
    finally:
        if file is not None:
            file.close()


_BOUNDS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b)}
_AT = {"path": 0, "size": 1, "offset": 3}


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests = options, []

    def pushFilters(self, filters):
        for f in filters:
            test, at = _BOUNDS.get(type(f)), _AT.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if test is None or at is None or getattr(f, "value", None) is None:
                yield f
            else:
                self.tests.append((at, test, f.value))

    def _pieces(self, paths: list[str], left: list[str] | None = None) -> Iterator[tuple]:
        asked = Asked.of(self.options)
        for path in paths:
            for file in listed(path, self.options.get("glob"), left):
                for piece in asked.ranges(file[1]):
                    if all(test((*file, *piece)[at], value) for at, test, value in self.tests):
                        yield *file, *piece

    def partitions(self):
        left = [] if Asked.of(self.options).sizes_only else None
        tasks = dealt(self._pieces([self.options["path"]], left), int(self.options.get("partitionbytes", PARTITION_BYTES)))
        n = min(len(left or []), FOLDER_TASKS)
        return [*tasks, *(Folders(left[k::n]) for k in range(n))]

    def read(self, partition):
        if isinstance(partition, Folders):
            yield from opened(self._pieces(partition.paths))
        elif partition is not None:
            yield from opened(partition.pieces)


class RangeStream(DataSourceStreamReader):
    """An offset is the last time of modification seen and the paths that have it."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):
        return {"time": "", "paths": []}

    def _files(self):
        return [(p, n, t, t.isoformat()) for p, n, t in listed(self.options["path"], self.options.get("glob"))]

    def latestOffset(self):
        files = self._files()
        last = max((x[3] for x in files), default="")
        return {"time": last, "paths": [x[0] for x in files if x[3] == last]}

    def partitions(self, start, end):
        asked = Asked.of(self.options)
        new = [x[:3] for x in self._files() if (x[3] > start["time"] or x[3] == start["time"] and x[0] not in start["paths"]) and (x[3] < end["time"] or x[3] == end["time"] and x[0] in end["paths"])]
        return dealt(((*f, *piece) for f in new for piece in asked.ranges(f[1])), int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def read(self, partition):
        yield from opened(partition.pieces)


class ByteRanges(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RangeReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema):
        return RangeStream({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ByteRanges)


def read_ranges(spark: SparkSession, path: str, **options) -> DataFrame:
    """``path, size, modified, offset, length, content`` of the ranges that ``options`` name."""
    register(spark)
    return spark.read.format(NAME).options(path=path, **options).load()


def stream_ranges(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).options(path=path, **options).load()


def write_files(rows: DataFrame, folder: str, name_col: str = "name", content_col: str = "content") -> None:
    """A file for each row, named by ``name_col``.  A task that repeats writes the same files again; null content is an empty file."""

    def written(batches):
        import pyarrow as pa

        system, inner, _ = file_system(folder)
        made: set[str] = set()
        for batch in batches:
            for part in slices(batch):
                for name, content in zip(*(part.column(k).to_pylist() for k in range(2)), strict=True):
                    path = posixpath.join(inner, name)
                    if (parent := posixpath.dirname(path)) not in made:
                        system.create_dir(parent, recursive=True)
                        made = {*made, parent} if len(made) < 1000 else {parent}
                    with system.open_output_stream(path) as out:
                        out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.select(F.col(name_col), F.col(content_col).cast("binary")).mapInArrow(written, "n long").agg(F.sum("n")).collect()


def detect_files(files: DataFrame, name_col: str = "name", mime_col: str = "declared_mime") -> DataFrame:
    """``detect`` for files on disk (``path``, ``size``, name and declared type): heads and directories are read, never contents.

    A file that cannot be opened is looked at as an empty one.
    """
    @arrow_function(LOOKED)
    def looked(path: pd.Series, size: pd.Series) -> pd.DataFrame:
        rows = []
        for own, n in zip(path, size, strict=True):
            try:
                system, inner, _ = file_system(own)
                with system.open_input_file(inner) as file:
                    rows.append(look(lambda at, k: file.read_at(k, at), int(n)))  # noqa: B023  used at once
            except OSError:
                rows.append(look(lambda at, k: b"", 0))
        return looked_frame(rows)

    return classified(files.withColumn("_looked", looked("path", "size")), name_col, mime_col)

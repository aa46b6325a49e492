"""Zip files on disk, scanned by entry.

Two phases.  The directory of each archive is read from its tail, and only that: rows of entries with their places.  What
then is asked of those rows (a path, a kind, all) is dealt to tasks by bytes, whatever archive it lies in, and each task
reads its entries' ranges.  A large archive is many tasks, and nothing but directories and asked entries is read.

Defined cases: an archive that cannot be read, is split or of the 64-bit format has one row with an error code; an unsafe
path is null; an empty archive has no rows; entries that fail to inflate, are encrypted or do not match their check sum
have an error code, and one beyond the limit is ``FILE_TOO_LARGE``, never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import zips
from quarrystone.functions.names import archive_path
from quarrystone.limits import LIMITS
from quarrystone.sources.ranges import PARTITION_BYTES, file_system

_ENTRIES = "path string, size long, entry_no long, raw_name string, is_regular boolean, method int, flags int, crc long, compressed long, uncompressed long, at long, error_code string"


def _opened(path: str):
    system, inner, _ = file_system(path)
    return system.open_input_file(inner)


def _reader(file):
    return lambda at, n: file.read_at(n, at)


def directories(files: DataFrame, per_task: int = 64) -> DataFrame:
    """Entries of the archives in ``files`` (``path``, ``size``): ``entry_no``, ``name`` (safe, or null), places, ``error_code``."""

    def scanned(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in _ENTRIES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string()]
        for batch in batches:
            for path, size in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                try:
                    with _opened(path) as file:
                        found = zips.directory(_reader(file), size)
                except OSError:
                    found = None
                rows = [(path, size, *[None] * 9, "CORRUPT_FILE")] if found is None else [(path, size, e.number, e.name, e.is_regular, e.method, e.flags, e.crc, e.compressed, e.size, e.offset, None) for e in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    count = files.count()  # rows of paths and sizes
    spread = files.select("path", "size").repartition(max(1, -(-count // per_task)), "path")
    return spread.mapInArrow(scanned, _ENTRIES).withColumn("name", archive_path(F.col("raw_name")))


def read_entries(entries: DataFrame, most: int = LIMITS.file_bytes, task_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``path, entry_no, name, content, error_code`` of ``entries`` (rows of ``directories``), by their ranges.

    Unsafe and irregular entries are refused.
    """
    asked = entries.filter("entry_no IS NOT NULL").select("path", "size", "entry_no", "name", "is_regular", "method", "flags", "crc", "compressed", "at")
    total = asked.agg(F.sum(F.col("compressed") + 4096)).first()[0] or 0
    schema = "path string, entry_no long, name string, content binary, error_code string"

    def read(batches):
        import pyarrow as pa

        path, file = None, None
        try:
            for batch in batches:
                for own, size, number, name, regular, method, flags, crc, compressed, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if name is None or not regular:
                        row = None, "ARCHIVE_PATH_REJECTED"
                    else:
                        try:
                            if own != path:
                                if file is not None:
                                    file.close()
                                path, file = own, _opened(own)
                            row = zips.payload(_reader(file), size, at, method, flags, crc, compressed, most)
                        except OSError:
                            row = None, "CORRUPT_FILE"
                    values = (own, number, name, *row)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)], ["path", "entry_no", "name", "content", "error_code"])
        finally:
            if file is not None:
                file.close()

    spread = asked.repartition(max(1, -(-total // task_bytes)), "path", F.floor(F.col("at") / task_bytes), "entry_no")
    return spread.sortWithinPartitions("path", "at").mapInArrow(read, schema)

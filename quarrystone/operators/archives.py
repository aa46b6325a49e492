"""Archives: entries as rows, listings with cursors, extraction of regular entries.

zip and tar (plain, gzip, bzip2, xz) are read from the bytes in the row; other formats have an error code.  Unsafe paths
are left out of listings, whose limit counts what is left, and refused on extraction, and what is inflated is counted while it is inflated.
"""

from __future__ import annotations

import io
import lzma
import tarfile
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.arrow import arrow_function
from quarrystone.functions.detection import entry_name, zip_entries
from quarrystone.functions.names import archive_path
from quarrystone.limits import LIMITS
from quarrystone.operators.paging import cursor_page

_BROKEN = (zipfile.BadZipFile, tarfile.TarError, NotImplementedError, zlib.error, lzma.LZMAError, EOFError, OSError, RuntimeError, ValueError)
ENTRY = "entry_no:long,raw_path:string,is_regular:boolean,compressed:long,uncompressed:long"


def list_entries(data: bytes) -> list[tuple] | None:
    """(number, raw path, regular, compressed size, size) of each entry; None where the archive cannot be read."""
    if data[:2] == b"PK":
        found = zip_entries(data)
        if found is None:
            return None
        regular = lambda x: not x.is_dir() and (x.external_attr >> 16) & 0o170000 in (0, 0o100000)
        return [(k, entry_name(x), regular(x), x.compress_size, x.file_size) for k, x in enumerate(found)]
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as archive:
            return [(k, x.name, x.isreg(), x.size, x.size) for k, x in enumerate(archive)]
    except _BROKEN:
        return None


def read_entry(data: bytes, number: int, most: int = LIMITS.file_bytes) -> tuple[bytes | None, str | None]:
    """(content, error code) of an entry by its number."""
    try:
        if data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as archive, archive.open(archive.infolist()[number]) as entry:
                out = entry.read(most + 1)
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as archive:
                member = next(x for k, x in enumerate(archive) if k == number)
                out = archive.extractfile(member).read(most + 1)
    except (*_BROKEN, StopIteration, AttributeError, IndexError):
        return None, "CORRUPT_FILE"
    return (None, "FILE_TOO_LARGE") if len(out) > most else (out, None)


def entries(archives: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """id, ``entry_no, raw_path, is_regular, compressed, uncompressed, path`` (null where unsafe), ``error_code`` (archive unreadable)."""

    @arrow_function(f"array<struct<{ENTRY}>>")
    def listed(content: pd.Series) -> pd.Series:
        names = [x.split(":")[0] for x in ENTRY.split(",")]
        return content.map(lambda x: None if (found := list_entries(bytes(x or b""))) is None else [dict(zip(names, e, strict=True)) for e in found])

    found = archives.select(id_col, listed(content_col).alias("_entries"))
    rows = found.select(id_col, F.when(F.col("_entries").isNull(), "CORRUPT_FILE").alias("error_code"), F.explode_outer("_entries").alias("_e"))
    return rows.select(id_col, "_e.*", archive_path(F.col("_e.raw_path")).alias("path"), "error_code")


def listing(found: DataFrame, group: list[str], prefix: str | None = None, cursor: int = 0, limit: int = 100) -> DataFrame:
    """A page of the distinct safe paths of each archive, in their order; ``prefix`` is a folder or a beginning."""
    safe = found.filter(F.col("path").isNotNull())
    if prefix:
        safe = safe.filter(F.startswith("path", archive_path(F.lit(prefix))))
    first = safe.groupBy(*group, "path").agg(F.min("entry_no").alias("_first"))
    return cursor_page(first, group, [F.col("_first")], cursor, limit).drop("_first")


def extract(asked: DataFrame, archives: DataFrame, id_col: str = "id") -> DataFrame:
    """``asked`` (id, ``archive_path``) with ``entry`` (bytes) and ``error_code``: only regular entries with a safe path."""
    wanted = asked.withColumn("path", archive_path(F.col("archive_path")))
    held = entries(archives, id_col).filter("is_regular AND path IS NOT NULL").groupBy(id_col, "path").agg(F.max("entry_no").alias("entry_no"))
    placed = wanted.join(held, [id_col, "path"], "left").join(archives.select(id_col, "content"), id_col, "left")

    @arrow_function("entry binary, error_code string")
    def taken(content: pd.Series, number: pd.Series) -> pd.DataFrame:
        rows = [(None, "ARCHIVE_PATH_REJECTED") if pd.isna(n) or c is None else read_entry(bytes(c), int(n)) for c, n in zip(content, number, strict=True)]
        return pd.DataFrame({"entry": [r[0] for r in rows], "error_code": [r[1] for r in rows]})

    return placed.withColumn("_taken", taken("content", "entry_no")).select(*asked.columns, "_taken.*")

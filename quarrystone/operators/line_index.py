"""A sparse index of lines: where each page of lines begins in a file, so that any page is one seek.

Files are read in windows of bytes, each by itself: a first pass counts the line feeds of every window, sums over the
windows of a file (one small row each) give the number of each window's first line, and a second pass notes the places of
the lines that begin pages.  A file of any length is as many tasks as it has windows; no text is split or decoded.

The index is a table keyed by content hash (``sha256, path, size, lines, page_no, pages, byte_start, byte_end``).  ``refresh``
scans only contents that it does not hold yet, and drops those that are gone.  ``read_pages`` joins requests to it and
reads the asked ranges only, within the byte budget of a reply.

Defined cases: an empty file has one empty page; a line feed at the end opens a last, empty line; a page behind the last
one is ``PAGE_OUT_OF_RANGE``, an unknown content ``CORRUPT_FILE``; a page over the budget ends with its last whole line
that fits, or inside a line that alone is too long, at a character, and ``next_offset`` says where to go on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.functions.arrow import slices
from quarrystone.limits import LIMITS
from quarrystone.sources.ranges import PARTITION_BYTES, file_system

WINDOW = 8 << 20
INDEX = ["sha256", "path", "size", "lines", "page_no", "pages", "byte_start", "byte_end"]


def _opened(path: str):
    system, inner, _ = file_system(path)
    return system.open_input_file(inner)


class _Held:
    """One open file, kept for as long as successive rows ask for it."""

    def __init__(self):
        self.path, self.own = None, None

    def file(self, path: str):
        if path != self.path:
            self.close()
            self.own, self.path = _opened(path), path
        return self.own

    def close(self) -> None:
        if self.own is not None:
            self.own.close()
        self.path, self.own = None, None

    def __enter__(self):
        return self

    def __exit__(self, *failed) -> None:
        self.close()


def _windows(files: DataFrame, window: int) -> DataFrame:
    """``path, size, offset`` of every window."""
    return files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)).cast("long"), F.lit(window).cast("long"))).alias("offset"))


def _scanned(windows: DataFrame, window: int, schema: str, found) -> DataFrame:
    """``found(row, places of the line feeds)`` yields rows for each window of a file."""
    names = [x.split()[0] for x in schema.split(", ")]

    def scanned(batches):
        import pyarrow as pa

        with _Held() as held:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    data = np.frombuffer(held.file(row["path"]).read_at(min(window, row["size"] - row["offset"]), row["offset"]), np.uint8) if row["size"] else np.empty(0, np.uint8)
                    rows += found(row, np.flatnonzero(data == 10) + row["offset"])
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                kinds = [pa.string()] + [pa.int64()] * (len(names) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return windows.mapInArrow(scanned, schema)


def build(files: DataFrame, every: int = LIMITS.page_lines, window: int = WINDOW, task_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The index of ``files`` (``sha256``, ``path``, ``size``): a row for each page of ``every`` lines."""
    total = files.agg(F.sum(F.col("size") + 4096)).first()[0] or 0
    dealt = lambda windows: windows.repartition(max(1, -(-total // task_bytes)), "path", F.floor(F.col("offset") / task_bytes)).sortWithinPartitions("path", "offset")
    # Of equal contents the same one whenever this is computed.
    files = files.groupBy("sha256").agg(F.min(F.struct("path", "size")).alias("_file")).select("sha256", "_file.*")
    counts = _scanned(dealt(_windows(files, window)), window, "path string, size long, offset long, feeds long", lambda row, at: [(row["path"], row["size"], row["offset"], len(at))])
    upto = W.partitionBy("path").orderBy("offset").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("path")
    numbered = counts.select("path", "size", "offset", (F.sum("feeds").over(upto) - F.col("feeds")).alias("before"), (F.sum("feeds").over(whole) + 1).alias("lines"))

    def begun(row, at):
        """Pages that begin behind line feeds of the window; the first page begins at 0."""
        first = -row["before"] % every  # the window's line feed number (from 1) that ends a page's last line
        ends = at[(first or every) - 1 :: every]
        pages = [(row["path"], row["size"], row["lines"], (row["before"] + (first or every)) // every + k + 1, int(x) + 1) for k, x in enumerate(ends)]
        return [(row["path"], row["size"], row["lines"], 1, 0), *pages] if row["offset"] == 0 else pages

    starts = _scanned(dealt(numbered), window, "path string, size long, lines long, page_no long, byte_start long", begun)
    ahead = F.lead("byte_start").over(W.partitionBy("path").orderBy("page_no"))
    pages = starts.select("*", F.coalesce(ahead, F.col("size")).alias("byte_end"), F.max("page_no").over(W.partitionBy("path")).alias("pages"))
    return pages.join(files.select("sha256", "path"), "path").select(*INDEX)


def refresh(index: DataFrame, files: DataFrame, every: int = LIMITS.page_lines, window: int = WINDOW) -> DataFrame:
    """``index`` for just the contents of ``files``: what it holds is kept, only new contents are scanned."""
    kept = index.join(files.select("sha256").distinct(), "sha256", "left_semi")
    new = files.join(index.select("sha256").distinct(), "sha256", "left_anti")
    return kept.select(*INDEX).unionByName(build(new, every, window))


def read_pages(requests: DataFrame, index: DataFrame, most_bytes: int = LIMITS.page_bytes, task_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``requests`` (``sha256``, ``page``) with ``text``, ``has_more``, ``next_offset``, ``error_code``.  One range of a file is read for each."""
    known = index.select("sha256").distinct().withColumn("_known", F.lit(True))
    placed = requests.join(known, "sha256", "left").join(index.withColumnRenamed("page_no", "page"), ["sha256", "page"], "left")
    kept = F.struct(*requests.columns).alias("_request")
    code = F.when(F.col("_known").isNull(), "CORRUPT_FILE").when(F.col("byte_start").isNull(), "PAGE_OUT_OF_RANGE")
    asked = placed.select(kept, "path", (F.col("page") == F.col("pages")).alias("_last"), "byte_start", "byte_end", code.alias("_code"))
    request = asked.schema["_request"].dataType.simpleString()
    # Bytes of all requests, by hashes of their keys: the wide rows are joined and shuffled only once.
    key = lambda page: F.xxhash64(F.col("sha256").cast("string"), F.col(page).cast("long")).alias("_key")
    lengths = index.select(key("page_no"), F.least(F.col("byte_end") - F.col("byte_start"), F.lit(most_bytes)).alias("_length"))
    total = requests.select(key("page")).join(lengths, "_key", "left").agg(F.sum(F.coalesce("_length", F.lit(0)) + 4096)).first()[0] or 0

    def read(batches):
        import pyarrow as pa

        with _Held() as held:
            for batch in (part for whole in batches for part in slices(whole)):
                rows = []
                for path, is_last, begin, end, code in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                    if code is not None:
                        rows.append((None, None, None, code))
                        continue
                    try:
                        rows.append((*fitted(held.file(path).read_at(min(end - begin, most_bytes), begin), end - begin, begin, is_last), None))
                    except OSError:
                        rows.append((None, None, None, "CORRUPT_FILE"))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), pa.bool_(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_request", "text", "has_more", "next_offset", "error_code"])

    # By content, as pages that are not there have no path; near pages of one file are in one task, which opens it once.
    spread = asked.repartition(max(1, -(-total // task_bytes)), "_request.sha256", F.floor(F.coalesce("byte_start", F.lit(0)) / task_bytes)).sortWithinPartitions("path", "byte_start")
    return spread.mapInArrow(read, f"_request {request}, text string, has_more boolean, next_offset long, error_code string").select("_request.*", "text", "has_more", "next_offset", "error_code")


def _whole_characters(data: bytes) -> bytes:
    """UTF-8 ``data`` without a character that its end cuts."""
    for k in range(1, min(4, len(data)) + 1):
        byte = data[-k]
        if byte >= 0xC0:
            return data[:-k] if k < 2 + (byte >= 0xE0) + (byte >= 0xF0) and k < len(data) else data
        if byte < 0x80:
            break
    return data


def fitted(data: bytes, wanted: int, begin: int, is_last: bool) -> tuple[str, bool, int | None]:
    """(text, more behind it, where) of a page of ``wanted`` bytes whose first are ``data``; a line feed that ends it is no part of it."""
    over = len(data) < wanted
    if over:
        data = data[: data.rfind(b"\n") + 1] or _whole_characters(data)
    more = over or not is_last
    return data[: len(data) - (more and data.endswith(b"\n"))].decode("utf-8", "replace"), more, begin + len(data) if more else None

"""Table functions for SQL: pages and windows of a text, entries of an archive and one entry's bytes, row by row.

They stand in LATERAL joins, so a query over a table of requests joins ownership and contents first and calls them on
what is left: ``SELECT r.id, p.* FROM asked r, LATERAL text_window(r.text, r.offset) p``.  Each call makes the rows of
one text or archive; nothing is kept between calls.  ``analyze`` refuses wrong types, and limits that are no constants or
beyond those of a reply, before a task runs.

Null: a text is empty, an archive cannot be read (one row with ``CORRUPT_FILE``), a place is the beginning.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, DataType, IntegralType, LongType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarrystone.limits import LIMITS
from quarrystone.operators.archives import list_entries, read_entry
from quarrystone.operators.paging import cut_pages


def checked(name: str, argument: AnalyzeArgument | None, kind: type, most: int | None = None) -> None:
    """Refuse an argument of another type and, where ``most`` is given, one that is no constant from 1 to that."""
    if argument is None:
        return
    if argument.isTable or not isinstance(argument.dataType, (kind, NullType)):
        raise ValueError(f"{name} must be of {kind.__name__}")
    if most is not None:
        if not argument.isConstantExpression:
            raise ValueError(f"{name} must be a constant")
        if argument.value is not None and not 1 <= argument.value <= most:
            raise ValueError(f"{name} must be from 1 to {most}")


def schema(**columns: type[DataType]) -> AnalyzeResult:
    made = StructType()
    for name, kind in columns.items():
        made = made.add(name, kind())
    return AnalyzeResult(made)


def safe_path(raw: str | None) -> str | None:
    """``names.archive_path`` for a value: a normalised relative path, or None where the path is unsafe."""
    posix = (raw or "").replace("\\", "/")
    if posix in ("", ".") or posix[0] == "/" or posix[1:2] == ":" and posix[0].isascii() and posix[0].isalpha():
        return None
    steps: list[str] = []
    for step in posix.split("/"):
        if step == ".." and not steps:
            return None
        if step == "..":
            steps.pop()
        elif step not in ("", "."):
            steps.append(step)
    return "/".join(steps) or "."


class TextPages:
    """``text_pages(text [, most_lines, most_bytes])``: the pages of whole lines, which together are the text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, most_lines: AnalyzeArgument | None = None, most_bytes: AnalyzeArgument | None = None) -> AnalyzeResult:
        checked("text", text, StringType)
        checked("most_lines", most_lines, IntegralType, LIMITS.page_lines)
        checked("most_bytes", most_bytes, IntegralType, LIMITS.page_bytes)
        return schema(page_no=LongType, byte_start=LongType, byte_len=LongType, text=StringType)

    def eval(self, text, most_lines=None, most_bytes=None):
        pages = cut_pages((text or "").encode(), most_lines or LIMITS.page_lines, most_bytes or LIMITS.page_bytes)
        for number, (start, end, page) in enumerate(pages, 1):
            yield number, start, end - start, page


class TextWindow:
    """``text_window(text, page [, most_lines, most_bytes])``: one page, with the number of the next one and an error.

    Null is the first page; ``PAGE_OUT_OF_RANGE`` beyond the last.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, page: AnalyzeArgument, most_lines: AnalyzeArgument | None = None, most_bytes: AnalyzeArgument | None = None) -> AnalyzeResult:
        checked("page", page, IntegralType)
        TextPages.analyze(text, most_lines, most_bytes)
        return schema(text=StringType, next_page=LongType, error_code=StringType)

    def eval(self, text, page, most_lines=None, most_bytes=None):
        wanted = 1 if page is None else page
        found = None
        for number, _, _, own in TextPages().eval(text, most_lines, most_bytes):
            if found is not None:
                yield found, number, None
                return
            if number == wanted:
                found = own
        yield found, None, "PAGE_OUT_OF_RANGE" if found is None else None


class ListArchive:
    """``list_archive(content [, prefix, cursor, most])``: distinct safe paths of an archive in their order, from ``cursor`` on."""

    @staticmethod
    def analyze(content: AnalyzeArgument, prefix: AnalyzeArgument | None = None, cursor: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        checked("content", content, BinaryType)
        checked("prefix", prefix, StringType)
        checked("cursor", cursor, IntegralType)
        checked("most", most, IntegralType, LIMITS.archive_entries)
        return schema(entry_no=LongType, path=StringType, uncompressed=LongType, next_cursor=LongType, error_code=StringType)

    def eval(self, content, prefix=None, cursor=None, most=None):
        found = list_entries(bytes(content or b""))
        if found is None:
            yield None, None, None, None, "CORRUPT_FILE"
            return
        begin = safe_path(prefix) if prefix else ""
        paths: dict[str, int] = {}
        for _, raw, _, _, size in found if begin is not None else ():
            path = safe_path(raw)
            if path is not None and path.startswith(begin):
                paths.setdefault(path, size)
        first = max(0, cursor or 0)
        upto = min(LIMITS.archive_entries, first + (most or 100))
        following = upto if upto < min(len(paths), LIMITS.archive_entries) else None
        for number, (path, size) in enumerate(paths.items()):
            if first <= number < upto:
                yield number, path, size, following, None


class ReadEntry:
    """``read_entry(content, path)``: the bytes of a regular entry, or why there are none; of equal paths the last counts."""

    @staticmethod
    def analyze(content: AnalyzeArgument, path: AnalyzeArgument) -> AnalyzeResult:
        checked("content", content, BinaryType)
        checked("path", path, StringType)
        return schema(entry=BinaryType, error_code=StringType)

    def eval(self, content, path):
        data, wanted = bytes(content or b""), safe_path(path)
        found = list_entries(data)
        if found is None:
            yield None, "CORRUPT_FILE"
            return
        numbers = [number for number, raw, regular, _, _ in found if regular and wanted is not None and safe_path(raw) == wanted]
        yield read_entry(data, numbers[-1]) if numbers else (None, "ARCHIVE_PATH_REJECTED")


FUNCTIONS = {"text_pages": TextPages, "text_window": TextWindow, "list_archive": ListArchive, "read_entry": ReadEntry}


def register(spark: SparkSession) -> None:
    """The table functions, under their names, in the session."""
    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind))

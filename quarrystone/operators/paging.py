"""Pages: lines, bytes, paragraphs, cursors, cells.

Positions within a document come from ``posexplode`` of the document itself, so no window and no shuffle is needed to
number lines; a document's lines stay in its task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.functions.arrow import arrow_function
from quarrystone.functions.names import utf8_prefix
from quarrystone.limits import LIMITS
from quarrystone.operators.running import HOT, running

MOST = 2**53 - 1


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``line_no`` (from 1), ``line``."""
    found = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"\r?\n", -1)).alias("_at", "line"))
    return found.select(id_col, (F.col("_at") + 1).cast("long").alias("line_no"), "line")


def line_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LIMITS.page_lines) -> DataFrame:
    """id, ``page_no`` (from 1), ``n_lines``, ``text``, ``has_more``: pages of at most ``most`` lines."""
    whole = F.split(F.coalesce(text_col, F.lit("")), r"\r?\n", -1)
    found = docs.select(id_col, whole.alias("_lines"))

    def page(k):  # exploded as pages, so no page carries the lines of the others
        own = F.slice("_lines", k * most + 1, most)
        return F.struct((k + 1).cast("long").alias("page_no"), F.size(own).cast("long").alias("n_lines"), F.array_join(own, "\n").alias("text"), ((k + 1) * most < F.size("_lines")).alias("has_more"))

    pages = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_lines") / most).cast("int") - 1), page)
    return found.select(id_col, F.explode(pages).alias("_page")).select(id_col, "_page.*")


def page_span(page: Column, page_end: Column, pages: Column, most: int = LIMITS.pdf_pages) -> Column:
    """Struct ``page``, ``page_end``: the pages asked for, clamped to those there are and to ``most`` at once."""
    first = F.least(F.greatest(F.coalesce(page, F.lit(1)), F.lit(1)), F.greatest(pages, F.lit(1)))
    last = F.least(F.greatest(F.coalesce(page_end, first), first), F.least(F.greatest(pages, F.lit(1)), first + most - 1))
    return F.struct(first.cast("long").alias("page"), last.cast("long").alias("page_end"))


def byte_window(text: Column, offset: Column, most_lines: int = LIMITS.page_lines, most_bytes: int = LIMITS.page_bytes) -> Column:
    """Struct ``text``, ``has_more``, ``next_offset``: whole lines from a byte offset on, within both limits.

    An offset inside a character begins with the next one; a line that alone is too long is cut at a character.
    """
    data = text.cast("binary")
    part = utf8_prefix(F.substring(data, offset + 1, F.lit(most_bytes)), most_bytes)
    part = F.regexp_replace(part, r"^\x{FFFD}+", "")
    lines = F.regexp_extract_all(part, F.lit(r"([^\n]*\n|[^\n]+)"), 1)
    rest = offset + most_bytes < F.octet_length(data)
    whole = F.filter(lines, lambda x: ~rest | F.endswith(x, F.lit("\n")))
    own = F.array_join(F.slice(F.when(F.size(whole) > 0, whole).otherwise(lines), 1, most_lines), "")
    skipped = F.length(F.regexp_extract(F.hex(F.substring(data, offset + 1, F.lit(3))), r"^((?:[89AB][0-9A-F])*)", 1)) / 2
    end = offset + skipped + F.octet_length(own)
    more = end < F.octet_length(data)
    return F.struct(own.alias("text"), more.alias("has_more"), F.when(more, end.cast("long")).alias("next_offset"))


def byte_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lines: int = LIMITS.page_lines, most_bytes: int = LIMITS.page_bytes) -> DataFrame:
    """id, ``page_no``, ``byte_start``, ``byte_len``, ``text``: pages of whole lines within both limits.

    A line that alone is too long is cut at character boundaries.  Pages together are the text, byte for byte.
    """

    @arrow_function("array<struct<page_no:long,byte_start:long,byte_len:long,text:string>>")
    def paged(text: pd.Series) -> pd.Series:
        return text.map(lambda x: [{"page_no": k + 1, "byte_start": a, "byte_len": b - a, "text": data} for k, (a, b, data) in enumerate(cut_pages((x or "").encode(), most_lines, most_bytes))])

    return docs.select(id_col, F.explode(paged(text_col)).alias("_page")).select(id_col, "_page.*")


def cut_pages(data: bytes, most_lines: int, most_bytes: int):
    """(start, end, text) of each page of UTF-8 ``data``."""
    start = end = count = 0
    for line in re.findall(rb"[^\n]*\n|[^\n]+", data):
        while line:
            if count and (count >= most_lines or end - start + len(line) > most_bytes):
                yield start, end, data[start:end].decode()
                start, count = end, 0
            part = line
            if len(line) > most_bytes:
                cut = most_bytes
                while line[cut] & 0xC0 == 0x80:
                    cut -= 1
                part = line[: cut or len(line)]
            end, count, line = end + len(part), count + 1, line[len(part) :]
    if count or not data:
        yield start, end, data[start:end].decode()


def fitting(items: Column, begin: Column, count: Column, sep: str = "\n", most_bytes: int = LIMITS.page_bytes) -> Column:
    """How many items of an array, at most ``count`` from ``begin`` on, fit into ``most_bytes`` when joined.

    The size grows with the number of items, so the largest number that fits is found by halving.
    """
    there = F.greatest(F.least(count.cast("int"), F.size(items) - begin.cast("int")), F.lit(0))
    fits = lambda n: F.octet_length(F.array_join(F.slice(items, begin.cast("int") + 1, n), sep)) <= most_bytes

    def halved(x, _):
        middle = F.ceil((x["low"] + x["high"]) / 2).cast("int")
        ok = fits(middle)
        return F.struct(F.when(ok, middle).otherwise(x["low"]).alias("low"), F.when(ok, x["high"]).otherwise(middle - 1).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(there + 1)).cast("int"), F.lit(1))), F.struct(F.lit(0).alias("low"), there.alias("high")), halved)
    return F.when(fits(there), there).otherwise(found["low"])


def window_of(items: Column, offset: Column | int = 0, limit: Column | int = LIMITS.page_lines, most: int = LIMITS.page_lines, most_bytes: int = LIMITS.page_bytes, sep: str = "\n") -> Column:
    """Struct ``text, n, has_more, next_offset, error_code`` of ``limit`` items (paragraphs, rows, pages) of an array from ``offset`` on.

    Fewer, if more would not fit into ``most_bytes``; where already the first does not, ``PARSER_OUTPUT_LIMIT``.
    """
    begin = F.greatest(F.lit(offset) if isinstance(offset, int) else offset, F.lit(0)).cast("int")
    limit = F.least(F.greatest(F.lit(limit) if isinstance(limit, int) else limit, F.lit(1)), F.lit(most)).cast("int")

    def window(x):
        n, size = x["n"], F.size(items)
        failed = (n == 0) & (size > begin)
        more = size > begin + n
        text = F.when(~failed, F.array_join(F.slice(items, begin + 1, n), sep))
        return F.struct(text.alias("text"), n.cast("long").alias("n"), F.when(~failed, more).alias("has_more"), F.when(~failed & more, (begin + n).cast("long")).alias("next_offset"), F.when(failed, "PARSER_OUTPUT_LIMIT").alias("error_code"))

    return F.element_at(F.transform(F.array(F.struct(fitting(items, begin, limit, sep, most_bytes).alias("n"))), window), 1)


def cursor_page(rows: DataFrame, group: list[str], order: list[Column], cursor: int = 0, limit: int = 100, most: int = LIMITS.archive_entries, hot: int = HOT) -> DataFrame:
    """Of each group the rows from ``cursor`` on, ``limit`` of them, with ``entry_no`` and ``next_cursor`` where there are more."""
    cursor, limit = max(0, cursor), max(1, min(limit, most))
    upto = min(most, cursor + limit)
    # One place more than is asked for tells whether there is more.
    numbered = running(rows, group, order, name="entry_no", hot=hot).withColumn("entry_no", F.col("entry_no") - 1).filter(F.col("entry_no").between(cursor, upto))
    more = F.max("entry_no").over(W.partitionBy(*group)) == upto  # at most limit + 1 rows
    page = numbered.withColumn("next_cursor", F.when(more & F.lit(upto < most), F.lit(upto).cast("long")))
    return page.filter(F.col("entry_no") < upto)


@dataclass(frozen=True)
class CellRange:
    row_from: int
    col_from: int
    row_to: int
    col_to: int


def column_index(letters: str) -> int:
    value = 0
    for char in letters.upper():
        value = value * 26 + ord(char) - 64
    return value


def cell_range(text: str | None) -> CellRange | None:
    """A1 notation: ``B2``, ``A1:B5``, ``A`` or ``A:C`` (whole columns).  What is not valid is no filter."""
    match = re.fullmatch(r"([A-Za-z]+)(\d*)(?::([A-Za-z]+)(\d*))?", (text or "").strip())
    if not match:
        return None
    first, top, last, bottom = match.groups()
    row_from = int(top) if top else 1
    row_to = (int(bottom) if bottom else MOST) if last else (row_from if top else MOST)
    col_from = column_index(first)
    col_to = column_index(last) if last else col_from
    return CellRange(row_from, col_from, row_to, col_to) if 1 <= row_from <= row_to and col_from <= col_to else None


def cells_in(cells: DataFrame, asked: str | None, row: str = "row_no", col: str = "col_no") -> DataFrame:
    """The cells of a range; the bounds are plain comparisons, so they are pushed down to the scan."""
    bounds = cell_range(asked)
    if bounds is None:
        return cells
    return cells.filter(F.col(row).between(bounds.row_from, bounds.row_to) & F.col(col).between(bounds.col_from, bounds.col_to))


def sheet_rows(cells: DataFrame, group: list[str], row: str = "row_no", col: str = "col_no", value: str = "value") -> DataFrame:
    """Rows as text: the filled cells of a row, by column, joined by tabs."""
    filled = cells.filter(F.coalesce(F.col(value), F.lit("")) != "")
    made = filled.groupBy(*group, row).agg(F.array_sort(F.collect_list(F.struct(col, value))).alias("_cells"))
    flat = F.transform("_cells", lambda x: F.regexp_replace(x[value], r"\r?\n", " "))
    return made.select(*group, row, F.array_join(flat, "\t").alias("text"))

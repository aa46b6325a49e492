"""Compound files and the two formats kept in them: binary workbooks (BIFF8) and binary text documents.

Written from the published format descriptions; only what a reader of text and cells needs.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.arrow import arrow_function

_BROKEN = (struct.error, IndexError, ValueError, KeyError, MemoryError, OverflowError)
_END = 0xFFFFFFFA


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by lower-cased name; raises on damage."""
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    first_dir, cutoff, first_small = struct.unpack_from("<I4xII", data, 48)
    first_more = struct.unpack_from("<I", data, 68)[0]
    size, small = 1 << shift, 1 << small_shift
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    places = list(struct.unpack_from("<109I", data, 76))
    seen = set()
    while first_more < _END and first_more not in seen:
        seen.add(first_more)
        *more, following = struct.unpack(f"<{size // 4}I", sector(first_more))
        places += more
        first_more = following
    table = [x for n in places if n < _END for x in struct.unpack(f"<{size // 4}I", sector(n))]

    def chain(start: int, links: list[int], part) -> bytes:
        out, passed = [], set()
        while start < _END and start not in passed:
            passed.add(start)
            out.append(part(start))
            start = links[start]
        return b"".join(out)

    directory = chain(first_dir, table, sector)
    entries = []
    for at in range(0, len(directory) - 127, 128):
        length, kind = struct.unpack_from("<HB", directory, at + 64)
        start, long = struct.unpack_from("<II", directory, at + 116)
        if kind in (2, 5):
            entries.append((directory[at : at + max(0, length - 2)].decode("utf-16-le", "replace").lower(), kind, start, long))
    root = next((chain(start, table, sector) for _, kind, start, _ in entries if kind == 5), b"")
    raw = chain(first_small, table, sector)
    links = list(struct.unpack(f"<{len(raw) // 4}I", raw))
    pick = lambda n: root[n * small : (n + 1) * small]
    return {name: (chain(start, links, pick) if long < cutoff else chain(start, table, sector))[:long] for name, kind, start, long in entries if kind == 2}


def _records(book: bytes, at: int = 0):
    while at + 4 <= len(book):
        kind, length = struct.unpack_from("<HH", book, at)
        yield kind, book[at + 4 : at + 4 + length]
        at += 4 + length


class _Strings:
    """Shared strings, which may run over from one record into the next."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
            piece = self.parts[self.k][self.at : self.at + n - len(out)]
            self.at += len(piece)
            out += piece
        return out

    def text(self) -> str:
        length, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, ""
        while len(out) < length:
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 1
                wide = self.parts[self.k][0] & 1
            unit = 2 if wide else 1
            n = min(length - len(out), (len(self.parts[self.k]) - self.at) // unit)
            out += self.take(n * unit).decode("utf-16-le" if wide else "latin-1", "replace")
            if not n:
                raise ValueError("string does not end")
        self.take(4 * runs + extra)
        return out


def _plain(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _small(raw: int) -> float:
    value = float(raw - (1 << 32) >> 2 if raw & 0x80000000 else raw >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def _short_text(raw: bytes, at: int, length: int) -> str:
    return raw[at + 1 : at + 1 + 2 * length].decode("utf-16-le", "replace") if raw[at] & 1 else raw[at + 1 : at + 1 + length].decode("latin-1")


def workbook_cells(data: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of each filled cell, rows and columns from 1."""
    found = streams(data)
    book = found.get("workbook") or found["book"]
    sheets, shared, strings = [], [], []
    for kind, raw in _records(book):
        if kind == 0x85:
            sheets.append((_short_text(raw, 7, raw[6]), struct.unpack_from("<I", raw)[0]))
        elif kind == 0xFC or kind == 0x3C and shared:
            shared.append(raw)
        elif shared and not strings:
            count = struct.unpack_from("<I", shared[0], 4)[0]
            reader = _Strings([shared[0][8:], *shared[1:]])
            strings = [reader.text() for _ in range(count)]
        if kind == 0x0A:
            break
    out = []
    for sheet, start in sheets:
        waiting = None
        for kind, raw in _records(book, start):
            if kind == 0x0A:
                break
            if kind == 0x207 and waiting:
                out.append((sheet, *waiting, _short_text(raw, 2, struct.unpack_from("<H", raw)[0])))
                waiting = None
            if kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x06, 0x205):
                continue
            row, col = struct.unpack_from("<HH", raw)
            place = (row + 1, col + 1)
            if kind == 0xFD:
                out.append((sheet, *place, strings[struct.unpack_from("<I", raw, 6)[0]]))
            elif kind == 0x203:
                out.append((sheet, *place, _plain(struct.unpack_from("<d", raw, 6)[0])))
            elif kind == 0x27E:
                out.append((sheet, *place, _plain(_small(struct.unpack_from("<I", raw, 6)[0]))))
            elif kind == 0xBD:
                out += [(sheet, row + 1, col + 1 + k, _plain(_small(struct.unpack_from("<I", raw, 6 + 6 * k)[0]))) for k in range((len(raw) - 6) // 6)]
            elif kind == 0x204:
                out.append((sheet, *place, _short_text(raw, 8, struct.unpack_from("<H", raw, 6)[0])))
            elif kind == 0x205:
                out.append((sheet, *place, ("FALSE", "TRUE")[raw[6] & 1] if not raw[7] else "#ERR"))
            elif raw[12:14] == b"\xff\xff":
                waiting = place if raw[6] == 0 else None
                if raw[6] == 1:
                    out.append((sheet, *place, ("FALSE", "TRUE")[raw[8] & 1]))
            else:
                out.append((sheet, *place, _plain(struct.unpack_from("<d", raw, 6)[0])))
    return [x for x in out if x[3]]


def document_text(data: bytes) -> str:
    """The body of a binary text document, by its piece table; field codes are left out, their results stay."""
    found = streams(data)
    main = found["worddocument"]
    flags = struct.unpack_from("<H", main, 0x0A)[0]
    table = found["1table" if flags & 0x0200 else "0table"]
    length = struct.unpack_from("<I", main, 0x4C)[0]
    start, size = struct.unpack_from("<II", main, 0x1A2)
    pieces, at = table[start : start + size], 0
    while pieces[at] == 1:
        at += 3 + struct.unpack_from("<H", pieces, at + 1)[0]
    n = (struct.unpack_from("<I", pieces, at + 1)[0] - 4) // 12
    bounds = struct.unpack_from(f"<{n + 1}I", pieces, at + 5)
    out = []
    for k in range(n):
        place = struct.unpack_from("<I", pieces, at + 5 + 4 * (n + 1) + 8 * k + 2)[0]
        count = bounds[k + 1] - bounds[k]
        if place & 0x40000000:
            begin = (place & 0x3FFFFFFF) // 2
            out.append(main[begin : begin + count].decode("cp1252", "replace"))
        else:
            out.append(main[place : place + 2 * count].decode("utf-16-le", "replace"))
    text = "".join(out)[:length]
    text = re.sub(r"\x13[^\x13-\x15]*\x14|\x13[^\x13-\x15]*\x15|\x15", "", text)
    text = text.replace("\x07", "\t").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n")
    return re.sub(r"[\x00-\x08\x0e-\x1f]", "", text)


def xls(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """id, ``sheet``, ``row_no``, ``col_no``, ``value``, ``error_code``: one row for each filled cell."""

    @arrow_function("cells array<struct<sheet:string,row_no:long,col_no:long,value:string>>, error_code string")
    def read(content: pd.Series) -> pd.DataFrame:
        rows = [_try(workbook_cells, x) for x in content]
        keys = ("sheet", "row_no", "col_no", "value")
        return pd.DataFrame({"cells": [None if r[0] is None else [dict(zip(keys, c, strict=True)) for c in r[0]] for r in rows], "error_code": [r[1] for r in rows]})

    found = files.select(id_col, read(content_col).alias("_w")).select(id_col, "_w.*")
    return found.select(id_col, "error_code", F.explode_outer("cells").alias("c")).select(id_col, "c.*", "error_code")


@arrow_function("text string, error_code string")
def doc_text(content: pd.Series) -> pd.DataFrame:
    """The text of binary documents; nulls for null content."""
    rows = [_try(document_text, x) if x is not None else (None, None) for x in content]
    return pd.DataFrame({"text": [r[0] for r in rows], "error_code": [r[1] for r in rows]})


def doc_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")


def doc(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """id, ``paragraphs``, ``error_code``."""
    found = files.select(id_col, doc_text(F.coalesce(content_col, F.lit(b""))).alias("_d")).select(id_col, "_d.*")
    return found.select(id_col, doc_lines(F.col("text")).alias("paragraphs"), "error_code")


def _try(reader, content) -> tuple:
    try:
        return reader(bytes(content or b"")), None
    except _BROKEN:
        return None, "CORRUPT_FILE"

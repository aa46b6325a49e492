"""Documents as rows.

Each reader turns the bytes in a row into an array of small structs, and Spark explodes, numbers, filters and joins them.
Python takes packages apart; paragraphs, links, sheets, ranges and pages are Column expressions over their parts.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.arrow import arrow_function
from quarrystone.functions.detection import zip_entries
from quarrystone.functions.names import strip_markup, zip_target
from quarrystone.limits import LIMITS

_BROKEN = (zipfile.BadZipFile, NotImplementedError, zlib.error, EOFError, OSError, RuntimeError, ValueError)


def package_parts(data: bytes, wanted: str, most: int = LIMITS.part_bytes, budget: int = LIMITS.decompressed_bytes) -> tuple[dict[str, str] | None, str | None]:
    """(texts of the parts whose name matches ``wanted``, error code); inflating stops where the budget ends."""
    found = zip_entries(data)
    if not found:
        return None, "CORRUPT_FILE"
    if sum(x.file_size for x in found) > budget:
        return None, "FILE_TOO_LARGE"
    if any(x.filename.startswith("/") or ".." in x.filename.split("/") for x in found):
        return None, "ARCHIVE_PATH_REJECTED"
    out, used = {}, 0
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in found:
                if re.search(wanted, info.filename):
                    with archive.open(info) as part:
                        text = part.read(min(most, budget - used) + 1)
                    used += len(text)
                    if used > budget:
                        return None, "FILE_TOO_LARGE"
                    if len(text) <= most:
                        out[info.filename] = text.decode("utf-8", "replace")
    except _BROKEN:
        return None, "CORRUPT_FILE"
    return out, None


def parts(content: Column, wanted: str) -> Column:
    """Struct ``parts`` (map of name to text) and ``error_code``."""

    @arrow_function("parts map<string,string>, error_code string")
    def opened(data: pd.Series) -> pd.DataFrame:
        rows = [package_parts(bytes(x or b""), wanted) for x in data]
        return pd.DataFrame({"parts": [r[0] for r in rows], "error_code": [r[1] for r in rows]})

    return opened(content)


#: The parts that are read of each kind of package.
PACKAGES = {
    "docx": r"^word/document\.xml$",
    "pptx": r"^ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml$",
    "xlsx": r"^xl/(workbook|sharedStrings|worksheets/sheet\d+)\.xml$",
    "odt": r"^content\.xml$",
    "ods": r"^content\.xml$",
    "odp": r"^content\.xml$",
    "epub": r"(?i)(^META-INF/container\.xml|\.opf|\.x?html?|\.xml)$",
}


@arrow_function("parts map<string,string>, error_code string")
def package(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """``parts`` of packages of any kind, each opened by what its kind needs; nulls for null content."""
    rows = [package_parts(bytes(x), PACKAGES[k]) if x is not None else (None, None) for x, k in zip(content, kind, strict=True)]
    return pd.DataFrame({"parts": [r[0] for r in rows], "error_code": [r[1] for r in rows]})


def _opened(files: DataFrame, wanted: str, id_col: str, content_col: str) -> DataFrame:
    return files.select(id_col, parts(F.col(content_col), wanted).alias("_p")).select(id_col, "_p.*")


def _texts(xml: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(f"(?s)({pattern})"), 1), strip_markup)


def docx(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """id, ``paragraphs`` (those outside tables, then a line for each table, its cells joined by " | "), ``error_code``."""
    found = _opened(files, PACKAGES["docx"], id_col, content_col)
    body, lines = docx_lines(F.col("parts"))
    return found.select(id_col, lines.alias("paragraphs"), F.coalesce("error_code", F.when(body.isNull(), "CORRUPT_FILE")).alias("error_code"))


def docx_lines(parts: Column) -> tuple[Column, Column]:
    """(the body, null where there is none; its lines)."""
    body = F.try_element_at(parts, F.lit("word/document.xml"))
    tables = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?s)(<w:tbl[ >].*?</w:tbl>)"), 1)
    rows = F.transform(tables, lambda t: F.array_join(F.filter(_texts(t, r"<w:tc[ >].*?</w:tc>"), lambda x: x != ""), " | "))
    prose = _texts(F.regexp_replace(body, r"(?s)<w:tbl[ >].*?</w:tbl>", ""), r"<w:p[ >].*?</w:p>")
    return body, F.filter(F.concat(prose, rows), lambda x: x != "")


def pptx(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """id, ``page_no``, ``text`` (slide and notes), ``n_pages``, ``error_code``: a row for each slide, by its number."""
    found = _opened(files, PACKAGES["pptx"], id_col, content_col).withColumn("_pages", pptx_pages(F.col("parts")))
    rows = found.select(id_col, "error_code", F.size("_pages").alias("n_pages"), F.posexplode_outer("_pages").alias("_at", "text"))
    return rows.select(id_col, (F.col("_at") + 1).cast("long").alias("page_no"), "text", "n_pages", "error_code")


def pptx_pages(parts: Column) -> Column:
    """The texts of the slides, by their numbers, each with its notes."""
    slides = F.filter(F.map_keys(parts), lambda x: x.rlike(r"^ppt/slides/slide\d+\.xml$"))
    numbers = F.array_sort(F.transform(slides, lambda x: F.regexp_extract(x, r"(\d+)\.xml$", 1).cast("int")))
    text = lambda folder, n: _texts(F.try_element_at(parts, F.concat(F.lit(folder), n, F.lit(".xml"))), r"<a:t[ >].*?</a:t>|<a:t>.*?</a:t>")
    return F.transform(numbers, lambda n: F.array_join(F.concat(text("ppt/slides/slide", n), text("ppt/notesSlides/notesSlide", n)), "\n"))


def xlsx(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """id, ``sheet``, ``row_no``, ``col_no``, ``value``, ``error_code``: one row for each filled cell, at its true place."""
    found = _opened(files, PACKAGES["xlsx"], id_col, content_col)
    names = F.regexp_extract_all(F.coalesce(F.try_element_at("parts", F.lit("xl/workbook.xml")), F.lit("")), F.lit(r'<sheet[^>]*\bname="([^"]*)"'), 1)
    shared = _texts(F.try_element_at("parts", F.lit("xl/sharedStrings.xml")), r"<si[ >].*?</si>")
    sheets = found.select(id_col, "parts", "error_code", shared.alias("_shared"), F.posexplode_outer(names).alias("_at", "sheet"))
    sheets = sheets.select(id_col, "sheet", "_shared", "error_code", _cells(F.try_element_at("parts", F.concat(F.lit("xl/worksheets/sheet"), F.col("_at") + 1, F.lit(".xml")))).alias("_cells"))
    cells = sheets.select(id_col, "sheet", "_shared", "error_code", F.explode_outer("_cells").alias("c"))
    by_index = F.try_element_at("_shared", F.expr("try_cast(c.raw AS int) + 1"))
    value = F.when(F.col("c.kind") == "s", F.coalesce(by_index, F.col("c.raw"))).otherwise(F.col("c.raw"))
    return cells.select(id_col, "sheet", "c.row_no", "c.col_no", value.alias("value"), "error_code")


@arrow_function("array<struct<row_no:long,col_no:long,kind:string,raw:string>>")
def _cells(sheet: pd.Series) -> pd.Series:
    """The cells of a sheet part; a row or cell without a reference follows the one before."""

    def read(xml):
        out, row_no = [], 0
        try:
            for row in ElementTree.fromstring(xml or "<x/>").iter():
                if not row.tag.endswith("row") or row.tag.endswith("}brk"):
                    continue
                row_no = int(row.get("r") or row_no + 1)
                col_no = 0
                for cell in row:
                    letters = re.match(r"[A-Za-z]+", cell.get("r") or "")
                    col_no = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0].upper()))) if letters else col_no + 1
                    kind = cell.get("t") or "n"
                    raw = "".join(x.text or "" for x in cell.iter() if x.tag.rpartition("}")[2] == ("t" if kind == "inlineStr" else "v"))
                    if raw:
                        out.append({"row_no": row_no, "col_no": col_no, "kind": kind, "raw": raw})
        except (ElementTree.ParseError, ValueError):
            return None
        return out

    return sheet.map(read)


def open_document(files: DataFrame, id_col: str = "id", content_col: str = "content", spreadsheet: bool = False) -> DataFrame:
    """id, ``paragraphs``, ``error_code``: paragraphs and headings of texts and slides; rows of sheets, cells joined by tabs."""
    found = _opened(files, PACKAGES["odt"], id_col, content_col)
    body, lines = open_lines(F.col("parts"), spreadsheet)
    return found.select(id_col, lines.alias("paragraphs"), F.coalesce("error_code", F.when(body.isNull(), "CORRUPT_FILE")).alias("error_code"))


def open_lines(parts: Column, spreadsheet: bool = False) -> tuple[Column, Column]:
    """(the body, null where there is none; its lines)."""
    body = F.try_element_at(parts, F.lit("content.xml"))
    if spreadsheet:
        rows = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?s)(<table:table-row[ >].*?</table:table-row>)"), 1)
        texts = F.transform(rows, lambda r: F.array_join(F.filter(F.transform(_texts(r, r"<table:table-cell[^>/]*>.*?</table:table-cell>"), lambda x: F.regexp_replace(x, r"\s+", " ")), lambda x: x != ""), "\t"))
    else:
        texts = _texts(body, r"<text:(?:p|h)[ >].*?</text:(?:p|h)>")
    return body, F.filter(texts, lambda x: x != "")


def epub(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """id, ``chapter_no``, ``path``, ``text``, ``error_code``: the spine's chapters in order, or all by name where there is no spine."""
    found = _opened(files, PACKAGES["epub"], id_col, content_col).withColumn("_chapters", epub_chapters(F.col("parts")))
    rows = found.select(id_col, "error_code", F.posexplode_outer("_chapters").alias("_at", "c"))
    return rows.select(id_col, (F.col("_at") + 1).cast("long").alias("chapter_no"), "c.path", "c.text", "error_code")


def epub_chapters(parts: Column) -> Column:
    """Structs ``path``, ``text`` of the chapters."""
    named = F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit("META-INF/container.xml")), F.lit("")), r'full-path="([^"]+)"', 1)
    opf, base = F.coalesce(F.try_element_at(parts, named), F.lit("")), F.regexp_replace(named, "/?[^/]*$", "")
    items = F.regexp_extract_all(opf, F.lit(r"(<item\b[^>]*>)"), 1)
    attribute = lambda tag, name: F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1)
    manifest = F.map_from_entries(F.array_distinct(F.transform(items, lambda x: F.struct(attribute(x, "id").alias("k"), attribute(x, "href").alias("v")))))
    spine = F.regexp_extract_all(opf, F.lit(r'<itemref\b[^>]*\bidref="([^"]*)"'), 1)
    book = F.struct(base.alias("base"), manifest.alias("manifest"), spine.alias("spine"))

    def chapters(book):  # the book's parts are lambda variables, so they are not made anew for each chapter
        linked = F.transform(book["spine"], lambda x: zip_target(book["base"], F.try_element_at(book["manifest"], x)))
        held = F.filter(linked, lambda x: F.map_contains_key(parts, x) & x.rlike(r"(?i)\.(x?html?|xml)$"))
        every = F.array_sort(F.filter(F.map_keys(parts), lambda x: x.rlike(r"(?i)\.x?html?$")))
        return F.when(F.size(held) > 0, held).otherwise(every)

    paths = F.element_at(F.transform(F.array(book), chapters), 1)
    return F.transform(paths, lambda p: F.struct(p.alias("path"), strip_markup(F.try_element_at(parts, p)).alias("text")))


_RTF = re.compile(r"\\u(-?\d+) ?|\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)
_RTF_BREAKS = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "\t"}
#: Groups whose text is not the document's.
_RTF_HIDDEN = frozenset("fonttbl colortbl stylesheet info pict object themedata colorschememapping latentstyles listtable listoverridetable rsidtbl generator".split())


def rtf_text(data: bytes) -> str:
    """The text of rich text: control words dropped, breaks and escapes decoded, tables of fonts and the like skipped."""
    out: list[str] = []
    hidden, skip, width, stack = False, 0, 1, []
    pending = bytearray()

    def flush() -> None:
        if pending:
            out.append(pending.decode("gb18030" if max(pending) > 0x9F and len(pending) > 1 else "cp1252", "replace"))
            pending.clear()

    for m in _RTF.finditer(data.decode("latin-1")):
        point, byte, word, number, sign, brace, plain = m.groups()
        if byte is None:
            flush()
        if brace == "{":
            stack.append((hidden, width))
        elif brace == "}":
            hidden, width = stack.pop() if stack else (False, 1)
        elif word:
            if word in _RTF_HIDDEN:
                hidden = True
            elif word == "uc":
                width = int(number or 1)
            elif word in _RTF_BREAKS and not hidden:
                out.append(_RTF_BREAKS[word])
        elif sign == "*":
            hidden = True
        elif hidden:
            continue
        elif point is not None:
            out.append(chr(int(point) % 65536))
            skip = width
        elif byte is not None:
            if skip:
                skip -= 1
            else:
                pending.append(int(byte, 16))
        elif sign is not None:
            out.append({"~": "\xa0", "_": "-", "-": ""}.get(sign, sign))
        elif plain:
            out.append(plain[skip:])
            skip = 0
    flush()
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@arrow_function("string")
def rtf(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else rtf_text(bytes(x)))


def whole_text(data: bytes) -> tuple[str, str]:
    """The text of a file and its encoding: by its mark, else strict UTF-8, else strict GB18030, else UTF-8 with replacements."""
    for mark, encoding in ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"), (b"\xef\xbb\xbf", "utf-8")):
        if data.startswith(mark):
            return data[len(mark) :].decode(encoding, "replace"), encoding
    for encoding in ("utf-8", "gb18030"):
        try:
            return data.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "utf-8"


@arrow_function("text string, encoding string")
def decoded(content: pd.Series) -> pd.DataFrame:
    """The text of a file and its encoding; nulls for null."""
    rows = [whole_text(bytes(x)) if x is not None else (None, None) for x in content]
    return pd.DataFrame({"text": [r[0] for r in rows], "encoding": [r[1] for r in rows]})


# PDF: pages and positioned runs of text, from streams that are plain or deflated.

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_SHOW = re.compile(
    rb"(?P<string>\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9a-fA-F\s]*>)|(?P<array>\[(?:[^\[\]()]|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\])|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+))|(?P<word>[A-Za-z'\"*]+)",
    re.S,
)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.|\n)", re.S)


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        table = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        data = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else table.get(m[1], m[1]), raw[1:-1])
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def _runs(stream: bytes) -> list[dict]:
    out, stack, x, y, size = [], [], 0.0, 0.0, 12.0
    for m in _SHOW.finditer(stream):
        if m["word"] is None:
            stack.append(m[0])
            continue
        word = m["word"]
        numbers = [float(s) for s in stack if re.fullmatch(rb"[-+]?(?:\d+\.?\d*|\.\d+)", s)]
        if word == b"BT":
            x = y = 0.0
        elif word == b"Tf" and numbers:
            size = numbers[-1]
        elif word in (b"Td", b"TD") and len(numbers) >= 2:
            x, y = x + numbers[-2], y + numbers[-1]
        elif word == b"Tm" and len(numbers) >= 6:
            x, y = numbers[-2:]
        elif word == b"T*":
            y -= size
        elif word in (b"Tj", b"TJ", b"'", b'"') and stack:
            y -= size if word in (b"'", b'"') else 0
            text = "".join(_pdf_string(s) for s in re.findall(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9a-fA-F\s]*>", stack[-1], re.S))
            width = 0.5 * size * len(text)
            out.append({"text": text, "x": x, "y": y, "width": width})
            x += width
        stack.clear()
    return out


class _TooLarge(Exception):
    """More is inflated than the documented budget."""


def pdf_pages(data: bytes) -> tuple[list[list[dict]] | None, str | None]:
    """(runs of each page, error code)."""
    if b"/Encrypt" in data:
        return None, "ENCRYPTED_FILE"
    objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
    left = LIMITS.decompressed_bytes

    def stream_of(body: bytes) -> bytes:
        nonlocal left
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        if b"/FlateDecode" not in body[: m.start()]:
            return m[1]
        out = zlib.decompressobj().decompress(m[1], left + 1)
        left -= len(out)
        if left < 0:
            raise _TooLarge
        return out

    try:
        return _pages_of(objects, stream_of)
    except _TooLarge:
        return None, "FILE_TOO_LARGE"
    except zlib.error:
        return None, "CORRUPT_FILE"


def _pages_of(objects: dict[int, bytes], stream_of) -> tuple[list[list[dict]] | None, str | None]:
    for body in list(objects.values()):  # objects packed in streams
        if re.search(rb"/Type\s*/ObjStm", body):
            inner, first = stream_of(body), re.search(rb"/First\s+(\d+)", body)
            if first:
                table = [int(x) for x in inner[: int(first[1])].split()]
                places = [*table[1::2], len(inner) - int(first[1])]
                objects |= {n: inner[int(first[1]) + a : int(first[1]) + b] for n, a, b in zip(table[::2], places, places[1:], strict=False)}
    refs = lambda body, key: [int(x) for m in re.finditer(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])]
    kids = [n for body in objects.values() if re.search(rb"/Type\s*/Pages\b", body) for n in refs(body, b"Kids")]
    order = [n for n in kids if n in objects and re.search(rb"/Type\s*/Page\b(?!s)", objects[n])]
    if not order:
        return None, "CORRUPT_FILE"
    return [_runs(b"\n".join(stream_of(objects[c]) for c in refs(objects[n], b"Contents") if c in objects)) for n in order], None


@arrow_function("pages array<array<struct<text:string,x:double,y:double,width:double>>>, error_code string")
def pdf(content: pd.Series) -> pd.DataFrame:
    """The runs of each page; nulls for null content."""
    rows = [pdf_pages(bytes(x)) if x is not None else (None, None) for x in content]
    return pd.DataFrame({"pages": [r[0] for r in rows], "error_code": [r[1] for r in rows]})


def pdf_runs(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """id, ``page_no``, ``run_no``, ``text``, ``x``, ``y``, ``width``, ``n_pages``, ``error_code``."""

    found = files.select(id_col, pdf(F.coalesce(content_col, F.lit(b""))).alias("_p")).select(id_col, "_p.*")
    pages = found.select(id_col, "error_code", F.size("pages").alias("n_pages"), F.posexplode_outer("pages").alias("_page", "_runs"))
    runs = pages.select(id_col, "error_code", "n_pages", "_page", F.posexplode_outer("_runs").alias("_run", "r"))
    return runs.select(id_col, (F.col("_page") + 1).cast("long").alias("page_no"), F.col("_run").cast("long").alias("run_no"), "r.*", "n_pages", "error_code")


def ordered_text(runs: DataFrame, group: list[str], line_height: float = 2.0) -> DataFrame:
    """Positioned runs as text: lines from top to bottom (by ``y`` in steps of ``line_height``), runs from left to right.

    A run further than one unit from the end of the one before is set off by a space.
    """
    runs = runs.filter(F.col("text").isNotNull()).groupBy(*group).agg(F.collect_list(F.struct("text", "x", "y", "width")).alias("_runs"))
    return runs.select(*group, joined_runs(F.col("_runs"), line_height).alias("text"))


def joined_runs(runs: Column, line_height: float = 2.0) -> Column:
    """The text of an array of runs (``text``, ``x``, ``y``, ``width``)."""
    placed = F.array_sort(F.transform(runs, lambda r: F.struct(F.floor(-r["y"] / line_height).alias("line"), r["x"].alias("x"), r["width"].alias("width"), r["text"].alias("text"))))
    joined = F.aggregate(
        placed,
        F.struct(F.lit("").alias("text"), F.lit(None).cast("bigint").alias("line"), F.lit(0.0).alias("end")),
        lambda acc, r: F.struct(
            F.concat(acc["text"], F.when(acc["line"].isNull(), "").when(acc["line"] != r["line"], "\n").when(r["x"] > acc["end"] + 1, " ").otherwise(""), r["text"]).alias("text"),
            r["line"].alias("line"),
            (r["x"] + r["width"]).cast("double").alias("end"),
        ),
    )
    return joined["text"]

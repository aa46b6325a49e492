"""What a file is, from its first bytes: text kinds as a CASE over patterns, containers by their entries.

``text_kind`` and ``mismatch`` are Column expressions.  ``detect`` adds the work on bytes (signatures, zip and compound
file directories, GB18030) in one pass of Arrow batches that looks only at what a kind needs.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import zips
from quarrystone.functions.arrow import arrow_function
from quarrystone.functions.names import extension, sanitize_filename, utf8_prefix
from quarrystone.limits import LIMITS

# Kinds of text files by extension.
TEXT_EXTENSIONS = {
    "config-json": "json jsonc", "html": "html htm", "config-xml": "xml xsd rss", "svg": "svg", "config-yaml": "yaml yml",
    "config-toml": "toml", "config-ini": "ini conf", "plist": "plist", "csv": "csv", "tsv": "tsv", "sql": "sql",
    "markdown": "md mdx", "source-typescript": "ts tsx", "source-javascript": "js jsx", "source-python": "py",
    "shell": "sh zsh bash", "source-c": "c h", "source-cpp": "cpp cc hpp", "source-go": "go", "source-rust": "rs", "source-java": "java",
}
#: Kinds that an extension promises beside those, and extensions that promise nothing.
OTHER_EXTENSIONS = {
    "text": "txt", "pdf": "pdf", "zip": "zip", "7z": "7z", "rar": "rar", "png": "png", "jpeg": "jpg jpeg", "gif": "gif", "webp": "webp",
    "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "epub": "epub", "doc": "doc wps", "xls": "xls", "ppt": "ppt", "rtf": "rtf",
    "odt": "odt", "ods": "ods", "odp": "odp", "config-text": "config",
}
NOT_PROMISED = ("xsd", "rss")
#: MIME types of kinds whose own is not text/plain, and other types that are accepted for a kind.
MIMES = {
    "config-json": "application/json", "config-yaml": "application/yaml", "config-xml": "application/xml", "plist": "application/xml", "html": "text/html",
    "svg": "image/svg+xml", "markdown": "text/markdown", "csv": "text/csv", "tsv": "text/tab-separated-values", "sql": "application/sql",
}
ACCEPTED = {
    "zip": "application/zip application/x-zip-compressed",
    "config-yaml": "application/yaml text/yaml application/x-yaml",
    "source-javascript": "text/plain text/javascript application/javascript application/ecmascript text/ecmascript",
    "source-typescript": "text/plain text/typescript application/typescript",
    "shell": "text/plain application/x-sh",
    "config-xml": "application/xml text/xml",
    "plist": "application/xml application/x-plist",
    "html": "text/html application/xhtml+xml text/plain",
    "svg": "image/svg+xml text/plain application/xml text/xml",
}
#: Signatures (offset, bytes, extension, MIME type) from public format descriptions.
SIGNATURES = [
    (0, b"\x89PNG\r\n\x1a\n", "png", "image/png"), (0, b"\x7fELF", "elf", "application/x-elf"), (0, b"%PDF", "pdf", "application/pdf"),
    (0, b"PK\x03\x04", "zip", "application/zip"), (0, b"PK\x05\x06", "zip", "application/zip"), (0, b"7z\xbc\xaf\x27\x1c", "7z", "application/x-7z-compressed"),
    (0, b"Rar!\x1a\x07", "rar", "application/x-rar-compressed"), (0, b"\xff\xd8\xff", "jpeg", "image/jpeg"), (0, b"GIF8", "gif", "image/gif"),
    (8, b"WEBP", "webp", "image/webp"), (0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "cfb", "application/x-cfb"), (0, b"{\\rtf", "rtf", "application/rtf"),
    (0, b"MZ", "exe", "application/x-msdownload"), (0, b"\x1f\x8b", "gz", "application/gzip"), (0, b"BZh", "bz2", "application/x-bzip2"),
    (0, b"\xfd7zXZ\x00", "xz", "application/x-xz"), (0, b"\x28\xb5\x2f\xfd", "zst", "application/zstd"), (0, b"OggS", "ogg", "audio/ogg"),
    (0, b"ID3", "mp3", "audio/mpeg"), (0, b"fLaC", "flac", "audio/x-flac"), (4, b"ftyp", "mp4", "video/mp4"), (0, b"BM", "bmp", "image/bmp"),
    (0, b"II*\x00", "tif", "image/tiff"), (0, b"MM\x00*", "tif", "image/tiff"), (257, b"ustar", "tar", "application/x-tar"), (0, b"wOFF", "woff", "font/woff"),
    (0, b"\x00asm", "wasm", "application/wasm"), (0, b"SQLite format 3\x00", "sqlite", "application/x-sqlite3"), (0, b"PAR1", "parquet", "application/vnd.apache.parquet"),
]
OPEN_XML = {"word/document.xml": ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), "xl/workbook.xml": ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"), "ppt/presentation.xml": ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation")}
PACKAGES = {"application/epub+zip": "epub", "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp"}

DETECTED = "family string, kind string, mime string, encoding string, confidence string, readable boolean"


def _map(table: dict[str, str], without=()) -> Column:
    pairs = [(f".{x}", kind) for kind, names in table.items() for x in names.split() if x not in without]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


@arrow_function("boolean")
def is_json(text: pd.Series) -> pd.Series:
    """Strictly one JSON value; null for null."""

    def strict(x):
        if x is None:
            return None
        try:
            json.loads(x, parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))
        except (ValueError, RecursionError):
            return False
        return True

    return text.map(strict)


def text_kind(name: Column, text: Column) -> Column:
    """The kind of a text file from its head and its name; the first rule that fits decides."""
    no_comments = F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"^(?://[^\n]*\n|/\*[\s\S]*?\*/\s*)+", "")
    # Only what begins and ends as JSON does is parsed.
    json_like = F.when(no_comments.rlike(r"^[\[{]") & no_comments.rlike(r"[}\]]\s*$"), no_comments)
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x != "")
    both = lambda mark: (F.size(lines) >= 2) & F.contains(F.get(lines, F.lit(0)), F.lit(mark)) & F.contains(F.get(lines, F.lit(1)), F.lit(mark))
    end, section = r"(?![A-Za-z0-9_])", r"(?md)^\s*\[[^\]\n]+\]\s*\n[\s\S]*?^\s*[A-Za-z0-9_.\-]+"
    # The patterns of text kinds, in their order.
    rules = [
        ("shell", text.rlike(rf"^\s*#!\s*(?:/usr/bin/env\s+)?(?:/(?:usr/)?bin/)?(?:bash|zsh|sh|dash|fish){end}")),
        ("dockerfile", text.rlike(r"(?mdi)^FROM\s+\S")),
        ("html", text.rlike(rf"(?i)^\s*<(?:!doctype\s+html|html){end}")),
        ("svg", text.rlike(rf"(?i)^\s*<svg{end}")),
        ("xml", text.rlike(rf"(?i)^\s*<(?:\?xml{end}|[A-Za-z0-9_]+[\s>])")),
        ("config-json", F.coalesce(is_json(json_like), F.lit(False))),
        ("sql", text.rlike(rf"(?i)^\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP){end}")),
        ("markdown", text.rlike(r"(?md)^#{1,6}\s+\S|^```")),
        ("config-yaml", text.rlike(r"(?md)^\s*[A-Za-z0-9_.\-]+:\s+\S")),
        ("config-toml", text.rlike(section + r"\s+=\s+\S")),
        ("config-ini", text.rlike(section + r"\s*=\s*\S")),
        ("tsv", both("\t")),
        ("csv", both(",")),
    ]
    own = extension(name)
    lower = F.lower(name)
    named = F.when(lower == "dockerfile", "dockerfile").when((lower == ".env") | F.startswith(lower, F.lit(".env.")), "env")
    kind = F.coalesce(named, F.try_element_at(_map(TEXT_EXTENSIONS), own), F.when(own == ".config", "config-text").otherwise("text"))
    for label, fits in reversed(rules):
        value = F.when(text.rlike(rf"(?i)<plist{end}"), "plist").otherwise("config-xml") if label == "xml" else F.lit(label)
        kind = F.when(fits, value).otherwise(kind)
    return kind


def text_mime(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MIMES.items() for x in pair]), kind), F.lit("text/plain"))


def head_text(text: Column, n: int = LIMITS.head_bytes) -> Column:
    """The first bytes of a text, without a character that the cut splits."""
    return F.when(F.octet_length(text) > n, utf8_prefix(text.cast("binary"), n)).otherwise(text)


def mismatch(name: Column, declared_mime: Column, kind: Column, mime: Column) -> Column:
    """Whether the extension promises another kind, or the declared type is not one of the kind's."""
    declared = F.substring_index(F.lower(F.trim(declared_mime)), ";", 1)
    promised = F.try_element_at(_map(TEXT_EXTENSIONS | OTHER_EXTENSIONS | {k: f"{TEXT_EXTENSIONS.get(k, '')} {v}" for k, v in OTHER_EXTENSIONS.items()}, NOT_PROMISED), extension(name))
    accepted = F.create_map(*[x for kind_, names in ACCEPTED.items() for x in (F.lit(kind_), F.array(*map(F.lit, names.split())))])
    fits = F.array_contains(F.coalesce(F.try_element_at(accepted, kind), F.array(F.lower(mime))), declared)
    return F.coalesce(promised != kind, F.lit(False)) | (~F.coalesce(declared, F.lit("")).isin("", "application/octet-stream") & ~fits)


# Bytes.


def signature(head: bytes) -> tuple[str, str] | None:
    return next(((ext, mime) for at, mark, ext, mime in SIGNATURES if head[at : at + len(mark)] == mark), None)


def zip_entries(data: bytes) -> list[zipfile.ZipInfo] | None:
    """The entries of a zip's directory, or None where it is damaged, split, of the 64-bit format, too long or has too many."""
    if zips.directory(zips.of_bytes(data), len(data)) is None:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return archive.infolist()
    except (zipfile.BadZipFile, NotImplementedError, ValueError, struct.error, OverflowError, UnicodeDecodeError):
        return None


def entry_name(info: zipfile.ZipInfo) -> str:
    """The name of an entry; without the UTF-8 flag, GB18030 if that fits, else code page 437."""
    if info.flag_bits & 0x800:
        return info.filename
    raw = info.orig_filename.encode("cp437")
    try:
        return raw.decode("gb18030")
    except UnicodeDecodeError:
        return info.filename


def _container(read: zips.ReadAt, size: int) -> tuple | None:
    entries = zips.directory(read, size)
    if entries is None:
        return None
    names = {x.name: x for x in reversed(entries)}
    if "[Content_Types].xml" in names:
        for part, (kind, mime) in OPEN_XML.items():
            if part in names:
                return "document", kind, mime, None, "high", True
    own = names.get("mimetype")
    if own is None or max(own.compressed, own.size) > LIMITS.mimetype_bytes:
        return None
    content, code = zips.payload(read, size, own.offset, own.method, own.flags, own.crc, own.compressed, LIMITS.mimetype_bytes)
    mime = content.decode("utf-8", "replace") if code is None else None
    return ("document", PACKAGES[mime], mime, None, "high", True) if mime in PACKAGES else None


def compound_names(read: zips.ReadAt) -> list[str]:
    """Stream names of a compound file, from its directory sectors; empty where it is damaged.  Only the table's and directory's sectors are read."""
    try:
        head = read(0, 512)
        shift, start = struct.unpack_from("<H", head, 30)[0], struct.unpack_from("<I", head, 48)[0]
        if not 7 <= shift <= 16:
            return []
        size, names, seen, tables = 1 << shift, [], set(), struct.unpack_from("<109I", head, 76)
        parts = {}

        def following(sector: int) -> int:
            table = tables[sector * 4 // size]
            if table not in parts:
                parts[table] = struct.unpack(f"<{size // 4}I", read((table + 1) * size, size))
            return parts[table][sector % (size // 4)]

        while start < 0xFFFFFFFA and start not in seen:
            seen.add(start)
            sector = read((start + 1) * size, size)
            for at in range(0, size, 128):
                length = struct.unpack_from("<H", sector, at + 64)[0]
                if 2 <= length <= 64:
                    names.append(sector[at : at + length - 2].decode("utf-16-le", "replace"))
            start = following(start)
    except (struct.error, IndexError):
        return []
    return names


def _compound(read: zips.ReadAt) -> tuple | None:
    names = [x.lower() for x in compound_names(read)]
    if any("worddocument" in x for x in names):
        return "document", "doc", "application/msword", None, "high", True
    if any("workbook" in x or x == "book" for x in names):
        return "document", "xls", "application/vnd.ms-excel", None, "high", True
    if any("powerpoint document" in x for x in names):
        return "binary", "ppt", "application/vnd.ms-powerpoint", None, "high", False
    return None


_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_CJK = re.compile(r"[一-鿿]")
_GB = re.compile(rb"(?P<four>[\x81-\xfe][0-9][\x81-\xfe][0-9])|(?P<two>[\x81-\xfe][\x40-\x7e\x80-\xfe])|(?P<lone>[\x81-\xfe])|(?P<ascii>[\x00-\x7f])")


def _readable(text: str) -> bool:
    return bool(text) and len(_CONTROLS.findall(text)) <= 0.01 * len(text)


def decode_text(head: bytes, cut: bool = False) -> tuple[str, str] | None:
    """The text and encoding of a head, or None where it is not text.  ``cut``: the head may end inside a character."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if head.startswith(mark):
            text = head[len(mark) :].decode(encoding, "replace")
            return (text, encoding) if text.count("�") <= 0.01 * len(text) and _readable(text) else None
    text = head.decode("utf-8", "replace")
    if text.count("�") <= 0.01 * len(text) and _readable(text):
        return text, "utf-8"
    found = {"four": 0, "two": 0, "lone": 0, "ascii": 0}
    for match in _GB.finditer(head):
        found[match.lastgroup] += 1
    pairs = found["four"] + found["two"]
    if pairs < 2 or pairs < 0.9 * (pairs + found["lone"]) or not found["ascii"]:
        return None
    for end in (len(head), len(head) - 1, len(head) - 2, len(head) - 3)[: 4 if cut else 1]:
        try:
            text = head[:end].decode("gb18030")
        except UnicodeDecodeError:
            continue
        return (text, "gb18030") if len(_CJK.findall(text)) >= 0.05 * len(text) and _readable(text) else None
    return None


def look(read: zips.ReadAt, size: int) -> tuple[tuple | None, str | None, str | None]:
    """(detected, text, encoding): of a file that is no text, or the text to classify.

    Reads the head, and of packages and compound files their directories and the entry that names the type.
    """
    head = read(0, LIMITS.head_bytes)
    marked = head[:3] == b"\xef\xbb\xbf" or head[:2] in (b"\xff\xfe", b"\xfe\xff")
    found = None if marked else signature(head)
    if found:
        ext, mime = found
        special = _container(read, size) if ext == "zip" else _compound(read) if ext == "cfb" else None
        if special:
            return special, None, None
        if ext in ("pdf", "rtf"):
            return ("document", ext, mime, None, "high", True), None, None
        if ext in ("zip", "7z", "rar"):
            return ("archive", ext, mime, None, "high", False), None, None
        if ext in ("png", "jpeg", "gif", "webp"):
            return ("image", ext, mime, None, "high", False), None, None
        return ("binary", "executable" if ext in ("elf", "exe") else ext, mime, None, "high", False), None, None
    if not head:
        return ("unknown", "unknown", "application/octet-stream", None, "low", False), None, None
    decoded = decode_text(head, size > len(head))
    if decoded is None:
        return ("binary", "unknown-binary", "application/octet-stream", None, "low", False), None, None
    return None, *decoded


def detect(files: DataFrame, name_col: str = "name", mime_col: str = "declared_mime", content_col: str = "content") -> DataFrame:
    """``files`` with ``safe_name`` and ``detected``: family, kind, mime, encoding, confidence, readable, mismatch, risks."""

    @arrow_function(LOOKED)
    def looked(content: pd.Series) -> pd.DataFrame:
        rows = [bytes(x) if x is not None else b"" for x in content]
        return looked_frame([look(zips.of_bytes(x), len(x)) for x in rows])

    return classified(files.withColumn("_looked", looked(F.col(content_col))), name_col, mime_col)


LOOKED = f"found struct<{DETECTED.replace(' ', ':').replace(',:', ',')}>, text string, encoding string"


def looked_frame(rows: list[tuple]) -> pd.DataFrame:
    names = ("family", "kind", "mime", "encoding", "confidence", "readable")
    return pd.DataFrame({"found": [dict(zip(names, r[0], strict=True)) if r[0] else None for r in rows], "text": [r[1] for r in rows], "encoding": [r[2] for r in rows]})


def classified(files: DataFrame, name_col: str = "name", mime_col: str = "declared_mime") -> DataFrame:
    """``files`` with what ``look`` has found (``_looked``) put together with names and declared types."""
    named = files.withColumn("safe_name", sanitize_filename(F.coalesce(name_col, F.lit(""))))
    kind = text_kind(F.col("safe_name"), F.col("_looked.text"))
    named = named.withColumn("_kind", F.when(F.col("_looked.text").isNotNull(), kind))
    of_text = F.struct(F.lit("text").alias("family"), F.col("_kind").alias("kind"), text_mime(F.col("_kind")).alias("mime"), F.col("_looked.encoding").alias("encoding"), F.lit("medium").alias("confidence"), F.lit(True).alias("readable"))
    named = named.withColumn("_found", F.when(F.col("_looked.found").isNotNull(), F.col("_looked.found")).otherwise(of_text))
    wrong = mismatch(F.col("safe_name"), F.col(mime_col), F.col("_found.kind"), F.col("_found.mime"))
    detected = F.struct("_found.*", wrong.alias("mismatch"), F.when(wrong, F.array(F.lit("type-mismatch"))).otherwise(F.array().cast("array<string>")).alias("risks"))
    # Exploded, so that detection is made once for all that asks for it.
    kept = [c for c in named.columns if c not in ("_looked", "_kind", "_found", "detected")]
    return named.select(*kept, F.explode(F.array(detected)).alias("detected"))

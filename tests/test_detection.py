import io
import zipfile

import pytest

from quarrystone.functions.detection import detect, entry_name, zip_entries


def package(parts, stored=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


OOXML = "[Content_Types].xml"
CASES = [
    ("app.config", "", b'<?xml version="1.0"?><configuration/>', "text", "config-xml", True),
    ("app.config", "", b'{"feature":true}', "text", "config-json", None),
    ("app.config", "", b"[server]\nport=8080", "text", "config-ini", None),
    ("app.config", "", b"feature on\nworkers 4", "text", "config-text", False),
    ("Dockerfile", "", b"FROM node:22\nRUN npm ci", "text", "dockerfile", False),
    ("no-extension", "", b"#!/bin/zsh\necho ok", "text", "shell", False),
    ("report.txt", "text/plain", bytes([0x7F, 0x45, 0x4C, 0x46, 2, 1, 1, 0]), "binary", "executable", True),
    ("note.txt", "", "hello ✓".encode(), "text", "text", False),
    ("note.txt", "", b"\xff\xfe" + "hello".encode("utf-16-le"), "text", "text", False),
    ("note.txt", "", b"\xfe\xff" + "hello".encode("utf-16-be"), "text", "text", False),
    ("payload.txt", "", b"\xc3\x28", "binary", "unknown-binary", True),
    ("payload.txt", "", b"\x80\x81\x82", "binary", "unknown-binary", True),
    ("payload.txt", "", b"\x7f" * 5, "binary", "unknown-binary", True),
    ("file", "", b"", "unknown", "unknown", False),
    ("file", "", b"unstructured prose", "text", "text", False),
    ("a.7z", "", b"7z\xbc\xaf\x27\x1c\x00", "archive", "7z", False),
    ("a.rar", "", b"Rar!\x1a\x07\x00", "archive", "rar", False),
    ("report.docx", "", package({OOXML: "", "word/document.xml": ""}), "document", "docx", False),
    ("upload.bin", "", package({OOXML: "", "xl/workbook.xml": ""}), "document", "xlsx", False),
    ("slides.pptx", "", package({OOXML: "", "ppt/presentation.xml": ""}), "document", "pptx", False),
    ("book.epub", "", package({"mimetype": "application/epub+zip"}, True), "document", "epub", False),
    ("bomb.zip", "", package({"mimetype": "a" * 3_000_000}), "archive", "zip", False),
    ("settings.jsonc", "", b"// c\n{}", "text", "config-json", False),
    ("settings.toml", "", b"[a]\nb = 1", "text", "config-toml", False),
    ("Info.plist", "", b"<?xml version='1.0'?><plist/>", "text", "plist", False),
    ("users.csv", "", b"a,b\n1,2", "text", "csv", False),
    ("users.tsv", "", b"a\tb\n1\t2", "text", "tsv", False),
    ("query.sql", "", b"SELECT 1", "text", "sql", False),
    ("README.md", "", b"# Title", "text", "markdown", False),
    ("index.ts", "text/typescript", b"let a = 1", "text", "source-typescript", False),
    (".env", "", b"A=1", "text", "env", False),
    ("notes.txt", "application/pdf", b"hello", "text", "text", True),
    ("page.htm", "", b"plain", "text", "html", False),
    ("note.txt", "", b"<!doctype html><p>", "text", "html", True),
    ("archive.zip", "application/x-zip-compressed", package({"a": "b"}), "archive", "zip", False),
    ("note.txt", "", bytes.fromhex("D6D0CEC4B2E2CAD40AB5DAB6FED0D00A"), "text", "text", False),
    ("price.txt", "", bytes.fromhex("BCDBB8F1A3BA8130843638380A"), "text", "text", False),
    ("payload.txt", "", bytes(0x81 + 13 * i % 0x7E for i in range(256)), "binary", "unknown-binary", True),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(k, n, m, bytearray(c)) for k, (n, m, c, *_) in enumerate(CASES)], "k int, name string, declared_mime string, content binary")
    return {r.k: r.detected for r in detect(files).select("k", "detected").collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_detect(found, k):
    *_, family, kind, mismatch = CASES[k]
    got = found[k]
    assert (got.family, got.kind) == (family, kind)
    assert mismatch is None or got.mismatch == mismatch
    assert got.risks == (["type-mismatch"] if got.mismatch else [])
    assert got.readable == (family in ("text", "document"))


def test_encodings(found):
    by = {CASES[k][2][:4]: found[k].encoding for k in found}
    assert by["hell".encode()] == "utf-8"
    assert by[b"\xff\xfeh\x00"] == "utf-16le"
    assert by[b"\xfe\xff\x00h"] == "utf-16be"
    assert by[bytes.fromhex("D6D0CEC4")] == "gb18030"


def test_entry_name_without_flag():
    data = package({"xxxx.txt": "a"}, True).replace(b"xxxx.txt", bytes.fromhex("D6D0CEC4") + b".txt")
    assert entry_name(zip_entries(data)[0]) == "中文.txt"

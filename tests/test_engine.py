import io
import tarfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone.api import Attachments
from quarrystone.limits import Limits
from quarrystone.operators import archives, paging, sessions, store
from quarrystone.plans import lifecycle
from quarrystone.sources import files, readers
from tests.test_detection import package

W, A = 'xmlns:w="w"', 'xmlns:a="a"'
DOCX = {"[Content_Types].xml": "", "word/document.xml": f"<w:document {W}><w:p><w:t>one</w:t></w:p><w:p><w:t>two &amp; x</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>A</w:t></w:p></w:tc><w:tc><w:p><w:t>B</w:t></w:p></w:tc></w:tr></w:tbl></w:document>"}
XLSX = {
    "[Content_Types].xml": "",
    "xl/workbook.xml": '<workbook><sheets><sheet name="Sheet1" sheetId="1"/></sheets></workbook>',
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>score</t></si><si><t>Ada</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"/><c r="C3"><v>10</v></c></row></sheetData></worksheet>',
}
PPTX = {"[Content_Types].xml": "", "ppt/presentation.xml": "", "ppt/slides/slide10.xml": "<a:t>ten</a:t>", "ppt/slides/slide2.xml": "<a:t>two</a:t>", "ppt/notesSlides/notesSlide2.xml": "<a:t>note</a:t>"}
EPUB = {
    "mimetype": "application/epub+zip",
    "META-INF/container.xml": '<container><rootfile full-path="OEBPS/c.opf"/></container>',
    "OEBPS/c.opf": '<package><manifest><item href="b.xhtml" id="b"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>',
    "OEBPS/a.xhtml": "<p>first</p>",
    "OEBPS/b.xhtml": "<p>second</p>",
}
ODT = {"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": "<o><text:h x='1'>head</text:h><text:p a='1'>one</text:p></o>"}
ODS = {"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": '<o><table:table-row a="1"><table:table-cell a="1"><text:p>x  y</text:p></table:table-cell><table:table-cell a="1"><text:p>2</text:p></table:table-cell></table:table-row></o>'}
RTF = rb"{\rtf1{\fonttbl{\f0 Arial;}}\uc1 \u20013?\u25991? \b bold\b0\par next \'e9}"


def pdf():
    body = b"BT /F1 12 Tf 72 700 Td (page) Tj 40 0 Td (one) Tj ET"
    second = zlib.compress(b"BT /F1 12 Tf 72 700 Td [(pa)-20(ge two)] TJ 0 -14 Td (line \\(b\\)) Tj ET")
    parts = [b"1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj", b"2 0 obj<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2>>endobj", b"3 0 obj<</Type/Page/Parent 2 0 R/Contents 5 0 R>>endobj", b"4 0 obj<</Type/Page/Parent 2 0 R/Contents 6 0 R>>endobj"]
    parts += [b"5 0 obj<</Length %d>>stream\n%s\nendstream endobj" % (len(body), body), b"6 0 obj<</Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj" % (len(second), second)]
    return b"%PDF-1.4\n" + b"\n".join(parts) + b"\n%%EOF"


def upload(session, batch, seq, name, content, mime=""):
    return (session, batch, seq, name, mime, bytearray(content), 1_700_000_000_000 + seq)


SCHEMA = "session_id string, batch_id string, seq long, name string, declared_mime string, content binary, created_at long"


@pytest.fixture(scope="module")
def engine(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as archive:
        for name, text in (("a.txt", b"token=abc"), ("dir/b.config", b"x"), ("../secret", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            archive.addfile(info, io.BytesIO(text))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "a.txt"
        archive.addfile(link)
    rows = [
        upload("s1", "b1", 1, "report.docx", package(DOCX)),
        upload("s1", "b1", 2, "budget.xlsx", package(XLSX)),
        upload("s1", "b1", 3, "slides.pptx", package(PPTX)),
        upload("s1", "b1", 4, "book.epub", package(EPUB)),
        upload("s1", "b1", 5, "doc.odt", package(ODT)),
        upload("s1", "b1", 6, "cells.ods", package(ODS)),
        upload("s1", "b1", 7, "note.rtf", RTF),
        upload("s1", "b1", 8, "paper.pdf", pdf()),
        upload("s1", "b1", 9, "conf.txt", b"user=a\npassword=b\nport=1"),
        upload("s1", "b1", 10, "tools.zip", package({"a.txt": "token=abc", "dir/b.config": "x=1", "dir/c.txt": "y"})),
        upload("s1", "b1", 11, "late.txt", b"over the quota"),
        upload("s2", "b1", 1, "copy.txt", b"user=a\npassword=b\nport=1"),
        upload("s2", "b2", 2, "locked.pdf", b"%PDF-1.4 /Encrypt"),
        upload("s2", "b2", 3, "all.tgz", tar.getvalue()),
    ]
    blobs, refs, rejected = lifecycle.ingest(spark.createDataFrame(rows, SCHEMA))
    return Attachments(refs.cache(), blobs.cache()), rejected.cache()


def test_ingest(engine):
    made, rejected = engine
    assert made.refs.count() == 13
    assert made.blobs.count() == 12  # two uploads have the same bytes
    assert [(r.name, r.error_code) for r in rejected.collect()] == [("late.txt", "MESSAGE_FILES_TOO_LARGE")]
    kinds = {r.safe_name: r.detected.kind for r in made.refs.collect()}
    assert kinds["report.docx"] == "docx" and kinds["cells.ods"] == "ods" and kinds["paper.pdf"] == "pdf" and kinds["tools.zip"] == "zip"
    assert store.valid_refs(made.refs).count() == 13


def test_governed_read(engine):
    made, _ = engine
    requests = made.refs.select(F.col("owner_session_id").alias("session_id"), "id", F.lit(1).alias("page"))
    names = {r.id: r.safe_name for r in made.refs.collect()}
    found = {names[r.id]: r for r in lifecycle.governed_read(requests, made.refs, made.blobs).collect()}
    text = {k: r.text for k, r in found.items()}
    assert text["report.docx"] == "one\ntwo & x\nA | B"
    assert text["budget.xlsx"] == "name\tscore\nAda\t10"
    assert text["slides.pptx"] == "two\nnote\nten"
    assert text["book.epub"] == "second\nfirst"
    assert text["doc.odt"] == "head\none"
    assert text["cells.ods"] == "x y\t2"
    assert text["note.rtf"] == "中文 bold\nnext é"
    assert text["paper.pdf"] == "page one\npage two\nline (b)"
    assert text["conf.txt"] == "user=a\npassword=[REDACTED]\nport=1" and found["conf.txt"].redacted == 1
    assert found["locked.pdf"].error_code == "ENCRYPTED_FILE"
    assert found["tools.zip"].error_code == "UNSUPPORTED_FILE_TYPE"


def test_windows(engine):
    made, _ = engine
    key = {r.safe_name: r.id for r in made.refs.collect()}
    one = lambda name, **window: made.read("s1", key[name], **window).collect()[0]
    row = one("slides.pptx", page=1)
    assert (row.text, row.has_more, row.next) == ("two\nnote", True, 2)
    assert one("slides.pptx", page=9).text == "ten"
    row = one("paper.pdf", page=0, page_end=99)
    assert row.text == "page one\npage two\nline (b)" and not row.has_more
    row = one("report.docx", paragraph_offset=1, paragraph_limit=1)
    assert (row.text, row.has_more, row.next) == ("two & x", True, 2)
    row = one("conf.txt", offset=7)
    assert (row.text, row.has_more, row.redacted) == ("password=[REDACTED]\nport=1", False, 1)
    assert made.read("s2", key["locked.pdf"]).collect()[0].error_code == "ENCRYPTED_FILE"
    assert made.read("s2", key["conf.txt"]).collect()[0].error_code == "ATTACHMENT_FORBIDDEN"


def test_dead_sessions_read_nothing(engine, spark):
    made, _ = engine
    key = {r.safe_name: r.id for r in made.refs.collect()}
    dead = type(made)(made.refs, made.blobs, spark.createDataFrame([("s2",)], "session_id string"))
    assert dead.info("s1").count() == 0 and dead.info("s2").count() == 3
    assert dead.list_archive("s1", key["tools.zip"]).count() == 0
    assert dead.read("s1", key["conf.txt"]).collect()[0].error_code == "ATTACHMENT_FORBIDDEN"
    assert dead.read_archive_entry("s1", key["tools.zip"], "a.txt").count() == 0


def test_byte_windows_are_the_text(spark):
    from quarrystone.operators import paging

    text = "é" * 7 + "\nab\n" + "x" * 30 + "\n日本語\nend"
    rows = spark.createDataFrame([(text,)], "t string")
    at, parts = 0, []
    while at is not None:
        row = rows.select(paging.byte_window(F.col("t"), F.lit(at), most_lines=2, most_bytes=11).alias("w")).first().w
        parts.append(row.text)
        assert len(row.text.encode()) <= 11 and row.has_more == (row.next_offset is not None)
        at = row.next_offset
    assert "".join(parts) == text
    inside = rows.select(paging.byte_window(F.col("t"), F.lit(1), most_bytes=6).alias("w")).first().w
    assert inside.text == "éé" and inside.next_offset == 6


def test_whole_texts_are_decoded():
    from quarrystone.sources.readers import whole_text

    chinese = "中文文件" * 3
    assert whole_text(chinese.encode("gb18030")) == (chinese, "gb18030")
    assert whole_text(b"\xff\xfe" + "aé".encode("utf-16-le")) == ("aé", "utf-16le")
    assert whole_text(b"ok \xff\xff bad") == ("ok \ufffd\ufffd bad", "utf-8")
    assert whole_text(b"") == ("", "utf-8")


def test_forbidden(engine):
    made, _ = engine
    other = made.refs.filter("safe_name = 'conf.txt'").select(F.lit("s2").alias("session_id"), "id", F.lit(1).alias("page"))
    row = lifecycle.governed_read(other, made.refs, made.blobs).collect()[0]
    assert (row.error_code, row.text) == ("ATTACHMENT_FORBIDDEN", None)


def test_api(engine):
    made, _ = engine
    assert made.info("s2").count() == 3
    key = made.info("s1", file_name="budget.xlsx").collect()[0].id
    assert [r.text for r in made.read_cells("s1", key, "Sheet1", "A1:B2").collect()] == ["name\tscore"]
    assert made.read_cells("s2", key).count() == 0
    zipped = made.info("s1", file_name="tools.zip").collect()[0].id
    page = made.list_archive("s1", zipped, cursor=1, limit=1).collect()
    assert [(r.path, r.next_cursor) for r in page] == [("dir/b.config", 2)]
    entry = made.read_archive_entry("s1", zipped, "a.txt").collect()[0]
    assert (entry.text, entry.redacted, entry.error_code) == ("token=[REDACTED]", 1, None)
    assert made.read_archive_entry("s1", zipped, "../a.txt").collect()[0].error_code == "ARCHIVE_PATH_REJECTED"
    assert made.read("s1", zipped).collect()[0].error_code == "UNSUPPORTED_FILE_TYPE"


def test_tar(engine, spark):
    made, _ = engine
    held = made.refs.filter("safe_name = 'all.tgz'").join(made.blobs, "sha256").select("id", "content")
    found = archives.entries(held)
    assert [r.path for r in archives.listing(found, ["id"]).orderBy("entry_no").collect()] == ["a.txt", "dir/b.config", "link"]
    asked = held.select("id", F.explode(F.array(F.lit("a.txt"), F.lit("link"), F.lit("none"))).alias("archive_path"))
    got = {r.archive_path: (r.entry, r.error_code) for r in archives.extract(asked, held).collect()}
    assert got == {"a.txt": (bytearray(b"token=abc"), None), "link": (None, "ARCHIVE_PATH_REJECTED"), "none": (None, "ARCHIVE_PATH_REJECTED")}
    broken = archives.entries(spark.createDataFrame([("x", bytearray(b"no archive")), ("y", None)], "id string, content binary"))
    assert {r.error_code for r in broken.collect()} == {"CORRUPT_FILE"}


def test_broken_documents(spark):
    rows = spark.createDataFrame([("a", bytearray(b"PK\x03\x04 broken")), ("b", None), ("c", bytearray(package({"x": "y"})))], "id string, content binary")
    for reader in (readers.docx, readers.open_document):
        assert {r.error_code for r in reader(rows).collect()} == {"CORRUPT_FILE"}
    assert {r.error_code for r in readers.xlsx(rows).filter("id <> 'c'").collect()} == {"CORRUPT_FILE"}
    assert readers.package_parts(package({"a": "x" * 1000}), "a", budget=100) == (None, "FILE_TOO_LARGE")
    assert readers.package_parts(package({"../a": "x"}), "a") == (None, "ARCHIVE_PATH_REJECTED")


@pytest.mark.parametrize(("text", "want"), [("A", (1, 1, paging.MOST, 1)), ("A1:B5", (1, 1, 5, 2)), ("B2", (2, 2, 2, 2)), ("A:C", (1, 1, paging.MOST, 3)), ("B5:A1", None), ("", None), ("1A", None), (None, None)])
def test_cell_range(text, want):
    found = paging.cell_range(text)
    assert (found and (found.row_from, found.col_from, found.row_to, found.col_to)) == want


def test_quota_like_a_loop(spark):
    sizes = [30, 30, 10, 5, 60, 1]
    rows = spark.createDataFrame([("s", "b", k, n) for k, n in enumerate(sizes)] + [("s", "c", 0, 50)], "session_id string, batch_id string, seq long, bytes long")
    got = {(r.batch_id, r.seq): r.error_code is None for r in store.admit(rows, limits=Limits(batch_files=4, batch_bytes=50)).collect()}
    assert got == {("b", 0): True, ("b", 1): False, ("b", 2): True, ("b", 3): True, ("b", 4): False, ("b", 5): True, ("c", 0): True}


def test_refs(spark):
    rows = [("a", "A", "report.md", 1), ("b", "A", "report.md", 2), ("c", "B", "report.md", 1), ("d", "A", "report.md", 2)]
    refs = spark.createDataFrame(rows, "id string, owner_session_id string, safe_name string, created_at long")
    assert {r.id for r in store.latest_by_name(refs).collect()} == {"d", "c"}
    assert [r.id for r in store.session_listing(refs).filter("owner_session_id = 'A'").orderBy("position").collect()] == ["d", "b", "a"]
    gone = spark.createDataFrame([("A", "a"), ("B", "b")], "session_id string, id string")
    assert {r.id for r in store.remove_refs(refs, gone).collect()} == {"b", "c", "d"}
    living = spark.createDataFrame([("A",)], "session_id string")
    asked = spark.createDataFrame([("A", "a"), ("B", "c"), ("A", "c"), ("A", "zz")], "session_id string, id string")
    got = {(r.session_id, r.id): r.error_code for r in store.authorize(asked, refs, living).collect()}
    assert got == {("A", "a"): None, ("B", "c"): "ATTACHMENT_FORBIDDEN", ("A", "c"): "ATTACHMENT_FORBIDDEN", ("A", "zz"): "ATTACHMENT_FORBIDDEN"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["中", "a", "\n", "bc\r\n", "é", "x" * 9]), max_size=40).map("".join), st.integers(1, 4), st.integers(4, 12))
def test_byte_pages_join_to_the_text(text, lines, size):
    data = text.encode()
    pages = list(paging.cut_pages(data, lines, size))
    assert "".join(p for *_, p in pages) == text
    assert [a for a, *_ in pages[1:]] == [b for _, b, _ in pages[:-1]]
    assert all(b - a <= size and p.count("\n") <= lines for a, b, p in pages)


def test_announce(spark):
    refs = spark.createDataFrame([("s", "att_" + "1" * 32, "a", 1), ("s", "att_" + "2" * 32, "b", 2), ("t", "att_" + "3" * 32, "c", 1)], "owner_session_id string, id string, safe_name string, created_at long")
    refs = refs.withColumns({"family": F.lit("text"), "kind": F.lit("csv")})
    log = spark.createDataFrame(
        [("s", "user/message", ("plugin", "attachments"), [("text", "seen att_" + "1" * 32)]), ("t", "user/message", ("user", None), [("text", "att_" + "3" * 32)])],
        "session_id string, type string, source struct<kind:string,plugin:string>, content array<struct<type:string,text:string>>",
    )
    got = {r.session_id: (r.n_fresh, r.text) for r in sessions.announce(refs, sessions.announced(log)).collect()}
    assert got == {"s": (1, f"b (att_{'2' * 32}, text/csv)"), "t": (1, f"c (att_{'3' * 32}, text/csv)")}


def test_receipts(spark):
    events = spark.createDataFrame([("s", 1, False, "ask", None), ("s", 2, False, None, "a.txt"), ("s", 3, True, "", None), ("s", 4, False, "more", None), ("s", 5, True, "", None)], "session_id string, seq long, is_send boolean, draft string, file string")
    assert [(r.batch_no, r.draft, r.files) for r in sessions.receipts(events).collect()] == [(0, "ask", ["a.txt"])]


def test_announce_stream(spark, tmp_path):
    from quarrystone.streaming.announce import announce_stream

    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    schema = "owner_session_id string, id string, safe_name string, created_at long, family string, kind string"

    def arrive(rows, k):
        spark.createDataFrame([(s, i, n, at, "text", "csv") for s, i, n, at in rows], schema).coalesce(1).write.parquet(str(source / str(k)))
        stream = announce_stream(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source)))
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.session_id, tuple(r.ids)) for r in spark.read.parquet(str(out)).collect())

    first = arrive([("s", "1", "a", 1), ("s", "2", "b", 2), ("t", "3", "c", 1)], 0)
    assert first == [("s", ("2", "1")), ("t", ("3",))]
    assert arrive([("s", "1", "a", 1), ("s", "4", "d", 3)], 1) == sorted([*first, ("s", ("4",))])


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n1,2")
    (tmp_path / "big.bin").write_bytes(b"x" * 100)
    found = files.as_uploads(files.read_files(spark, str(tmp_path), most=50))
    assert [(r.name, bytes(r.content)) for r in found.collect()] == [("a.csv", b"a,b\n1,2")]
    assert files.stream_files(spark, str(tmp_path)).isStreaming

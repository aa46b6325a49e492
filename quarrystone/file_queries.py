"""Registered queries of the readers, archives, uploads, sessions and windows, over whole tables, and their SQL.

Files are written from the tables' columns by Spark and read back by the engine's readers; the SQL says what they hold.
"""

from __future__ import annotations

import re
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import detection, names
from quarrystone.limits import LIMITS
from quarrystone.operators import archive_scan, archives, line_index, paging, store, tables, uploads
from quarrystone.plans import lifecycle
from quarrystone.plans.texts import TextStore
from quarrystone.queries import MASKED_DOCUMENTS, _ATT, ORACLES, _as_attachments, _attachments, _known, _table, query
from quarrystone.sources import ranges, readers
from quarrystone.sources.packages import escaped, packed
from quarrystone.streaming.announce import announce_stream, batches_stream, stream_folder, whole_announcements

#: Rows of narrow tables, each made into a file, that one task takes.
TASK_ROWS = 5_000
#: Files of a folder that a query writes, about.
FOLDER_FILES = 4_000

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by a key to as many tasks as they can use: a narrow table may be one row group, but each row becomes a file."""
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), *by)  # a count reads no columns


def _wrapped(lines, before: str, after: str):
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit(before), escaped(x), F.lit(after))), "")


_LINES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '')"


@query(rf"""SELECT doc_id, md5(array_to_string(list_append({_LINES}, lang || ' | ' || source), chr(10))) AS text_md5, len({_LINES}) + 1 AS n FROM documents""")
def docx_text(spark, sf_dir):
    """Documents as word processor files: paragraphs, and a table of one row."""
    lines = F.split("text", "\n", -1)
    body = F.concat(F.lit("<w:document><w:body>"), _wrapped(lines, "<w:p ><w:r><w:t>", "</w:t></w:r></w:p>"), F.lit("<w:tbl ><w:tr><w:tc ><w:p><w:t>"), "lang", F.lit("</w:t></w:p></w:tc><w:tc ><w:p><w:t>"), "source", F.lit("</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"))
    files = _documents(spark, sf_dir).select("doc_id", packed({"[Content_Types].xml": F.lit("<Types/>"), "word/document.xml": body}).alias("content"))
    found = readers.docx(files, "doc_id")
    return found.select("doc_id", F.md5(F.array_join("paragraphs", "\n")).alias("text_md5"), F.size("paragraphs").cast("long").alias("n"))


@query(rf"""SELECT doc_id, md5(array_to_string({_LINES}, chr(10))) AS text_md5 FROM documents""")
def odt_text(spark, sf_dir):
    """Documents as open texts."""
    body = F.concat(F.lit("<office:text>"), _wrapped(F.split("text", "\n", -1), '<text:p text:style-name="x">', "</text:p>"), F.lit("</office:text>"))
    files = _documents(spark, sf_dir).select("doc_id", packed({"mimetype": F.lit("application/vnd.oasis.opendocument.text"), "content.xml": body}, stored=True).alias("content"))
    return readers.open_document(files, "doc_id").select("doc_id", F.md5(F.array_join("paragraphs", "\n")).alias("text_md5"))


@query(r"""SELECT c_custkey, c_name || chr(9) || c_mktsegment || chr(10) || c_nationkey AS text FROM customer""")
def ods_rows(spark, sf_dir):
    """Customers as open sheets of two rows; blank runs in a cell are one blank."""
    cell = lambda c: F.concat(F.lit('<table:table-cell office:value-type="string"><text:p>'), escaped(c), F.lit("</text:p></table:table-cell>"))
    row = lambda *cs: F.concat(F.lit('<table:table-row table:style-name="r">'), *map(cell, cs), F.lit("</table:table-row>"))
    body = F.concat(F.lit("<x>"), row(F.col("c_name"), F.col("c_mktsegment")), row(F.col("c_nationkey").cast("string")), F.lit("</x>"))
    files = _dealt(_table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", packed({"content.xml": body}).alias("content"))
    return readers.open_document(files, "c_custkey", spreadsheet=True).select("c_custkey", F.array_join("paragraphs", "\n").alias("text"))


@query(rf"""WITH s AS (SELECT doc_id, 1 AS page_no, {_TRIM.format('coalesce(text, chr(39) || chr(39))').replace("coalesce(text, chr(39) || chr(39))", "coalesce(text, '')")} || chr(10) || source AS t FROM documents UNION ALL SELECT doc_id, 2, lang FROM documents)
SELECT doc_id, page_no::BIGINT AS page_no, md5(t) AS text_md5, 2::BIGINT AS n_pages FROM s""")
def pptx_slides(spark, sf_dir):
    """Documents as two slides, the first with notes."""
    run = lambda c: F.concat(F.lit("<p:sp><a:t>"), escaped(c), F.lit("</a:t></p:sp>"))
    parts = {"ppt/presentation.xml": F.lit("<p/>"), "ppt/slides/slide10.xml": run(F.col("lang")), "ppt/slides/slide2.xml": run(F.col("text")), "ppt/notesSlides/notesSlide2.xml": run(F.col("source"))}
    files = _documents(spark, sf_dir).select("doc_id", packed(parts).alias("content"))
    return readers.pptx(files, "doc_id").select("doc_id", "page_no", F.md5("text").alias("text_md5"), F.col("n_pages").cast("long").alias("n_pages"))


@query("""WITH c AS (SELECT c_custkey, unnest([{'r': 1, 'c': 1, 'v': c_name}, {'r': 1, 'c': 28, 'v': c_nationkey::VARCHAR}, {'r': 3, 'c': 2, 'v': c_mktsegment}, {'r': 3, 'c': 3, 'v': '9'}]) AS x FROM customer)
SELECT c_custkey, 'Data' AS sheet, x.r::BIGINT AS row_no, x.c::BIGINT AS col_no, x.v AS value FROM c""")
def xlsx_cells(spark, sf_dir):
    """Customers as sheets: shared, inline and plain values, an index out of range, gaps between rows and cells."""
    sheet = F.concat(
        F.lit('<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>'), F.col("c_nationkey").cast("string"),
        F.lit('</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>'), escaped(F.col("c_mktsegment")), F.lit('</t></is></c><c t="s"><v>9</v></c></row></sheetData></worksheet>'),
    )
    parts = {"xl/workbook.xml": F.lit('<workbook><sheets><sheet name="Data" sheetId="1"/></sheets></workbook>'), "xl/sharedStrings.xml": F.concat(F.lit("<sst><si ><t>"), escaped(F.col("c_name")), F.lit("</t></si></sst>")), "xl/worksheets/sheet1.xml": sheet}
    files = _dealt(_table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", packed(parts).alias("content"))
    return readers.xlsx(files, "c_custkey").select("c_custkey", "sheet", "row_no", "col_no", "value")


@query(rf"""WITH s AS (SELECT doc_id, 1 AS chapter_no, 'OEBPS/b c.xhtml' AS path, source AS t FROM documents UNION ALL SELECT doc_id, 2, 'OEBPS/a.xhtml', {_TRIM.format("coalesce(text, '')")} FROM documents)
SELECT doc_id, chapter_no::BIGINT AS chapter_no, path, md5(t) AS text_md5 FROM s""")
def epub_chapters(spark, sf_dir):
    """Documents as books of two chapters; the spine names them the other way round, and a third that is not there."""
    opf = '<package><manifest><item id="i1" href="a.xhtml"/><item id="i2" href="b%20c.xhtml"/></manifest><spine><itemref idref="i2"/><itemref idref="i9"/><itemref idref="i1"/></spine></package>'
    html = lambda c: F.concat(F.lit("<html><body><p>"), escaped(c), F.lit("</p></body></html>"))
    parts = {"META-INF/container.xml": F.lit('<rootfile full-path="OEBPS/book.opf"/>'), "OEBPS/book.opf": F.lit(opf), "OEBPS/a.xhtml": html(F.col("text")), "OEBPS/b c.xhtml": html(F.col("source"))}
    files = _documents(spark, sf_dir).select("doc_id", packed(parts).alias("content"))
    return readers.epub(files, "doc_id").select("doc_id", "chapter_no", "path", F.md5("text").alias("text_md5"))


@query("""SELECT s_suppkey, s_name || chr(10) || 'é' || s_nationkey || chr(9) || '{x}' AS text FROM supplier""")
def rtf_text(spark, sf_dir):
    """Suppliers as rich text: hidden groups, breaks, escapes."""
    content = F.concat(F.lit(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0\fs24 "), "s_name", F.lit(r"\par \'e9"), F.col("s_nationkey").cast("string"), F.lit(r"\tab \{x\}{\*\generator y}}")).cast("binary")
    return _dealt(_table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", readers.rtf(content).alias("text"))


@query("""SELECT s_suppkey, page_no::BIGINT AS page_no, CASE page_no WHEN 1 THEN s_name || ' ' || s_nationkey || chr(10) || 'below' ELSE 'second' END AS text FROM supplier, (VALUES (1), (2)) v(page_no)""")
def pdf_text(spark, sf_dir):
    """Suppliers as PDF files of two pages with positioned runs."""
    stream = lambda *parts: F.concat(F.lit("<< /Length 1 >>\nstream\n"), *parts, F.lit("\nendstream"))
    first = stream(F.lit("BT /F1 10 Tf 1 0 0 1 50 690 Tm (below) Tj ET BT /F1 10 Tf 1 0 0 1 300 700 Tm ("), F.col("s_nationkey").cast("string"), F.lit(") Tj ET BT /F1 10 Tf 50 700 Td ("), "s_name", F.lit(") Tj ET"))
    objects = [F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.lit("<< /Type /Pages /Kids [3 0 R 5 0 R] /Count 2 >>"), F.lit("<< /Type /Page /Contents 4 0 R >>"), first, F.lit("<< /Type /Page /Contents 6 0 R >>"), stream(F.lit("BT /F1 10 Tf 9 9 Td (second) Tj ET"))]
    content = F.concat(F.lit("%PDF-1.4\n"), *[x for k, o in enumerate(objects, 1) for x in (F.lit(f"{k} 0 obj\n"), o, F.lit("\nendobj\n"))], F.lit("%%EOF")).cast("binary")
    files = _dealt(_table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", content.alias("content"))
    return readers.ordered_text(readers.pdf_runs(files, "s_suppkey"), ["s_suppkey", "page_no"])


# Archives.


def _archives(spark, sf_dir):
    """Each page as an archive: its url, its html, a copy of a name, and an entry that leaves the archive."""
    html = F.coalesce("html", F.lit(""))
    parts = {"docs/url.txt": F.col("url"), "docs/./page.html": html, "../out.txt": F.lit("x"), "notes/b.txt": F.lit("token = abc\nplain"), "docs/a.txt": F.when(F.col("page_id") % 2 == 0, F.lit("even"))}
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), packed(parts).alias("content"))


@query(r"""WITH e AS (SELECT page_id, unnest([{'n': 0, 'p': 'docs/url.txt', 's': strlen(url)}, {'n': 1, 'p': 'docs/page.html', 's': strlen(coalesce(html, ''))}, {'n': 2, 'p': NULL, 's': 1}, {'n': 3, 'p': 'notes/b.txt', 's': 17}, {'n': 4, 'p': 'docs/a.txt', 's': 4}]) AS x FROM pages)
SELECT page_id AS id, x.n::BIGINT AS entry_no, x.p AS path, x.s::BIGINT AS uncompressed FROM e WHERE x.n < 4 OR page_id % 2 = 0""")
def archive_entries(spark, sf_dir):
    """All entries of the archives; an unsafe path is null."""
    return archives.entries(_archives(spark, sf_dir)).select("id", "entry_no", "path", "uncompressed")


@query("""SELECT page_id AS id, x.p AS path, x.n::BIGINT AS entry_no, CASE WHEN page_id % 2 = 0 THEN 2 ELSE -1 END::BIGINT AS next_cursor FROM pages, (VALUES (0, 'docs/url.txt'), (1, 'docs/page.html')) x(n, p)""")
def archive_listing(spark, sf_dir):
    """The first two entries under docs of each archive, and where to go on."""
    return archives.listing(archives.entries(_archives(spark, sf_dir)), ["id"], "docs", 0, 2).fillna(-1, ["next_cursor"])


@query(r"""SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'docs/url.txt' WHEN 1 THEN '../out.txt' ELSE 'notes//b.txt' END AS archive_path, CASE page_id % 3 WHEN 0 THEN 'text' WHEN 2 THEN 'config-ini' END AS kind,
  CASE page_id % 3 WHEN 0 THEN url WHEN 2 THEN 'token = [REDACTED]' || chr(10) || 'plain' END AS text, CASE WHEN page_id % 3 = 1 THEN 'ARCHIVE_PATH_REJECTED' END AS error_code FROM pages""".replace("'config-ini'", "'text'"))
def archive_read(spark, sf_dir):
    """One entry of each archive, found by its path, decoded and masked."""
    path = F.when(F.col("id") % 3 == 0, "docs/url.txt").when(F.col("id") % 3 == 1, "../out.txt").otherwise("notes//b.txt")
    held = _archives(spark, sf_dir)
    return lifecycle.read_entries(held.select("id", path.alias("archive_path")), held).select("id", "archive_path", "kind", "text", "error_code")


# Detection of bytes.

_MARKS = [("89504E470D0A1A0A", "image", "png", "image/png"), ("255044462D312E37", "document", "pdf", "application/pdf"), ("1F8B0800", "binary", "gz", "application/gzip"), ("377ABCAF271C", "archive", "7z", "application/x-7z-compressed"), ("7F454C46", "binary", "executable", "application/x-elf"), ("00", "binary", "unknown-binary", "application/octet-stream"), ("EFBBBF", "text", None, None)]


@query("SELECT page_id, CASE page_id % 7 " + " ".join(f"WHEN {k} THEN '{m[1]}'" for k, m in enumerate(_MARKS)) + " END AS family, CASE page_id % 7 " + " ".join(f"WHEN {k} THEN '{m[2]}'" for k, m in enumerate(_MARKS) if m[2]) + " ELSE 'html' END AS kind, CASE page_id % 7 " + " ".join(f"WHEN {k} THEN '{m[3]}'" for k, m in enumerate(_MARKS) if m[3]) + " ELSE 'text/html' END AS mime, page_id % 7 = 6 OR page_id % 7 = 1 AS readable FROM pages")
def detect_bytes(spark, sf_dir):
    """Families, kinds and types of files by their bytes: signatures before the page, control characters, a byte order mark."""
    mark = F.element_at(F.array(*[F.unhex(F.lit(m[0])) for m in _MARKS]), (F.col("page_id") % 7 + 1).cast("int"))
    body = F.when(F.col("page_id") % 7 == 5, F.unhex(F.repeat(F.lit("00"), F.lit(200)))).otherwise(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    files = _table(spark, sf_dir, "pages").select("page_id", F.lit("file").alias("name"), F.lit("").alias("declared_mime"), F.concat(mark, body).alias("content"))
    return detection.detect(files).select("page_id", "detected.family", "detected.kind", "detected.mime", "detected.readable")


# Uploads, sessions, refs.

_HEADERS = """h AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'http://evil.example' WHEN 2 THEN 'http://localhost:80' ELSE 'https://app.example' END AS origin, CASE event_id % 5 WHEN 2 THEN '127.0.0.1:80' ELSE 'app.example' END AS host,
  CASE WHEN event_id % 11 = 0 THEN 'bad id!' ELSE 'u' || user_id END AS session_id, 'b1' AS batch_id, CASE WHEN event_id % 13 = 0 THEN '%zz' ELSE 'a%20b%2Bc+' || event_type || '.txt' END AS file_name, CASE WHEN event_id % 17 = 0 THEN 30000000 ELSE 10 END AS content_length, user_id FROM events)"""


def _headers(spark, sf_dir):
    e, k = _table(spark, sf_dir, "events"), F.col("event_id")
    origin = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "http://evil.example").when(k % 5 == 2, "http://localhost:80").otherwise("https://app.example")
    return e.select(
        "event_id", origin.alias("origin"), F.when(k % 5 == 2, "127.0.0.1:80").otherwise("app.example").alias("host"), F.when(k % 11 == 0, "bad id!").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("session_id"), F.lit("b1").alias("batch_id"),
        F.when(k % 13 == 0, "%zz").otherwise(F.concat(F.lit("a%20b%2Bc+"), "event_type", F.lit(".txt"))).alias("file_name"), F.when(k % 17 == 0, 30_000_000).otherwise(10).alias("content_length"),
    )


@query(f"""WITH {_HEADERS}, s AS (SELECT *, CASE WHEN event_id % 5 < 2 THEN 403 WHEN event_id % 11 = 0 THEN 400 WHEN user_id NOT IN (SELECT c_custkey FROM customer) THEN 403 WHEN event_id % 17 = 0 THEN 413 WHEN event_id % 13 = 0 THEN 400 ELSE 201 END AS status FROM h)
SELECT event_id, status, CASE status WHEN 201 THEN NULL WHEN 413 THEN 'FILE_TOO_LARGE' ELSE 'ATTACHMENT_FORBIDDEN' END AS error_code, CASE WHEN status = 201 THEN regexp_replace(replace(file_name, '%20', ' '), '%2B', '+') END AS name FROM s""")
def upload_checks(spark, sf_dir):
    """Uploads by their headers: origin, ids, living session, declared size, name.  Customers stand for living sessions."""
    living = _table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("session_id"))
    return uploads.checked(_headers(spark, sf_dir), living).select("event_id", "status", "error_code", "name")


@query(f"WITH {_HEADERS} SELECT event_id, event_id % 5 <> 1 AS allowed FROM h")
def touch_checks(spark, sf_dir):
    """Reads and removals may come without an origin."""
    return _headers(spark, sf_dir).select("event_id", uploads.may_touch(F.col("origin"), F.col("host")).alias("allowed"))


_FILES = """f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'image/avif' WHEN 3 THEN NULL ELSE 'text/plain' END AS mime, strlen(coalesce(text, '')) * 20000 AS size FROM documents)"""


def _files(spark, sf_dir):
    k = F.col("doc_id") % 6
    mime = F.when(k == 0, "image/png").when(k == 1, "image/tiff").when(k == 2, "image/avif").when(k == 3, F.lit(None)).otherwise("text/plain")
    return _table(spark, sf_dir, "documents").select("doc_id", mime.alias("mime"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * 20_000).alias("size"))


@query(f"WITH {_FILES} SELECT doc_id, CASE WHEN mime IN ('image/png', 'image/avif') THEN 'native' ELSE 'generic' END AS handled FROM f")
def image_partition(spark, sf_dir):
    """Files that the engine takes and images that a client shows by itself."""
    generic, native = uploads.by_handling(_files(spark, sf_dir))
    return generic.select("doc_id", F.lit("generic").alias("handled")).unionByName(native.select("doc_id", F.lit("native").alias("handled")))


@query(f"WITH {_FILES} SELECT doc_id, CASE WHEN mime LIKE 'image/%' THEN 'UNSUPPORTED_FILE_TYPE' WHEN size > 26214400 THEN 'FILE_TOO_LARGE' END AS error_code FROM f")
def client_guards(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", uploads.client_guard(F.col("mime"), F.col("size")).alias("error_code"))


@query(f"""WITH {_FILES} SELECT doc_id, CASE WHEN mime LIKE 'image/%' THEN 400 WHEN size > 26214400 THEN 413 ELSE 200 END AS status,
  CASE WHEN mime LIKE 'image/%' THEN '{{"ok":false,"error":{{"code":"UNSUPPORTED_FILE_TYPE"}}}}' WHEN size > 26214400 THEN '{{"ok":false,"error":{{"code":"FILE_TOO_LARGE"}}}}'
  ELSE '{{"ok":true,"metadata":{{"id":' || doc_id || ',' || CASE WHEN mime IS NULL THEN '' ELSE '"mime":"' || mime || '",' END || '"sizes":[' || size || ',null]}}}}' END AS body FROM f""")
def json_replies(spark, sf_dir):
    """Replies as JSON: absent fields are left out, absent items are null."""
    value = F.struct(F.col("doc_id").alias("id"), "mime", F.array("size", F.lit(None).cast("long")).alias("sizes"))
    return _files(spark, sf_dir).select("doc_id", uploads.reply(value, uploads.client_guard(F.col("mime"), F.col("size"))).alias("r")).select("doc_id", "r.status", "r.body")


_KINDS = ["image/png", "archive/zip", "binary/elf", "document/pdf", "document/ods", "document/odp", "document/epub", "document/doc", "text/markdown", "text/env", "text/tsv", "text/sql", "text/source-go", "text/html", "other/x"]
_ICONS = ["🖼️ #b06ec4", "🗜️ #b7791f", "📦 #8a8f98", "📕 #e05656", "📊 #3b9b68", "📽️ #d68a3c", "📖 #6c8fd4", "📝 #5b8ff9", "📄 #6c8fd4", "⚙️ #b7791f", "📊 #3b9b68", "🗄️ #5b8ff9", "💻 #7a86a6", "📃 #8a8f98", "❓ #8a8f98"]


@query("SELECT p_partkey, ([" + ", ".join(f"'{x}'" for x in _ICONS) + f"])[p_partkey % {len(_ICONS)} + 1] AS look FROM part")
def icons(spark, sf_dir):
    """Icons and colours of kinds, dealt over the parts."""
    own = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    look = names.presentation(F.substring_index(own, "/", 1), F.substring_index(own, "/", -1))
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", look["icon"], look["color"]).alias("look"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'TS' WHEN 1 THEN 'YAML' WHEN 2 THEN 'MD' ELSE 'PDF' END AS label FROM part")
def kind_labels(spark, sf_dir):
    own = F.element_at(F.array(*map(F.lit, ["source-typescript", "config-yaml", "markdown", "pdf"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", names.kind_label(own).alias("label"))


@query("""WITH r AS (SELECT o_custkey AS session_id, o_orderkey AS id, o_orderkey % 3 AS batch_id FROM orders),
b AS (SELECT session_id, batch_id, id, row_number() OVER (PARTITION BY session_id, batch_id ORDER BY id DESC) AS n FROM r)
SELECT session_id AS owner_session_id, batch_id, id, n - 1 AS position FROM b""")
def batch_listing(spark, sf_dir):
    """Orders as the files of their customer's batches, in the order of the batch's own list, which also names strangers."""
    refs = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner_session_id"), (F.col("o_orderkey") % 3).alias("batch_id"), F.col("o_orderkey").alias("id"))
    lists = refs.groupBy(F.col("owner_session_id").alias("session_id"), "batch_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids"))
    lists = lists.withColumn("ids", F.concat("ids", F.array((F.element_at("ids", 1) + 1), F.lit(-1).cast("long"))))
    return store.batch_listing(lists, refs).select("owner_session_id", "batch_id", "id", F.col("position").cast("long").alias("position"))


@query(f"""WITH {_ATT}, req AS (SELECT event_id, 'src' || (user_id % 20) AS session_id, 'att_' || md5((event_id % (SELECT count(*) FROM documents))::VARCHAR) AS id FROM events), alive AS (SELECT DISTINCT source AS s FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT event_id, CASE WHEN att.id IS NULL OR req.session_id NOT IN (SELECT s FROM alive WHERE s IS NOT NULL) THEN 'ATTACHMENT_FORBIDDEN' END AS error_code FROM req LEFT JOIN att ON att.id = req.id AND att.owner_session_id = req.session_id""")
def living_sessions(spark, sf_dir):
    """Reads by owners whose sessions live on, over all documents; sources with a label of toxicity stand for living sessions."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    alive = docs.join(labels.filter("toxic = 1"), "doc_id").select(F.col("source").alias("session_id"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))  # one row
    asked = _table(spark, sf_dir, "events").crossJoin(F.broadcast(total)).select("event_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("session_id"), F.concat(F.lit("att_"), F.md5((F.col("event_id") % F.col("n")).cast("string"))).alias("id"))
    return store.authorize(asked, _attachments(spark, sf_dir), alive).select("event_id", "error_code")


@query("""WITH d AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS h FROM documents), kept AS (SELECT * FROM d WHERE NOT (doc_id % 2 = 0)),
all_h AS (SELECT DISTINCT h FROM d) SELECT h AS sha256, (SELECT count(*) FROM kept k WHERE k.h = all_h.h) AS n_refs FROM all_h""")
def blob_refcount(spark, sf_dir):
    """How many refs each content has left after the even ones were removed by their sessions; unused contents have none."""
    docs = store.hashed(_documents(spark, sf_dir), "text").select(F.col("doc_id").alias("id"), F.col("source").alias("owner_session_id"), "sha256")
    blobs = docs.select("sha256").distinct()
    left = store.remove_refs(docs, docs.filter("id % 2 = 0").select(F.col("owner_session_id").alias("session_id"), "id"))
    used = left.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_refs"))
    return used.unionByName(store.unused_blobs(blobs, left).select("sha256", F.lit(0).cast("long").alias("n_refs")))


# Windows.


@query("SELECT l_orderkey, l_linenumber, least(greatest(l_linenumber * 5 - 10, 1), 20)::BIGINT AS page, least(greatest(l_suppkey % 40, least(greatest(l_linenumber * 5 - 10, 1), 20)), least(20, least(greatest(l_linenumber * 5 - 10, 1), 20) + 9))::BIGINT AS page_end FROM lineitem")
def page_spans(spark, sf_dir):
    """Asked pages, clamped to the twenty there are and to ten at once."""
    span = paging.page_span((F.col("l_linenumber") * 5 - 10).cast("int"), (F.col("l_suppkey") % 40).cast("int"), F.lit(20))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", span.alias("s")).select("l_orderkey", "l_linenumber", "s.page", "s.page_end")


_CUT = ", ".join(f"try(decode(array_slice(b, {101 + k}, {500 - j})))" for k in range(4) for j in range(4))


@query(f"""WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT *, CASE WHEN n > 100 THEN coalesce({_CUT}) ELSE '' END AS c, CASE WHEN n > 100 THEN coalesce({", ".join(f"CASE WHEN try(decode(array_slice(b, {101 + k}, least(n, {104 + k})))) IS NOT NULL OR try(decode(array_slice(b, {101 + k}, least(n, {103 + k})))) IS NOT NULL OR try(decode(array_slice(b, {101 + k}, least(n, {102 + k})))) IS NOT NULL OR try(decode(array_slice(b, {101 + k}, least(n, {101 + k})))) IS NOT NULL THEN {k} END" for k in range(4))}) ELSE 0 END AS skipped FROM t),
w AS (SELECT *, CASE WHEN n <= 500 OR NOT contains(c, chr(10)) THEN c ELSE regexp_extract(c, '^([\\s\\S]*\\n)', 1) END AS own FROM c)
SELECT doc_id, own AS text, greatest(n, 100) > 100 + skipped + strlen(own) AS has_more, CASE WHEN greatest(n, 100) > 100 + skipped + strlen(own) THEN 100 + skipped + strlen(own) ELSE -1 END::BIGINT AS next_offset FROM w""".replace("\\\\", "\\"))
def byte_windows(spark, sf_dir):
    """Whole lines from byte 100 on, within 400 bytes: the window may begin and end inside a character."""
    window = paging.byte_window(F.coalesce("text", F.lit("")), F.lit(100), most_bytes=400)
    return _documents(spark, sf_dir).select("doc_id", window.alias("w")).select("doc_id", "w.text", "w.has_more", "w.next_offset").fillna(-1, ["next_offset"])


@query(f"""WITH {MASKED_DOCUMENTS}, page AS (SELECT doc_id, string_split(text, chr(10)) AS x, redacted FROM r)
SELECT doc_id, array_to_string(x[1:3], chr(10)) AS text, len(x) > 3 AS has_more, redacted FROM page""")
def governed_lines(spark, sf_dir):
    """The first three lines of every document, as its owner reads it, and how many of the document's lines are masked."""
    docs = _documents(spark, sf_dir)
    ident = F.concat(F.lit("att_"), F.md5(F.col("doc_id").cast("string"))).alias("id")
    hashed = store.hashed(docs.withColumn("content", F.coalesce("text", F.lit("")).cast("binary")))
    refs = hashed.select("doc_id", ident, F.coalesce("source", F.lit("none")).alias("owner_session_id"), "sha256", F.struct(F.lit("text").alias("kind"), F.lit("text").alias("family")).alias("detected"))
    asked = refs.select(F.col("owner_session_id").alias("session_id"), "id", F.lit(1).alias("page"))
    found = lifecycle.governed_read(asked, refs.drop("doc_id"), store.new_blobs(hashed), most_lines=3)
    return found.join(refs.select("id", "doc_id"), "id").select("doc_id", "text", "has_more", "redacted")


@query(f"""WITH {MASKED_DOCUMENTS} SELECT doc_id, text, redacted, NULL AS error_code FROM r""")
def kept_texts(spark, sf_dir):
    """Every document read from the store of texts, after the contents themselves are gone."""
    docs = _documents(spark, sf_dir)
    files = store.hashed(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content")))
    asked = files.select(F.col("doc_id").alias("id"), "sha256", F.struct(F.lit("text").alias("kind"), F.lit("text").alias("family")).alias("detected"))
    kept = TextStore(spark, f"{stream_folder(spark)}/{uuid4().hex}")
    blobs = store.new_blobs(files)
    lifecycle.masked_texts(asked, blobs, kept)
    gone = blobs.withColumn("content", F.lit(None).cast("binary"))
    return lifecycle.masked_texts(asked, gone, kept).select(F.col("id").alias("doc_id"), "text", "redacted", F.col("_failed").alias("error_code"))


# Table functions.


@query(ORACLES["byte_pages"])
def sql_text_pages(spark, sf_dir):
    """Pages of every document by the table function, in a LATERAL join."""
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, p.* FROM {docs} d, LATERAL text_pages(d.text, 40, 2000) p", docs=_documents(spark, sf_dir))


@query(f"""WITH {re.sub("^WITH RECURSIVE p AS", "RECURSIVE p AS", ORACLES["byte_pages"].split("SELECT doc_id, page_no, byte_start, strlen")[0])},
o AS (SELECT doc_id, max(page_no) AS n FROM p GROUP BY doc_id), q AS (SELECT doc_id, n, doc_id % 4 + 1 AS page FROM o)
SELECT q.doc_id, p.text, CASE WHEN q.page < n THEN q.page + 1 ELSE -1 END::BIGINT AS next_page, CASE WHEN q.page > n THEN 'PAGE_OUT_OF_RANGE' END AS error_code
FROM q LEFT JOIN p ON p.doc_id = q.doc_id AND p.page_no = q.page""")
def sql_text_windows(spark, sf_dir):
    """One page of every document, which the row itself names, by the table function."""
    tables.register(spark)
    docs = _documents(spark, sf_dir).withColumn("page", F.col("doc_id") % 4 + 1)
    return spark.sql("SELECT d.doc_id, w.text, coalesce(w.next_page, -1) AS next_page, w.error_code FROM {docs} d, LATERAL text_window(d.text, d.page, 40, 2000) w", docs=docs)


@query(ORACLES["archive_listing"])
def sql_archive_listing(spark, sf_dir):
    """The first two entries under docs of each archive, by the table function."""
    tables.register(spark)
    return spark.sql("SELECT a.id, e.path, e.entry_no, coalesce(e.next_cursor, -1) AS next_cursor FROM {held} a, LATERAL list_archive(a.content, 'docs', 0, 2) e", held=_archives(spark, sf_dir))


@query(r"""SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN url WHEN 2 THEN 'token = abc' || chr(10) || 'plain' END AS text, CASE WHEN page_id % 3 = 1 THEN 'ARCHIVE_PATH_REJECTED' END AS error_code FROM pages""")
def sql_archive_entry(spark, sf_dir):
    """One entry of each archive, whose path a request names, by the table function."""
    tables.register(spark)
    path = F.when(F.col("id") % 3 == 0, "docs/url.txt").when(F.col("id") % 3 == 1, "../out.txt").otherwise("notes//b.txt")
    return spark.sql("SELECT a.id, decode(e.entry, 'UTF-8') AS text, e.error_code FROM {held} a, LATERAL read_entry(a.content, a.path) e", held=_archives(spark, sf_dir).withColumn("path", path))


# Files on disk.


def _on_disk(spark, rows: DataFrame) -> str:
    """A shared folder with a file for each row (``name``, ``content``), in folders below it that can be listed one by one."""
    folder = f"{stream_folder(spark)}/{uuid4().hex}"
    below = F.crc32(F.col("name").cast("binary")) % max(1, -(-rows.count() // FOLDER_FILES))
    ranges.write_files(rows.select(F.concat(below.cast("string"), F.lit("/"), "name").alias("name"), "content"), folder)
    return folder


def _id_of(path: str = "path"):
    return F.regexp_extract(path, r"/(\d+)\.[a-z]+$", 1).cast("long")


@query("""WITH f AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), p AS (SELECT *, unnest(range(0, octet_length(b), 1000)) AS o FROM f)
SELECT page_id, o AS "offset", least(1000, octet_length(b) - o) AS length, octet_length(b) AS size, lower(hex(array_slice(b, o + 1, least(o + 1000, octet_length(b))))) AS bytes FROM p WHERE o >= 2000""")
def ranged_windows(spark, sf_dir):
    """Pages as files, read in windows of 1,000 bytes from byte 2,000 on: no range before that is opened."""
    folder = _on_disk(spark, _table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).alias("content")))
    found = ranges.read_ranges(spark, folder, window=1000).filter("offset >= 2000")
    return found.select(_id_of().alias("page_id"), "offset", "length", "size", F.lower(F.hex("content")).alias("bytes"))


def _packages(spark, sf_dir) -> DataFrame:
    """Pages as archives on disk; of five, one is of the 64-bit format, one split, and one cut short."""
    html, case = F.coalesce("html", F.lit("")), F.col("id") % 5
    wide = packed({"docs/url.txt": F.col("url")}, wide=True)
    plain = _archives(spark, sf_dir).withColumnRenamed("content", "_plain").join(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), wide.alias("_wide"), html.alias("_html")), "id")
    end = F.octet_length("_plain") - 22  # packages have no comment
    split = F.concat(F.substring("_plain", F.lit(1), end + 4), F.lit(b"\x01\x00"), F.substring("_plain", end + 7, F.lit(16)))
    content = F.when(case == 1, F.col("_wide")).when(case == 2, split).when(case == 3, F.substring("_plain", F.lit(1), end + 10)).otherwise(F.col("_plain"))
    return plain.select(F.concat(F.col("id").cast("string"), F.lit(".zip")).alias("name"), content.alias("content"))


@query(r"""WITH e AS (SELECT page_id, unnest([{'n': 0, 'p': 'docs/url.txt', 't': url, 'r': true}, {'n': 1, 'p': 'docs/page.html', 't': coalesce(html, ''), 'r': true}, {'n': 2, 'p': NULL, 't': NULL, 'r': false},
  {'n': 3, 'p': 'notes/b.txt', 't': 'token = abc' || chr(10) || 'plain', 'r': true}, {'n': 4, 'p': 'docs/a.txt', 't': 'even', 'r': true}]) AS x FROM pages WHERE page_id % 5 IN (0, 4))
SELECT page_id, x.n::BIGINT AS entry_no, x.p AS path, x.t AS text, CASE WHEN NOT x.r THEN 'ARCHIVE_PATH_REJECTED' END AS error_code FROM e WHERE x.n < 4 OR page_id % 2 = 0
UNION ALL SELECT page_id, -1, NULL, NULL, 'CORRUPT_FILE' FROM pages WHERE page_id % 5 IN (1, 2, 3)""")
def archive_scan_entries(spark, sf_dir):
    """Archives on disk: directories from their tails, every entry by its range, refusals as rows."""
    files = ranges.read_ranges(spark, _on_disk(spark, _packages(spark, sf_dir))).select("path", "size")
    entries = archive_scan.directories(files).cache()
    read = archive_scan.read_entries(entries).select(_id_of().alias("page_id"), "entry_no", F.col("name").alias("path"), F.col("content").cast("string").alias("text"), "error_code")
    return read.unionByName(entries.filter("entry_no IS NULL").select(_id_of().alias("page_id"), "entry_no", "error_code"), allowMissingColumns=True).fillna(-1, ["entry_no"])


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'odt' ELSE 'zip' END AS kind, page_id % 3 < 2 AS readable, page_id % 3 < 2 AS mismatch FROM pages""")
def ranged_detection(spark, sf_dir):
    """Packages on disk named .zip, by head and directory: their true kinds, without their contents."""
    html, case = F.coalesce("html", F.lit("")), F.col("page_id") % 3
    docx = packed({"big.bin": html, "[Content_Types].xml": F.lit("<Types/>"), "word/document.xml": html})
    odt = packed({"mimetype": F.lit("application/vnd.oasis.opendocument.text"), "content.xml": html}, stored=True)
    other = packed({"a.html": html})
    pages = _table(spark, sf_dir, "pages").select("page_id", F.when(case == 0, docx).when(case == 1, odt).otherwise(other).alias("content"))
    folder = _on_disk(spark, pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".zip")).alias("name"), "content"))
    files = ranges.read_ranges(spark, folder).select("path", "size", F.substring_index("path", "/", -1).alias("name"), F.lit("").alias("declared_mime"))
    return ranges.detect_files(files).select(_id_of().alias("page_id"), "detected.kind", "detected.readable", "detected.mismatch")


@query(r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x, unnest([1, 2, 3, 9]) AS page FROM documents), p AS (SELECT *, array_to_string(x[page * 4 - 3:page * 4], chr(10)) AS t, len(x) > page * 4 AS more, len(x) > page * 4 - 4 AS there FROM l),
c AS (SELECT *, string_split(t, chr(10)) AS y FROM p),
f AS (SELECT *, coalesce(list_max(list_filter(range(1, len(y) + 1), lambda k: strlen(array_to_string(y[1:k], chr(10))) + 1 <= 600)), 0) AS k, strlen(t) + CASE WHEN more THEN 1 ELSE 0 END > 600 AS over FROM c)
SELECT doc_id, page, CASE WHEN NOT over THEN t WHEN k > 0 THEN array_to_string(y[1:k], chr(10)) ELSE coalesce(try(decode(array_slice(encode(t), 1, 600))), try(decode(array_slice(encode(t), 1, 599))), try(decode(array_slice(encode(t), 1, 598))), try(decode(array_slice(encode(t), 1, 597)))) END AS text, more OR over AS has_more, NULL AS error_code FROM f WHERE there
UNION ALL SELECT doc_id, page, NULL, NULL, 'PAGE_OUT_OF_RANGE' FROM f WHERE NOT there""")
def indexed_pages(spark, sf_dir):
    """Pages of four lines of documents on disk by an index of lines, each read by one seek, within 600 bytes."""
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    folder = _on_disk(spark, docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "content"))
    files = ranges.read_ranges(spark, folder).select("path", "size", _id_of().alias("doc_id")).join(docs.select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string").cast("binary"), "content"), 256).alias("sha256")), "doc_id").cache()  # listed once
    index = line_index.build(files, every=4, window=1000).cache()
    asked = files.select("doc_id", "sha256", F.explode(F.array(*map(F.lit, (1, 2, 3, 9))).cast("array<long>")).alias("page"))
    return line_index.read_pages(asked, index, most_bytes=600).select("doc_id", F.col("page").cast("int").alias("page"), "text", "has_more", "error_code")


_WINDOW_LINES = "o AS (SELECT o_custkey, list(o_orderkey || ' of ' || o_orderstatus || repeat('x', (o_orderkey % 40)::INT) ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)"


@query(f"""WITH {_WINDOW_LINES},
d AS (SELECT o_custkey, 'docx' AS kind, l, o_custkey % 4 AS b, least(5, greatest(len(l) - o_custkey % 4, 0)) AS n FROM o WHERE o_custkey % 3 = 0
  UNION ALL SELECT o_custkey, 'pptx', l, least(greatest(o_custkey % 7, 1), len(l)) - 1, 1 FROM o WHERE o_custkey % 3 = 1),
k AS (SELECT *, coalesce(list_max(list_filter(range(1, n + 1), lambda k: strlen(array_to_string(l[b + 1:b + k], chr(10))) <= 48)), 0) AS k FROM d),
t AS (SELECT o_custkey, array_to_string(l, chr(10)) AS x, o_custkey % 50 AS b FROM o WHERE o_custkey % 3 = 2),
w AS (SELECT *, substr(x, b + 1, 48) AS c, b + 48 < length(x) AS rest FROM t),
v AS (SELECT *, CASE WHEN NOT rest OR NOT contains(c, chr(10)) THEN c ELSE regexp_extract(c, '^([\\s\\S]*\\n)', 1) END AS own FROM w)
SELECT o_custkey, kind, CASE WHEN k > 0 OR len(l) <= b THEN array_to_string(l[b + 1:b + k], chr(10)) END AS text, CASE WHEN k > 0 OR len(l) <= b THEN len(l) > b + k END AS has_more,
  CASE WHEN k > 0 AND len(l) > b + k THEN b + k + CASE WHEN kind = 'pptx' THEN 1 ELSE 0 END ELSE -1 END AS next, CASE WHEN k = 0 AND len(l) > b THEN 'PARSER_OUTPUT_LIMIT' END AS error_code FROM k
UNION ALL SELECT o_custkey, 'text', own, b + length(own) < length(x), CASE WHEN b + length(own) < length(x) THEN b + length(own) ELSE -1 END, NULL FROM v""".replace("\\\\", "\\"))
def read_windows(spark, sf_dir):
    """Customers' orders as files of three kinds, each read from a place of its own, within 48 bytes."""
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(" of "), "o_orderstatus", F.repeat(F.lit("x"), (F.col("o_orderkey") % 40).cast("int")))
    own = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("x")))), lambda s: s["x"]).alias("l"))
    kind = F.element_at(F.array(F.lit("docx"), F.lit("pptx"), F.lit("text")), (F.col("o_custkey") % 3 + 1).cast("int"))
    body = F.concat(F.lit("<w:document><w:body>"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("<w:p><w:t>"), x, F.lit("</w:t></w:p>"))), ""), F.lit("</w:body></w:document>"))
    slides = {f"ppt/slides/slide{k + 1}.xml": F.when(F.size("l") > k, F.concat(F.lit("<p:sp><a:t>"), F.get("l", F.lit(k)), F.lit("</a:t></p:sp>"))) for k in range(64)}  # no customer has more orders
    content = F.when(kind == "docx", packed({"[Content_Types].xml": F.lit("<Types/>"), "word/document.xml": body})).when(kind == "pptx", packed({"ppt/presentation.xml": F.lit("<p/>")} | slides)).otherwise(F.array_join("l", "\n").cast("binary"))
    files = store.hashed(own.select("o_custkey", kind.alias("kind"), content.alias("content")))
    family = F.when(F.col("kind") == "text", "text").otherwise("document")
    refs = files.select("o_custkey", F.concat(F.lit("att_"), F.md5(F.col("o_custkey").cast("string"))).alias("id"), F.lit("s").alias("owner_session_id"), "sha256", F.struct("kind", family.alias("family")).alias("detected"))
    at = lambda x: x.cast("long")
    asked = refs.select(F.lit("s").alias("session_id"), "id", at(F.col("o_custkey") % 50).alias("offset"), at(F.col("o_custkey") % 7).alias("page"), F.lit(None).cast("long").alias("page_end"), at(F.col("o_custkey") % 4).alias("paragraph_offset"), at(F.lit(5)).alias("paragraph_limit"))
    found = lifecycle.read_window(asked, refs.drop("o_custkey"), store.new_blobs(files), limits=replace(LIMITS, page_bytes=48))
    return found.join(refs.select("id", "o_custkey"), "id").select("o_custkey", "kind", "text", "has_more", "next", "error_code").fillna(-1, ["next"])


# Streams.


def _streamed(spark, sf_dir, table: str):
    """A table's files as a stream."""
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")  # a pattern may stand for a file or a folder


def _run_to_its_end(spark, stream, schema: str):
    """What a stream has written when it has read all there is."""
    out = f"{stream_folder(spark)}/{uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


@query(ORACLES["announce_fresh"])
def announced_by_stream(spark, sf_dir):
    """``announce_fresh`` as a stream over the documents' files, with the log's announcements as its beginning."""
    said = announce_stream(_as_attachments(_streamed(spark, sf_dir, "documents")), known=_known(spark, sf_dir))
    rows = _run_to_its_end(spark, said.select("session_id", "items", "error_code"), "session_id string, items array<struct<at:long,id:string,said:string>>, error_code string")
    return whole_announcements(rows).drop("ids")


@query("""SELECT conv_id::VARCHAR AS session_id, turn::BIGINT AS seq, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS batch_no FROM conversations""")
def batches_by_stream(spark, sf_dir):
    """``batch_rotation`` as a stream over the conversations' files, in event time; a later event of another session moves the watermark past all."""
    rows = _streamed(spark, sf_dir, "conversations")
    event = lambda session, at, send: F.struct(session.alias("session_id"), F.timestamp_seconds(at).alias("at"), F.col("turn").cast("long").alias("seq"), send.alias("is_send"))
    own = event(F.col("conv_id").cast("string"), F.col("turn") + 1, F.col("role") == "user")
    events = rows.select(F.explode(F.array(own, event(F.lit("later"), F.col("turn") + 86_400, F.lit(False)))).alias("e")).select("e.*")
    found = _run_to_its_end(spark, batches_stream(events), "session_id string, seq long, batch_no long")
    return found.filter("session_id <> 'later'")

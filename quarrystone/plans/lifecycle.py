"""Ingest and governed read, each one declarative plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.detection import detect
from quarrystone.functions.redaction import masked
from quarrystone.limits import LIMITS, Limits
from quarrystone.operators import archives, paging, store
from quarrystone.plans.texts import TextStore
from quarrystone.sources import legacy, readers


#: What stands between the pages of a document that has pages.
PAGE_BREAK = "\n\f\n"


def ingest(uploads: DataFrame, blobs: DataFrame | None = None, limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new blobs, new refs, rejected) of ``uploads``.

    Contents are hashed and detected once; sizes and quotas work on rows without them.
    """
    # Written once where the session has a folder for that: detection looks into the contents, and three results need it.
    seen = detect(store.hashed(uploads))
    if uploads.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        seen = seen.checkpoint()
    seen = seen.withColumn("_large", store.oversize(F.col("detected.family"), F.col("bytes"), limits))
    narrow = seen.drop("content")
    judged = store.admit(narrow.filter("_large IS NULL").drop("_large"), limits=limits)
    admitted = judged.filter("error_code IS NULL").drop("error_code")
    rejected = judged.filter("error_code IS NOT NULL").unionByName(narrow.filter("_large IS NOT NULL").withColumnRenamed("_large", "error_code"))
    held = seen.join(admitted.select("sha256").distinct(), "sha256", "left_semi")
    return store.new_blobs(held, blobs), store.make_refs(admitted), rejected


def governed_read(requests: DataFrame, refs: DataFrame, blobs: DataFrame, sessions: DataFrame | None = None, most_lines: int = LIMITS.page_lines, most_bytes: int = LIMITS.page_bytes, kept: TextStore | None = None) -> DataFrame:
    """Requests (``session_id``, ``id``, ``page``) with ``text``, ``redacted``, ``has_more``, ``next_line`` and ``error_code``.

    A page that would be longer than ``most_bytes`` has only the lines that fit; ``next_line`` (from 0) says where to go
    on, and a request with a column ``line`` begins there.  One line that alone is too long is ``PARSER_OUTPUT_LIMIT``.

    Ownership is decided on refs alone; only contents of allowed rows are joined.  A document is masked as a whole and
    paged after that, so a key block that spans pages stays masked.
    """
    judged = store.authorize(requests, refs, sessions)
    allowed = judged.filter("error_code IS NULL").drop("error_code")
    # A document meets its requests whole, and each takes its own page of the lines: no other page is made.
    texts = masked_texts(allowed, blobs, kept).withColumn("_lines", F.split(F.replace("text", F.lit(PAGE_BREAK), F.lit("\n")), r"\r?\n", -1)).drop("text")
    found = allowed.join(texts, "id", "left")
    at, count = (F.col("page") - 1).cast("int") * most_lines, F.size("_lines")
    if "line" in requests.columns:
        at = F.coalesce(F.col("line").cast("int"), at)
    inside = F.col("_failed").isNull() & (F.col("page") >= 1) & (at >= 0) & (at < count)
    found = found.withColumn("_w", F.when(inside, paging.window_of(F.col("_lines"), at, most_lines, most_lines, most_bytes)))
    found = found.withColumns({"text": F.col("_w.text"), "n_lines": F.col("_w.n"), "has_more": F.col("_w.has_more"), "next_line": F.col("_w.next_offset")})
    found = found.withColumn("error_code", F.coalesce("_failed", F.when(~F.coalesce(inside, F.lit(False)), "PAGE_OUT_OF_RANGE"), "_w.error_code"))
    keep = ["session_id", "id", "page", "kind", "text", "n_lines", "has_more", "next_line", "redacted", "error_code"]
    refused = judged.filter("error_code IS NOT NULL").select("session_id", "id", "page", "error_code")
    return found.select(*keep).unionByName(refused, allowMissingColumns=True)


def masked_texts(allowed: DataFrame, blobs: DataFrame, kept: TextStore | None = None) -> DataFrame:
    """``id, kind, text, redacted, _failed`` of the documents of allowed requests, each read and masked once, as a whole.

    With ``kept``, only contents whose texts it does not have are opened.
    """
    needed = allowed.select("id", "sha256", F.col("detected.kind").alias("kind"), F.col("detected.family").alias("family")).distinct()
    if kept is None:
        texts = document_texts(needed.join(blobs.select("sha256", "content"), "sha256", "left"))
    else:
        texts = needed.select("id", "sha256", "kind").join(kept.read(needed, blobs, document_texts), ["sha256", "kind"])
    return masked(texts).select("id", "kind", F.col("_r.text").alias("text"), F.col("_r.redacted").alias("redacted"), F.col("error_code").alias("_failed"))


def read_window(requests: DataFrame, refs: DataFrame, blobs: DataFrame, sessions: DataFrame | None = None, limits: Limits = LIMITS, kept: TextStore | None = None) -> DataFrame:
    """Requests with a window of their own: ``session_id``, ``id``, ``offset`` (bytes), ``page``, ``page_end``, ``paragraph_offset``, ``paragraph_limit``.

    Slides and PDF pages are read by page, at most ten of a PDF and one slide at once, clamped to those there are; word
    processor texts by paragraph; all else by byte offset.  Null means the beginning.  A reply has at most the limit's
    bytes: fewer pages or paragraphs where more would not fit, ``PARSER_OUTPUT_LIMIT`` where one alone does not.  Returns
    ``kind``, ``text``, ``redacted``, ``has_more``, ``next`` (the page, paragraph or byte to go on from), ``error_code``.
    """
    judged = store.authorize(requests, refs, sessions)
    allowed = judged.filter("error_code IS NULL").drop("error_code")
    found = allowed.join(masked_texts(allowed, blobs, kept), "id", "left")
    kind, text = F.col("kind"), F.coalesce("text", F.lit(""))
    pages = F.split(text, PAGE_BREAK, -1)
    span = paging.page_span(F.col("page"), F.when(kind == "pdf", F.col("page_end")), F.size(pages))
    paged = paging.window_of(pages, span["page"] - 1, span["page_end"] - span["page"] + 1, most_bytes=limits.page_bytes)
    paged = F.struct(paged["text"].alias("text"), paged["has_more"].alias("has_more"), (paged["next_offset"] + 1).alias("next"), paged["error_code"].alias("error_code"))
    lines = paging.window_of(F.split(text, "\n", -1), F.coalesce("paragraph_offset", F.lit(0)), F.coalesce("paragraph_limit", F.lit(limits.page_lines)), limits.page_lines, limits.page_bytes)
    paragraphs = F.struct(lines["text"].alias("text"), lines["has_more"].alias("has_more"), lines["next_offset"].alias("next"), lines["error_code"].alias("error_code"))
    own = paging.byte_window(text, F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)).cast("int"), limits.page_lines, limits.page_bytes)
    by_bytes = F.struct(own["text"].alias("text"), own["has_more"].alias("has_more"), own["next_offset"].alias("next"), F.lit(None).cast("string").alias("error_code"))
    window = F.when(kind.isin("pdf", "pptx"), paged).when(kind.isin("docx", "doc", "odt"), paragraphs).otherwise(by_bytes)
    found = found.withColumn("_w", F.when(F.col("_failed").isNull(), window))
    done = found.select("session_id", "id", "kind", "_w.text", "redacted", "_w.has_more", "_w.next", F.coalesce("_failed", "_w.error_code").alias("error_code"))
    return done.unionByName(judged.filter("error_code IS NOT NULL").select("session_id", "id", "error_code"), allowMissingColumns=True)


def document_texts(files: DataFrame) -> DataFrame:
    """``id, kind, text, error_code`` of files (``id, kind, family, content``), each by the reader of its kind.

    Slides and PDF pages are set apart by ``PAGE_BREAK``.  A file is joined and opened once: every reader sees only the
    contents of its kind, in the same pass.  Sheets, whose cells are grouped into rows, are a second branch.
    """
    kind, content = F.col("kind"), F.col("content")
    only = lambda *kinds: F.when(kind.isin(*kinds), content)
    opened = files.filter(~kind.isin("xlsx", "xls")).select(
        "id",
        "kind",
        F.col("family").alias("_family"),
        content.isNull().alias("_none"),
        readers.package(only("docx", "pptx", "odt", "odp", "ods", "epub"), kind).alias("_p"),
        legacy.doc_text(only("doc")).alias("_doc"),
        readers.rtf(only("rtf")).alias("_rtf"),
        readers.pdf(only("pdf")).alias("_pdf"),
        readers.decoded(F.when(F.col("family") == "text", content)).alias("_plain"),
    )
    parts = F.col("_p.parts")
    docx, lines = readers.docx_lines(parts)
    body, open_lines = readers.open_lines(parts)
    _, open_rows = readers.open_lines(parts, spreadsheet=True)
    text = (
        F.when(F.col("_family") == "text", F.col("_plain.text"))
        .when(kind == "docx", F.array_join(lines, "\n"))
        .when(kind == "pptx", F.array_join(readers.pptx_pages(parts), PAGE_BREAK))
        .when(kind.isin("odt", "odp"), F.array_join(open_lines, "\n"))
        .when(kind == "ods", F.array_join(open_rows, "\n"))
        .when(kind == "epub", F.array_join(F.transform(readers.epub_chapters(parts), lambda x: x["text"]), "\n"))
        .when(kind == "doc", F.array_join(legacy.doc_lines(F.col("_doc.text")), "\n"))
        .when(kind == "rtf", F.col("_rtf"))
        .when(kind == "pdf", F.array_join(F.transform("_pdf.pages", lambda runs: readers.joined_runs(runs)), PAGE_BREAK))
    )
    readable = (F.col("_family") == "text") | kind.isin("docx", "pptx", "odt", "odp", "ods", "epub", "doc", "rtf", "pdf")
    empty = (kind == "docx") & docx.isNull() | kind.isin("odt", "odp", "ods") & body.isNull()
    code = F.when(~readable, "UNSUPPORTED_FILE_TYPE").when(F.col("_none"), "CORRUPT_FILE").otherwise(F.coalesce("_p.error_code", "_doc.error_code", "_pdf.error_code", F.when(empty, "CORRUPT_FILE")))
    # Exploded, so that the text is made once and not inside each expression that masks it.
    out = opened.select(F.explode(F.array(F.struct("id", "kind", text.alias("text"), code.alias("error_code")))).alias("_x")).select("_x.*")
    of = lambda *kinds: files.filter(kind.isin(*kinds))
    sheets = readers.xlsx(of("xlsx")).unionByName(legacy.xls(of("xls")))
    failed = sheets.groupBy("id").agg(F.max("error_code").alias("error_code"))
    rows = paging.sheet_rows(sheets, ["id", "sheet"])
    grouped = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sheet", "row_no", "text"))).alias("_t"))
    joined = failed.join(grouped, "id", "left").join(of("xlsx", "xls").select("id", "kind"), "id")
    return out.unionByName(joined.select("id", "kind", F.array_join(F.transform("_t", lambda x: x["text"]), "\n").alias("text"), "error_code"))


def list_archive(requests: DataFrame, refs: DataFrame, blobs: DataFrame, prefix: str | None = None, cursor: int = 0, limit: int = 100, sessions: DataFrame | None = None) -> DataFrame:
    """A page of entries for each allowed request (``session_id``, ``id``) for an archive."""
    allowed = store.authorize(requests, refs, sessions).filter("error_code IS NULL")
    opened = allowed.select("id", "sha256").distinct().join(blobs.select("sha256", "content"), "sha256")
    return archives.listing(archives.entries(opened), ["id"], prefix, cursor, limit)


def read_entries(asked: DataFrame, archives_of: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """``asked`` (``id``, ``archive_path``, and ``offset`` if given) with the masked text of each readable entry, ``kind`` and ``error_code``.

    From byte ``offset`` on within the limits of a reply; ``has_more`` and ``next`` say whether and where to go on.
    """
    if "offset" not in asked.columns:
        asked = asked.withColumn("offset", F.lit(0).cast("long"))
    found = archives.extract(asked, archives_of)
    named = found.withColumns({"name": F.col("archive_path"), "declared_mime": F.lit("")})
    seen = detect(named, content_col="entry").drop("name", "declared_mime", "safe_name")
    entry = F.sha1(F.concat_ws("\0", F.col("id").cast("string"), "archive_path"))
    seen = seen.withColumn("_entry", entry)
    texts = document_texts(seen.filter("error_code IS NULL AND detected.readable").select(F.col("_entry").alias("id"), F.col("detected.kind").alias("kind"), F.col("detected.family").alias("family"), F.col("entry").alias("content")).dropDuplicates(["id"]))
    texts = masked(texts.select(F.col("id").alias("_entry"), "text", F.col("error_code").alias("_failed")))
    joined = seen.join(texts, "_entry", "left")
    code = F.coalesce("error_code", "_failed", F.when(~F.col("detected.readable"), "UNSUPPORTED_FILE_TYPE"))
    own = paging.byte_window(F.coalesce("_r.text", F.lit("")), F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)).cast("int"), limits.page_lines, limits.page_bytes)
    joined = joined.withColumn("_w", F.when(F.col("_r.text").isNotNull(), own))
    return joined.select("id", "archive_path", F.when(F.col("error_code").isNull(), F.col("detected.kind")).alias("kind"), "_w.text", F.col("_r.redacted").alias("redacted"), "_w.has_more", F.col("_w.next_offset").alias("next"), code.alias("error_code"))

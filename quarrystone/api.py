"""The engine's three calls over refs and blobs, and SQL functions for the same work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import redaction
from quarrystone.functions.redaction import redacted
from quarrystone.limits import LIMITS, Limits
from quarrystone.operators import paging, store, tables
from quarrystone.plans import lifecycle
from quarrystone.plans.texts import TextStore
from quarrystone.sources import readers


@dataclass
class Attachments:
    refs: DataFrame
    blobs: DataFrame
    sessions: DataFrame | None = None
    #: Where texts are kept; null: every read opens its contents.
    kept: TextStore | None = None

    def info(self, session: str, attachment_id: str | None = None, file_name: str | None = None) -> DataFrame:
        """One ref by id, the newest by exact name, or all of the session, newest first."""
        own = store.living(store.valid_refs(self.refs).filter(F.col("owner_session_id") == session), self.sessions, "owner_session_id")
        if attachment_id:
            return own.filter(F.col("id") == attachment_id)
        if file_name:
            return store.latest_by_name(own.filter(F.col("safe_name") == file_name))
        return store.session_listing(own)

    def _ask(self, session: str, attachment_id: str, **more) -> DataFrame:
        rows = self.refs.sparkSession.range(1).select(F.lit(session).alias("session_id"), F.lit(attachment_id).alias("id"), *[F.lit(v).alias(k) for k, v in more.items()])
        return rows

    def read_lines(self, session: str, attachment_id: str, page: int = 1) -> DataFrame:
        """A page of at most 2,000 lines of the masked text."""
        return lifecycle.governed_read(self._ask(session, attachment_id, page=page or 1), self.refs, self.blobs, self.sessions, kept=self.kept)

    def read(self, session: str, attachment_id: str, offset: int = 0, page: int | None = None, page_end: int | None = None, paragraph_offset: int | None = None, paragraph_limit: int | None = None, sheet: str | None = None, range: str | None = None, archive_path: str | None = None) -> DataFrame:
        """A window of the masked text: by byte, page, paragraph, cell range or archive entry, as the kind of file has it."""
        if archive_path:
            return self.read_archive_entry(session, attachment_id, archive_path, offset)
        if sheet or range:
            return self.read_cells(session, attachment_id, sheet, range)
        asked = {"offset": offset, "page": page, "page_end": page_end, "paragraph_offset": paragraph_offset, "paragraph_limit": paragraph_limit}
        rows = self._ask(session, attachment_id).withColumns({k: F.lit(v).cast("long") for k, v in asked.items()})
        return lifecycle.read_window(rows, self.refs, self.blobs, self.sessions, kept=self.kept)

    def read_cells(self, session: str, attachment_id: str, sheet: str | None = None, cells: str | None = None, limits: Limits = LIMITS) -> DataFrame:
        """Rows of a sheet's range, masked: those that fit into a reply; ``next_row`` is the first that did not."""
        allowed = store.authorize(self._ask(session, attachment_id), self.refs, self.sessions).filter("error_code IS NULL")
        found = readers.xlsx(allowed.select("id", "sha256").join(self.blobs, "sha256"))
        found = found.filter(F.col("sheet") == sheet) if sheet else found
        rows = paging.sheet_rows(paging.cells_in(found, cells), ["id", "sheet"])
        # The range is masked as a whole, so that what spans rows is caught; its rows are the lines of that.
        whole = rows.groupBy("id", "sheet").agg(F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("_rows"))
        lines = F.split(redacted(F.array_join(F.transform("_rows", lambda x: F.regexp_replace(x["text"], r"\r?\n", " ")), "\n"))["text"], "\n", -1)
        window = paging.window_of(F.col("_masked"), 0, limits.page_lines, limits.page_lines, limits.page_bytes)
        made = whole.select("id", "sheet", "_rows", lines.alias("_masked")).withColumn("_w", window)
        row = lambda x, k: F.struct(x["row_no"].alias("row_no"), F.get("_masked", k).alias("text"))
        kept = F.transform(F.slice("_rows", F.lit(1), F.col("_w.n").cast("int")), row)
        following = F.get("_rows", F.col("_w.next_offset").cast("int"))["row_no"].alias("next_row")
        return made.select("id", "sheet", F.explode_outer(kept).alias("_row"), following, F.col("_w.error_code").alias("error_code")).select("id", "sheet", "_row.*", "next_row", "error_code")

    def publish(self, requests: str, name: str) -> DataFrame:
        """A temporary view ``name`` of the answers to a table or view of requests, to be joined and filtered in SQL.

        The requests hold ``session_id``, ``id`` and any of ``offset``, ``page``, ``page_end``, ``paragraph_offset`` and
        ``paragraph_limit``.  Only contents that some request may read are opened, when the view is queried.
        """
        rows = self.refs.sparkSession.table(requests)
        for column in ("offset", "page", "page_end", "paragraph_offset", "paragraph_limit"):
            rows = rows.withColumn(column, (F.col(column) if column in rows.columns else F.lit(None)).cast("long"))
        answers = lifecycle.read_window(rows, self.refs, self.blobs, self.sessions, kept=self.kept)
        answers.createOrReplaceTempView(name)
        return answers

    def list_archive(self, session: str, attachment_id: str, prefix: str | None = None, cursor: int = 0, limit: int = 100) -> DataFrame:
        return lifecycle.list_archive(self._ask(session, attachment_id), self.refs, self.blobs, prefix, cursor, limit, self.sessions)

    def read_archive_entry(self, session: str, attachment_id: str, path: str, offset: int = 0) -> DataFrame:
        allowed = store.authorize(self._ask(session, attachment_id, archive_path=path, offset=offset), self.refs, self.sessions).filter("error_code IS NULL")
        held = allowed.select("id", "sha256").join(self.blobs, "sha256").select("id", "content")
        return lifecycle.read_entries(allowed.select("id", "archive_path", "offset"), held)


def register(spark: SparkSession) -> None:
    """SQL functions ``json_redacted(text)`` (null where nothing is masked), ``rtf_text(bytes)`` and ``decoded_text(bytes)``, and the table functions."""
    tables.register(spark)
    spark.udf.register("json_redacted", redaction._json_masked.made())
    spark.udf.register("rtf_text", readers.rtf.made())
    spark.udf.register("decoded_text", readers.decoded.made())

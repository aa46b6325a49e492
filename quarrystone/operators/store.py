"""Content-addressed store: hashing, de-duplication, quotas, refs, look-ups, ownership.

Contents are read once, to be hashed; all else works on narrow refs.  Nothing collects a session or a batch: latest rows
are aggregates; ranks and quotas have a plan for sessions and batches that are too large for one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.names import ID, attachment_id, sanitize_filename, storage_path
from quarrystone.limits import LIMITS, Limits
from quarrystone.operators.running import HOT, running, written_once

BATCH = ["session_id", "batch_id"]


def hashed(uploads: DataFrame, content_col: str = "content") -> DataFrame:
    """``uploads`` with ``sha256`` and ``bytes``."""
    return uploads.withColumns({"sha256": F.sha2(F.col(content_col), 256), "bytes": F.octet_length(F.col(content_col)).cast("long")})


def new_blobs(uploads: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """One row for each content that ``blobs`` does not have yet: ``sha256``, ``bytes``, ``content``.

    Hashes already stored are left out first; of equal contents in a task only one enters the shuffle.
    """
    found = uploads if blobs is None else uploads.join(blobs.select("sha256"), "sha256", "left_anti")
    return found.select("sha256", "bytes", "content").dropDuplicates(["sha256"])


def oversize(family: Column, size: Column, limits: Limits = LIMITS) -> Column:
    """The error code of a file that is too large for its family, else null."""
    return F.when(size > limits.archive_bytes, "FILE_TOO_LARGE").when((family != "archive") & (size > limits.file_bytes), "FILE_TOO_LARGE")


def admit(uploads: DataFrame, order_col: str = "seq", size_col: str = "bytes", limits: Limits = LIMITS, hot: int = HOT) -> DataFrame:
    """``uploads`` with ``error_code``: in arrival order, a file is taken while its batch has room in number and bytes.

    What is rejected uses no quota, so this is a fold, not a running sum.  Rows are sorted by batch and order and the fold
    keeps three numbers, so a batch streams through its task.  Where a count shows a batch of more than ``hot`` rows, the
    quota is filled in rounds instead: as a batch takes at most so many files, in as many rounds each takes its first file
    that still fits, which is a minimum and combines before the shuffle; no batch is sorted or kept together.

    A null size counts nothing; null sessions and batches are a batch; files that tie in the order come as they are read.
    """
    kept = list(dict.fromkeys([*BATCH, order_col, size_col, *(c for c in uploads.columns if c != "content")]))
    uploads = uploads.select(*kept)  # contents take no part in the fold
    largest = uploads.groupBy(*BATCH).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > hot:
        return _admitted_in_rounds(uploads, order_col, size_col, limits)
    rows = uploads.repartition(*BATCH).sortWithinPartitions(*BATCH, order_col)
    files, most = limits.batch_files, limits.batch_bytes

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count, used = (), 0, 0
        for pdf in batches:
            codes = []
            named = [pdf[c].astype(object).where(pdf[c].notna(), None) for c in BATCH]
            for session, batch, size in zip(*named, pdf[size_col].fillna(0), strict=True):
                if (session, batch) != key:
                    key, count, used = (session, batch), 0, 0
                if count >= files or used + size > most:
                    codes.append("MESSAGE_FILES_TOO_LARGE")
                else:
                    codes.append(None)
                    count, used = count + 1, used + size
            yield pdf.assign(error_code=codes)

    return rows.mapInPandas(fold, f"{_ddl(uploads)}, error_code string")


def _admitted_in_rounds(uploads: DataFrame, order_col: str, size_col: str, limits: Limits) -> DataFrame:
    rows = written_once(uploads.withColumn("__row", F.monotonically_increasing_id()))
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    narrow = rows.select(*BATCH, F.struct(F.col(order_col).alias("o"), F.col("__row").alias("r")).alias("at"), size.alias("size")).filter(F.col("size") <= limits.batch_bytes)
    taken = state = None
    for _ in range(limits.batch_files):
        left = narrow.withColumn("used", F.lit(0).cast("long"))
        if state is not None:
            held = state.toDF("_s", "_b", "last", "used")
            held = F.broadcast(held) if state.limit(100_001).count() <= 100_000 else held
            same = F.col("session_id").eqNullSafe(F.col("_s")) & F.col("batch_id").eqNullSafe(F.col("_b"))
            left = narrow.join(held, same & (F.col("at") > F.col("last")) & (F.col("size") + F.col("used") <= limits.batch_bytes))
        first = left.groupBy(*BATCH).agg(F.min(F.struct("at", "size")).alias("first"), F.max("used").alias("used"))
        state = written_once(first.select(*BATCH, F.col("first.at").alias("last"), (F.col("used") + F.col("first.size")).alias("used")))
        if state.isEmpty():
            break
        own = state.select(F.col("last.r").alias("_taken"))
        taken = own if taken is None else taken.unionByName(own)
    if taken is None:
        return uploads.withColumn("error_code", F.lit("MESSAGE_FILES_TOO_LARGE"))
    code = F.when(F.col("_taken").isNull(), "MESSAGE_FILES_TOO_LARGE")
    return rows.join(taken, F.col("__row") == F.col("_taken"), "left").withColumn("error_code", code).drop("__row", "_taken")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def make_refs(uploads: DataFrame) -> DataFrame:
    """Refs of admitted uploads (``session_id, batch_id, seq, name, declared_mime, detected, bytes, sha256, created_at``)."""
    return uploads.select(
        attachment_id(F.col("session_id"), F.col("batch_id"), F.col("seq")).alias("id"),
        F.col("session_id").alias("owner_session_id"),
        "batch_id",
        sanitize_filename(F.coalesce("name", F.lit(""))).alias("safe_name"),
        "declared_mime",
        *(["detected"] if "detected" in uploads.columns else []),
        "bytes",
        "sha256",
        "created_at",
        storage_path(F.col("sha256")).alias("storage_path"),
    )


def valid_refs(refs: DataFrame) -> DataFrame:
    """Refs that are whole; what is not reads as absent.  A missing storage path is made anew."""
    whole = F.col("id").rlike(ID) & F.col("owner_session_id").isNotNull() & F.col("batch_id").isNotNull() & F.col("sha256").rlike("^[a-f0-9]{64}$") & (F.col("bytes") >= 0)
    return refs.filter(whole).withColumn("storage_path", F.coalesce("storage_path", storage_path(F.col("sha256"))))


def opened(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Refs with their content; ``error_code`` where the blob is missing."""
    found = refs.join(blobs.select("sha256", "content"), "sha256", "left")
    return found.withColumn("error_code", F.when(F.col("content").isNull(), "CORRUPT_FILE"))


def latest_by_name(refs: DataFrame, session: str = "owner_session_id", name: str = "safe_name", at: str = "created_at", key: str = "id") -> DataFrame:
    """The newest ref of each (session, name); the larger id among equals.  An aggregate, so it combines before the shuffle."""
    rest = [c for c in refs.columns if c not in (session, name)]
    newest = refs.groupBy(session, name).agg(F.max_by(F.struct(*rest), F.struct(at, key)).alias("_newest"))
    return newest.select(session, name, "_newest.*").select(*refs.columns)


def session_listing(refs: DataFrame, session: str = "owner_session_id", at: str = "created_at", key: str = "id", most: int | None = None, hot: int = HOT) -> DataFrame:
    """Refs with ``position``, newest first within their session, whatever a session holds."""
    ranked = running(refs, [session], [F.desc(at), F.desc(key)], hot=hot)
    return ranked if most is None else ranked.filter(F.col("position") <= most)


def batch_listing(batches: DataFrame, refs: DataFrame) -> DataFrame:
    """The refs of each batch (``session_id``, ``batch_id``, ``ids``) in the order of its ids, with ``position``.

    Ids without a ref, and refs of another session or batch, are left out.
    """
    asked = batches.select("session_id", F.col("batch_id").alias("_batch"), F.posexplode("ids").alias("position", "id"))
    found = asked.join(refs, "id").filter((F.col("owner_session_id") == F.col("session_id")) & (F.col("batch_id") == F.col("_batch")))
    return found.select("position", *refs.columns)


def remove_refs(refs: DataFrame, deletes: DataFrame) -> DataFrame:
    """Refs without those that their own session deletes (``session_id``, ``id``); blobs stay."""
    gone = deletes.select(F.col("session_id").alias("owner_session_id"), "id")
    return refs.join(gone, ["owner_session_id", "id"], "left_anti")


def unused_blobs(blobs: DataFrame, refs: DataFrame) -> DataFrame:
    return blobs.join(refs.select("sha256"), "sha256", "left_anti")


def living(requests: DataFrame, sessions: DataFrame | None, session: str = "session_id") -> DataFrame:
    """``requests`` of sessions that exist; all of them where no sessions are given."""
    if sessions is None:
        return requests
    return requests.join(sessions.select(F.col("session_id").alias(session)).distinct(), session, "left_semi")


def authorize(requests: DataFrame, refs: DataFrame, sessions: DataFrame | None = None, key: str = "id") -> DataFrame:
    """``requests`` (``session_id``, ``id``) with their ref's columns and ``error_code``; only owners in living sessions may read.

    The join carries no content, so that contents of refused rows are never read.
    """
    found = requests.join(refs.withColumnRenamed("owner_session_id", "_owner"), key, "left")
    code = F.when(F.col("_owner").isNull() | (F.col("_owner") != F.col("session_id")), "ATTACHMENT_FORBIDDEN")
    if sessions is not None:
        living = sessions.select("session_id").distinct().withColumn("_living", F.lit(True))
        found = found.join(living, "session_id", "left")
        code = F.coalesce(code, F.when(F.col("_living").isNull(), "ATTACHMENT_FORBIDDEN"))
    return found.withColumn("error_code", code).drop("_owner", "_living")

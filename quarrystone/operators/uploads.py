"""Upload requests: what headers must say, which files go where, and replies as JSON.  All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.names import HEADER_ID, error_status, trusted_origin
from quarrystone.limits import LIMITS, Limits

# Types that a client shows by itself.
NATIVE_IMAGES = ("image/png", "image/jpeg", "image/gif", "image/webp", "image/avif")


def decoded_name(header: Column) -> Column:
    """A file name from its percent-encoded header; a plus sign stays; null where it is malformed."""
    return F.try_url_decode(F.replace(header, F.lit("+"), F.lit("%2B")))


def checked(requests: DataFrame, sessions: DataFrame | None = None, limits: Limits = LIMITS) -> DataFrame:
    """``requests`` (``origin``, ``host``, ``session_id``, ``batch_id``, ``file_name``, ``content_length``) with ``name``, ``error_code`` and ``status``.

    An upload must name its origin; a size that is not declared passes here and is measured later.
    """
    given = F.col("session_id").rlike(HEADER_ID) & F.col("batch_id").rlike(HEADER_ID) & (F.col("file_name") != "")
    trusted = F.coalesce(trusted_origin(F.col("origin"), F.col("host")), F.lit(False))
    name = decoded_name(F.col("file_name"))
    forbidden = F.lit("ATTACHMENT_FORBIDDEN")
    said = lambda code, status: F.struct(code.alias("code"), F.lit(status).alias("status"))
    living = F.lit(True)
    if sessions is not None:
        requests = requests.join(sessions.select("session_id").distinct().withColumn("_living", F.lit(True)), "session_id", "left")
        living = F.col("_living").isNotNull()
    refused = (
        F.when(~trusted, said(forbidden, 403))
        .when(~F.coalesce(given, F.lit(False)), said(forbidden, 400))
        .when(~living, said(forbidden, 403))
        .when(F.col("content_length") > limits.file_bytes, said(F.lit("FILE_TOO_LARGE"), 413))
        .when(name.isNull(), said(forbidden, 400))
    )
    found = requests.withColumn("_refused", refused)
    name = F.when(F.col("_refused").isNull(), name)
    return found.withColumns({"name": name, "error_code": F.col("_refused.code"), "status": F.coalesce("_refused.status", F.lit(201))}).drop("_refused", "_living")


def may_touch(origin: Column, host: Column) -> Column:
    """Whether a read or a removal may go on: what names no origin may, what names one must be trusted."""
    return origin.isNull() | F.coalesce(trusted_origin(origin, host), F.lit(False))


def native_image(mime: Column) -> Column:
    return F.coalesce(mime.isin(*NATIVE_IMAGES), F.lit(False))


def by_handling(files: DataFrame, mime: str = "mime") -> tuple[DataFrame, DataFrame]:
    """(generic files, native images): two filters that share no row and leave none out."""
    own = native_image(F.col(mime))
    return files.filter(~own), files.filter(own)


def client_guard(mime: Column, size: Column, limits: Limits = LIMITS) -> Column:
    """Why a client does not send a file, or null."""
    return F.when(F.startswith(mime, F.lit("image/")), "UNSUPPORTED_FILE_TYPE").when(size > limits.file_bytes, "FILE_TOO_LARGE")


def lossless_json(value: Column) -> Column:
    """JSON in which absent fields are left out and absent items of arrays are null."""
    return F.to_json(value, {"ignoreNullFields": "true"})


def reply(value: Column, code: Column) -> Column:
    """Struct ``status``, ``body``: the value, or the error, as a JSON reply."""
    failed = F.struct(F.lit(False).alias("ok"), F.struct(code.alias("code")).alias("error"))
    done = F.struct(F.lit(True).alias("ok"), value.alias("metadata"))
    return F.struct(F.when(code.isNull(), 200).otherwise(error_status(code)).alias("status"), F.when(code.isNull(), lossless_json(done)).otherwise(lossless_json(failed)).alias("body"))

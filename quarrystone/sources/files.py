"""Files as uploads, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.limits import LIMITS

UPLOAD = ["session_id", "batch_id", "seq", "name", "declared_mime", "content", "created_at"]


def read_files(spark: SparkSession, path: str, most: int = LIMITS.archive_bytes, glob: str | None = None) -> DataFrame:
    """``path, name, length, modified, content`` of the files under ``path``; too long ones are never opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return _named((reader.option("pathGlobFilter", glob) if glob else reader).load(path), most)


def stream_files(spark: SparkSession, path: str, most: int = LIMITS.archive_bytes, per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of new files."""
    schema = spark.read.format("binaryFile").load(path).schema
    return _named(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path), most)


def _named(files: DataFrame, most: int) -> DataFrame:
    return files.filter(F.col("length") <= most).select("path", F.substring_index("path", "/", -1).alias("name"), "length", F.col("modificationTime").alias("modified"), "content")


def as_uploads(files: DataFrame, manifest: DataFrame | None = None, session: Column | None = None, batch: Column | None = None) -> DataFrame:
    """Uploads from files: session, batch, sequence and type from ``manifest`` (by ``path``), or from the given columns."""
    if manifest is not None:
        found = files.drop("name").join(manifest, "path") if "name" in manifest.columns else files.join(manifest, "path")
    else:
        found = files.withColumns({"session_id": F.lit("local") if session is None else session, "batch_id": F.lit("local") if batch is None else batch, "declared_mime": F.lit("")})
        found = found.withColumn("seq", F.unix_micros("modified"))
    return found.withColumn("created_at", F.unix_millis("modified")).select(*UPLOAD)


def head(files: DataFrame, n: int = LIMITS.head_bytes) -> DataFrame:
    return files.withColumn("head", F.substring("content", 1, n))

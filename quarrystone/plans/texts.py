"""Texts that readers have made of contents, kept so that no content is opened twice.

A table in a folder, one part for each version of the readers: ``sha256, kind, text``.  What is asked for is looked up by
content hash and kind; only contents without a row are joined and opened, and what is read of them is appended.  Failures
are not kept, so a content that could not be read is tried again.  Texts are kept as the readers give them and are masked
after that, so a change of what is masked needs no new reading.

Two runs at once may both append a text; the rows are the same and are read as one.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: To be raised when a reader gives other texts than before.
READERS = 1
SCHEMA = "sha256 string, kind string, text string"


class TextStore:
    def __init__(self, spark: SparkSession, folder: str, version: int = READERS):
        self.spark, self.path = spark, f"{folder}/readers={version}"

    def known(self) -> DataFrame:
        try:
            found = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/*/failed=false")
        except AnalysisException:  # nothing is kept yet
            return self.spark.createDataFrame([], SCHEMA)
        return found.dropDuplicates(["sha256", "kind"])

    def read(self, needed: DataFrame, blobs: DataFrame, reader) -> DataFrame:
        """``sha256, kind, text, error_code`` of ``needed`` (``sha256``, ``kind``, ``family``).

        ``reader`` makes ``id, kind, text, error_code`` of opened files (``id, kind, family, content``).
        """
        wanted = needed.select("sha256", "kind", "family").dropDuplicates(["sha256", "kind"])
        unseen = wanted.join(self.known().select("sha256", "kind"), ["sha256", "kind"], "left_anti")
        opened = unseen.join(blobs.select("sha256", "content"), "sha256", "left").withColumn("id", F.col("sha256"))
        made = reader(opened).select(F.col("id").alias("sha256"), "kind", "text", "error_code")
        folder = f"{self.path}/{uuid4().hex}"  # one pass over the contents writes texts and failures side by side
        made.withColumn("failed", F.col("error_code").isNotNull()).write.partitionBy("failed").parquet(folder)
        failed = self.spark.read.schema(f"{SCHEMA}, error_code string").parquet(folder).filter("error_code IS NOT NULL")
        found = wanted.select("sha256", "kind").join(self.known(), ["sha256", "kind"])
        return found.select("sha256", "kind", "text", F.lit(None).cast("string").alias("error_code")).unionByName(failed.select("sha256", "kind", "text", "error_code"))

"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only if a count has shown that it has at most so many rows of a few numbers each.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The column's text, null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves in local mode, as in tests; on a cluster it is an error.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored`` and the path, for ``forget``."""
    path = f"{shared_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str | None) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    if path:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder all executors share, so that it is computed once and survives their loss."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ids_name_rows(docs: DataFrame, id_col: str) -> bool:
    """Whether every row has an id and no two rows have the same."""
    return docs.groupBy(F.col(id_col).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("k IS NULL OR n > 1").isEmpty()


def slices(batch, rows: int = 256):
    """Parts of an Arrow batch, without copies: so many rows are Python values at one time."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def numbered(docs: DataFrame) -> DataFrame:
    """``_row`` and ``_doc`` (the whole row): rows with numbers of their own, written once so that the numbers stay."""
    return cut(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc")))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows; else as it is, for a shuffled join.

    Only for narrow tables that have been cut already, as they are counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

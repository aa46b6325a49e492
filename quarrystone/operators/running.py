"""Running sums and positions within groups, of which one may hold most rows.

A window puts a group into one task.  Where a count shows a group of more than ``hot`` rows, the rows are sorted over
ranges instead, which may end inside a group; each range sums its part of a group, the parts' sums give every later part
its start, and the rest is a window over the parts.  Results are the same; which plan is taken is a question of size.

Defined cases: a null group is a group; rows that tie in the order come in the order they are read; null values count
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.streaming.announce import stream_folder

#: Rows that a window takes into one task.
HOT = 1_000_000


def written_once(df: DataFrame) -> DataFrame:
    """``df`` in the folder all executors share, with its partitions as they are."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(stream_folder(spark))
    return df.checkpoint()


def running(rows: DataFrame, group: list[str], order: list[Column], value: Column | None = None, name: str = "position", hot: int = HOT) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (by default 1, so a position) over the group's rows up to this one."""
    value = F.lit(1).cast("long") if value is None else F.coalesce(value.cast("long"), F.lit(0))
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    if (sizes.largest or 0) <= hot:
        return rows.withColumn(name, F.sum(value).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes.total * 4 // hot))
    by = [F.col(c).asc_nulls_first() for c in group] + order
    valued = rows.withColumns({"__value": value, "__row": F.monotonically_increasing_id()})
    parts = written_once(valued.repartitionByRange(ranges, *by, "__row").sortWithinPartitions(*by, "__row")).withColumn("__part", F.spark_partition_id())
    sums = parts.groupBy("__part", *group).agg(F.sum("__value").alias("__sum"))
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    held = [f"__of{k}" for k in range(len(group))]
    starts = sums.select(F.col("__part").alias("__in"), *[F.col(c).alias(h) for c, h in zip(group, held, strict=True)], F.sum("__sum").over(before).alias("__start"))
    starts = written_once(starts.filter("__start <> 0"))  # of groups that go on in a range: one row for a range at most
    inside = W.partitionBy("__part", *group).orderBy(*order, "__row").rowsBetween(W.unboundedPreceding, 0)
    local = parts.withColumn(name, F.sum("__value").over(inside))
    on = F.col("__part") == F.col("__in")
    for c, h in zip(group, held, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(h))
    joined = local.join(F.broadcast(starts) if ranges <= 100_000 else starts, on, "left")
    return joined.withColumn(name, F.col(name) + F.coalesce("__start", F.lit(0))).select(*rows.columns, name)

"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (by a digest of their id) and may be repeated up to three times.
A document's virtual finish time is the source's words up to its end, divided by the source's target; all sources that
are served in proportion to their targets finish a word share at the same virtual time.  The copies of all documents are
sorted by finish time and the mix ends where the total budget is used up.

Running totals never put a source, or all rows, in one task: words are first summed by (source, slice of the digest) or
by slice of the virtual time, the small tables of sums give each slice its start, and only the rest is summed inside a
slice.  A source with a third of all rows is spread over 4,096 slices.

Targets: sources, by code point and null last, weigh 5, 2, 1 and so on again, and share the budget; a target stops at
three times its source's size and the excess goes to the others by weight until none is above.  That water level has a
closed form over the sources sorted by size over weight.

Defined cases: a null text has size 0; a document of size 0 takes nothing; a source without words has target 0; ties in
the shuffled order are broken by id and size; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.llm.common import WORD, cut, ids_name_rows, numbered, text_of

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Hex digits of the digest that name a slice, and slices of a unit of virtual time.
DIGITS, TICKS = 3, 4096


def source_targets(base: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``target`` (double): one row for each source of ``base`` (``source``, ``size``)."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    sizes = sizes.select("source", "source_size", "_n", weight.cast("long").alias("_w"), (F.col("source_size") * repeats).alias("_cap"))
    order = W.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_n").asc())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everywhere = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = sizes.select("*", left.alias("_left"), F.sum("_w").over(after).alias("_weights"))
    capped = F.col("_cap") * F.col("_weights") <= F.col("_left") * F.col("_w")
    share = F.when(~capped, F.col("_left").cast("double") / F.col("_weights").cast("double"))
    level = level.select("source", "source_size", "_n", "_w", "_cap", capped.alias("_capped"), F.first(share, ignorenulls=True).over(everywhere).alias("_level"))
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_level"))
    return level.select("source", F.col("_n").alias("source_rank"), "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row for each input row: id, ``size`` (words), ``source_size``, ``target``, ``taken`` (words the mix takes of it)."""
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.col(id_col).cast("string")).alias("_key"),
    )
    base = cut(base.withColumn("_key", F.coalesce("_key", F.lit("g"))).withColumn("_slice", F.substring("_key", 1, DIGITS)))
    targets = source_targets(base, weights, repeats)
    slices = base.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    starts = slices.select("source", "_slice", (F.sum("_sum").over(W.partitionBy("source").orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).alias("_start"))
    inside = W.partitionBy("source", "_slice").orderBy("_key", F.col("_id").asc_nulls_last(), "size", "_row").rowsBetween(W.unboundedPreceding, 0)
    placed = base.withColumn("_inside", F.sum("size").over(inside))
    placed = _with(_with(placed, starts, ["source", "_slice"]), targets, ["source"])
    copies = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_copy"))
    finish = (F.col("_copy") * F.col("source_size") + F.col("_start") + F.col("_inside")).cast("double") / F.when(F.col("target") > 0, F.col("target"))
    copies = copies.withColumn("_finish", F.coalesce(finish, F.lit(float("inf"))))
    # What finishes after time 2 would give a source twice its target and is never reached.
    copies = cut(copies.filter("_finish <= 2").select("_row", "size", "source_rank", "_key", "_id", "_copy", "_finish", F.floor(F.col("_finish") * TICKS).alias("_tick")))
    ticks = copies.groupBy("_tick").agg(F.sum("size").alias("_sum"))
    ticks = ticks.select("_tick", (F.sum("_sum").over(W.orderBy("_tick").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).alias("_start"))
    order = W.partitionBy("_tick").orderBy("_finish", "source_rank", "_key", F.col("_id").asc_nulls_last(), "size", "_copy", "_row").rowsBetween(W.unboundedPreceding, 0)
    queue = copies.withColumn("_inside", F.sum("size").over(order)).join(F.broadcast(ticks), "_tick")  # 2 * TICKS + 1 rows at most
    budget = base.agg(F.sum("size").alias("_budget"))  # one row
    taken = queue.join(F.broadcast(budget)).filter(F.col("_start") + F.col("_inside") <= F.col("_budget")).groupBy("_row").agg(F.sum("size").alias("_taken"))
    result = _with(base, targets, ["source"]).join(taken, "_row", "left")
    return result.select(F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on ``keys``, in which null equals null."""
    right = right.select([F.col(c).alias(f"_{c}_r") if c in keys else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(right[f"_{k}_r"]) for k in keys]
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    return left.join(right, condition).drop(*[f"_{k}_r" for k in keys])


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as many times as it is repeated.

    Where ids are null or repeat, rows are told apart by numbers given to them.
    """
    if ids_name_rows(docs, id_col):
        rows, key = docs.select(F.col(id_col).alias("_row"), F.struct("*").alias("_doc")), docs.select(F.col(id_col).alias("_row"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    else:
        rows = numbered(docs)
        key = rows.select("_row", F.col("_doc")[text_col].alias("_text"), F.col("_doc")[source_col].alias("_source"))
    chosen = mix_sources(key, "_row", "_text", "_source").filter("taken > 0").select(F.col("_row").alias("_chosen"), (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    taken = rows.join(chosen, F.col("_row") == F.col("_chosen"))
    return taken.select(F.explode(F.array_repeat("_doc", F.col("_times"))).alias("row")).select("row.*")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS k
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM s0),
s2 AS (SELECT *, ([5, 2, 1])[(n - 1) % 3 + 1]::BIGINT AS w, source_size * 3 AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft,
              (sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws FROM s2),
s4 AS (SELECT *, cap * ws <= lft * w AS capped, lft::DOUBLE / ws::DOUBLE AS lev FROM s3),
s5 AS (SELECT source, n, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE w * (SELECT arg_min(lev, cap / w) FILTER (NOT capped) FROM s4) END AS target FROM s4),
p AS (SELECT doc_id, b.source, size, k, n, source_size, target,
             (sum(size) OVER (PARTITION BY b.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
      FROM base b JOIN s5 ON b.source IS NOT DISTINCT FROM s5.source),
c AS (SELECT *, (e * source_size + cum)::DOUBLE / target AS finish FROM p, (VALUES (0), (1), (2)) v(e) WHERE target > 0),
q AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, n, k, doc_id, size, e ROWS UNBOUNDED PRECEDING) AS upto FROM c WHERE finish <= 2),
t AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM q WHERE upto <= (SELECT sum(size) FROM base) GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN t USING (doc_id)
"""

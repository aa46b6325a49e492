"""Exact de-duplication: 128-bit content hash, smallest id stays, bytes compared inside groups.

Texts are equal when they are the same after each run of white space has become one space (not trimmed).

The grouping key is the pair of the hash and the normalised text itself, so two texts that share a hash are still
compared byte by byte and stay apart.  Copies are combined before the shuffle: a text that fills a third of the table
sends one row a task.  The rows then meet their group's decision in a join on two digests; where one group is very
large, the join's hot partition holds narrow rows only and is split by adaptive execution.

Defined cases: a null text is empty; empty texts are copies of each other; a null id sorts after every other and is
kept only if its group has no other; rows that repeat id and text are the same document, counted each and marked alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import BLANK, text_of


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.regexp_replace(text_of(text_col), f"{BLANK}+", " ").alias("_text"))
    return rows.select("_id", "_text", F.md5("_text").alias("_hash"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the normalised text)."""
    rows = _rows(docs, id_col, text_col)
    groups = (
        rows.groupBy("_hash", "_text")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    members = rows.select("_id", "_hash", F.sha2("_text", 256).alias("text_sha256"))
    return members.join(groups, ["_hash", "text_sha256"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one for each distinct normalised text, with the least id of its rows."""
    rows = _rows(docs, id_col, text_col)
    kept = rows.groupBy("_hash", "_text").agg(F.min("_id").alias("_kept")).select("_kept", F.col("_hash").alias("_kept_hash"), F.sha2("_text", 256).alias("_kept_sha"))
    # An id says nothing of the text where it is null or repeats, so the text's digests are part of the key.
    text = F.regexp_replace(text_of(text_col), f"{BLANK}+", " ")
    named = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_own"), F.md5(text).alias("_own_hash"), F.sha2(text, 256).alias("_own_sha"))
    same = F.col("_own").eqNullSafe(F.col("_kept")) & (F.col("_own_hash") == F.col("_kept_hash")) & (F.col("_own_sha") == F.col("_kept_sha"))
    return named.join(kept, same, "left_semi").dropDuplicates(["_own_hash", "_own_sha"]).select("_row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

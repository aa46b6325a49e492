"""Session logs: announcements, receipts, draft batches, read signals.

Each is a join, an aggregate or a window over a session's events; the streaming form of announcements is in
``quarrystone.streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.names import ID_IN_TEXT, receipt_key
from quarrystone.operators.running import HOT, running

PLUGIN = "attachments"


def announced(events: DataFrame, plugin: str = PLUGIN) -> DataFrame:
    """``session_id``, ``id``: the ids that a session's log has announced already (``type``, ``source``, ``content``)."""
    own = events.filter((F.col("type") == "user/message") & (F.col("source.kind") == "plugin") & (F.col("source.plugin") == plugin))
    texts = own.select("session_id", F.explode("content").alias("part")).filter(F.col("part.text").isNotNull())
    return ids_in(texts.select("session_id", F.col("part.text").alias("text")))


def ids_in(texts: DataFrame, text_col: str = "text", pattern: str = ID_IN_TEXT) -> DataFrame:
    """Distinct (``session_id``, ``id``) of all ids that stand in a text."""
    return texts.select("session_id", F.explode(F.regexp_extract_all(text_col, F.lit(f"({pattern})"), 1)).alias("id")).distinct()


def announcement(name: str = "safe_name", key: str = "id", family: str = "family", kind: str = "kind") -> Column:
    """How one attachment is named in an announcement."""
    return F.format_string("%s (%s, %s/%s)", F.col(name), F.col(key), F.col(family), F.col(kind))


def announce(refs: DataFrame, known: DataFrame, session: str = "owner_session_id", at: str = "created_at", key: str = "id", page: int | None = None, hot: int = HOT) -> DataFrame:
    """One row for each session with attachments that are not ``known`` (``session_id``, ``id``) yet: ``session_id``, ``n_fresh``, ``ids``, ``text``.

    Newest first.  Sessions without fresh attachments have no row.  With ``page``, a row has at most so many attachments
    and a session as many rows as it needs, so no row grows with a session.
    """
    fresh = refs.withColumnRenamed(session, "session_id").join(known.select("session_id", key), ["session_id", key], "left_anti")
    item = F.struct(F.col(at), F.col(key), announcement(key=key).alias("said"))
    by = ["session_id"]
    if page:
        by.append("_page")
        fresh = running(fresh, ["session_id"], [F.desc(at), F.desc(key)], name="_place", hot=hot).withColumn("_page", F.floor((F.col("_place") - 1) / page))
    grouped = fresh.groupBy(*by).agg(F.count(F.lit(1)).alias("n_fresh"), F.sort_array(F.collect_list(item), asc=False).alias("_items"))
    return grouped.select("session_id", "n_fresh", F.transform("_items", lambda x: x[key]).alias("ids"), F.array_join(F.transform("_items", lambda x: x["said"]), ", ").alias("text"))


def with_announcements(messages: DataFrame, said: DataFrame) -> DataFrame:
    """``messages`` and one more row for each announcement (columns of ``messages``; others null)."""
    return messages.unionByName(said, allowMissingColumns=True)


def may_announce(messages: DataFrame) -> DataFrame:
    """Sessions whose last message comes from the user (``session_id``, ``seq``, ``source``)."""
    last = messages.groupBy("session_id").agg(F.max_by("source", "seq").alias("_last"))
    return last.filter(F.col("_last.kind") == "user").select("session_id")


def draft_batches(events: DataFrame, session: str = "session_id", order: str = "seq", sends: Column | None = None, hot: int = HOT) -> DataFrame:
    """``events`` with ``batch_no``: each send ends a batch, the next event opens the next one."""
    sends = F.coalesce((F.col("is_send") if sends is None else sends).cast("long"), F.lit(0))
    numbered = running(events, [session], [F.col(order)], sends, "batch_no", hot)
    return numbered.withColumn("batch_no", F.col("batch_no") - sends)


def receipts(events: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """One row for each sent draft with files: ``batch_no``, ``draft`` (its last text), ``files``.

    ``events``: ``is_send``, ``draft`` (text, may be null), ``file`` (uploaded name, may be null).
    """
    batched = draft_batches(events, session, order)
    grouped = batched.groupBy(session, "batch_no").agg(
        F.max_by("draft", F.when(F.coalesce("draft", F.lit("")) != "", F.col(order))).alias("draft"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("file").isNotNull(), F.struct(order, "file")))), lambda x: x["file"]).alias("files"),
        F.max("is_send").alias("_sent"),
    )
    return grouped.filter(F.col("_sent") & (F.size("files") > 0)).drop("_sent")


def match_receipts(found: DataFrame, messages: DataFrame, draft: str = "draft", text: str = "text", session: str | None = "session_id") -> DataFrame:
    """Receipts and the messages of their session with the same text, but for zero-width spaces and outer blanks.

    Where ``messages`` has no column ``session`` (or it is None), messages of all sessions are matched.
    """
    left = found.withColumn("_key", receipt_key(F.col(draft)))
    right = messages.withColumn("_key", receipt_key(F.col(text)))
    return left.join(right, ["_key", session] if session and session in messages.columns and session in found.columns else "_key").drop("_key")


def read_signals(calls: DataFrame, key: str = "session_id", turn: str = "turn") -> DataFrame:
    """``session_id, turn, id, signal``: reading, if a call for the id is under way, else read.

    ``calls``: ``args`` (text with ids), ``state`` (running or done).  The ids are taken out of the text first, so that what
    would be a join on "contains" is one on equality.
    """
    named = calls.select(key, turn, "state", F.explode(F.array_distinct(F.regexp_extract_all("args", F.lit(f"({ID_IN_TEXT})"), 1))).alias("id"))
    rank = F.max(F.when(F.col("state") == "running", 2).otherwise(1))
    return named.groupBy(key, turn, "id").agg(F.when(rank == 2, "reading").otherwise("read").alias("signal"))

"""Announcements and draft batches as streams, with keyed state.

Announcements: each attachment of a session is announced exactly once.  State is a map from a session's announced ids,
so a trigger reads and writes only the ids it meets; a log's announcements are the initial state, a time to live may
forget ids, and Spark's checkpoint is the recovery.  A row that cannot be announced becomes a row with an error code and
does not fail the query.

Draft batches: events are held in a list until the watermark has passed them, then released in order of time and number;
so events that come late, but within the watermark's delay, are numbered as if they had come in order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session_id string, n_fresh long, ids array<string>, text string, error_code string, items array<struct<at:{0},id:string,said:string>>"
#: Attachments of one announcement: a session with more in a trigger gets several, so a task holds no more.
PAGE = 1000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_folder(spark: SparkSession) -> str:
    """Where a stream keeps its state and rows: the folder all executors share; a temporary one only in local mode."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    folder = found.get() if found.isDefined() else context.getConf().get("spark.checkpoint.dir")
    if not folder and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="stream-")


class Announcer(StatefulProcessor):
    """Says which ids of a session are new.  ``ttl_ms``: how long an id is remembered; null: for ever."""

    def __init__(self, page: int = PAGE, ttl_ms: int | None = None):
        self.page, self.ttl_ms = page, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "id string", "said boolean", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for own in initialState["id"]:
            self.known.updateValue((own,), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for pdf in rows:
            for own, name, at, family, kind in zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("id", "safe_name", "created_at", "family", "kind")), strict=True):
                if key[0] is None or own is None or at is None:
                    yield self._row(key[0], None, [own], None, "INVALID_REQUEST", [])
                elif not self.known.containsKey((own,)):
                    self.known.updateValue((own,), (True,))
                    fresh.append((at, own, f"{name} ({own}, {family}/{kind})"))
                    if len(fresh) == self.page:
                        yield self._said(key[0], fresh)
                        fresh = []
        if fresh:
            yield self._said(key[0], fresh)

    def _said(self, session, fresh: list[tuple]) -> pd.DataFrame:
        fresh.sort(reverse=True)  # newest first
        items = [dict(zip(("at", "id", "said"), x, strict=True)) for x in fresh]
        return self._row(session, len(fresh), [x[1] for x in fresh], ", ".join(x[2] for x in fresh), None, items)

    def _row(self, session, n, ids, text, code, items) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [session], "n_fresh": pd.array([n], "Int64"), "ids": [ids], "text": [text], "error_code": [code], "items": [items]})

    def close(self) -> None:
        pass


def announce_stream(refs: DataFrame, session: str = "owner_session_id", known: DataFrame | None = None, page: int = PAGE, ttl_ms: int | None = None) -> DataFrame:
    """One row for each session and trigger with new ids; ``refs``: session, ``id``, ``safe_name``, ``created_at``, ``family``, ``kind``.

    ``known`` (``session_id``, ``id``; see ``sessions.announced``) is what a log shows as announced before the stream began.
    A session with more than ``page`` new ids in a trigger has several rows, each newest first; ``items`` are their parts,
    from which ``whole_announcements`` makes one row for a session.  Rows without session, id or time have ``error_code``.
    """
    spark = refs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the one with maps, timers and times to live
    rows = refs.select(F.col(session).alias("session_id"), "id", "safe_name", "created_at", "family", "kind")
    begun = None if known is None else known.select("session_id", "id").filter("session_id IS NOT NULL AND id IS NOT NULL").groupBy("session_id")
    output = OUTPUT.format(rows.schema["created_at"].dataType.simpleString())
    return rows.groupBy("session_id").transformWithStateInPandas(Announcer(page, ttl_ms), output, "Append", "ProcessingTime" if ttl_ms else "None", begun)


def whole_announcements(rows: DataFrame) -> DataFrame:
    """``session_id``, ``n_fresh``, ``ids``, ``text``: what a stream has said of each session, over all its rows, newest first."""
    items = rows.filter("error_code IS NULL").select("session_id", F.explode("items").alias("_item"))
    grouped = items.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_fresh"), F.sort_array(F.collect_list("_item"), asc=False).alias("_items"))
    return grouped.select("session_id", "n_fresh", F.transform("_items", lambda x: x["id"]).alias("ids"), F.array_join(F.transform("_items", lambda x: x["said"]), ", ").alias("text"))


class Batcher(StatefulProcessor):
    """Numbers a session's events in order of time, once the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "number long")
        self.held = handle.getListState("held", "at long, seq long, is_send boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for pdf in rows:
            new = [(int(a.value // 1_000_000), int(s), bool(x)) for a, s, x in zip(pdf["at"], pdf["seq"], pdf["is_send"].fillna(False), strict=True)]
            self.held.appendList(new)
            times |= {x[0] for x in new}
        if times:  # at the first time something can go; what stays sets the next one
            self.handle.registerTimer(min(times) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.held.get())
        ready, rest = [x for x in held if x[0] < mark], [x for x in held if x[0] >= mark]
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(rest[0][0] + 1)
        else:
            self.held.clear()
        if not ready:
            return
        number = self.number.get()[0] if self.number.exists() else 0
        numbers = []
        for _, _, send in ready:
            numbers.append(number)
            number += send
        self.number.update((number,))
        yield pd.DataFrame({"session_id": key[0], "seq": [x[1] for x in ready], "batch_no": numbers})

    def close(self) -> None:
        pass


def batches_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Draft batches as a stream: events (``session_id``, ``seq``, ``at``, ``is_send``) with their session's batch number.

    An event is released when the watermark, the latest ``at`` less ``delay``, has passed it; of one time, in order of
    ``seq``.  Events that come later than that are left out, as with every watermark.  Null sessions or times are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select("session_id", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "is_send").filter("session_id IS NOT NULL AND at IS NOT NULL")
    return rows.withWatermark("at", delay).groupBy("session_id").transformWithStateInPandas(Batcher(), "session_id string, seq long, batch_no long", "Append", "EventTime")

import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import sessions
from quarrystone.streaming.announce import announce_stream, batches_stream, whole_announcements

REFS = "owner_session_id string, id string, safe_name string, created_at long, family string, kind string"


class Source:
    """Files that arrive, and a stream over them that stops after each trigger and goes on from its checkpoint."""

    def __init__(self, spark, folder, schema, build):
        self.spark, self.folder, self.schema, self.build, self.k = spark, folder, schema, build, 0

    def arrive(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(self.folder / "in" / str(self.k)))
        self.k += 1
        stream = self.build(self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(str(self.folder / "in")))
        query = stream.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress = query.recentProgress
        return self.spark.read.schema(stream.schema).parquet(str(self.folder / "out")).collect()


def refs(*rows):
    return [(s, i, f"{i}.csv", at, "text", "csv") for s, i, at in rows]


def test_announcements_over_triggers_and_restarts(spark, tmp_path):
    known = spark.createDataFrame([("s", "0"), ("t", "9"), (None, "x")], "session_id string, id string")
    source = Source(spark, tmp_path, REFS, lambda s: announce_stream(s, known=known, page=3))
    found = source.arrive(refs(("s", "0", 0), ("s", "1", 1), ("s", "2", 2), ("t", "9", 1)))
    assert [(r.session_id, r.n_fresh, r.ids, r.text) for r in found] == [("s", 2, ["2", "1"], "2.csv (2, text/csv), 1.csv (1, text/csv)")]
    found = source.arrive(refs(("s", "1", 1), ("s", "2", 2), ("t", "9", 1)))
    assert len(found) == 1
    found = source.arrive(refs(("s", "3", 3), (None, "4", 4), ("t", None, 5), ("t", "5", None), ("t", "6", 6)))
    assert sorted(((r.session_id, tuple(r.ids), r.error_code) for r in found), key=str) == sorted([("s", ("2", "1"), None), ("s", ("3",), None), (None, ("4",), "INVALID_REQUEST"), ("t", (None,), "INVALID_REQUEST"), ("t", ("5",), "INVALID_REQUEST"), ("t", ("6",), None)], key=str)
    found = source.arrive(refs(*[("u", str(k), k) for k in range(8)]))
    pages = [r for r in found if r.session_id == "u"]
    assert sorted(r.n_fresh for r in pages) == [2, 3, 3] and sorted(i for r in pages for i in r.ids) == [str(k) for k in range(8)]


def test_pages_make_one_announcement(spark, tmp_path):
    source = Source(spark, tmp_path, REFS, lambda s: announce_stream(s, page=3))
    rows = refs(*[("s", str(k), 7 * k % 10) for k in range(10)], ("t", "a", 1))
    source.arrive(rows[:8])
    source.arrive(rows[4:])
    out = whole_announcements(spark.read.parquet(str(tmp_path / "out"))).collect()
    empty = spark.createDataFrame([], "session_id string, id string")
    want = sessions.announce(spark.createDataFrame(rows, REFS), empty).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, want)) and [r.n_fresh for r in sorted(out)] == [10, 1]


def test_state_written_is_what_is_new(spark, tmp_path):
    source = Source(spark, tmp_path, REFS, announce_stream)
    source.arrive(refs(*[("s", str(k), k) for k in range(2000)]))
    source.arrive(refs(("s", "5", 5), ("s", "new", 9999)))
    updated = [p["stateOperators"][0]["customMetrics"].get("rocksdbPutCount", 0) for p in source.progress if p["numInputRows"]]
    assert sum(updated) < 100


@pytest.mark.parametrize("seed", range(2))
def test_drafts_in_any_order_within_the_delay(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(rng.choice("abc"), k, 1_000 + 10 * k, rng.random() < 0.3) for k in range(120)]
    late = sorted(events, key=lambda e: e[2] + rng.randint(0, 290))  # none comes 300 seconds after a later one
    source = Source(spark, tmp_path, "session_id string, seq long, at long, is_send boolean", lambda s: batches_stream(s.withColumn("at", F.timestamp_seconds("at")), "5 minutes"))
    for k in range(0, 120, 40):
        source.arrive(late[k : k + 40])
    found = source.arrive([("z", 0, 1_000_000, False), ("z", 1, 2_000_000, False)])  # moves the watermark past all
    want = sessions.draft_batches(spark.createDataFrame(events, "session_id string, seq long, at long, is_send boolean")).select("session_id", "seq", "batch_no").collect()
    assert sorted(tuple(r) for r in found if r.session_id != "z") == sorted(map(tuple, want))

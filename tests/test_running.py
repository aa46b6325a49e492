import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import paging, sessions, store
from quarrystone.operators.running import running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    found = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randint(0, 300), k, rng.choice([0, 1, None])) for k in range(3000)]
    return spark.createDataFrame(found, "g string, o long, k long, v long").repartition(5)


@pytest.mark.parametrize("hot", [10, 100_000])
def test_running_sums_against_loops(rows, hot):
    got = {r.k: (r.s, r.p) for r in running(running(rows, ["g"], [F.desc("o"), F.col("k")], F.col("v"), "s", hot), ["g"], [F.desc("o"), F.col("k")], name="p", hot=hot).collect()}
    sums, places = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (-r.o, r.k)):
        sums[r.g], places[r.g] = sums.get(r.g, 0) + (r.v or 0), places.get(r.g, 0) + 1
        assert got[r.k] == (sums[r.g], places[r.g])


def test_a_hot_group_is_many_tasks(rows):
    found = running(rows, ["g"], [F.col("o")], hot=10).withColumn("task", F.spark_partition_id())
    spread = found.filter("g = 'hot'").groupBy("task").count().collect()
    assert len(spread) > 2
    assert sorted(r.position for r in found.filter("g = 'hot'").collect()) == list(range(1, rows.filter("g = 'hot'").count() + 1))


def test_users_of_it_do_not_depend_on_the_plan(spark, rows):
    refs = rows.select(F.col("g").alias("owner_session_id"), F.col("o").alias("created_at"), F.col("k").cast("string").alias("id"), F.lit("n").alias("safe_name"), F.lit("f").alias("family"), F.lit("t").alias("kind"))
    events = rows.select(F.col("g").alias("session_id"), F.col("k").alias("seq"), (F.col("v") == 1).alias("is_send"))
    known = refs.limit(0).select(F.col("owner_session_id").alias("session_id"), "id")
    same = [
        lambda hot: store.session_listing(refs, hot=hot),
        lambda hot: sessions.draft_batches(events, hot=hot),
        lambda hot: paging.cursor_page(rows, ["g"], [F.col("k")], 20, 50, hot=hot),
        lambda hot: sessions.announce(refs, known, page=40, hot=hot),
    ]
    for make in same:
        assert sorted(map(tuple, make(10).collect()), key=str) == sorted(map(tuple, make(10**6).collect()), key=str)
    pages = sessions.announce(refs, known, page=40).collect()
    assert max(r.n_fresh for r in pages) == 40 and sum(r.n_fresh for r in pages) == refs.filter("owner_session_id IS NOT NULL").count() + refs.filter("owner_session_id IS NULL").count()


def test_pages_by_cursor(spark):
    frame = spark.createDataFrame([("a", k) for k in range(10)] + [("b", 0)], "g string, k long")
    page = lambda *a, **b: sorted((r.g, r.k, r.entry_no, r.next_cursor) for r in paging.cursor_page(frame, ["g"], [F.col("k")], *a, **b).collect())
    assert page(8, 2) == [("a", 8, 8, None), ("a", 9, 9, None)]
    assert page(7, 2) == [("a", 7, 7, 9), ("a", 8, 8, 9)]
    assert page(0, 100, most=5) == [("a", k, k, None) for k in range(5)] + [("b", 0, 0, None)]


def test_empty(spark):
    assert running(spark.createDataFrame([], "g string, o long"), ["g"], [F.col("o")]).collect() == []


@pytest.mark.parametrize("hot", [0, 10**6])
def test_quota_in_rounds_and_as_a_fold(spark, hot):
    from quarrystone.limits import Limits

    rng = random.Random(8)
    rows = [(rng.choice(["s"] * 8 + ["t", None]), rng.choice(["b", "c", None]), k, rng.choice([1, 5, 20, 49, 60, None])) for k in range(600)]
    frame = spark.createDataFrame([(*r, b"x") for r in rows], "session_id string, batch_id string, seq long, bytes long, content binary").repartition(4)
    used, want = {}, {}
    for s, b, k, n in rows:
        count, size = used.get((s, b), (0, 0))
        want[k] = count < 4 and size + (n or 0) <= 50
        if want[k]:
            used[s, b] = count + 1, size + (n or 0)
    found = store.admit(frame, limits=Limits(batch_files=4, batch_bytes=50), hot=hot)
    assert "content" not in found.columns
    assert {r.seq: r.error_code is None for r in found.collect()} == want
    assert store.admit(frame.limit(0), hot=hot).collect() == []
    assert not any(r.error_code is None for r in store.admit(frame.filter("bytes = 60"), limits=Limits(batch_files=4, batch_bytes=50), hot=hot).collect())

import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import duckdb
import pytest

from quarrystone.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    convs = {c: [t for *_, t in sorted(own)] for c, own in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, own in sorted(rebuilt.items()):
        for d in range(len(own) + 1):
            members[own[:d]].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(own) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in own if rebuilt[c] == p)
        out.append((own[0], len(p), members[p[:-1]][0] if p else None, len(own), kids[p], leaves[p], saved[p], sha256(ends.encode()).hexdigest()))
    return out


def table(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, depth int")
    return frame


def found(frame):
    out = pt.trie_digests(frame)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=str)


def some(seed, convs=120, longest=14):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-20, 3 * convs), convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "bé", "tree"])))
    rows += [(7, None, "user", "x"), (7, None, "user", "x"), (None, 1, "user", "lost"), (8, 3, "user", "tie"), (8, 3, "tool", "tie"), (8, 3, "tool", "tie")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_dictionaries(spark, seed):
    rows = some(seed)
    assert found(table(spark, rows)) == sorted(brute(rows), key=str)


@pytest.mark.parametrize(("shard", "turns", "ranges"), [(1, 3, 7), (3, 10_000, 40), (512, 2, 90)])
def test_ends_of_shards_and_ranges(spark, monkeypatch, shard, turns, ranges):
    """Ranges that end inside conversations, shards of few turns: the same nodes."""
    monkeypatch.setattr(pt, "SHARD", shard)
    monkeypatch.setattr(pt, "SHARD_TURNS", turns)
    rows = some(9, convs=30, longest=40) + [(5, t, "user", f"t{t % 3}") for t in range(100, 400)] + [(6, t, "user", f"t{t % 3}") for t in range(100, 400)]
    monkeypatch.setattr(pt, "RANGE_ROWS", -(-len(rows) // ranges))
    assert found(table(spark, rows)) == sorted(brute(rows), key=str)


def test_copies_and_common_first_turns(spark):
    rows = [(c, t, "user", ["hello", "again", "bye"][t]) for c in range(700) for t in range(3)]
    rows += [(c, t, "user", "hello" if not t else f"{c} {t}") for c in range(700, 1000) for t in range(4)]
    assert found(table(spark, rows)) == sorted(brute(rows), key=str)


def test_without_rebuilding(spark):
    nodes, ends = pt.prefix_trie(table(spark, [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b"), (3, 0, "u", "c")]))
    assert sorted((r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in nodes.collect()) == [(1, 0, 3, 2, 2, 1), (1, 1, 2, 1, 1, 1), (2, 2, 1, 0, 1, 0), (3, 1, 1, 0, 1, 0)]
    assert sorted(r.ends for r in ends.collect()) == [[1], [2], [3]]


def test_empty_table(spark):
    assert found(table(spark, []).limit(0)) == []


def test_against_sql(spark):
    conversations = table(spark, some(4)).toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by the SQL
    want = duckdb.sql(pt.ORACLE)
    assert want.columns == COLUMNS
    assert sorted(want.fetchall(), key=str) == sorted(brute(some(4)), key=str)


def test_runs_compose():
    rng = random.Random(1)
    turns = [(rng.randrange(1, pt.PRIME), 1) for _ in range(40)]
    for _ in range(50):
        a, b, c = sorted(rng.choices(range(41), k=3))
        whole = pt.Run.of(turns[a:c], 8)
        assert pt.Run.of(turns[a:b], 8).then(pt.Run.of(turns[b:c], 8)) == whole
        assert whole.tails == [pt.prefix_key(turns[a + j : c]) for j in range(9)]

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarrystone.llm import mixture_packing as mp


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path(mp.TOKENIZER))


def check(docs, rows, library, capacity):
    """Every id lies in exactly one piece, sequences have no gaps and need no padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    found, want = Counter(), Counter()
    for (key, whole), own in pieces.items():
        own.sort()
        found[key] += sum(len(x) for _, x in own)
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        want[d.doc_id] += len(ids)
        if sum(e.doc_id == d.doc_id for e in docs) == 1:
            own = pieces[d.doc_id, len(ids)]
            assert [a for a, _ in own] == np.cumsum([0, *(len(x) for _, x in own)])[:-1].tolist()
            assert [x for _, part in own for x in part] == ids
    assert found == want
    for own in sequences.values():
        own.sort()
        size = sum(n for _, n in own)
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        assert size == capacity or size < capacity and size & (size - 1) == 0
    return sequences


@pytest.mark.parametrize(("capacity", "slice_tokens"), [(4096, 4_000_000), (64, 500), (32, 100)])
def test_every_id_once(docs, library, capacity, slice_tokens):
    rows = mp.pack_mixture(docs, capacity=capacity, slice_tokens=slice_tokens, least=4).collect()
    check(docs.collect(), rows, library, capacity)


def test_ids_as_the_library_gives(library, texts):
    odd = [*(t or "" for t in texts), "<|endoftext|> x<|startoftext|>y", "x" * 5000, "日本語テキスト" * 20_000, "don't  stop\x1cit", "\x01a", "ÀÉß÷×¡¿ñ'S we'LL 've''d'", "é" * 100_000, "a1b2!!'s..d", "   "]
    rng = random.Random(4)
    parts = [*"abcXYZéÈßÿ÷×¿İΣσ \t\n\x0b\x0c\r\x1c\x85\xa0'\"!?.,;<|>019²½", "'s", "'LL", "the", "Tion", "\u0301", "日本", "😀"]
    odd += ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)]
    odd += ["".join(rng.choices(parts[:12] + parts[15:18], k=rng.randint(0, 200))) for _ in range(3000)]
    own = mp.Encoder()
    assert own.fast is not None
    for text, ids in zip(odd, own.ids(odd), strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    slow = mp.Encoder()
    slow.fast = None
    assert slow.ids(odd) == own.ids(odd)


def test_odd_rows(spark, library):
    rows = [(None, None, None), (None, "", "a"), (1, "twice the same", "a"), (1, "twice the same", "a"), (2, "word " * 30_000, None), (3, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS _source", "2 AS start")
    check(docs.collect(), mp.pack_mixture(docs, slice_tokens=10_000).collect(), library, 4096)


def test_empty_table(empty):
    found = mp.pack_mixture(empty)
    assert found.collect() == []
    assert found.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_every_window_has_the_mixture(spark):
    rng = random.Random(5)
    rows = [(k, "stone " * rng.randint(1, 400), rng.choices("abcd", (60, 25, 10, 5))[0]) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    source, tokens = {k: s for k, _, s in rows}, Counter()
    windows = defaultdict(Counter)
    for r in mp.pack_mixture(docs, capacity=1024, slice_tokens=50_000, least=16).collect():
        windows[r.sequence_id][source[r.doc_id]] += r.length
        tokens[source[r.doc_id]] += r.length
    whole = sum(tokens.values())
    full = [w for w in windows.values() if sum(w.values()) == 1024]
    assert len(full) > 200
    for w in full:
        for s, n in tokens.items():
            assert abs(w[s] - 1024 * n / whole) <= 34  # twice what a queue may wait for, and a rounding


def test_given_weights_hold_until_a_source_is_empty():
    takes = list(mp.round_robin({"a": 1000, "b": 1000}, {"a": 3, "b": 1}, {}, mp.lengths(2000, 100), 1))
    assert all(sorted(t) == [("a", 75), ("b", 25)] for t in takes[:13])
    assert takes[-1] == [("b", 100)]
    assert sum(n for t in takes for q, n in t if q == "a") == 1000


def test_weighted_slices(spark, library):
    rows = [(k, "stone " * 50, "ab"[k % 2]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mp.pack_mixture(docs, weights={"a": 3}, capacity=64, slice_tokens=1000, least=1).collect()
    check(docs.collect(), found, library, 64)
    share = Counter()
    for r in found:
        if r.sequence_id >> 24 == 1:
            share[r.doc_id % 2] += r.length
    assert 0.7 < share[0] / (share[0] + share[1]) < 0.8


def test_slices_cover_queues():
    rng = random.Random(2)
    for _ in range(200):
        size, weight, count = rng.randint(1, 5000), rng.randint(1, 50), rng.randint(1, 40)
        cuts = mp.Slices(count, rng.randint(size, size * 3), weight)
        at, parts = 0, []
        while at < size:
            n = min(size - at, rng.randint(1, 300))
            parts += cuts.of(at, at + n, weight, size)
            at += n
        assert [a for _, a, _ in parts] == [0, *(b for _, _, b in parts[:-1])] and parts[-1][2] == size
        assert all(cuts.bound(k, weight, size) <= a < b <= cuts.bound(k + 1, weight, size) and k < count for k, a, b in parts)
        assert all(0 <= cuts.carried(k, weight, size) < 1 for k in range(count))

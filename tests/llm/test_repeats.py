import hashlib
import random
import re

import numpy as np
import pytest
from quarrystone.llm import hashing, jaccard_join, suffix_dedup
from quarrystone.llm.components import components


def removed(texts, window):
    """Brute force: (bytes, removed, spans, digest) of each text, in order."""
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            w = data[p : p + window]
            if w in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(w)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [100, 40])
def test_remove_repeats(docs, texts, window):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, window=window).drop("kept", "spans").collect()}
    want = removed(texts, window)
    assert [got[3 * k + 1] for k in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000


def test_remove_repeats_within_low_entropy(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["ab" * 300, "a" * 500, "ba" * 300]
    texts += [texts[k][10:200] for k in range(10)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, window=32).drop("kept", "spans").collect()}
    assert [got[k] for k in range(len(texts))] == removed(texts, 32)


def test_remove_repeats_cases(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    text = "the river stone house green walks under light " * 5
    rows = spark.createDataFrame([(None, text), (1, text), (2, "short"), (3, text), (3, text), (4, "x" + text), (4, text + "y")], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(rows).collect()]
    assert len(got) == 7
    assert sorted(n for i, n in got if i in (1, 3)) == [len(text)] * 3
    assert dict(got)[2] == 0


def test_repeated_rows_keep_what_stands_nowhere_else(spark):
    rng = random.Random(8)
    own, other, third = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    texts = [(7, own), (7, own), (7, own), (8, own), (9, other), (9, f"{other} {third}"), (9, f"{other} {third}"), (None, third), (None, third), (5, own[:50] * 4), (5, own[:50] * 4)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(rows).collect()]
    assert len(got) == len(texts)
    assert [x for x in got if x[0] == 7] == [(7, len(own), 0, own.encode())] * 3
    assert [x for x in got if x[0] == 8] == [(8, len(own), len(own), b"")]
    assert [x for x in got if x[0] is None] == [(None, len(third), 0, third.encode())] * 2
    nine = sorted(x for x in got if x[0] == 9)
    assert nine[1] == nine[2] and sum(x[1] - x[2] for x in nine[:2]) == len(other) + 1  # third stands under the null id
    five = [x for x in got if x[0] == 5]
    assert five[0] == five[1] and five[0][2] == 150


def test_equal_classes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2300] = data[100:400]
    starts = np.arange(len(data) - 100)
    group = np.zeros(len(starts), np.int64)
    got = suffix_dedup.equal_classes(data, starts, group)
    by = {}
    for s in starts:
        by.setdefault(data[s : s + 100].tobytes(), set()).add(got[s])
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def sets_of(texts, width):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(words))
        out.append(frozenset(tuple(words[a : a + k]) for a in range(len(words) - k + 1)) if words else frozenset())
    return out


def classes(sets, num):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(sets))]


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 60)])
def test_components_of_documents(docs, texts, width, num):
    sets = sets_of(texts, width)
    want = [(len(s), 3 * c + 1) for s, c in zip(sets, classes(sets, num), strict=True)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, width=width, num=num).collect()}
    assert [got[3 * k + 1] for k in range(len(texts))] == want


def test_many_near_copies_over_blocks(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(70):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(80)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert [got[k] for k in range(len(texts))] == classes(sets_of(texts, 3), 90)


def test_jaccard_cases(spark, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (8, None), (9, " "), (None, "only")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.jaccard_components(rows).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (8, 0, 8), (9, 0, 9), (None, 1, None)], key=str)
    kept = jaccard_join.keep_representatives(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_near_copies_with_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(80)]

    def changed(*places):
        return " ".join(f"x{k}" if k in places else w for k, w in enumerate(words))

    # A chain whose middle has a null id; near copies that all have null ids; an id with two texts, one near another's.
    two, three = (" ".join(f"{c}{k}" for k in range(80)) for c in "yz")
    rows = [(4, changed()), (None, changed(0)), (6, changed(0, 79)), (None, two), (None, f"{two} end"), (None, "alone of its kind"), (3, three), (3, "another text of three"), (2, f"{three} end"), (9, "another text of three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = sets_of([t for _, t in rows], 3)
    roots = classes(sets, 95)
    least = {c: min((i for (i, _), own in zip(rows, roots, strict=True) if own == c and i is not None), default=None) for c in roots}
    want = [(i, len(s), least[c]) for (i, _), s, c in zip(rows, sets, roots, strict=True)]
    assert len(set(roots)) == 5 and roots[0] == roots[1] == roots[2] and roots[3] == roots[4]
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs, num=95).collect()), key=str) == sorted(want, key=str)
    kept = jaccard_join.keep_representatives(docs, width=3, num=95)
    assert kept.columns == docs.columns
    got = sorted(roots[[t for _, t in rows].index(r.text)] for r in kept.collect())
    assert got == sorted(set(roots))
    assert {r.doc_id for r in kept.collect()} == {4, 2, 3, None}


def test_word_hashes_by_pieces(monkeypatch):
    text = b"Some words  here\tand there " * 40 + b"x" * 300
    whole = hashing.word_hashes(text)
    assert len(whole) == len(text.split()) and len(set(whole.tolist())) == len({w.lower() for w in text.split()})
    monkeypatch.setattr(hashing, "PIECE", 64)
    assert (hashing.word_hashes(text[:1000]) == whole[: len(text[:1000].split())])[:-1].all()
    assert (hashing._long_words(text) == whole).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(5, 5), (200, 150), (150, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100), 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

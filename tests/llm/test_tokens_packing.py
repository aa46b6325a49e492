import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarrystone.llm import packing, token_counts

ODD = list("abc ABC  \n\t'sté́ŸΣσς123!?<|>中文€\x1c\x85\u00a0\u3000Åİß𝄞") + ["<|endoftext|>", "'ll", " the", "<|startoftext|>"]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(1)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 200))) for _ in range(300)]


@pytest.mark.parametrize(("huge", "chunk", "overlap"), [(65_536, 32_768, 256), (10, 60, 8), (0, 7, 1), (100, 500, 64)])
def test_counts(texts, odd, huge, chunk, overlap):
    every = [t or "" for t in texts] + odd + ["x" * 5000, "word " * 900, "a\u0301 " * 50]
    encoder = token_counts.tokenizer(token_counts.TOKENIZER)
    want = [len(encoder.encode(t, add_special_tokens=False).ids) for t in every]
    assert token_counts.Counter(token_counts.TOKENIZER, huge, chunk, overlap).count([t.encode() for t in every]) == want


def test_chunks_are_spliced_not_whole():
    encoder = token_counts.tokenizer(token_counts.TOKENIZER)
    text = "the river stone house " * 400
    runs = list(token_counts.resynchronised(encoder, text, 500, 32))
    assert len(runs) > 10
    assert np.concatenate(runs, axis=1)[2].tolist() == encoder.encode(text, add_special_tokens=False).ids


SCRIPTS = {
    "cjk": "日本語のテキスト。これは、長い文章です！第１２章：石と川。",
    "thai": "ภาษาไทยไม่มีช่องว่าง(แม่น้ำ)หิน",
    "marks": "e\u0301a\u0308!İ!x\u0301'sing don't...'ll\u200b(é)한글ᄒ\u1161\u11ab.",
    "digits": "1234567890",
    "letters": "xyzzy",
    "special": "a<|endoftext|>b,<|startoftext|>c.",
}


@pytest.mark.parametrize("kind", SCRIPTS)
@pytest.mark.parametrize(("chunk", "overlap"), [(37, 5), (400, 16), (3000, 256)])
def test_chunks_of_unbroken_scripts(kind, chunk, overlap):
    encoder = token_counts.tokenizer(token_counts.TOKENIZER)
    text = SCRIPTS[kind] * 150
    runs = list(token_counts.resynchronised(encoder, text, chunk, overlap))
    assert np.concatenate(runs, axis=1)[2].tolist() == encoder.encode(text, add_special_tokens=False).ids
    if kind in ("cjk", "thai", "digits", "special"):
        assert len(runs) > len(text) / chunk / 4


def test_time_of_unbroken_scripts_is_linear():
    encoder = token_counts.tokenizer(token_counts.TOKENIZER)
    for text in ("日本語テキスト" * 140_000, SCRIPTS["cjk"] * 35_000, "x" * 1_000_000):
        began = time.process_time()
        found = sum(run.shape[1] for run in token_counts.resynchronised(encoder, text))
        took, began = time.process_time() - began, time.process_time()
        assert found == len(encoder.encode(text, add_special_tokens=False).ids)
        assert took < 8 * (time.process_time() - began) + 2


def test_token_counts_cases(spark):
    huge = SCRIPTS["cjk"] * 9000
    rows = [(None, "a b", 1, "x"), (7, None, 2, "y"), (7, "", 3, "z"), (8, huge, 4, "z"), (8, huge, 4, "z")]
    got = sorted(map(tuple, token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, _id string")).collect()), key=str)
    n = len(token_counts.tokenizer(token_counts.TOKENIZER).encode(huge, add_special_tokens=False).ids)
    assert got == sorted([(None, 3, 2, False), (7, 0, 0, False), (7, 0, 0, False), *[(8, len(huge.encode()), n, True)] * 2], key=str)


def test_token_counts(docs, texts, empty):
    got = {r.doc_id: r for r in token_counts.token_counts(docs, limit=50).collect()}
    encoder = token_counts.tokenizer(token_counts.TOKENIZER)
    for k, t in enumerate(texts):
        n = len(encoder.encode(t or "", add_special_tokens=False).ids)
        r = got[3 * k + 1]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 50)
    assert token_counts.token_counts(empty).count() == 0


def test_ids_are_the_library_s(texts, odd):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in [*(x or "" for x in texts), *odd]:
        assert packing.token_ids(t).tolist() == [*encoder.encode(t, add_special_tokens=False).ids, 2]


def test_ids_of_long_white_space():
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("a" + " " * 2_000_000 + "b", "\n" * 50_000, "x" + "\u3000" * 5000 + "<|endoftext|> y"):
        assert packing.token_ids(t).tolist() == [*encoder.encode(t, add_special_tokens=False).ids, 2]


def test_pack_cases(spark):
    """Null and repeated ids, null, empty and very long texts, other columns."""
    rows = [(None, "a b", "x", 1), (None, None, "y", 2), (7, "", "z", 3), (7, "river stone " * 40_000, "z", 4), (7, "river stone " * 40_000, "z", 4)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, ids string, piece int")).collect()
    long = len(packing.token_ids(rows[3][1]))
    assert sorted(((r.doc_id, r.length) for r in got if r.doc_id is None), key=str) == sorted([(None, len(packing.token_ids("a b"))), (None, 1)], key=str)
    assert sum(r.length for r in got if r.doc_id == 7) == 2 * long + 1
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= packing.CAPACITY


def check(rows, texts, capacity):
    """Pieces make up their documents and fill their sequences without gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, t in enumerate(texts):
        pieces = sorted(by_doc[3 * k + 1], key=lambda r: r.piece)
        ids = packing.token_ids(t or "")
        assert b"".join(bytes(r.ids) for r in pieces) == ids.tobytes()
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert all(r.length == capacity for r in pieces[1:]) and pieces[0].length <= capacity
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_pack(docs, texts, empty, capacity):
    rows = packing.pack(docs.coalesce(1), capacity=capacity).collect()
    total = sum(len(packing.token_ids(t or "")) for t in texts)
    assert check(rows, texts, capacity) <= -(-total // capacity) * 1.05 + 1
    assert packing.pack(empty).count() == 0


def test_digest_of_ids(spark):
    from quarrystone.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    own = {r.doc_id: packing.token_ids(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_best_fit_packing"](spark, sf_dir).collect()
    assert all(r.ids_crc32 == zlib.crc32(own[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    assert sum(r.length for r in rows) == sum(map(len, own.values()))


def test_few_open_bins(docs, texts):
    check(packing.pack(docs, capacity=100, open_bins=2).collect(), texts, 100)


def test_bins():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 10, 5, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (3, 5)]
    bins = packing.Bins(10, 1)
    assert [bins.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]  # the bin with 6 closed

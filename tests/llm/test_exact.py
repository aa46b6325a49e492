import hashlib
import time
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import exact_dedup, fingerprints

SF = "/root/testdata/sf0.001"


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, texts):
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(normal(t), []).append(3 * k + 1)
    want = {(i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in exact_dedup.exact_dedup(docs).collect()} == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_exact_dedup_cases(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    rows = spark.createDataFrame([(5, "a"), (5, "a"), (None, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    got = sorted(exact_dedup.exact_dedup(rows).select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(5, 5, 3, True), (5, 5, 3, True), (None, 5, 3, False), (None, None, 1, True), (2, 2, 1, True)], key=str)
    assert sorted((r.doc_id or 0) for r in exact_dedup.drop_copies(rows).collect()) == [0, 2, 5]


def test_drop_copies_keeps_each_text(spark):
    rows = [(5, "a"), (None, "a"), (None, "b"), (None, "c  d"), (None, "c d"), (2, None), (2, "e"), (2, "f"), (1, "f"), (2, "a"), (7, "e"), (7, "e")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _id string")
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), normal(r.text)) for r in got.collect()) == sorted([("2", "a"), ("None", "b"), ("None", "c d"), ("2", ""), ("2", "e"), ("1", "f")])


def canonical(t):
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t or "").casefold())
    return re.sub(r"\s+", " ", t).strip()


def test_canonical(spark):
    same = ["Straße  É", " STRASSE E\u0301", "strasse\u00a0é\n"]
    rows = spark.createDataFrame([(x,) for x in same], "t string").select(fingerprints.canonical(F.col("t"))).collect()
    assert {r[0] for r in rows} == {"strasse é"}


def test_fingerprints(docs, texts):
    ids = [3 * k + 1 for k in range(len(texts))]
    own = dict(zip(ids, [t or "" for t in texts], strict=True))
    following = dict(zip(ids, [own[i] for i in [*ids[1:], ids[0]]], strict=True))
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    prints = {}
    for i in ids:
        q = len(own[i]) // 4
        edited = own[i][: len(own[i]) - q] + following[i][:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(canonical(edited) == canonical(own[i]))
        assert r.near_next == float(canonical(following[i]) == canonical(own[i]))
        prints.setdefault(canonical(own[i]), set()).add(r.fingerprint)
        prints.setdefault(canonical(edited), set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    assert len({x for s in prints.values() for x in s}) == len(prints)


def test_fingerprint_cases(spark, empty):
    assert fingerprints.fingerprint_documents(empty).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()[0]
    assert (one.near_next, one.n_chars, one.edited_sha256) == (1.0, 4, hashlib.sha256(b"abca").hexdigest())
    again = spark.createDataFrame([(1, "a"), (1, "b"), (None, None)], "doc_id long, text string")
    assert fingerprints.fingerprint_documents(again).count() == 3


def test_places_give_what_quantiles_give(docs, monkeypatch):
    want = sorted(map(tuple, fingerprints.fingerprint_documents(docs).collect()))
    monkeypatch.setattr(fingerprints, "MOST_EDGES", 0)
    assert sorted(map(tuple, fingerprints.fingerprint_documents(docs).collect())) == want


def test_many_rows_without_ids_of_their_own(spark):
    """Null and repeated ids beside distinct ones, nearly all with one text: every row has a next, in linear time."""
    rows = [(None, "same text") for _ in range(4000)] + [(7, "same text") for _ in range(4000)] + [(k, "same text") for k in range(10, 3000)] + [(None, "other"), (7, "more"), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    began = time.time()
    found = fingerprints.fingerprint_documents(frame).collect()
    assert time.time() - began < 60
    assert len(found) == len(rows)
    assert sum(r.near_next == 0 for r in found) in range(4, 7)  # around the three others
    assert sum(r.edited_sha256 == hashlib.sha256(b"same tesa").hexdigest() for r in found) > 10_900
    ids = [r.doc_id for r in found]
    assert (ids.count(None), ids.count(7)) == (4001, 4002)


def test_equal_hashes_are_told_apart(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "b", "a"])], "k long, t string")

    def weak(form, seed):
        return F.lit("same") if seed == 0 else fingerprints.wide_hash(form, seed)

    got = {r.k: r.t_fp for r in fingerprints.fingerprint(rows, ["t"], "k", digest=weak).collect()}
    assert got[0] == got[2] != got[1] and got[0] != "same"
    with pytest.raises(ValueError, match="no seed"):
        fingerprints.fingerprint(rows, ["t"], "k", digest=lambda form, seed: F.lit("x"))


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op5_url_reputation", "op7_fair_mixing"])
def test_sql(spark, name):
    from quarrystone.llm import queries
    from tests.test_queries import canonical as rows_of

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(con.sql(queries.ORACLES[name]).df())

import random
import re

import pytest
from quarrystone.llm import mixing, url_reputation

URLS = {
    "http://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "https://example.org/en/17#f": ("example.org", "/en/17", "example.org/en/1", "block"),
    "https://x.org/": ("x.org", "/", "org/", "allow"),
    "https://x.org": ("x.org", "", None, None),
    "http://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"),
    "http://b.com/de/9": ("b.com", "/de/9", "com/de/", "block"),
    "http://org.net/es/": ("org.net", "/es/", None, None),
    "no url": ("", "", None, None),
    None: ("", "", None, None),
    "": ("", "", None, None),
    "a://b://c/d": ("b:", "//c/d", None, None),
    "http://h?q=/x": ("h", "", None, None),
}


def test_rules(spark):
    pages = spark.createDataFrame([(k, u, "extra") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in url_reputation.filter_urls(pages).collect():
        host, path, rule, verdict = list(URLS.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")
    assert url_reputation.filter_urls(pages.limit(0)).count() == 0


def test_reputation_shrinks(spark):
    bad = [("bad.x.net", 1)] * 60 + [("ok.x.net", 0)] * 60 + [("few.x.net", 1)] + [("fine.y.net", 0)] * 40
    outcomes = spark.createDataFrame(bad, "host string, bad int")
    pages = spark.createDataFrame([(k, f"http://{h}/en/") for k, h in enumerate(["bad.x.net", "ok.x.net", "few.x.net", "new.x.net", "fine.y.net", "z.info"])], "page_id long, url string")
    got = {r.host: r for r in url_reputation.filter_urls(pages, rules=(), outcomes=outcomes).collect()}
    assert {h: r.verdict for h, r in got.items()} == {"bad.x.net": "block", "ok.x.net": "allow", "few.x.net": "allow", "new.x.net": "allow", "fine.y.net": "allow", "z.info": "allow"}
    assert got["ok.x.net"].mean < got["new.x.net"].mean < got["few.x.net"].mean < got["bad.x.net"].mean


def test_domains_of_long_suffixes(spark):
    rows = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "com", "", "uk")], "h string")
    got = [tuple(r) for r in rows.select(url_reputation.registered_domain(rows.h), url_reputation.suffix_of(rows.h)).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", ""), ("uk", "uk")]


def test_url_cases(spark):
    """Null ids, repeated rows, clashing columns; SQL says the same."""
    import duckdb

    rng = random.Random(5)
    hosts = ["a.org", "b.a.org", "example.org", "x.example.org", "q.com", "w.q.com", "n.co.uk", "m.n.co.uk", "z.net", ""]
    rows = [(None if k % 50 == 0 else k // 2, f"http://{rng.choice(hosts)}/{rng.choice(['es/', 'en/1', 'fr/', 'de/', ''])}{k % 3}", "x", "y") for k in range(600)] + [(9, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, mean string, rule string")
    got = sorted((tuple(r) for r in url_reputation.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    import pandas as pd

    base = duckdb.connect()
    base.register("pages", pd.DataFrame({"page_id": pd.array([r[0] for r in rows], "Int64"), "url": [r[1] for r in rows]}))
    want = sorted((tuple(r) for r in base.sql(url_reputation.ORACLE).fetchall()), key=str)
    assert [x for x in got if x[1]] == [x for x in want if x[1]] and len(got) == len(rows)


def test_mixing(docs, texts):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(texts)
    words = {3 * k + 1: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in got} == words
    sources = {r.doc_id: r.source for r in docs.collect()}
    order = sorted(set(sources.values()), key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    size = {s: sum(words[i] for i in words if sources[i] == s) for s in order}
    target, free, left = {}, set(order), sum(size.values())
    while True:  # by rounds, as the contract has it
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= 3 * size[s]
        free -= over
    for s in order:
        own = [r for r in got if sources[r.doc_id] == s]
        assert own[0].target == pytest.approx(target[s]) and own[0].source_size == size[s]
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own)
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    assert sum(r.taken for r in got) <= sum(size.values())
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.taken // r.size for r in got if r.size)
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(3)).collect())) == sorted(map(tuple, got))


def test_mixing_cases(spark, empty):
    assert mixing.mix_sources(empty).count() == 0 and mixing.take_mix(empty).count() == 0
    rows = spark.createDataFrame([(1, None, None), (1, None, None), (None, "a b", None), (2, "c", "s")], "doc_id long, text string, source string")
    assert sorted(r["size"] for r in mixing.mix_sources(rows).collect()) == [0, 0, 1, 2]


def test_targets_stop_at_three_times(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 100)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(base).collect()}
    assert got["a"] == 3.0 and got["b"] + got["c"] == pytest.approx(1098) and got["c"] == 300.0
    assert mixing.source_targets(base.limit(0)).count() == 0

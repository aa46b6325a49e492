import corpus_pipeline
from quarrystone.llm import exact_dedup, jaccard_join, mixing, toxicity
from quarrystone.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, table(spark, SF, "labels")).collect()}
            assert {r.doc_id for r in after.collect()} == {i for i, p in scores.items() if not p}
        elif name == "exact dedup":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in exact_dedup.exact_dedup(before).collect() if r.kept}
        elif name == "near dedup":
            assert {r.doc_id for r in after.collect()} == {r.component_id for r in jaccard_join.jaccard_components(before, width=5, num=80).collect()}
        else:
            assert after.count() == sum(r.taken // r.size for r in mixing.mix_sources(before).collect() if r.size)
        before = after
    packed = corpus_pipeline.run(spark, SF)
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    key = lambda df: sorted((r.doc_id, r.piece, r.length) for r in df.collect())
    assert key(packed) == key(last)


def odd(spark):
    """Null and repeated ids, ties, null, empty and very long texts, columns with the names that stages use inside."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    texts = [(1, "river stone house green"), (1, "another text that shares the id"), (None, "a text without an id"), (None, "one more without an id"), (None, None), (2, ""), (3, " \n"), (4, long), (5, long + " end"), (6, "river  stone house green"), (6, "river stone house green"), (7, "x")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _row string, _id string, _doc string, _kept string, size string, taken string, row string, root string, ids string, _text string, _source string, _chosen string"
    return spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", 1, *[str(k)] * 12) for k, (i, t) in enumerate(texts)], kinds)


def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    norm = lambda rows: {" ".join((r.text or "").split(" ")).replace("  ", " ") for r in rows}
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        assert name == "packing" or after.columns == docs.columns, name
        rows[name] = after.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    texts = [r.text for r in docs.collect()]
    assert len(rows["toxicity"]) == len(texts)
    assert norm(rows["exact dedup"]) == norm(docs.collect()) and len(rows["exact dedup"]) == 9
    near = [r.text for r in rows["near dedup"]]
    assert len(near) == 9 and sum(not (x or "").strip() for x in near) == 3
    assert {x for x in near if x and x.strip() and "river" not in x} == {t for t in texts if t and t.strip() and "river" not in t and not t.endswith(" end")}
    assert {r.text for r in rows["mixing"]} <= set(texts) and all((r.text or "").split() for r in rows["mixing"])
    from quarrystone.llm import packing

    assert sum(r.length for r in rows["packing"]) == sum(len(packing.token_ids(t or "")) for t in texts)


def test_mix_by_row(spark):
    """Rows that share an id are taken as often as their own place in the queue says."""
    docs = spark.createDataFrame([(k % 5, "w " * (k + 1), f"s{k % 2}") for k in range(40)], "doc_id long, text string, source string")
    taken = mixing.take_mix(docs).groupBy("text").count().collect()
    assert all(r["count"] <= 3 for r in taken)
    total = sum(k + 1 for k in range(40))
    assert 0.9 * total <= sum(len(r.text.split()) * r["count"] for r in taken) <= total

import random
import time

import pytest
from pyspark.sql import functions as F

from quarrystone.functions.redaction import redacted, scan
from quarrystone.operators import masking

LINES = ["-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "x", " y", "  z: 1", "secret: |", " token: >", "   pwd: |2 # c", "   ", "", "password: a", '  {"token": 1, "b": 2}', "export API_KEY='k' # c", "\ttab", '"token": "t"', "{", "}"]


def texts(n, seed, most=40):
    rng = random.Random(seed)
    return ["\n".join(rng.choices(LINES, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("segment", [1, 3, 7, 20_000])
def test_segments_give_what_whole_texts_give(spark, segment):
    docs = spark.createDataFrame([*enumerate(texts(250, segment)), (1000, None), (1001, ""), (1002, '{"a":\n{"token": [1,\n2]}}'), (None, "password: x\r\ny")], "doc_id long, text string")
    lines = masking.redacted_lines(docs, segment=segment)
    found = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"), F.sum("counts").alias("n"))
    want = docs.select("doc_id", redacted(F.coalesce("text", F.lit(""))).alias("r")).select("doc_id", "r.text", "r.redacted")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_summaries_compose():
    rng = random.Random(3)
    for _ in range(3000):
        lines = [(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randint(1, 12))]
        for key in (False, True):
            for indent in (None, 0, 1, 2, 3, 4):
                want = scan(*zip(*lines, strict=True), key, indent)[1:]
                assert masking.Summary.of(*zip(*lines, strict=True)).after(key, indent) == want
                k = rng.randint(0, len(lines))
                state = key, indent
                for part in (lines[:k], lines[k:]):
                    if part:
                        state = masking.Summary.of(*zip(*part, strict=True)).after(*state)
                assert state == want


def test_odd_rows(spark):
    rows = [(None, 1, "secret: |"), (None, 2, "  x"), ("a", 1, None), ("a", 5, "token: x"), ("a", None, "pwd: y"), ("a", 5, "token: x")]
    frame = spark.createDataFrame(rows, "doc_id string, line_no long, line string").selectExpr("*", "'kept' AS _line", "7 AS key")
    found = masking.mask_lines(frame, segment=2)
    assert found.columns == ["doc_id", "line_no", "line", "_line", "key", "masked", "counts"]
    assert sorted(((r.doc_id, r.line_no, r.masked, r.counts, r._line) for r in found.collect()), key=str) == sorted(
        [(None, 1, "secret: [REDACTED]", True, "kept"), (None, 2, "  [REDACTED]", True, "kept"), ("a", 1, "", False, "kept"), ("a", 5, "token: [REDACTED]", True, "kept"), ("a", 5, "token: [REDACTED]", True, "kept"), ("a", None, "pwd: [REDACTED]", True, "kept")], key=str
    )
    assert masking.mask_lines(frame.limit(0)).collect() == []


def test_a_million_lines_of_one_document(spark):
    """100,000 keys of ten lines in one document: many segments, linear time."""
    row = F.col("id") % 10
    line = F.when(row == 0, "-----BEGIN PRIVATE KEY-----").when(row == 9, "-----END PRIVATE KEY-----").otherwise(F.concat(F.lit("body "), F.col("id")))
    took = {}
    for n in (100_000, 1_000_000):
        began = time.time()
        rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), line.alias("line"))
        found = masking.mask_lines(rows, segment=10_003).agg(F.count_if("counts").alias("masked"), F.count_if(F.col("masked") == "[REDACTED]").alias("hidden"), F.count_if(F.col("masked") == F.col("line")).alias("kept")).first()
        assert tuple(found) == (n // 10 * 8, n // 10 * 8, n // 10 * 2)
        took[n] = time.time() - began
    assert took[1_000_000] < 30 * max(took[100_000], 1)


def test_whole_texts_are_linear_in_their_spans(spark):
    took = []
    for n in (2_000, 20_000):
        text = "-----BEGIN PRIVATE KEY-----\nbody\n-----END PRIVATE KEY-----\nsecret: |\n  a\n\n" * n
        frame = spark.createDataFrame([(text,)], "text string").select(redacted("text").alias("r"))
        began = time.time()
        assert frame.first().r.redacted == 3 * n
        took.append(time.time() - began)
    assert took[1] < 25 * max(took[0], 0.3)

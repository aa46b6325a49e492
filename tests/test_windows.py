import os
import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import line_index, paging
from quarrystone.sources import ranges

WORDS = ["", "a", "bé", "日本", "😀", "word " * 5, "x" * 70]


def test_fitting_items_against_counting(spark):
    rng = random.Random(1)
    rows = [(k, rng.choices(WORDS, k=rng.randint(0, 30)), rng.randint(0, 12), rng.randint(1, 30)) for k in range(400)]
    frame = spark.createDataFrame(rows, "k long, items array<string>, b int, c int")
    window = paging.window_of(F.col("items"), F.col("b"), F.col("c"), most=20, most_bytes=100)
    for r in frame.select("*", window.alias("w")).collect():
        asked = r["items"][r.b : r.b + min(r.c, 20)]
        n = max(k for k in range(len(asked) + 1) if len("\n".join(asked[:k]).encode()) <= 100)
        if n == 0 and len(r["items"]) > r.b:
            assert r.w.error_code == "PARSER_OUTPUT_LIMIT" and r.w.text is None
        else:
            more = len(r["items"]) > r.b + n
            assert (r.w.text, r.w.n, r.w.has_more, r.w.next_offset) == ("\n".join(asked[:n]), n, more, r.b + n if more else None)


@pytest.fixture
def texts(tmp_path):
    rng, found = random.Random(2), {}
    for k in range(40):
        text = "\n".join(rng.choices(WORDS, k=rng.randint(0, 60))) + rng.choice(["", "\n", "\n\n"])
        found[k] = text if k else ""
        (tmp_path / f"{k}.txt").write_bytes(found[k].encode())
    return found


def listed(spark, folder):
    files = ranges.read_ranges(spark, str(folder)).select("path", "size")
    return files.withColumn("sha256", F.regexp_extract("path", r"(\d+)\.txt$", 1))


@pytest.mark.parametrize(("every", "window"), [(1, 7), (3, 50), (4, 1 << 20), (1000, 64)])
def test_pages_by_the_index(spark, tmp_path, texts, every, window):
    index = line_index.build(listed(spark, tmp_path), every, window).cache()
    asked = spark.createDataFrame([(str(k), p) for k in [*texts, 99] for p in (1, 2, 3, 21)], "sha256 string, page long")
    for r in line_index.read_pages(asked, index).collect():
        if r.sha256 == "99":
            assert r.error_code == "CORRUPT_FILE"
            continue
        lines = texts[int(r.sha256)].split("\n")
        own = lines[(r.page - 1) * every : r.page * every]
        if not own:
            assert r.error_code == "PAGE_OUT_OF_RANGE"
        else:
            assert (r.text, r.has_more, r.error_code) == ("\n".join(own), len(lines) > r.page * every, None)
    assert {r.sha256: (r.lines, r.pages) for r in index.collect()} == {str(k): (n := t.count("\n") + 1, -(-n // every)) for k, t in texts.items()}


def test_only_new_contents_are_scanned(spark, tmp_path, texts):
    files = listed(spark, tmp_path)
    index = spark.createDataFrame(line_index.build(files.filter("sha256 < '30'"), 3, 50).collect())
    for k in texts:
        if str(k) < "30":
            os.remove(tmp_path / f"{k}.txt")  # would fail if it were opened
    again = line_index.refresh(index, spark.createDataFrame(listed_rows(files, texts), files.schema), 3, 50)
    assert {r.sha256 for r in again.collect()} == {str(k) for k in texts if k != 5}


def listed_rows(files, texts):
    folder = files.first().path.rsplit("/", 1)[0]
    return [(f"{folder}/{k}.txt", len(t.encode()), str(k)) for k, t in texts.items() if k != 5]


def test_a_page_goes_on_where_it_was_cut(spark, tmp_path):
    """Cut pages, read on by byte ranges from next_offset, are the text."""
    text = "".join(random.Random(3).choices(["é", "日", "😀", "abc ", "\n"], [3, 3, 3, 3, 1], k=3000))
    data = text.encode()
    for most in (9, 50, 333):
        at, parts = 0, []
        while at < len(data):
            own, more, following = line_index.fitted(data[at : at + most], len(data) - at, at, True)
            parts.append(data[at : following if more else len(data)])
            assert own == parts[-1].decode().removesuffix("\n" if more else "")
            at += len(parts[-1])
        assert b"".join(parts) == data

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone import api
from quarrystone.functions import names
from quarrystone.operators import archives, store, tables


@pytest.fixture(scope="module")
def sql(spark):
    api.register(spark)
    return lambda text, **frames: [tuple(r) for r in spark.sql(text, **frames).collect()]


def zipped(*entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in entries:
            archive.writestr(name, data)
    return out.getvalue()


def test_safe_paths_are_those_of_the_column(spark):
    raws = ["", ".", "a", "a/./b", "a//b/", "../a", "a/../b", "a/..", "a/../..", "/a", "C:a", "c:\\x", "é:a", "a\\b\\..\\c", "..", "a/b/../../..", "1:a", "./", "  ", None]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(raws)], "k int, raw string").select("k", names.archive_path(F.col("raw")).alias("p"))
    assert [r.p for r in sorted(got.collect())] == [tables.safe_path(x) for x in raws]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé\n😀", max_size=60), st.integers(1, 4), st.integers(4, 12))
def test_pages_are_the_text_and_windows_are_the_pages(text, most_lines, most_bytes):
    pages = list(tables.TextPages().eval(text, most_lines, most_bytes))
    assert "".join(p[3] for p in pages) == text
    assert all(len(p[3].encode()) == p[2] <= most_bytes and p[3].count("\n") <= most_lines for p in pages)
    for number, _, _, page in pages:
        assert list(tables.TextWindow().eval(text, number, most_lines, most_bytes)) == [(page, number + 1 if number < len(pages) else None, None)]
    assert list(tables.TextWindow().eval(text, len(pages) + 1, most_lines, most_bytes)) == [(None, None, "PAGE_OUT_OF_RANGE")]
    assert list(tables.TextWindow().eval(text, 0, most_lines, most_bytes)) == [(None, None, "PAGE_OUT_OF_RANGE")]


def test_lateral_joins(spark, sql):
    docs = spark.createDataFrame([(1, "a\nb\nc", 2), (2, None, None), (3, "x", 9), (1, "a\nb\nc", 1)], "id long, text string, page int")
    assert sorted(sql("SELECT id, page_no, byte_start, p.text FROM {d} d, LATERAL text_pages(d.text, 2) p", d=docs)) == [(1, 1, 0, "a\nb\n"), (1, 1, 0, "a\nb\n"), (1, 2, 4, "c"), (1, 2, 4, "c"), (2, 1, 0, ""), (3, 1, 0, "x")]
    got = sql("SELECT id, w.text, next_page, error_code FROM {d} d, LATERAL text_window(d.text, d.page, 2) w", d=docs)
    assert sorted(got, key=str) == [(1, "a\nb\n", 2, None), (1, "c", None, None), (2, "", None, None), (3, None, None, "PAGE_OUT_OF_RANGE")]
    assert sql("SELECT p.* FROM {d} d, LATERAL text_pages(d.text) p", d=docs.limit(0)) == []


def test_archives_from_sql_as_from_columns(spark, sql):
    first = zipped(("a/x.txt", "one"), ("../out", "no"), ("a/./x.txt", "again"), ("b.txt", "two"), ("a/y/", ""), ("a/z", "three"))
    held = spark.createDataFrame([(1, first), (2, b"broken"), (3, None)], "id long, content binary")
    for prefix, cursor, most in [(None, 0, 2), ("a", 0, 1), ("a", 1, 5), (None, 9, 3), ("../a", 0, 2)]:
        given = "NULL" if prefix is None else f"'{prefix}'"
        got = sql(f"SELECT id, e.path, e.entry_no, e.next_cursor FROM {{h}} h, LATERAL list_archive(h.content, {given}, {cursor}, {most}) e WHERE e.error_code IS NULL", h=held)
        want = archives.listing(archives.entries(held), ["id"], prefix, cursor, most)
        assert sorted(got) == sorted((r.id, r.path, r.entry_no, r.next_cursor) for r in want.collect())
    assert sorted(sql("SELECT id, e.error_code FROM {h} h, LATERAL list_archive(h.content) e WHERE e.path IS NULL", h=held)) == [(2, "CORRUPT_FILE"), (3, "CORRUPT_FILE")]
    asked = spark.createDataFrame([(1, "a/x.txt"), (1, "../out"), (1, "a/y"), (1, "none"), (1, None), (2, "x")], "id long, path string")
    got = sql("SELECT a.path, decode(e.entry, 'UTF-8'), e.error_code FROM {a} a JOIN {h} h USING (id), LATERAL read_entry(h.content, a.path) e WHERE a.id = 1", a=asked, h=held)
    assert {r[0]: r[1:] for r in got} == {"a/x.txt": ("again", None), **{x: (None, "ARCHIVE_PATH_REJECTED") for x in ("../out", "a/y", "none", None)}}


@pytest.mark.parametrize("call", ["text_pages(1)", "text_pages('a', 0)", "text_pages('a', 2001)", "text_pages('a', CAST(rand() AS INT))", "text_window('a', 'b')", "list_archive('a')", "list_archive(X'00', NULL, 0, 10001)", "read_entry(X'00', 1)"])
def test_wrong_arguments_are_refused_before_a_task_runs(sql, call):
    with pytest.raises(Exception, match="must be"):
        sql(f"SELECT * FROM {call}")


def test_requests_as_a_view(spark):
    files = store.hashed(spark.createDataFrame([("a", "s1", b"token: x\nplain"), ("b", "s2", b"other")], "id string, owner_session_id string, content binary"))
    refs = files.select("id", "owner_session_id", "sha256", F.struct(F.lit("text").alias("kind"), F.lit("text").alias("family")).alias("detected"))
    made = api.Attachments(refs, store.new_blobs(files))
    spark.createDataFrame([("s1", "a", 0), ("s1", "b", 0), ("s2", "b", 2)], "session_id string, id string, offset int").createOrReplaceTempView("asked")
    made.publish("asked", "answers")
    got = sorted(tuple(r) for r in spark.sql("SELECT session_id, id, coalesce(text, ''), coalesce(error_code, '') FROM answers").collect())
    assert got == [("s1", "a", "token: [REDACTED]\nplain", ""), ("s1", "b", "", "ATTACHMENT_FORBIDDEN"), ("s2", "b", "her", "")]
    spark.catalog.dropTempView("asked")
    spark.catalog.dropTempView("answers")

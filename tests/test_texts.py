from pyspark.sql import functions as F

from quarrystone.operators import store
from quarrystone.plans import lifecycle
from quarrystone.plans.texts import TextStore


def asked(files):
    return files.select(F.col("k").alias("id"), "sha256", F.struct("kind", F.when(F.col("kind") == "text", "text").otherwise("document").alias("family")).alias("detected"))


def read(frame):
    return sorted((r.id, r.text or None, r.redacted, r._failed) for r in frame.collect())


def test_contents_are_opened_once(spark, tmp_path):
    rows = [(1, "text", b"token: a\nb"), (2, "text", b"plain"), (3, "text", b"plain"), (4, "docx", b"no package")]
    files = store.hashed(spark.createDataFrame(rows, "k long, kind string, content binary"))
    blobs, kept = store.new_blobs(files), TextStore(spark, str(tmp_path / "texts"))
    want = [(1, "token: [REDACTED]\nb", 1, None), (2, "plain", 0, None), (3, "plain", 0, None), (4, None, 0, "CORRUPT_FILE")]
    assert read(lifecycle.masked_texts(asked(files), blobs, kept)) == want
    assert kept.known().count() == 2  # equal contents once, failures not at all
    # The contents are gone: what is known needs none, and what failed is tried again.
    gone = blobs.withColumn("content", F.lit(None).cast("binary"))
    assert read(lifecycle.masked_texts(asked(files), gone, kept)) == want
    # One more content: it alone is opened.
    more = store.hashed(spark.createDataFrame([(5, "text", b"new")], "k long, kind string, content binary"))
    both = gone.unionByName(store.new_blobs(more))
    opened = []

    def reader(needed):
        opened.extend(r.sha256 for r in needed.collect())
        return lifecycle.document_texts(needed)

    needed = asked(files.unionByName(more)).select("sha256", "detected.kind", "detected.family").filter("kind = 'text'")
    assert sorted(r.text for r in kept.read(needed, both, reader).collect()) == ["new", "plain", "token: a\nb"]
    assert opened == [more.first().sha256]
    # Another version of the readers begins anew.
    assert TextStore(spark, str(tmp_path / "texts"), version=99).known().count() == 0


def test_one_content_of_two_kinds(spark, tmp_path):
    rows = [(1, "text", b"{\\rtf1 x}"), (2, "rtf", b"{\\rtf1 x}")]
    files = store.hashed(spark.createDataFrame(rows, "k long, kind string, content binary"))
    kept = TextStore(spark, str(tmp_path / "texts"))
    for _ in range(2):
        assert [x[1] for x in read(lifecycle.masked_texts(asked(files), store.new_blobs(files), kept))] == ["{\\rtf1 x}", "x"]
    assert lifecycle.masked_texts(asked(files).limit(0), store.new_blobs(files), kept).count() == 0

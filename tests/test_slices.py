"""Python holds slices of a batch, and work is dealt to tasks whatever a table's files are."""

from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from quarrystone import file_queries
from quarrystone.functions.arrow import SLICE, arrow_function
from quarrystone.operators import line_index
from quarrystone.sources.packages import packed


def test_functions_see_slices(spark):
    @arrow_function("n long, kept map<string,string>")
    def seen(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(text)] * len(text), "kept": [None if x is None else {"x": x} for x in text]})

    rows = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))
    found = rows.select("id", seen("text").alias("s")).select("id", "s.*").collect()
    assert max(r.n for r in found) <= SLICE and len(found) == 1000
    assert all(r.kept == (None if r.id % 3 == 0 else {"x": str(r.id)}) for r in found)
    assert spark.range(0).select(seen(F.lit("x"))).collect() == []


def test_packages_of_a_batch_are_packed_in_slices(spark, tmp_path):
    from zipfile import ZipFile

    rows = spark.range(0, 600, 1, 1).select("id", packed({"a": F.col("id").cast("string"), "b": F.when(F.col("id") % 2 == 0, "even")}).alias("content")).collect()
    for r in rows:
        (tmp_path / "x.zip").write_bytes(r.content)
        with ZipFile(tmp_path / "x.zip") as archive:
            assert archive.read("a").decode() == str(r.id) and archive.namelist() == (["a", "b"] if r.id % 2 == 0 else ["a"])


def test_one_row_group_is_many_tasks(spark, tmp_path):
    n = 3 * file_queries.TASK_ROWS
    spark.range(0, n, 1, 1).select(F.col("id").alias("c_custkey"), F.lit("a").alias("c_name"), F.lit("b").alias("c_mktsegment"), F.lit(1).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    found = file_queries.xlsx_cells(spark, str(tmp_path))
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 3 and sum(r["count"] for r in tasks) == 4 * n


def test_pages_that_are_not_there_are_dealt_by_content(spark, tmp_path):
    files = []
    for k in range(40):
        (tmp_path / f"{k}.txt").write_text(f"{k}\n" * 5)
        files.append((f"h{k}", f"{tmp_path}/{k}.txt", len(f"{k}\n") * 5))
    files = spark.createDataFrame(files, "sha256 string, path string, size long")
    asked = files.select("sha256", F.explode(F.array(F.lit(1), F.lit(2), F.lit(9)).cast("array<long>")).alias("page"))
    found = line_index.read_pages(asked, line_index.build(files, every=4, window=3), task_bytes=20_000)
    rows = found.withColumn("_task", F.spark_partition_id()).collect()
    texts = {(r.sha256, r.page): r.text for r in rows}
    assert all(texts[f"h{k}", 1] == "\n".join([str(k)] * 4) and texts[f"h{k}", 2] == f"{k}\n" for k in range(40))
    assert len({r._task for r in rows if r.error_code == "PAGE_OUT_OF_RANGE"}) > 1


def test_files_of_a_query_lie_in_folders_and_are_listed_once(spark, tmp_path, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    want = sorted(map(str, file_queries.indexed_pages(spark, sf_dir).collect()))
    monkeypatch.setattr(file_queries, "FOLDER_FILES", 4)
    found = file_queries.indexed_pages(spark, sf_dir)
    assert sorted(map(str, found.collect())) == want
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert {leaves.apply(k).nodeName() for k in range(leaves.size())} == {"InMemoryRelation"}
    rows = spark.range(0, 200, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.lit("x").alias("content"))
    folder = Path(file_queries._on_disk(spark, rows).removeprefix("file:"))
    below = list(folder.iterdir())
    assert 40 < len(below) <= 50 and sorted(f.name for x in below for f in x.iterdir()) == sorted(f"{k}.txt" for k in range(200))


def test_equal_contents_are_one_file_and_total_bytes_deal_requests(spark, tmp_path):
    files = []
    for k in range(60):  # thirty contents, each at two places
        (tmp_path / f"{k}.txt").write_text(f"{k % 30}\n" * 9)
        files.append((f"h{k % 30}", f"{tmp_path}/{k}.txt", len(f"{k % 30}\n") * 9))
    index = line_index.build(spark.createDataFrame(files, "sha256 string, path string, size long").repartition(7, "path"), every=4, window=5)
    rows = index.collect()
    assert len(rows) == 90 and {(r.sha256, r.path) for r in rows} == {(h, min(p for g, p, _ in files if g == h)) for h, _, _ in files}
    asked = spark.createDataFrame([(f"h{k}", page) for k in range(31) for page in (1, 2, 3, 4)], "sha256 string, page int")
    found = line_index.read_pages(asked, index, task_bytes=4200)
    got = {(r.sha256, r.page): r.text if r.error_code is None else r.error_code for r in found.collect()}
    assert got == {(f"h{k}", p): "CORRUPT_FILE" if k == 30 else "PAGE_OUT_OF_RANGE" if p == 4 else "\n".join([str(k)] * (4 if p < 3 else 1)) + ("\n" if p == 3 else "") for k in range(31) for p in (1, 2, 3, 4)}
    assert 100 < found.rdd.getNumPartitions() <= 124

import io
import os
import pickle
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import zips
from quarrystone.functions.detection import look
from quarrystone.operators import archive_scan
from quarrystone.sources import ranges
from quarrystone.sources.packages import _widened


class Counted:
    """Bytes that count what is read of them."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def __call__(self, at, n):
        part = self.data[at : at + n]
        self.read += len(part)
        return part


def package(parts, method=zipfile.ZIP_DEFLATED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as archive:
        for name, data in parts:
            archive.writestr(zipfile.ZipInfo(name) if not isinstance(name, zipfile.ZipInfo) else name, data, method)
        archive.comment = comment
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 40)
    (tmp_path / "sub" / "b.txt").write_bytes(b"hello")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x")
    return tmp_path


def rows(frame):
    return sorted((os.path.basename(r.path), r.size, r.offset, bytes(r.content)) for r in frame.collect())


def test_ranges_of_files(spark, folder):
    data = bytes(range(256)) * 40
    assert rows(ranges.read_ranges(spark, str(folder), head=3, tail=4)) == [("a.bin", 10240, 0, data[:3]), ("a.bin", 10240, 10236, data[-4:]), ("b.txt", 5, 0, b"hello"), ("empty", 0, 0, b"")]
    assert rows(ranges.read_ranges(spark, f"file://{folder}", offset=2, length=2)) == [("a.bin", 10240, 2, data[2:4]), ("b.txt", 5, 2, b"ll"), ("empty", 0, 0, b"")]
    assert b"".join(x[3] for x in rows(ranges.read_ranges(spark, str(folder), window=1000, glob="*.bin", partitionBytes=6000))) == data
    assert [x[1:] for x in rows(ranges.read_ranges(spark, str(folder)))] == [(10240, 0, b""), (5, 0, b""), (0, 0, b"")]
    assert rows(ranges.read_ranges(spark, str(folder / "sub" / "b.txt"), head=2)) == [("b.txt", 5, 0, b"he")]


def test_partitions_by_bytes(spark, folder):
    assert ranges.read_ranges(spark, str(folder), window=1000, partitionBytes=6000).rdd.getNumPartitions() >= 10
    assert ranges.read_ranges(spark, str(folder), window=1000).rdd.getNumPartitions() == 1


def test_filters_prune_ranges(spark, folder):
    reader = ranges.RangeReader({"path": str(folder), "window": "1000"})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull

    left = list(reader.pushFilters([GreaterThanOrEqual(("offset",), 9000), IsNotNull(("path",)), EqualTo(("content",), b"")]))
    assert [type(x).__name__ for x in left] == ["IsNotNull", "EqualTo"]
    assert [p[3:] for t in reader.partitions() for p in t.pieces] == [(9000, 1000), (10000, 240)]
    plan = ranges.read_ranges(spark, str(folder), window=1000).filter("offset >= 9000")
    assert [x[2] for x in rows(plan)] == [9000, 10000]


def test_only_asked_bytes_of_a_huge_file(spark, tmp_path):
    """A file of 2 TB, nearly all a hole: its ends, a window and its type, in no time."""
    path = tmp_path / "huge.zip"
    with open(path, "wb") as out:
        out.write(b"PK\x03\x04 begin")
        out.seek((2 << 40) - 3)
        out.write(b"end")
    began = time.time()
    assert [x[2:] for x in rows(ranges.read_ranges(spark, str(tmp_path), head=10, tail=3))] == [(0, b"PK\x03\x04 begin"), ((2 << 40) - 3, b"end")]
    assert rows(ranges.read_ranges(spark, str(tmp_path), offset=1 << 40, length=4))[0][2:] == (1 << 40, b"\0" * 4)
    files = ranges.read_ranges(spark, str(tmp_path)).select("path", "size", F.lit("huge.zip").alias("name"), F.lit("").alias("declared_mime"))
    assert ranges.detect_files(files).first().detected.kind == "zip"
    assert time.time() - began < 60


def test_detection_reads_heads_and_directories_only():
    big = os.urandom(3_000_000)
    for parts, kind in (([("x.bin", big), ("[Content_Types].xml", "<T/>"), ("word/document.xml", "<w/>")], "docx"), ([("mimetype", "application/epub+zip"), ("x.bin", big)], "epub"), ([("x.bin", big)], "zip")):
        read = Counted(package(parts))
        assert look(read, len(read.data))[0][1] == kind
        assert read.read < 80_000
    read = Counted(b"plain text " * 500_000)
    assert look(read, len(read.data))[1].startswith("plain text") and read.read == 4100


def test_directories_against_the_standard_library():
    data = package([("a.txt", "1"), ("d/", ""), ("日本.txt", "x" * 999), ("../up", "y")], comment=b"some comment")
    assert len(zips.directory(zips.of_bytes(x := package([("a", "1")], comment=b"a sign PK\5\6 in it")), len(x))) == 1
    found = zips.directory(Counted(data), len(data))
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        want = archive.infolist()
        assert [(e.name, e.method, e.crc, e.compressed, e.size, e.offset, e.is_regular) for e in found] == [(x.filename, x.compress_type, x.CRC, x.compress_size, x.file_size, x.header_offset, not x.is_dir()) for x in want]
        for e, x in zip(found, want, strict=True):
            assert zips.payload(Counted(data), len(data), e.offset, e.method, e.flags, e.crc, e.compressed) == (archive.read(x), None)


def test_refusals():
    data = package([("a.txt", "hello " * 50), ("b.txt", "2")])
    refused = {
        "64 bit": _widened(data),
        "split": data[:-18] + b"\1\0" + data[-16:],
        "counts": data[:-12] + b"\3\0" + data[-10:],
        "cut": data[:-5],
        "no zip": b"x" * 100,
        "empty": b"",
    }
    for name, own in refused.items():
        assert zips.directory(zips.of_bytes(own), len(own)) is None, name
    with zipfile.ZipFile(io.BytesIO(refused["64 bit"])) as archive:  # well formed, and refused all the same
        assert archive.namelist() == ["a.txt", "b.txt"]
    e = zips.directory(zips.of_bytes(data), len(data))[0]
    broken = bytearray(data)
    broken[e.offset + 40] ^= 0xFF
    assert zips.payload(zips.of_bytes(bytes(broken)), len(data), e.offset, e.method, e.flags, e.crc, e.compressed)[1] == "CORRUPT_FILE"
    assert zips.payload(zips.of_bytes(data), len(data), e.offset, e.method, e.flags, e.crc, e.compressed, 10) == (None, "FILE_TOO_LARGE")
    assert zips.payload(zips.of_bytes(data), len(data), e.offset, e.method, 1, e.crc, e.compressed) == (None, "CORRUPT_FILE")


def test_entries_are_dealt_by_bytes(spark, tmp_path):
    """One archive is many tasks; what is not asked for is not read."""
    parts = [(f"p{k}.bin", os.urandom(50_000)) for k in range(40)]
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    (tmp_path / "one.zip").write_bytes(package([*parts, ("../out", "x"), (link, "p0.bin")]))
    (tmp_path / "none.zip").write_bytes(package([]))
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04")
    files = ranges.read_ranges(spark, str(tmp_path)).select("path", "size")
    entries = archive_scan.directories(files).cache()
    assert entries.filter("error_code = 'CORRUPT_FILE'").count() == 1
    found = archive_scan.read_entries(entries, task_bytes=200_000)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    got = {r.entry_no: (r.name, r.error_code, r.content and zlib.crc32(bytes(r.content))) for r in found.collect()}
    assert got == {k: (n, None, zlib.crc32(d)) for k, (n, d) in enumerate(parts)} | {40: (None, "ARCHIVE_PATH_REJECTED", None), 41: ("link", "ARCHIVE_PATH_REJECTED", None)}
    assert archive_scan.read_entries(entries.limit(0)).collect() == []


def test_stream_of_new_files(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()

    def run():
        ranges.stream_ranges(spark, str(source), head=4).select("path", "content").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted((os.path.basename(r.path), bytes(r.content)) for r in spark.read.schema("path string, content binary").parquet(str(tmp_path / "out")).collect())

    (source / "a").write_bytes(b"first file")
    assert run() == [("a", b"firs")]
    (source / "b").write_bytes(b"second")
    os.utime(source / "b", ns=(os.stat(source / "a").st_mtime_ns,) * 2)  # the same time: new all the same
    (source / "c").write_bytes(b"3")
    assert run() == [("a", b"firs"), ("b", b"seco"), ("c", b"3")]
    assert len(run()) == 3


def test_written_files(spark, tmp_path):
    rows_ = spark.createDataFrame([("x/1.bin", b"one"), ("x/2.bin", None)], "name string, content binary")
    ranges.write_files(rows_, str(tmp_path))
    ranges.write_files(rows_, str(tmp_path))
    assert rows(ranges.read_ranges(spark, str(tmp_path), head=10)) == [("1.bin", 3, 0, b"one"), ("2.bin", 0, 0, b"")]


def test_the_driver_lists_no_files_of_many_folders(spark, tmp_path):
    """Sizes of files in many folders: tasks list the folders, and what the driver holds does not grow with the files."""
    for k in range(40):
        (tmp_path / "in" / f"{k}" / "deep").mkdir(parents=True)
        for j in range(10):
            (tmp_path / "in" / f"{k}" / ("deep" if j % 2 else "") / f"{j}.txt").write_bytes(b"x" * j)
        (tmp_path / "in" / f"{k}" / "_hidden").write_bytes(b"x")
    (tmp_path / "in" / "top.txt").write_bytes(b"top")
    parts = ranges.RangeReader({"path": str(tmp_path), "glob": "*.txt"}).partitions()
    assert sum(len(x.pieces) for x in parts if isinstance(x, ranges.Ranges)) == 1
    found = ranges.read_ranges(spark, str(tmp_path), glob="*.txt")
    assert found.rdd.getNumPartitions() == len(parts) == 41
    want = sorted([(f"{tmp_path}/in/{k}/{'deep/' if j % 2 else ''}{j}.txt", j) for k in range(40) for j in range(10)] + [(f"{tmp_path}/in/top.txt", 3)])
    assert sorted((r.path, r.size) for r in found.collect()) == want
    assert sorted((r.path, r.size) for r in found.filter("size >= 8").collect()) == [x for x in want if x[1] >= 8]
    windows = ranges.read_ranges(spark, str(tmp_path), window=4, glob="*.txt").collect()  # bytes are dealt by the sizes of all files
    assert sorted((r.path, r.offset, r.length) for r in windows) == [(p, at, min(4, n - at)) for p, n in want for at in range(0, max(n, 1), 4)]


def test_dealt_pieces_are_held_packed():
    pieces = [(f"/some/long/folder/of/files/{k}.txt", k, None, 0, 0) for k in range(20_000)]
    tasks = ranges.dealt(iter(pieces), 40 << 20)
    assert [p for t in tasks for p in t.pieces] == pieces and len(tasks) == 2
    assert sum(len(pickle.dumps(t)) for t in tasks) < 15 * len(pieces)

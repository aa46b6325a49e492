import struct

import pytest

from quarrystone.functions import zips
from quarrystone.functions.detection import look
from quarrystone.sources import legacy


def compound(parts, small=False):
    """A compound file with these streams; short ones are padded into whole sectors unless ``small``."""
    names = list(parts)
    bodies = [parts[n] if small else parts[n].ljust(4096, b"\0") for n in names]
    size, table, sectors = 512, [], []

    def add(data):
        start, n = len(sectors), max(1, -(-len(data) // size))
        for k in range(n):
            sectors.append(data[k * size : (k + 1) * size].ljust(size, b"\0"))
            table.append(start + k + 1 if k + 1 < n else 0xFFFFFFFE)
        return start

    pool, links, starts = b"", [], []
    for body in bodies:
        if small:
            first, n = len(links), -(-len(body) // 64)
            starts.append(first)
            links += [*range(first + 1, first + n), 0xFFFFFFFE]
            pool += body.ljust(64 * n, b"\0")
        else:
            starts.append(add(body))
    root = add(pool) if small else 0xFFFFFFFE
    small_table = add(struct.pack(f"<{len(links)}I", *links).ljust(size, b"\xff")) if small else 0xFFFFFFFE
    entry = lambda name, kind, start, n: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", start, n, 0)
    directory = entry("Root Entry", 5, root, len(pool)) + b"".join(entry(n, 2, s, len(b)) for n, s, b in zip(names, starts, bodies, strict=True))
    first_dir = add(directory)
    place = len(sectors)
    table.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(table)}I", *table).ljust(size, b"\xff"))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIIII", 0, 1, first_dir, 0, 4096, small_table, 1 if small else 0, 0xFFFFFFFE, 0, place)
    return head.ljust(512, b"\xff") + b"".join(sectors)


def record(kind, data):
    return struct.pack("<HH", kind, len(data)) + data


def workbook():
    texts = ["名称", "count", "router", "long " * 10]
    strings = b"".join(struct.pack("<HB", len(t), 1) + t.encode("utf-16-le") if not t.isascii() else struct.pack("<HB", len(t), 0) + t.encode() for t in texts)
    cut = len(strings) - 20  # the last string runs over into the next record
    shared = record(0xFC, struct.pack("<II", 4, 4) + strings[:cut]) + record(0x3C, b"\0" + strings[cut:])
    name = "清单".encode("utf-16-le")
    globals_ = lambda at: record(0x809, b"\0" * 16) + record(0x85, struct.pack("<IHBB", at, 0, 2, 1) + name) + shared + record(0x0A, b"")
    cell = lambda kind, row, col, rest: record(kind, struct.pack("<HHH", row, col, 0) + rest)
    sheet = record(0x809, b"\0" * 16) + b"".join(cell(0xFD, 0, k, struct.pack("<I", k)) for k in range(2)) + cell(0xFD, 1, 0, struct.pack("<I", 2)) + cell(0x27E, 1, 1, struct.pack("<I", 3 << 2 | 2))
    sheet += cell(0x203, 2, 0, struct.pack("<d", 1.5)) + cell(0xFD, 2, 2, struct.pack("<I", 3)) + record(0xBD, struct.pack("<HHHIHIH", 3, 0, 0, 700 << 2 | 3, 0, 8 << 2 | 2, 1))
    sheet += cell(0x06, 4, 0, b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + record(0x207, struct.pack("<HB", 3, 0) + b"sum") + record(0x0A, b"")
    return globals_(len(globals_(0))) + sheet


def document():
    one, two = "Title\rfield \x13 PAGE \x1417\x15 end\r".encode("cp1252"), "中文\r".encode("utf-16-le")
    main = bytearray(0x400)
    struct.pack_into("<H", main, 0x0A, 0x0200)
    struct.pack_into("<I", main, 0x4C, len(one) + len(two) // 2)
    places = [len(main), len(main) + len(one)]
    main += one + two
    pieces = struct.pack("<III", 0, len(one), len(one) + len(two) // 2) + struct.pack("<HIH", 0, places[0] * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, places[1], 0)
    table = b"\x01\x02\x00xx" + b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 0x1A2, 0, len(table))
    return {"WordDocument": bytes(main), "1Table": table}


@pytest.mark.parametrize("small", [False, True])
def test_workbook(spark, small):
    data = compound({"Workbook": workbook()}, small)
    assert look(zips.of_bytes(data), len(data))[0][1] == "xls"
    want = [("清单", 1, 1, "名称"), ("清单", 1, 2, "count"), ("清单", 2, 1, "router"), ("清单", 2, 2, "3"), ("清单", 3, 1, "1.5"), ("清单", 3, 3, "long " * 10), ("清单", 4, 1, "7"), ("清单", 4, 2, "8"), ("清单", 5, 1, "sum")]
    assert legacy.workbook_cells(data) == want
    rows = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"broken")), ("c", None)], "id string, content binary")
    got = legacy.xls(rows).collect()
    assert [(r.sheet, r.row_no, r.col_no, r.value) for r in got if r.id == "a"] == want
    assert {r.error_code for r in got if r.id != "a"} == {"CORRUPT_FILE"}


@pytest.mark.parametrize("small", [False, True])
def test_document(spark, small):
    data = compound(document(), small)
    assert look(zips.of_bytes(data), len(data))[0][1] == "doc"
    rows = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"x"))], "id string, content binary")
    got = {r.id: (r.paragraphs, r.error_code) for r in legacy.doc(rows).collect()}
    assert got == {"a": (["Title", "field 17 end", "中文"], None), "b": ([], "CORRUPT_FILE")}

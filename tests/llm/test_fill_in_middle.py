import hashlib
import random
import re

from quarrystone.llm import fill_in_middle as fim

PARTS = ["a", "Bc", " ", "\n", "é", "日", "😀", "<", "P", ">", "<P", "S>", "\r", ".", "\x00"]


def brute(text, key):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_slices_of_strings():
    rng, forms = random.Random(1), set()
    for k in range(5000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 30)))
        *rest, output = fim.transformed(text.encode(), str(k))
        assert (*rest, output.decode()) == brute(text, k)
        assert fim.restored(output, rest[1]) == text.encode()
        forms.add(rest[1])
    assert forms == {"plain", "psm", "spm"}


def test_rotation_exchanges_blocks():
    buffer = bytearray(b"..abcDE..")
    fim.rotate(buffer, 2, 5, 7)
    assert buffer == b"..DEabc.."
    fim.rotate(buffer, 2, 4, 7)
    assert buffer == b"..abcDE.."


def test_rows(spark, docs, texts):
    extra = spark.createDataFrame([(None, "no id here"), (1, "twice"), (1, "twice"), (2, "x <P> y"), (3, "long " * 400_000)], "doc_id long, text string")
    every = docs.select("doc_id", "text", "source", "_id").unionByName(extra, allowMissingColumns=True)
    found = fim.restore(fim.fill_in_middle(every)).collect()
    given = [(r.doc_id, r.text or "") for r in every.collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, *r[1:6]) for r in found), key=key) == sorted(((i, *brute(t, "" if i is None else i)) for i, t in given), key=key)
    assert sorted((str(r.doc_id), r.restored) for r in found) == sorted((str(i), t) for i, t in given)


def test_empty_table(empty):
    found = fim.digests(empty)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert found.collect() == []


def test_against_sql(spark, docs):
    import duckdb

    documents = docs.toPandas()  # noqa: F841  read by the SQL
    found = fim.digests(docs)
    want = duckdb.sql(fim.ORACLE)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert found.columns == want.columns

import random

from pyspark.sql import functions as F

from quarrystone.functions import names
from quarrystone.functions.redaction import redacted


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column(F.col("x"))).collect()]


def test_sanitize_filename(spark):
    rows = {
        "who?what*when|where.md": "who_what_when_where.md",
        '<b>"q":z': "_b__q__z",
        "nul": "_nul",
        "Aux.tar.gz": "Aux.tar.gz",
        "aux.csv": "_aux.csv",
        "com7": "_com7",
        "com10": "com10",
        "D:\\data\\x y.json": "x y.json",
        "./../deep/er/z.bin": "z.bin",
        "\x01\x1f\x7f": "unnamed",
        "///": "unnamed",
        "folder//": "folder",
        "é" * 200: "é" * 127,
    }
    assert values(spark, names.sanitize_filename, rows) == list(rows.values())


def test_archive_path(spark):
    rows = {"a/b/../../../c": None, "/root": None, "..": None, "E:\\x": None, "z:": None, " /x": " /x", "": None, "./": ".", "q//./w/e": "q/w/e", "q/w/../e": "q/e", "q\\w": "q/w"}
    assert values(spark, names.archive_path, rows) == list(rows.values())


def test_labels(spark):
    assert values(spark, names.kind_label, ["config-json", "pdf", "markdown"]) == ["JSON", "PDF", "MD"]
    rows = spark.createDataFrame([(1023,), (1024,), (1536,), (1 << 20,)], "n long").select(names.byte_label(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["1023 B", "1.0 KB", "1.5 KB", "1.0 MB"]
    assert values(spark, names.error_status, ["FILE_TOO_LARGE", "PARSER_TIMEOUT", "ATTACHMENT_FORBIDDEN", "INVALID_ARGS"]) == [413, 504, 403, 400]
    assert values(spark, names.column_number, ["A", "AB"]) == [1, 28]
    assert values(spark, names.extension, ["a.TXT", ".env", "a", "x/y.tar.gz"]) == [".txt", "", "", ".gz"]


def test_markup_chips_links(spark):
    assert values(spark, names.strip_markup, ["<a> &lt;b&gt; &amp;lt; </a>"]) == ["<b> &lt;"]
    assert values(spark, names.chips, ["/run @me x/y /a.b"]) == [["/run", "@me"]]
    links = spark.createDataFrame([("OEBPS", "../a%20b+c.xhtml#x"), ("", "c/./d.html"), ("O", "../../x")], "b string, h string")
    assert [r[0] for r in links.select(names.zip_target(F.col("b"), F.col("h"))).collect()] == ["a b+c.xhtml", "c/d.html", None]


def test_marker(spark):
    text = 'ask\nFile: a.txt\n<!-- <m r="1"/> -->\nFile: b.txt\n<!-- <m r="2"/> -->'
    assert values(spark, lambda c: names.remove_marker(c, '<m r="1"/>'), [text]) == ['ask\nFile: b.txt\n<!-- <m r="2"/> -->']


def test_origin(spark):
    rows = [("http://a.b", "a.b", True), ("http://localhost:3", "127.0.0.1:3", True), ("http://localhost:3", "127.0.0.1:4", False), ("http://x", "a", False), ("", "", False)]
    found = spark.createDataFrame([x[:2] for x in rows], "o string, h string").select(names.trusted_origin(F.col("o"), F.col("h"))).collect()
    assert [r[0] for r in found] == [x[2] for x in rows]


R = "[REDACTED]"
#: Own inputs: (text, masked, count).
CASES = [
    ("db_passwd=opensesame", f"db_passwd={R}", 1),
    ("X-Api-Key: 77-12", f"X-Api-Key: {R}", 1),
    ("    access_key   :   v w x", f"    access_key   :   {R}", 1),
    ("my cookie: is a biscuit", "my cookie: is a biscuit", 0),
    ("tokens: 3\nkeynote: 4\nsecretary = Ann\npassworded: no", "tokens: 3\nkeynote: 4\nsecretary = Ann\npassworded: no", 0),
    ("accessKey: q\nAccessKey: q\nmyAccessKey: q", f"accessKey: {R}\nAccessKey: {R}\nmyAccessKey: q", 2),
    ("'pwd' = \"river # stone\" # why ; not", f"'pwd' = \"{R}\" # why ; not", 1),
    ("secret = a;b ;note", f"secret = {R} ;note", 1),
    ("secret: a ;b #c", f"secret: {R} #c", 1),
    ("secret: 'never closed # so no comment", f"secret: '{R}'", 1),
    ("set export  AUTH_TOKEN = z", f"set export  AUTH_TOKEN = {R}", 1),
    ("-----BEGIN EC PRIVATE KEY-----\n  line\n\n-----END EC PRIVATE KEY-----\npwd=", f"-----BEGIN EC PRIVATE KEY-----\n  {R}\n\n-----END EC PRIVATE KEY-----\npwd={R}", 2),
    ("-----END PRIVATE KEY-----\nopen", "-----END PRIVATE KEY-----\nopen", 0),
    ("-----BEGIN PRIVATE KEY-----\nnever\nended", f"-----BEGIN PRIVATE KEY-----\n{R}\n{R}", 2),
    ('{"n": 1, "Password_Hash": {"a": ["}", 2]}, "m": [{"token": null}]}', f'{{"n": 1, "Password_Hash": "{R}", "m": [{{"token": "{R}"}}]}}', 1),
    ('{"pwd": 1, "open": [1, 2}', '{"pwd": 1, "open": [1, 2}', 0),
    ('{"pwd": a"b"c, "x": "cookie"}', f'{{"pwd": "{R}", "x": "cookie"}}', 1),
    ('[{"auth\\u005ftoken" : "\\"x\\""}]', f'[{{"auth\\u005ftoken" : "{R}"}}]', 1),
    ('x = {"cookie": 5}', f'x = {{"cookie": "{R}"}}', 1),
    ('{\n "credential": [\n1\n]\n}', f'{{\n "credential": "{R}"\n}}', 1),
    ("credential: >+2 # folded\n   a\n\n   b\n  c: d\ne: f", f"credential: {R} # folded\n   {R}\n\n   {R}\n  {R}\ne: f", 4),
    ("a:\n  token: |\n    x\n  b: |\n    y", f"a:\n  token: {R}\n    {R}\n  b: |\n    y", 2),
    ("one\r\ntwo", "one\ntwo", 0),
    ("", "", 0),
]


def masked(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", redacted("t").alias("r")).collect()
    return [(r.r.text, r.r.redacted) for r in sorted(rows, key=lambda r: r.k)]


def test_redact(spark):
    assert masked(spark, [c[0] for c in CASES]) == [c[1:] for c in CASES]
    assert masked(spark, [None]) == [(None, 0)]


PARTS = ["password: x", "token='a'", "a: b", '{"token": 1}', "  c", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", '"', "secret: |", "", "  pwd: >", "    d"]


def test_redact_again_is_the_same(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choices(PARTS, k=rng.randint(0, 8))) for _ in range(400)]
    once = [x for x, _ in masked(spark, texts)]
    assert [x for x, _ in masked(spark, once)] == once


def test_redact_spans_against_brute_force(spark):
    """Keys and blocks line by line, with a state for each."""
    rng = random.Random(10)
    texts = ["\n".join(rng.choices(["-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "x", " y", "  z", "secret: |", " token: >", "   ", ""], k=rng.randint(1, 14))) for _ in range(400)]

    def brute(text):
        out, key, level = [], False, None
        for line in text.split("\n"):
            depth, edge = len(line) - len(line.lstrip()), "BEGIN" in line or key and "END" in line
            if edge:
                key = "BEGIN" in line
            elif line.strip():
                if level is not None and depth <= level:
                    level = None
                opens = line.strip() in ("secret: |", "token: >")
                if level is not None or key:
                    hidden = line[:depth] + R
                else:
                    hidden = line.rsplit(" ", 1)[0] + " " + R if opens else line
                level = depth if opens and level is None else level
                line = hidden
            out.append(line)
        return "\n".join(out)

    assert [x for x, _ in masked(spark, texts)] == [brute(t) for t in texts]

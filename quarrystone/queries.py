"""The registered queries of the engine's operators, over whole tables, and their SQL.

``documents`` stand for attachments (session: ``source``; batch: a remainder of ``doc_id``; time: ``doc_id``), ``pages``
for HTML files, ``conversations`` for session logs, ``events`` for calls, ``lineitem`` for cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.functions import detection, names, redaction
from quarrystone.functions.redaction import masked
from quarrystone.operators import masking, paging, sessions, store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def added(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return added


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as refs, without their texts."""
    return _as_attachments(_table(spark, sf_dir, "documents"))


def _as_attachments(docs: DataFrame) -> DataFrame:
    ident = F.concat(F.lit("att_"), F.md5(F.col("doc_id").cast("string")))
    return docs.select(ident.alias("id"), F.col("source").alias("owner_session_id"), F.concat("lang", F.lit("-"), (F.col("doc_id") % 5).cast("string"), F.lit(".txt")).alias("safe_name"), F.col("doc_id").alias("created_at"), F.lit("text").alias("family"), F.lit("text").alias("kind"))


_ATT = """att AS (SELECT 'att_' || md5(doc_id::VARCHAR) AS id, source AS owner_session_id, lang || '-' || (doc_id % 5) || '.txt' AS safe_name,
  doc_id AS created_at, 'text' AS family, 'text' AS kind FROM documents)"""
_HEAD = """coalesce(try(decode(array_slice(encode(text), 1, 4100))), try(decode(array_slice(encode(text), 1, 4099))),
  try(decode(array_slice(encode(text), 1, 4098))), try(decode(array_slice(encode(text), 1, 4097))))"""


def _kind_sql(t: str, name: str) -> str:
    delimited = lambda m: f"len(list_filter(regexp_split_to_array({t}, '\\r?\\n'), lambda x: x <> '')) >= 2 AND contains(list_filter(regexp_split_to_array({t}, '\\r?\\n'), lambda x: x <> '')[1], {m}) AND contains(list_filter(regexp_split_to_array({t}, '\\r?\\n'), lambda x: x <> '')[2], {m})"
    # The patterns of text kinds, in their order.
    return rf"""CASE
    WHEN regexp_matches({t}, '^\s*#!\s*(?:/usr/bin/env\s+)?(?:/(?:usr/)?bin/)?(?:bash|zsh|sh|dash|fish)\b') THEN 'shell'
    WHEN regexp_matches({t}, '(?mi)^FROM\s+\S') THEN 'dockerfile'
    WHEN regexp_matches({t}, '(?i)^\s*<(?:!doctype\s+html|html)\b') THEN 'html'
    WHEN regexp_matches({t}, '(?i)^\s*<svg\b') THEN 'svg'
    WHEN regexp_matches({t}, '(?i)^\s*<(?:\?xml\b|\w+[\s>])') THEN CASE WHEN regexp_matches({t}, '(?i)<plist\b') THEN 'plist' ELSE 'config-xml' END
    WHEN regexp_matches({t}, '^\s*[\[{{]') AND json_valid(ltrim({t})) THEN 'config-json'
    WHEN regexp_matches({t}, '(?i)^\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b') THEN 'sql'
    WHEN regexp_matches({t}, '(?m)^#{{1,6}}\s+\S|^```') THEN 'markdown'
    WHEN regexp_matches({t}, '(?m)^\s*[\w.\-]+:\s+\S') THEN 'config-yaml'
    WHEN regexp_matches({t}, '(?m)^\s*\[[^\]\n]+\]\s*\n(?:.|\n)*?^\s*[\w.\-]+\s+=\s+\S') THEN 'config-toml'
    WHEN regexp_matches({t}, '(?m)^\s*\[[^\]\n]+\]\s*\n(?:.|\n)*?^\s*[\w.\-]+\s*=\s*\S') THEN 'config-ini'
    WHEN {delimited("chr(9)")} THEN 'tsv'
    WHEN {delimited("','")} THEN 'csv'
    WHEN regexp_matches({name}, '\.html?$') THEN 'html' ELSE 'text' END"""


@query(f"SELECT doc_id, {_kind_sql('h', chr(39) * 2)} AS kind FROM (SELECT doc_id, {_HEAD} AS h FROM documents)")
def detect_documents(spark, sf_dir):
    """Kinds of the documents, by the first 4,100 bytes."""
    head = _table(spark, sf_dir, "documents").select("doc_id", detection.head_text(F.coalesce("text", F.lit(""))).alias("h"))
    return head.select("doc_id", detection.text_kind(F.lit(""), F.col("h")).alias("kind"))


@query(f"""WITH p AS (SELECT page_id, {_HEAD.replace("text", "html")} AS h, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages),
k AS (SELECT page_id, name, {_kind_sql("h", "name")} AS kind FROM p)
SELECT page_id, kind, CASE kind WHEN 'html' THEN 'text/html' ELSE 'text/plain' END AS mime,
  (regexp_matches(name, '\\.html?$') AND kind <> 'html') OR (kind <> 'html' AND kind <> 'text') AS mismatch FROM k""")
def mismatch_pages(spark, sf_dir):
    """Kinds of the pages; whether the url's extension or the declared type says otherwise."""
    name = F.regexp_extract("url", "([^/]*)$", 1)
    rows = _table(spark, sf_dir, "pages").select("page_id", names.sanitize_filename(name).alias("name"), detection.head_text(F.coalesce("html", F.lit(""))).alias("h"))
    rows = rows.select("page_id", "name", detection.text_kind(F.col("name"), F.col("h")).alias("kind")).withColumn("mime", detection.text_mime(F.col("kind")))
    declared = F.when(F.col("kind") == "text", "text/plain").otherwise("text/html")
    return rows.select("page_id", "kind", "mime", detection.mismatch(F.col("name"), declared, F.col("kind"), F.col("mime")).alias("mismatch"))


@query(r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[\x00-\x1f\x7f]', '', 'g'), '\\', '/', 'g'), '/+$', ''), '^.*/', '') AS b FROM pages),
r AS (SELECT page_id, regexp_replace(b, '[<>:"|?*]', '_', 'g') AS b FROM n)
SELECT page_id, CASE WHEN b = '' THEN 'unnamed' WHEN regexp_matches(regexp_replace(b, '\.[^.]*$', ''), '^(?i:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || b ELSE b END AS safe_name FROM r""")
def sanitize_names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", names.sanitize_filename(F.col("url")).alias("safe_name"))


@query("""SELECT sha256(text) AS sha256, min(strlen(text)) AS bytes, count(*) AS n_refs, count(DISTINCT source) AS n_sessions, min(doc_id) AS first_id,
  'blobs/sha256/' || left(sha256(text), 2) || '/' || sha256(text) AS storage_path FROM documents GROUP BY sha256(text)""")
def blob_dedupe(spark, sf_dir):
    """Distinct contents and how many refs each has."""
    docs = store.hashed(_table(spark, sf_dir, "documents"), "text")
    found = docs.groupBy("sha256").agg(F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_refs"), F.countDistinct("source").alias("n_sessions"), F.min("doc_id").alias("first_id"))
    return found.withColumn("storage_path", names.storage_path(F.col("sha256")))


@query("""WITH RECURSIVE u AS (SELECT source AS session_id, doc_id % 7 AS batch_id, doc_id AS seq, strlen(text) * 9000 AS bytes,
    row_number() OVER (PARTITION BY source, doc_id % 7 ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT session_id, batch_id, seq, rn, CASE WHEN bytes <= 52428800 THEN 1 ELSE 0 END AS n, CASE WHEN bytes <= 52428800 THEN bytes ELSE 0 END AS used, bytes <= 52428800 AS ok FROM u WHERE rn = 1
  UNION ALL SELECT u.session_id, u.batch_id, u.seq, u.rn, f.n + CASE WHEN f.n < 10 AND f.used + u.bytes <= 52428800 THEN 1 ELSE 0 END,
    f.used + CASE WHEN f.n < 10 AND f.used + u.bytes <= 52428800 THEN u.bytes ELSE 0 END, f.n < 10 AND f.used + u.bytes <= 52428800
  FROM f JOIN u ON u.session_id = f.session_id AND u.batch_id = f.batch_id AND u.rn = f.rn + 1)
SELECT session_id, batch_id, seq, CASE WHEN NOT ok THEN 'MESSAGE_FILES_TOO_LARGE' END AS error_code FROM f""")
def quota_admission(spark, sf_dir):
    """Which uploads a batch's quota of 10 files and 50 MiB admits, in order of arrival; a character stands for 9,000 bytes."""
    uploads = _table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), (F.col("doc_id") % 7).alias("batch_id"), F.col("doc_id").alias("seq"), (F.octet_length("text").cast("long") * 9000).alias("bytes"))
    return store.admit(uploads).drop("bytes")


@query(f"""WITH {_ATT} SELECT id, owner_session_id, safe_name, created_at FROM att
QUALIFY row_number() OVER (PARTITION BY owner_session_id, safe_name ORDER BY created_at DESC, id DESC) = 1""")
def latest_by_name(spark, sf_dir):
    return store.latest_by_name(_attachments(spark, sf_dir)).select("id", "owner_session_id", "safe_name", "created_at")


@query(f"WITH {_ATT} SELECT id, owner_session_id, row_number() OVER (PARTITION BY owner_session_id ORDER BY created_at DESC, id DESC) AS position FROM att")
def session_listing(spark, sf_dir):
    return store.session_listing(_attachments(spark, sf_dir)).select("id", "owner_session_id", "position")


_REQUESTS = "req AS (SELECT event_id, 'src' || (user_id % 20) AS session_id, 'att_' || md5((event_id % (SELECT count(*) FROM documents))::VARCHAR) AS id FROM events)"


def _requests(spark, sf_dir):
    """Requests of the events, over all documents."""
    total = _table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))  # one row
    events = _table(spark, sf_dir, "events").select("event_id", "user_id").crossJoin(F.broadcast(total))
    return events.select("event_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("session_id"), F.concat(F.lit("att_"), F.md5((F.col("event_id") % F.col("n")).cast("string"))).alias("id"))


@query(f"WITH {_ATT}, {_REQUESTS} SELECT event_id, req.id, safe_name FROM req JOIN att ON req.id = att.id AND req.session_id = att.owner_session_id")
def authorized_reads(spark, sf_dir):
    """Requests of owners, with the ref they may read."""
    return store.authorize(_requests(spark, sf_dir), _attachments(spark, sf_dir)).filter("error_code IS NULL").select("event_id", "id", "safe_name")


@query(f"""WITH {_ATT}, {_REQUESTS} SELECT event_id, id, 403 AS status FROM req
WHERE NOT EXISTS (SELECT 1 FROM att WHERE att.id = req.id AND att.owner_session_id = req.session_id)""")
def forbidden_reads(spark, sf_dir):
    judged = store.authorize(_requests(spark, sf_dir), _attachments(spark, sf_dir)).filter("error_code IS NOT NULL")
    return judged.select("event_id", "id", names.error_status(F.col("error_code")).alias("status"))


def _known(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return labels.select(F.col("source").alias("session_id"), F.concat(F.lit("att_"), F.md5(F.col("doc_id").cast("string"))).alias("id"))


@query(f"""WITH {_ATT}, fresh AS (SELECT * FROM att WHERE id NOT IN (SELECT 'att_' || md5(doc_id::VARCHAR) FROM labels JOIN documents USING (doc_id)))
SELECT owner_session_id AS session_id, count(*) AS n_fresh, string_agg(safe_name || ' (' || id || ', ' || family || '/' || kind || ')', ', ' ORDER BY created_at DESC, id DESC) AS text
FROM fresh GROUP BY owner_session_id""")
def announce_fresh(spark, sf_dir):
    """One announcement for each session, of the attachments that the log does not name."""
    return sessions.announce(_attachments(spark, sf_dir), _known(spark, sf_dir)).drop("ids")


_LOG = "log AS (SELECT conv_id AS session_id, text || ' att_' || md5((turn % 7)::VARCHAR) || ', att_' || md5(conv_id::VARCHAR) || '!' AS text FROM conversations WHERE role = 'user')"


@query(f"WITH {_LOG} SELECT DISTINCT session_id, unnest(regexp_extract_all(text, 'att_[a-f0-9]{{32}}')) AS id FROM log")
def announced_rebuild(spark, sf_dir):
    """The announced ids of each session, from its log."""
    log = _table(spark, sf_dir, "conversations").filter("role = 'user'")
    mark = lambda c: F.concat(F.lit("att_"), F.md5(c.cast("string")))
    texts = log.select(F.col("conv_id").alias("session_id"), F.concat("text", F.lit(" "), mark(F.col("turn") % 7), F.lit(", "), mark(F.col("conv_id")), F.lit("!")).alias("text"))
    return sessions.ids_in(texts)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, ((n - 1) // 5 + 1)::BIGINT AS page_no, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY n)) AS text_md5,
  ((n - 1) // 5 + 1) * 5 < (SELECT count(*) FROM l l2 WHERE l2.doc_id = l.doc_id) AS has_more FROM l GROUP BY doc_id, (n - 1) // 5""")
def line_pages(spark, sf_dir):
    """Pages of five lines."""
    pages = paging.line_pages(_table(spark, sf_dir, "documents"), most=5)
    return pages.select("doc_id", "page_no", "n_lines", F.md5("text").alias("text_md5"), "has_more")


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
SELECT doc_id, array_to_string(p[2:3], chr(10)) AS text, len(p) > 3 AS has_more, CASE WHEN len(p) > 3 THEN 3 ELSE -1 END::BIGINT AS next_offset FROM l""")
def paragraph_window(spark, sf_dir):
    """Two paragraphs from the second on."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", paging.window_of(F.split("text", r"\r?\n", -1), 1, 2).alias("w"))
    return rows.select("doc_id", "w.text", "w.has_more", F.coalesce("w.next_offset", F.lit(-1)).alias("next_offset"))


_PREFIX = " ,".join(f"try(decode(array_slice(encode(rest), 1, {n})))" for n in (2000, 1999, 1998, 1997))


@query(
    rf"""WITH RECURSIVE p AS (SELECT doc_id, 0::BIGINT AS page_no, 0::BIGINT AS byte_start, '' AS text, coalesce(text, '') AS rest FROM documents
  UNION ALL SELECT doc_id, page_no + 1, byte_start + strlen(text), page, substr(rest, length(page) + 1)
  FROM (SELECT *, CASE WHEN k IS NULL THEN coalesce({_PREFIX}) ELSE array_to_string(l[1:k], chr(10)) || CASE WHEN k < len(l) THEN chr(10) ELSE '' END END AS page
    FROM (SELECT *, list_max(list_filter(range(1, least(len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END, 40) + 1), lambda k: strlen(array_to_string(l[1:k], chr(10))) + CASE WHEN k < len(l) THEN 1 ELSE 0 END <= 2000)) AS k
      FROM (SELECT *, string_split(rest, chr(10)) AS l FROM p WHERE rest <> '' OR page_no = 0))))
SELECT doc_id, page_no, byte_start, strlen(text)::BIGINT AS byte_len, text FROM p WHERE page_no > 0"""
)
def byte_pages(spark, sf_dir):
    """Pages of whole lines within 2,000 bytes and 40 lines."""
    return paging.byte_pages(_table(spark, sf_dir, "documents"), most_lines=40, most_bytes=2000)


_ENTRIES = r"""e AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS archive, regexp_replace(url, '^[a-z]+://[^/]*/', '') || CASE WHEN page_id % 11 = 0 THEN '/../../..' ELSE '' END AS raw, page_id FROM pages)"""


def _entries(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    raw = F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), F.when(F.col("page_id") % 11 == 0, "/../../..").otherwise(""))
    return pages.select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("archive"), raw.alias("raw"), "page_id").withColumn("path", names.archive_path(F.col("raw")))


@query(rf"""WITH {_ENTRIES}, s AS (SELECT archive, regexp_replace(raw, '/+$', '') AS path, min(page_id) AS f FROM e WHERE page_id % 11 <> 0 AND raw <> '' GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY f) - 1 AS entry_no, count(*) OVER (PARTITION BY archive) AS c FROM s WHERE starts_with(path, 'en'))
SELECT archive, path, entry_no, CASE WHEN c > 6 THEN 6 ELSE -1 END::BIGINT AS next_cursor FROM n WHERE entry_no BETWEEN 2 AND 5""")
def entry_listing(spark, sf_dir):
    """Of each host as an archive, entries 2 to 5 of its distinct safe paths that begin with en."""
    safe = _entries(spark, sf_dir).filter(F.startswith("path", F.lit("en")))
    first = safe.groupBy("archive", "path").agg(F.min("page_id").alias("_first"))
    return paging.cursor_page(first, ["archive"], [F.col("_first")], 2, 4).drop("_first").fillna(-1, ["next_cursor"])


@query(rf"WITH {_ENTRIES} SELECT page_id, archive, raw FROM e WHERE page_id % 11 = 0 OR raw = ''")
def entry_rejects(spark, sf_dir):
    """Unsafe paths."""
    return _entries(spark, sf_dir).filter(F.col("path").isNull()).select("page_id", "archive", "raw")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_orderkey BETWEEN 2 AND 500000 AND l_linenumber BETWEEN 2 AND 4")
def cell_range(spark, sf_dir):
    """Line items as cells (order, line): the range B2:D500000."""
    return paging.cells_in(_table(spark, sf_dir, "lineitem"), "B2:D500000", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, (l_partkey * 2)::VARCHAR) AS value FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2")
def shared_strings(spark, sf_dir):
    """Cells whose value is an index into shared strings; an index out of range stays as it is."""
    shared = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), "p_name")
    cells = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("index")).join(shared, "index", "left")
    return cells.select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.col("index").cast("string")).alias("value"))


@query(r"""SELECT l_orderkey, string_agg(l_linenumber || ':' || l_quantity::BIGINT, chr(9) ORDER BY l_linenumber, l_linenumber || ':' || l_quantity::BIGINT) AS text FROM lineitem GROUP BY l_orderkey""")
def sheet_rows(spark, sf_dir):
    """Orders as rows of a sheet, cells joined by tabs."""
    cells = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_quantity").cast("long").cast("string")).alias("value"))
    return paging.sheet_rows(cells, [], "l_orderkey", "l_linenumber")


@query(r"""SELECT page_id, md5(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages""")
def strip_markup(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(names.strip_markup(F.col("html"))).alias("text_md5"))


def _masked(rows: DataFrame, key: str) -> DataFrame:
    return masked(rows).select(key, F.col("_r.text").alias("text"), F.col("_r.redacted").alias("redacted"))


@query("""SELECT c_custkey, '  api_key: [REDACTED]' || chr(10) || 'name=' || c_name || chr(10) || 'export TOKEN="[REDACTED]" # ' || c_mktsegment AS text, 2::BIGINT AS redacted FROM customer""")
def redact_kv(spark, sf_dir):
    """Secrets in key-value lines."""
    text = F.concat(F.lit("  api_key: "), "c_name", F.lit("\nname="), "c_name", F.lit('\nexport TOKEN="'), "c_name", F.lit('" # '), "c_mktsegment")
    return _masked(_table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey")


@query("""SELECT o_orderkey, '{"id": ' || o_orderkey || ', "client_secret": "[REDACTED]", "nested": {"token": "[REDACTED]", "open": "' || o_orderstatus || '"}}' AS text, 1::BIGINT AS redacted FROM orders""")
def redact_json(spark, sf_dir):
    """Secrets in JSON, values of any kind."""
    text = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "client_secret": "'), "o_orderpriority", F.lit('", "nested": {"token": ['), F.col("o_custkey").cast("string"), F.lit('], "open": "'), "o_orderstatus", F.lit('"}}'))
    return _masked(_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey")


@query(r"""SELECT p_partkey, 'password: [REDACTED]' || chr(10) || '  [REDACTED]' || chr(10) || '  [REDACTED]' || chr(10) || 'brand: ' || p_brand || chr(10) || '-----BEGIN PRIVATE KEY-----' || chr(10) || '[REDACTED]' || chr(10) || '-----END PRIVATE KEY-----' AS text, 4::BIGINT AS redacted FROM part""")
def redact_blocks(spark, sf_dir):
    """Secrets over several lines: YAML blocks and private keys."""
    text = F.concat(F.lit("password: |\n  "), "p_name", F.lit("\n  "), "p_type", F.lit("\nbrand: "), "p_brand", F.lit("\n-----BEGIN PRIVATE KEY-----\n"), "p_name", F.lit("\n-----END PRIVATE KEY-----"))
    return _masked(_table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey")


_KEY = r"""("[^"]+"|'[^']+'|[A-Za-z_][A-Za-z0-9_-]*)"""
_LEAD = rf"^(\s*(?:(?:export|set)\s+)*{_KEY}\s*[:=]\s*)".replace("'", "''")
_QUOTE = "regexp_extract(substr(x, length(lead) + 1), '^[\"'']')"


_MASKED_LINES = rf"""l AS (SELECT doc_id, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS n, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS x FROM documents),
k AS (SELECT *, regexp_extract(x, '{_LEAD}', 1) AS lead, regexp_replace(regexp_extract(x, '{_LEAD}', 2), '^["'']|["'']$', '', 'g') AS key FROM l),
m AS (SELECT *, CASE WHEN lead <> '' AND (regexp_matches(key, '{redaction.SECRET}') OR regexp_matches(key, '{redaction.SECRET_CAMEL}')) THEN lead || {_QUOTE} || '[REDACTED]' || {_QUOTE} ELSE x END AS y FROM k)"""
MASKED_DOCUMENTS = f"""{_MASKED_LINES}, r AS (SELECT doc_id, string_agg(y, chr(10) ORDER BY n) AS text, count(*) FILTER (y <> x) AS redacted FROM m GROUP BY doc_id)"""


@query(f"WITH {_MASKED_LINES} SELECT doc_id, n::BIGINT AS line_no, y AS line, (y <> x)::BIGINT AS counts FROM m")
def redact_lines(spark, sf_dir):
    """Documents as lines that may leave the engine, scanned in segments of three lines."""
    return masking.redacted_lines(_table(spark, sf_dir, "documents"), segment=3)


#: Parts of a size as a document whose lines open and close keys and blocks in many orders.
_LINES = [
    ("-----BEGIN PRIVATE KEY-----", False, 1),
    ("-----END PRIVATE KEY-----", False, 2),
    ("-----END PRIVATE KEY-----", False, 2),
    ("password: |", True, 4),
    ("", False, 3),
    ("token: >", True, 4),
    ("api_key = x", True, 0),
]
_FOLD = """list_reduce(list_prepend({'k': 0, 'i': 0, 'key': false, 'open': -1, 'st': 0}, own[1:n]), lambda a, x: {'k': x.k, 'i': x.i,
  'key': CASE WHEN x.k = 1 THEN true WHEN x.k = 2 THEN false ELSE a.key END,
  'open': CASE WHEN x.k IN (1, 3) OR (x.k = 2 AND a.key) OR (a.open >= 0 AND x.i > a.open) THEN a.open WHEN x.k = 4 THEN x.i ELSE -1 END,
  'st': CASE WHEN x.k IN (1, 3) OR (x.k = 2 AND a.key) THEN 3 WHEN a.open >= 0 AND x.i > a.open THEN 1 WHEN a.key THEN 2 ELSE 0 END})"""


@query(
    f"""WITH c AS (SELECT p_size, p_partkey, p_name, p_partkey * 7 % 11 AS c, p_partkey // 3 % 5 AS d FROM part),
l AS (SELECT p_size, p_partkey, CASE c {' '.join(f"WHEN {k} THEN {'0' if not d else 'd'}" for k, (_, d, _) in enumerate(_LINES))} ELSE d END AS i,
  CASE c {' '.join(f"WHEN {k} THEN '{x}'" for k, (x, _, _) in enumerate(_LINES))} ELSE p_name END AS x, CASE c {' '.join(f"WHEN {k} THEN {kind}" for k, (_, _, kind) in enumerate(_LINES))} ELSE 0 END AS k FROM c),
o AS (SELECT p_size, list({{'k': k, 'i': i::INT, 'key': false, 'open': -1, 'st': 0}} ORDER BY p_partkey) AS own, list(p_partkey ORDER BY p_partkey) AS ids, list(x ORDER BY p_partkey) AS xs FROM l GROUP BY p_size),
s AS (SELECT p_size, ids[n] AS p_partkey, xs[n] AS x, own[n].i AS i, {_FOLD}.st AS st FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS n FROM o)),
m AS (SELECT *, repeat(' ', i) || x AS was, repeat(' ', i) || CASE WHEN st IN (1, 2) THEN '[REDACTED]' WHEN st = 0 THEN regexp_replace(x, '^(password: |token: |api_key = ).*$', '\\1[REDACTED]') ELSE x END AS masked FROM s)
SELECT p_size, p_partkey, masked, st = 1 OR masked <> was AS counts FROM m"""
)
def mask_segments(spark, sf_dir):
    """Fifty documents with a line for each part, scanned in segments of some lines: keys and blocks open over many segments."""
    case, deep = F.col("p_partkey") * 7 % 11, F.floor(F.col("p_partkey") / 3) % 5
    line = F.concat(F.repeat(F.lit(" "), deep.cast("int")), "p_name")
    for k, (x, indented, _) in enumerate(_LINES):
        line = F.when(case == k, F.concat(F.repeat(F.lit(" "), deep.cast("int")), F.lit(x)) if indented else F.lit(x)).otherwise(line)
    rows = _table(spark, sf_dir, "part").select("p_size", "p_partkey", line.alias("line"))
    return masking.mask_lines(rows, "p_size", "p_partkey", "line", segment=200).select("p_size", "p_partkey", "masked", "counts")


@query(f"WITH {MASKED_DOCUMENTS} SELECT * FROM r")
def redact_documents(spark, sf_dir):
    """Documents as they may leave the engine."""
    return _masked(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("""SELECT conv_id, turn, role, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS batch_no FROM conversations""")
def batch_rotation(spark, sf_dir):
    """Draft batches: every message of the user sends one."""
    events = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return sessions.draft_batches(events, "conv_id", "turn", F.col("role") == "user")


@query(r"""WITH r AS (SELECT conv_id, turn, regexp_replace(replace(chr(8203) || text || '  ', chr(8203), ''), '^\s+|\s+$', '', 'g') AS k FROM conversations WHERE role = 'user'),
m AS (SELECT conv_id, turn AS message_turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS k FROM conversations)
SELECT r.conv_id, turn, message_turn FROM r JOIN m ON r.conv_id = m.conv_id AND r.k = m.k""")
def receipt_match(spark, sf_dir):
    """Receipts of sent drafts and the messages with their text."""
    log = _table(spark, sf_dir, "conversations")
    found = log.filter("role = 'user'").select("conv_id", "turn", F.concat(F.lit("​"), "text", F.lit("  ")).alias("draft"))
    messages = log.select("conv_id", F.col("turn").alias("message_turn"), "text")
    return sessions.match_receipts(found, messages, session="conv_id").select("conv_id", "turn", "message_turn")


_CALLS = """calls AS (SELECT user_id AS session_id, event_id % 4 AS turn, CASE WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS state,
  '{"attachment_id":"att_' || md5((event_id % 9)::VARCHAR) || '"} att_' || md5((event_id % 2)::VARCHAR) AS args FROM events)"""


@query(f"""WITH {_CALLS}, c AS (SELECT session_id, turn, state, unnest(list_distinct(regexp_extract_all(args, 'att_[a-f0-9]{{32}}'))) AS id FROM calls)
SELECT session_id, turn, id, CASE WHEN bool_or(state = 'running') THEN 'reading' ELSE 'read' END AS signal FROM c GROUP BY session_id, turn, id""")
def read_signal(spark, sf_dir):
    """Whether an attachment is being read or was read, in each turn of a session."""
    mark = lambda n: F.concat(F.lit("att_"), F.md5((F.col("event_id") % n).cast("string")))
    calls = _table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 4).alias("turn"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("state"), F.concat(F.lit('{"attachment_id":"'), mark(9), F.lit('"} '), mark(2)).alias("args"))
    return sessions.read_signals(calls)


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents""")
def marker_removal(spark, sf_dir):
    """Drafts with an attachment's marker and visible line, which are taken out again."""
    marker = '<file ref="att_0"/>'
    draft = F.concat(F.col("text"), F.lit(f"\nFile: a.txt\n<!-- {marker} -->\nFile: b (1).txt\n{marker}"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(names.remove_marker(draft, marker, "File: b (1).txt")).alias("text_md5"))


@query(r"""SELECT conv_id, turn, string_agg(w, '|' ORDER BY n) AS chips FROM (SELECT conv_id, turn, unnest(string_split_regex('@u' || conv_id || ' ' || text || ' /run', '\s+')) AS w, generate_subscripts(string_split_regex('@u' || conv_id || ' ' || text || ' /run', '\s+'), 1) AS n FROM conversations)
WHERE regexp_matches(w, '^[/@][A-Za-z0-9_-]+$') GROUP BY conv_id, turn""")
def chips(spark, sf_dir):
    """Commands and mentions in messages."""
    text = F.concat(F.lit("@u"), F.col("conv_id").cast("string"), F.lit(" "), "text", F.lit(" /run"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(names.chips(text), "|").alias("chips"))


@query("""SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' WHEN strlen(text) < 1048576 THEN round(strlen(text)::DECIMAL(20, 0) / 1024.0, 1)::DECIMAL(20, 1) || ' KB'
  ELSE round(strlen(text)::DECIMAL(20, 0) / 1048576.0, 1)::DECIMAL(20, 1) || ' MB' END AS size_label, upper(lang) AS kind_label FROM documents""")
def labels_bytes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", names.byte_label(F.octet_length("text").cast("long")).alias("size_label"), names.kind_label(F.col("lang")).alias("kind_label"))


@query("""WITH spine AS (SELECT conv_id, turn, 'c' || (turn % 3) AS idref FROM conversations), manifest AS (SELECT DISTINCT conv_id, 'c' || (turn % 3) AS k, 'ch' || (turn % 3) || '.xhtml' AS href FROM conversations WHERE turn % 3 > 0)
SELECT s.conv_id, string_agg(href, ' ' ORDER BY turn) AS chapters FROM spine s JOIN manifest m ON s.conv_id = m.conv_id AND s.idref = m.k GROUP BY s.conv_id""")
def spine_order(spark, sf_dir):
    """Chapters by a book's spine: an inner join with its manifest that keeps the spine's order."""
    log = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), (F.col("turn") % 3).cast("string")).alias("idref"))
    manifest = log.filter("turn % 3 > 0").select("conv_id", "idref", F.concat(F.lit("ch"), (F.col("turn") % 3).cast("string"), F.lit(".xhtml")).alias("href")).distinct()
    placed = log.join(manifest, ["conv_id", "idref"])
    return placed.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "href"))), lambda x: x["href"]), " ").alias("chapters"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, 10.0 AS width, floor(-(l_linenumber // 3) * 6.0 / 2.0) AS line, l_returnflag AS text FROM lineitem),
o AS (SELECT *, lag(line) OVER w AS pl, lag(x + width) OVER w AS pe, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY line, x, width, text))
SELECT l_orderkey, string_agg(CASE WHEN pl IS NULL THEN '' WHEN pl <> line THEN chr(10) WHEN x > pe + 1 THEN ' ' ELSE '' END || text, '' ORDER BY n) AS text FROM o GROUP BY l_orderkey""")
def pdf_run_order(spark, sf_dir):
    """Positioned runs as text: lines downwards, runs rightwards, gaps as spaces."""
    from quarrystone.sources.readers import ordered_text

    runs = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), F.lit(10.0).alias("width"), (F.floor(F.col("l_linenumber") / 3) * 6.0).alias("y"), F.col("l_returnflag").alias("text"))
    return ordered_text(runs, ["l_orderkey"])


@query("""SELECT event_id, u.name || CASE WHEN rn = 1 THEN '' ELSE '-' || rn END AS last_names FROM (SELECT event_id, event_type AS name, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) u WHERE rn <= 2""")
def newest_two(spark, sf_dir):
    """The two newest events of each user and type: a limit for each group."""
    ranked = _table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))).filter("rn <= 2")
    return ranked.select("event_id", F.concat("event_type", F.when(F.col("rn") == 1, "").otherwise(F.concat(F.lit("-"), F.col("rn").cast("string")))).alias("last_names"))

"""File names, paths, labels and other scalar functions, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What results must equal.
RESERVED = r'[<>:"|?*]'
DEVICES = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
NAME_BYTES = 255
ID = r"^att_[a-f0-9]{32}$"
ID_IN_TEXT = r"att_[a-f0-9]{32}"
HEADER_ID = r"^[A-Za-z0-9_-]{1,128}$"
STATUS = {
    413: ("FILE_TOO_LARGE", "MESSAGE_FILES_TOO_LARGE", "PARSER_OUTPUT_LIMIT"),
    504: ("PARSER_TIMEOUT",),
    403: ("ATTACHMENT_FORBIDDEN",),
}
#: (icon, colour) by family and kind; an empty kind stands for the rest of its family.
LOOKS = {
    "image": {"": ("🖼️", "#b06ec4")},
    "archive": {"": ("🗜️", "#b7791f")},
    "binary": {"": ("📦", "#8a8f98")},
    "document": {"pdf": ("📕", "#e05656"), "xlsx xls ods": ("📊", "#3b9b68"), "pptx odp": ("📽️", "#d68a3c"), "epub": ("📖", "#6c8fd4"), "": ("📝", "#5b8ff9")},
    "text": {
        "markdown": ("📄", "#6c8fd4"),
        "config-json config-yaml config-ini config-toml config-xml plist env": ("⚙️", "#b7791f"),
        "csv tsv": ("📊", "#3b9b68"),
        "sql": ("🗄️", "#5b8ff9"),
        "shell source-typescript source-javascript source-python source-c source-cpp source-go source-rust source-java": ("💻", "#7a86a6"),
        "": ("📃", "#8a8f98"),
    },
}
NO_LOOK = ("❓", "#8a8f98")
KIND_LABELS = {"source-typescript": "TS", "source-javascript": "JS", "source-python": "PY", "config-json": "JSON", "config-yaml": "YAML", "config-toml": "TOML", "config-ini": "INI", "config-xml": "XML", "markdown": "MD"}


def sanitize_filename(name: Column, most: int = NAME_BYTES) -> Column:
    """The base name without control characters, reserved characters or device names, at most ``most`` bytes long."""
    base = F.regexp_replace(F.replace(F.regexp_replace(name, r"[\x00-\x1f\x7f-\x9f]", ""), F.lit("\\"), F.lit("/")), "/+$", "")
    base = F.regexp_replace(F.substring_index(base, "/", -1), RESERVED, "_")
    device = F.regexp_replace(base, r"\.[^.]*$", "").rlike(DEVICES)
    base = F.when(device, F.concat(F.lit("_"), base)).otherwise(base)
    base = F.when(F.octet_length(base) > most, utf8_prefix(base.cast("binary"), most)).otherwise(base)
    return F.when(base == "", "unnamed").otherwise(base)


def utf8_prefix(data: Column, n: int) -> Column:
    """The longest text in the first ``n`` bytes of UTF-8 ``data``: a character that the cut splits is left out."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(data, 1, n).cast("string")), r"\x{FFFD}+$", "")


def extension(name: Column) -> Column:
    """The lower-cased extension with its dot; a leading dot makes none."""
    return F.lower(F.regexp_extract(name, r"^.*[^/](\.[^./]*)$", 1))


def storage_path(sha256: Column) -> Column:
    return F.concat_ws("/", F.lit("blobs/sha256"), F.substring(sha256, 1, 2), sha256)


def attachment_id(*parts: Column) -> Column:
    """A reproducible id from what names the upload."""
    return F.concat(F.lit("att_"), F.md5(F.to_json(F.struct(*parts))))


def remove_marker(text: Column, marker: str, visible: str | None = None) -> Column:
    """``text`` without a draft's marker, the note that carries it and the visible line; blank runs are closed."""
    quote = lambda x: "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    out = F.regexp_replace(text, rf"(?:^|\n)[^\n]*\n<!--\s*{quote(marker)}\s*-->", "")
    if visible:
        out = F.regexp_replace(out, rf"(?:^|\n){quote(visible)}(?=\n|$)", "")
    out = F.replace(F.replace(out, F.lit(f"\n{marker}"), F.lit("")), F.lit(marker), F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, r"(?md)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def strip_markup(xml: Column) -> Column:
    """``xml`` without tags; the three basic references decoded, in this order."""
    out = F.regexp_replace(xml, "<[^>]+>", "")
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(char))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def kind_label(kind: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, kind), F.upper(kind))


def presentation(family: Column, kind: Column) -> Column:
    """Struct ``icon``, ``color`` of a file."""
    known = {(own, x): look for own, kinds in LOOKS.items() for names in kinds for x in names.split() or [""] for look in [kinds[names]]}
    looks = F.create_map(*[x for (own, name), look in known.items() for x in (F.lit(f"{own}/{name}"), F.struct(F.lit(look[0]).alias("icon"), F.lit(look[1]).alias("color")))])
    at = lambda name: F.try_element_at(looks, F.concat_ws("/", family, name))
    return F.coalesce(at(kind), at(F.lit("")), F.struct(F.lit(NO_LOOK[0]).alias("icon"), F.lit(NO_LOOK[1]).alias("color")))


def byte_label(n: Column) -> Column:
    """Bytes as B, KB or MB; tenths are rounded half up."""
    tenths = lambda unit: F.round(n.cast("decimal(20,0)") / F.lit(unit), 1).cast("decimal(20,1)").cast("string")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(tenths(1 << 10), F.lit(" KB"))).otherwise(F.concat(tenths(1 << 20), F.lit(" MB")))


def error_status(code: Column) -> Column:
    out = F.lit(400)
    for status, codes in STATUS.items():
        out = F.when(code.isin(*codes), status).otherwise(out)
    return out


def trusted_origin(origin: Column, host: Column) -> Column:
    """Whether a request's origin is its host, or both are this machine with the same port."""
    own = F.regexp_extract(origin, r"^[a-z]+://([^/]*)", 1)
    name = lambda x: F.regexp_replace(x, r":\d+$", "")
    port = lambda x: F.regexp_extract(x, r":(\d+)$", 1)
    here = lambda x: name(x).isin("localhost", "127.0.0.1", "[::1]")
    return (own != "") & ((own == host) | (here(own) & here(host) & (port(own) == port(host))))


def column_number(letters: Column) -> Column:
    """A spreadsheet column's number: A is 1, AB is 28."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)


def archive_path(path: Column) -> Column:
    """A normalised relative path, or null where the path is unsafe: empty, absolute, on a drive, or leaving the archive."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    steps = F.filter(F.split(posix, "/"), lambda x: (x != "") & (x != "."))
    # Parts so far, or null once a step up has left the archive.
    start = F.array().cast("array<string>")
    walk = F.aggregate(steps, start, lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)))
    unsafe = posix.isin("", ".") | F.startswith(posix, F.lit("/")) | posix.rlike("^[A-Za-z]:")
    joined = F.array_join(walk, "/")
    return F.when(~unsafe & walk.isNotNull(), F.when(joined == "", ".").otherwise(joined))


def chips(text: Column) -> Column:
    """The words that begin with / or @ and stand between white space."""
    return F.regexp_extract_all(text, F.lit(r"(^|\s)([/@][A-Za-z0-9_-]+)(?=\s|$)"), 2)


def receipt_key(text: Column) -> Column:
    """A message's text without zero-width spaces at its sides or inside, for comparing."""
    return F.regexp_replace(F.replace(text, F.lit("​"), F.lit("")), r"^\s+|\s+$", "")


def zip_target(base: Column, href: Column) -> Column:
    """A link inside a package, resolved against its folder; + stays +."""
    target = F.try_url_decode(F.replace(F.substring_index(href, "#", 1), F.lit("+"), F.lit("%2B")))
    return archive_path(F.concat_ws("/", F.nullif(base, F.lit("")), target))

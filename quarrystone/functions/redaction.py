"""Masking of secrets in text before it leaves the engine.

A document is masked as a whole, before it is cut into pages, by expressions over the array of its lines:

* key-value lines by one pattern, with the mask in the value's quotes and a trailing comment kept;
* private keys and YAML blocks by one scan over what each line is (``operators.masking`` scans documents in segments);
* JSON by a small Arrow function, as its values nest.  Only texts and lines that could hold a secret key reach it.

A text without a line that could hold or open a secret is not split into lines at all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.arrow import arrow_function

# What counts as a secret's key, and the delimiters of private keys.
MASK = "[REDACTED]"
SECRET = (
    r"(?i)(^|[_-])(password|passwd|pwd|secret|token|apikey|api[-_]?key|auth[-_]?token|authorization|cookie|private[-_]?key|client[-_]?secret|credential|access[-_]?key|"
    r"stripe[-_]?key|openai[-_]?key|database[-_]?url|password[-_]?hash)($|[_-])"
)
SECRET_CAMEL = r"^(password|passwd|pwd|secret|token|apiKey|authToken|authorization|cookie|privateKey|clientSecret|credential|accessKey|passwordHash)$"
KEY_BEGIN = r"^[ \t]*-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY(?: BLOCK)?-----[ \t]*$"
KEY_END = r"^[ \t]*-----END (?:[A-Z0-9 ]+ )?PRIVATE KEY(?: BLOCK)?-----[ \t]*$"

# Fixed as well, for equal results: what a key may be, and what the head of a block scalar is.
#: A key with what leads up to its value, and the value.
_PAIR = r"""(?s)^(\s*(?:(?:export|set)\s+)*+("[^"]+"|'[^']+'|[A-Za-z_][A-Za-z0-9_-]*)\s*([:=])\s*)(.*)$"""
_BLOCK = r"^\s*([A-Za-z][A-Za-z0-9_-]*)\s*:\s*[|>][-+]?\d*\s*(?:#.*)?$"
#: A value up to a comment: strings, which may hold any sign, and other characters but a blank before a sign.
_COMMENT = r"""(?s)^(?:"(?:[^"\\]|\\.)*+(?:"|$)|'(?:[^'\\]|\\.)*+(?:'|$)|\s(?![%s])|[^\s"'])*+(\s[%s].*)$"""
#: What could be a JSON key that is secret: a key's end, and a secret's word or an escape.
_KEY_END = r'"\s*:'
_MAYBE = r"(?i)pass|pwd|secret|token|key|auth|cookie|credential|url|\\"
#: The same, and on its line the sign that a value follows.
_MAYBE_PAIR = r"(?i)(?:pass|pwd|secret|token|key|auth|cookie|credential|url|\\)[^\n]*[:=]"


# JSON, by its grammar.

_STRING = r'"(?:[^"\\]|\\.)*"'
_TOKENS = re.compile(rf'(?P<string>{_STRING})|(?P<open>[{{\[])|(?P<close>[}}\]])|(?P<torn>")', re.S)
_COLON = re.compile(r"\s*:\s*")
_SCALAR = re.compile(r"[^\s,}\]]+")
_IS_SECRET, _IS_CAMEL = re.compile(SECRET), re.compile(SECRET_CAMEL)


def is_secret(key: str) -> bool:
    return bool(_IS_SECRET.search(key) or _IS_CAMEL.match(key))


def _extents(text: str) -> tuple[dict[int, int], dict[int, tuple[str, int]]]:
    """Where each string and each bracketed part that is whole ends, by where it begins; the key and value's place of each pair.

    A secret's bare value is passed over as it is, whatever signs it holds.
    """
    ends, pairs, open_, at = {}, {}, [], 0
    while token := _TOKENS.search(text, at):
        start, at = token.span()
        if token["string"]:
            ends[start] = at
            if colon := _COLON.match(text, at):
                pairs[start] = json.loads(token[0]), colon.end()
                if text[colon.end() : colon.end() + 1] not in ('"', "{", "[") and is_secret(pairs[start][0]) and (bare := _SCALAR.match(text, colon.end())):
                    at = bare.end()
        elif token["torn"]:
            pairs[start] = "", start
            break
        elif token["open"]:
            open_.append((start, token[0]))
        elif open_ and open_[-1][1] + token[0] in ("{}", "[]"):
            ends[open_.pop()[0]] = at
        else:
            open_.clear()  # what this crosses ends nowhere
    return ends, pairs


def _pairs(text: str) -> Iterator[tuple[str, int, int]]:
    """(key, begin, end of its value) of the pairs in ``text``, not of those inside a secret's value.  An error if one is torn."""
    ends, pairs = _extents(text)
    past = 0
    for start, (key, begin) in pairs.items():
        if start < past:
            continue
        bare = text[begin : begin + 1] not in ('"', "{", "[") and _SCALAR.match(text, begin)
        end = bare.end() if bare else ends.get(begin)
        if end is None:
            raise ValueError("a string or a value has no end")
        yield key, begin, end
        if is_secret(key):
            past = end


def mask_json(text: str) -> str:
    """``text`` with the values of secret JSON keys masked; as it is where strings or brackets do not match up."""
    try:
        secret = [(begin, end) for key, begin, end in _pairs(text) if is_secret(key)]
    except ValueError:
        return text
    edges = [0, *(x for span in secret for x in span), len(text)]
    return f'"{MASK}"'.join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


@arrow_function("string")
def _json_masked(text: pd.Series) -> pd.Series:
    """Null where nothing is masked."""
    return text.map(lambda x: y if x is not None and (y := mask_json(x)) != x else None)


def json_masked(line: Column) -> Column:
    """``line`` with the values of secret JSON keys masked; null where there are none."""
    return _json_masked(F.when(_whole(line), line))


def whole_json_masked(text: Column) -> Column:
    """The same of a text that begins as JSON does; null for others."""
    return _json_masked(F.when(text.rlike(r"^\s*[{\[]") & _whole(text), text))


@arrow_function("array<string>")
def _json_lines_masked(lines: pd.Series) -> pd.Series:
    """Of each line, null where it is null or nothing is masked; null for a text without any."""

    def each(own):
        if own is None:
            return None
        found = [y if x is not None and (y := mask_json(x)) != x else None for x in own]
        return found if any(x is not None for x in found) else None

    return lines.map(each)


# Lines.


def _secret(key: Column) -> Column:
    return key.rlike(SECRET) | key.rlike(SECRET_CAMEL)


def _pair_masked(line: Column) -> Column:
    """A key-value line with its value masked, if its key is secret."""
    part = lambda k: F.regexp_extract(line, _PAIR, k)
    value = part(4)
    comment = F.when(part(3) == "=", F.regexp_extract(value, _COMMENT % ("#;", "#;"), 1)).otherwise(F.regexp_extract(value, _COMMENT % ("#", "#"), 1))
    quote = F.regexp_extract(value, r"^\s*([\"'])", 1)
    masked = F.concat(part(1), quote, F.lit(MASK), quote, comment)
    return F.when(_secret(F.regexp_replace(part(2), r"^[\"']|[\"']$", "")), masked).otherwise(line)


def _line_masked(line: Column, as_json: Column) -> Column:
    kept = line.rlike(r'^\s*(?:(?:export|set)\s+)*+"') & line.rlike(_KEY_END)  # a JSON key that is not secret, or is torn
    return F.when(~_may_pair(line), line).when(as_json.isNotNull(), as_json).when(kept, line).otherwise(_pair_masked(line))


#: What a line is to the scan, and what the scan says of it.
PLAIN, BEGIN, END, BLANK, START = range(5)
ALONE, IN_BLOCK, IN_KEY, KEPT = range(4)


def line_kind(line: Column) -> Column:
    opens = line.rlike(_BLOCK) & _secret(F.regexp_extract(line, _BLOCK, 1))
    return F.when(line.rlike(r"^\s*$"), BLANK).when(line.rlike(KEY_BEGIN), BEGIN).when(line.rlike(KEY_END), END).when(opens, START).otherwise(PLAIN)


def line_indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


def scan(kinds, indents, key: bool = False, indent: int | None = None) -> tuple[list[int], bool, int | None]:
    """What each line is part of, and the state behind the last: whether a private key is open, and the open block's indent.

    A key goes from a line that begins one to the next that ends one; a block from a secret key's line to the next line
    that is not indented more.  The key's delimiters and blank lines neither end a block nor are masked.
    """
    found = []
    for kind, own in zip(kinds, indents, strict=True):
        state = KEPT
        if kind == BEGIN:
            key = True
        elif kind == END and key:
            key = False
        elif kind == BLANK:
            pass
        elif indent is not None and own > indent:
            state = IN_BLOCK
        else:
            indent = own if kind == START else None
            state = IN_KEY if key else ALONE
        found.append(state)
    return found, key, indent


def line_masked(line: Column, state: Column, as_json: Column) -> Column:
    """``line`` masked as its state says; ``as_json``: the line with JSON values masked, null where there are none."""
    hidden = F.concat(F.regexp_extract(line, r"^(\s*)", 1), F.lit(MASK))
    return F.when(state == KEPT, line).when(state.isin(IN_BLOCK, IN_KEY), hidden).otherwise(_line_masked(line, as_json))


@arrow_function("array<int>")
def _states(kinds: pd.Series, indents: pd.Series) -> pd.Series:
    return kinds.combine(indents, lambda a, b: None if a is None else scan(a.tolist(), b.tolist())[0])


def _let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _whole(text: Column) -> Column:
    return F.contains(text, F.lit('"')) & F.contains(text, F.lit(":")) & text.rlike(_KEY_END) & text.rlike(_MAYBE)


def _may_pair(text: Column) -> Column:
    """Whether a key-value line that is secret may be in ``text``: the plain search for its sign comes first, as most texts have none."""
    return (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(_MAYBE_PAIR)


def _may_open(text: Column) -> Column:
    return F.contains(text, F.lit("PRIVATE KEY")) | F.contains(text, F.lit(":")) & text.rlike(r":\s*[|>]")


def redacted(text: Column | str) -> Column:
    """Struct ``text``, ``redacted``: the masked text (lines joined by line feeds), and how many lines were masked.

    A text masked as JSON counts once for that.  Null text: null and 0.  Time is linear in the text.
    """
    text = F.col(text) if isinstance(text, str) else text
    as_json = whole_json_masked(text)
    whole = F.coalesce(as_json, text)
    lines = F.split(whole, r"\r?\n", -1)
    of_lines = _json_lines_masked(F.when(_whole(whole), F.transform(lines, lambda x: F.when(_whole(x), x))))
    opens = _may_open(whole)
    states = _states(F.when(opens, F.transform(lines, line_kind)), F.when(opens, F.transform(lines, line_indent)))
    given = F.struct(lines.alias("lines"), of_lines.alias("json"), states.alias("states"), as_json.isNotNull().cast("long").alias("n"))
    none = lambda x: F.struct(x.alias("text"), F.lit(0).cast("long").alias("redacted"))
    plain = none(F.regexp_replace(text, r"\r\n", "\n"))
    return F.when(text.isNull(), none(F.lit(None).cast("string"))).when(as_json.isNull() & ~opens & ~_may_pair(text), plain).otherwise(_let(given, _masked))


def masked(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with ``_r``: ``redacted`` of a column.  Exploded, so that it is made once for all that uses it."""
    return rows.select("*", F.explode(F.array(redacted(F.col(text_col)))).alias("_r"))


def _masked(given: Column) -> Column:
    def line(x, k):
        state = F.coalesce(F.get(given["states"], k), F.lit(ALONE))
        text = line_masked(x, state, F.get(given["json"], k))
        return F.struct(text.alias("text"), ((state == IN_BLOCK) | (text != x)).alias("counts"))

    def joined(out):
        return F.struct(F.array_join(F.transform(out, lambda x: x["text"]), "\n").alias("text"), (given["n"] + F.size(F.filter(out, lambda x: x["counts"]))).alias("redacted"))

    return _let(F.transform(given["lines"], line), joined)

"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and the middle is moved behind the rest.

A text is a row of units: a run of ASCII letters, or any other single character.  Two draws from the document's id name
the units at which the prefix and the middle end.  The work is done on the text's UTF-8 bytes in one buffer:

* one scan marks where units begin; the cuts are the places of two of them;
* sentinels are inserted at the cuts, which gives ``<P>prefix<M>middle<S>suffix``;
* two neighbouring blocks change places by a rotation made of three reversals (each block, then both together):
  ``<M>middle`` with ``<S>suffix`` for the order prefix-suffix-middle (psm), all before ``<S>`` with ``<S>suffix`` for
  suffix-prefix-middle (spm).

``restored`` finds the sentinels, rotates back by the same reversals and deletes them, which yields the text exactly: a
text that holds a sentinel is never cut, and as a sentinel's first byte occurs in it once, none can arise at a seam.

Rows are transformed one by one inside their partitions: no shuffle, and a lost task repeats alone.  Memory is one batch
of rows and one buffer; time is linear in the text.

Defined cases: a null text is empty; an empty text and one that holds a sentinel stay plain; a null id draws like the
empty string; repeated ids draw alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import text_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of a hundred documents so many stay plain, and of the others so many put the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Places of the bytes (UTF-8) at which a unit begins."""
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def rotate(buffer: bytearray, begin: int, between: int, end: int) -> None:
    """Exchanges the blocks ``begin:between`` and ``between:end`` of ``buffer`` by three reversals."""
    for a, b in ((begin, between), (between, end), (begin, end)):
        buffer[a:b] = buffer[a:b][::-1]


def draws(key: str, seed: int = 1) -> tuple[int, int, int, int]:
    digest = sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transformed(text: bytes, key: str, seed: int = 1, plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, characters of the prefix and of the middle (None if plain), and the output."""
    data = np.frombuffer(text, np.uint8)
    starts = unit_starts(data)
    n = len(starts)
    h1, h2, h3, h4 = draws(key, seed)
    if not n or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return n, PLAIN, None, None, text
    first, second = (int(starts[k]) if k < n else len(data) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    buffer = bytearray(text)
    for place, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[place:place] = sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    form = SPM if h4 % 100 < spm else PSM
    rotate(buffer, 0 if form == SPM else middle, suffix, len(buffer))
    return n, form, characters(data[:first]), characters(data[first:second]), bytes(buffer)


def restored(output: bytes, form: str) -> bytes:
    """The text that ``transformed`` was given."""
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    middle = buffer.index(MIDDLE)
    if form == SPM:  # suffix, prefix and middle: the suffix goes behind all
        begin = buffer.index(PREFIX)
        rotate(buffer, 0, begin, len(buffer))
        middle -= begin
        suffix = len(buffer) - begin
    else:  # prefix, suffix, middle
        begin = buffer.index(SUFFIX)
        rotate(buffer, begin, middle, len(buffer))
        suffix, middle = begin + len(buffer) - middle, begin
    for place, sentinel in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del buffer[place : place + len(sentinel)]
    return bytes(buffer)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """One row for each input row: id, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output``."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), text_of(text_col).cast("binary").alias("_text"))

    def worked(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [transformed(t, k, seed, plain, spm) for k, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(worked, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.select(F.col("_id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restore(outputs: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``outputs`` with the column ``restored``: the texts rebuilt from nothing but output and form."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def rebuilt(output, form):
        return output.combine(form, restored)

    return outputs.withColumn("restored", rebuilt(F.col(output_col).cast("binary"), form_col).cast("string"))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: outputs and restored texts as SHA-256."""
    found = restore(fill_in_middle(docs))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, list_transform(range(4), lambda k: ('0x' || substr(d, k * 8 + 1, 8))::BIGINT) AS h FROM units),
cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

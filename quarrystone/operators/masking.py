"""Masking of documents given as lines, however long a document is.

What a line is part of depends on the lines before it: a private key may be open, and a block with some indent.  Over a
segment of lines that state is a small function of the state before it, and such functions compose:

* the key behind a segment is what its last delimiter says, or as before where it has none;
* a block that is open before a segment stays so if every line that counts is indented more; else what is open behind the
  segment is what would be without it.  (The first line that ends it is indented less than all before it in the
  segment, so it ends whatever the segment has opened too.)  Least indent and that result say it all;
* only a segment's first delimiter, if it ends a key, counts as a line where no key is open, so there are two such pairs.

So segments are summed up on their own, in parallel; a pass over one small row for each segment gives every segment the
state it begins with; and the segments' lines are then scanned on their own.  The work is linear in the lines, whatever
the number of keys and blocks, and a document of any length is as many tasks as it has segments.

Defined cases: a null line is an empty one, a null number is 0; numbers of lines may have gaps; lines of a document that share a number come
in the order of their texts; a null id is a document of its own; an empty table gives an empty result; other columns are
kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrystone.functions import redaction
from quarrystone.functions.redaction import BEGIN, BLANK, END, IN_BLOCK, line_indent, line_kind, line_masked, scan

SEGMENT = 20_000


class Summary(NamedTuple):
    """What a segment does to the state: ``key`` behind it (null: as before), and by the key before it, least indent and result."""

    key: bool | None
    least: tuple[int | None, int | None]
    result: tuple[int | None, int | None]

    @staticmethod
    def of(kinds, indents) -> Summary:
        last = next((k for k in reversed(kinds) if k in (BEGIN, END)), None)
        least, result = [], []
        for key in (False, True):
            counted, open_ = [], key
            for kind, own in zip(kinds, indents, strict=True):
                if kind == BEGIN:
                    open_ = True
                elif kind == END and open_:
                    open_ = False
                elif kind != BLANK:
                    counted.append(own)
            least.append(min(counted, default=None))
            result.append(scan(kinds, indents, key)[2])
        return Summary(None if last is None else last == BEGIN, tuple(least), tuple(result))

    def after(self, key: bool, indent: int | None) -> tuple[bool, int | None]:
        """The state behind the segment, from the state before it."""
        least, result = self.least[key], self.result[key]
        stays = indent is not None and (least is None or least > indent)
        return key if self.key is None else self.key, indent if stays else result


def _runs(batches, columns: int):
    """(values of the first two columns, the other columns) of each run of rows with the same two, over batches."""
    own, held = None, None
    for batch in batches:
        for document, segment, *rest in zip(*(batch.column(c).to_pylist() for c in range(columns)), strict=True):
            if (document, segment) != own:
                if held is not None:
                    yield own, held
                own, held = (document, segment), []
            held.append(rest)
    if held is not None:
        yield own, held


def mask_lines(rows: DataFrame, id_col: str = "doc_id", no_col: str = "line_no", line_col: str = "line", segment: int = SEGMENT) -> DataFrame:
    """``rows`` with ``masked``, the masked line, and ``counts``, whether it counts as masked.  Order is by ``no_col``."""
    kind = rows.schema[id_col].dataType.simpleString()
    line, number = F.coalesce(F.col(line_col), F.lit("")), F.coalesce(F.col(no_col), F.lit(0))
    given = rows.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.floor(number / segment).cast("long").alias("_segment"), number.cast("long").alias("_no"), line.alias("_line"))
    coded = given.withColumns({"_kind": line_kind(F.col("_line")), "_indent": line_indent(F.col("_line"))})

    def summed(batches):
        import pyarrow as pa

        for (document, at), lines in _runs(batches, 4):
            found = Summary.of(*zip(*lines, strict=True))
            values = (document, at, found.key, *found.least, *found.result)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (id_type, pa.int64(), pa.bool_(), *[pa.int64()] * 4), strict=True)], names)

    id_type = to_arrow_type(rows.schema[id_col].dataType)
    names = ["_id", "_segment", "key", "least_f", "least_t", "result_f", "result_t"]
    by = ["_id", "_segment"]
    order = [*by, "_no", "_line"]
    narrow = coded.repartition(*by).sortWithinPartitions(*order).select(*by, "_kind", "_indent")
    summaries = narrow.mapInArrow(summed, f"_id {kind}, _segment long, key boolean, least_f long, least_t long, result_f long, result_t long")

    def states(batches):
        import pyarrow as pa

        document, key, indent = object(), False, None
        for batch in batches:
            found = []
            for own, own_key, *rest in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6)), strict=True):
                if own != document:
                    document, key, indent = own, False, None
                found.append((key, indent))
                key, indent = Summary(own_key, tuple(rest[:2]), tuple(rest[2:])).after(key, indent)
            keys, indents = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.bool_()), pa.array(indents, pa.int64())], ["_of", "_at", "_key", "_open"])

    # One small row for each segment; only what begins inside a key or a block is joined to its lines.
    begun = summaries.repartition("_id").sortWithinPartitions("_id", "_segment").mapInArrow(states, f"_of {kind}, _at long, _key boolean, _open long").filter("_key OR _open IS NOT NULL")
    joined = coded.join(begun, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_segment") == F.col("_at")), "left").drop("_of", "_at")
    sorted_ = joined.repartition(*by).sortWithinPartitions(*order).select("_id", "_segment", "_kind", "_indent", "_key", "_open", "_line", "_row")

    def scanned(batches):
        import pyarrow as pa

        own, key, indent = None, False, None
        for batch in batches:
            found = []
            for document, at, line_is, depth, begins, opened in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if (document, at) != own:
                    own, key, indent = (document, at), bool(begins), opened
                (state,), key, indent = scan((line_is,), (depth,), key, indent)
                found.append(state)
            yield pa.RecordBatch.from_arrays([batch.column(6), pa.array(found, pa.int32()), batch.column(7)], ["_line", "_state", "_row"])

    row_kind = given.schema["_row"].dataType.simpleString()
    out = sorted_.mapInArrow(scanned, f"_line string, _state int, _row {row_kind}")
    out = out.withColumn("_json", redaction.json_masked(F.col("_line")))
    out = out.withColumn("_masked", line_masked(F.col("_line"), F.col("_state"), F.col("_json")))
    return out.select("_row.*", F.col("_masked").alias("masked"), ((F.col("_state") == IN_BLOCK) | (F.col("_masked") != F.col("_line"))).alias("counts"))


def redacted_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """id, ``line_no`` (from 1), ``line``, ``counts`` of every document, masked: ``redacted`` for documents of any length.

    A document that is JSON as a whole is masked as such first; its first line then counts one more, in ``counts`` (long).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col), text.alias("_text"), redaction.whole_json_masked(text).alias("_json"))
    lines = whole.select(id_col, F.col("_json").isNotNull().alias("_was_json"), F.posexplode(F.split(F.coalesce("_json", "_text"), r"\r?\n", -1)).alias("_at", "_given"))
    lines = lines.select(id_col, (F.col("_at") + 1).cast("long").alias("line_no"), "_given", ((F.col("_at") == 0) & F.col("_was_json")).cast("long").alias("_once"))
    found = mask_lines(lines, id_col, "line_no", "_given", segment)
    return found.select(id_col, "line_no", F.col("masked").alias("line"), (F.col("counts").cast("long") + F.col("_once")).alias("counts"))

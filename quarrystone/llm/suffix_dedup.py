"""Suffix-array de-duplication: bytes covered by a 100-byte string that also starts earlier are removed.

1. Candidates.  Every window of 100 bytes has an anchor, the least hash of the 24-byte strings inside it.  Equal windows
   have equal anchors, and neighbouring windows mostly share theirs, so a text becomes a few runs of windows by anchor.
   Anchors that occur once in the corpus have no equal windows; all other runs go on.  A task settles anchors that
   repeat inside its own batch and sends each anchor once, so a passage that stands in a third of all documents does
   not flood the bucket of its anchors.
2. Sorting.  The bytes of the remaining runs meet in the bucket of their anchor.  Equal runs are merged first.
   The suffixes at all window starts are then put in groups of equal first 100 bytes by deep-shallow sorting: a
   multikey sort, eight bytes at a time, down to a shallow depth; what still shares its prefix is ordered by blind
   tries, built for all groups at once: each group takes its first suffix as the path, every other suffix branches off
   at its first differing word, and only branches are looked at again.  What is wanted of the sort is which suffixes share
   their first 100 bytes; the order of groups is not kept, and no whole suffix array is made.
3. The earliest window of each group stays and every other one is removed from its text.

All rows are packed into blocks for the shuffle, and the runs' bytes, which overlap, are compressed there.  Texts are shuffled once, by document, and that exchange serves both
reads of them.

Defined cases: a null text is empty; texts under 100 bytes lose nothing; a null id comes before every other; rows that
repeat id and text are one document and have the same result; rows of one id with different texts are ordered by a hash
of the text; an empty table gives an empty result; other columns are ignored.  Ids are integers.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import partitions, text_of

WINDOW, GRAM = 100, 24
#: Words of eight bytes that the multikey sort compares.
SHALLOW = 3
#: Window starts handled at once; a run has no more, which 24 bits hold.
PIECE = 1 << 19
#: Windows sorted at once, unless one anchor has more.
SORTED = 1 << 19
#: Bytes of text whose runs meet in a bucket (about).
BUCKET_BYTES = 1 << 24
LEAST_ID = -(2**63)

_PLACE = np.uint64((1 << 17) - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: bytes | np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as big-endian numbers."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))


def window_runs(text: bytes, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Rows (anchor, first window start, number of windows, whether the anchor repeats inside), as columns of an array."""
    out = []
    for at in range(0, len(text) - window + 1, PIECE):
        part = text[at : at + PIECE + window - 1]
        w = _words(part).astype(np.uint64)
        n = len(part) - gram + 1
        h = w[:n] * _C[0] + w[8 : n + 8] * _C[1] + w[gram - 8 : n + gram - 8] * _C[2]
        h ^= h >> np.uint64(32)
        h *= _C[3]
        h = (h & ~_PLACE) | (np.arange(n, dtype=np.uint64) & _PLACE)
        span, width = 1, window - gram + 1
        while span * 2 <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < width:
            h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
        anchor = h >> np.uint64(17)
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        moved = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
        last = np.concatenate((new[1:], [len(h)])) - 1
        out.append(np.stack((anchor[new].astype(np.int64), new + at, last - new + 1, moved[last] > moved[new])))
    return np.concatenate(out, axis=1) if out else np.empty((4, 0), np.int64)


def equal_classes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A class number for each suffix, equal if group and first ``window`` bytes are, by deep-shallow sorting."""
    depths = [*range(0, window - 8, 8), window - 8]
    words = _words(data)
    n = len(starts)
    classes = np.arange(n)  # a suffix that is alone is its own class
    active, group = np.arange(n), group.astype(np.int64)
    for depth in depths[:SHALLOW]:  # multikey: within each group by the next word
        key = words[starts[active] + depth].astype(np.uint64)
        order = np.lexsort((key, group))
        active, group = _split(active[order], group[order], key[order])
    # Blind tries: the first suffix of a group is the path, the others branch off at their first differing word.
    deep = depths[SHALLOW:]
    while len(active):
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        path = active[first][group]
        branch = np.full(len(active), len(deep))
        word = np.zeros(len(active), np.uint64)
        open_ = np.arange(len(active))
        for k, depth in enumerate(deep):
            own = words[starts[active[open_]] + depth]
            off = own != words[starts[path[open_]] + depth]
            branch[open_[off]] = k
            word[open_[off]] = own[off]
            open_ = open_[~off]
        same = branch == len(deep)
        classes[active[same]] = path[same]
        active, group, branch, word = active[~same], group[~same], branch[~same], word[~same]
        order = np.lexsort((word, branch, group))
        active, group = _split(active[order], group[order], branch[order], word[order])
    return classes


def _split(active, group, *keys):
    """Sorted suffixes in new groups by old group and keys; those alone drop out."""
    if not len(active):
        return active, group
    new = group[1:] != group[:-1]
    for key in keys:
        new = new | (key[1:] != key[:-1])
    number = np.concatenate(([0], np.cumsum(new)))
    several = np.bincount(number)[number] > 1
    active, number = active[several], number[several]
    return active, np.unique(number, return_inverse=True)[1] if len(number) else number


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as ranges: first and how many."""
    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)))
    return starts[new], np.diff(np.concatenate((new, [len(starts)])))


def _pack(*columns) -> bytes:
    return b"".join(np.ascontiguousarray(c, np.int64).tobytes() for c in columns)


def _dealt(rows: np.ndarray, to: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """The rows of each bucket that has any."""
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(buckets + 1))
    return {b: rows[order[ends[b] : ends[b + 1]]] for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist()}


def _packed_runs(rows: DataFrame, buckets: int, window: int) -> DataFrame:
    """Blocks of runs by bucket: ``sure`` ones, and single ones with the anchors that the batch has of its own."""

    none = np.empty(0, np.int64)

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            runs, owner = [], []
            for k, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                if len(text) >= window:
                    runs.append(window_runs(text, window))
                    owner.append(np.full(runs[-1].shape[1], k))
            if not runs:
                continue
            anchor, start, count, within = np.concatenate(runs, axis=1)
            owner = np.concatenate(owner)
            order = np.argsort(anchor, kind="stable")
            anchor, start, count, within, owner = (x[order] for x in (anchor, start, count, within, owner))
            new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            number = np.cumsum(new) - 1
            sure = (np.bincount(number)[number] > 1) | (within > 0)
            known = np.unique(anchor[sure])
            block = lambda x: _pack(anchor[x], ids[owner[x]], marks[owner[x]], start[x] << 24 | count[x])  # noqa: B023, E731
            parts = [_dealt(np.flatnonzero(sure), (ids[owner] % buckets)[sure], buckets), _dealt(np.flatnonzero(~sure), (anchor % buckets)[~sure], buckets), _dealt(known, known % buckets, buckets)]
            out = [(b, block(parts[0].get(b, none)), block(parts[1].get(b, none)), _pack(parts[2].get(b, none))) for b in sorted(set().union(*parts))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3))], ["bucket", "sure", "single", "known"])

    return rows.mapInArrow(made, "bucket int, sure binary, single binary, known binary").repartitionById(buckets, "bucket")


def _repeated_runs(blocks: DataFrame) -> DataFrame:
    """``k, mark, anchor, start, count``: runs whose anchor occurs more than once."""

    def met(batches):
        import pyarrow as pa

        single, known = [], []

        def rows(columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[0]), pa.array(columns[3] >> 24), pa.array(columns[3] & ((1 << 24) - 1))], ["k", "mark", "anchor", "start", "count"])

        for batch in batches:
            for sure, own, told in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if sure:
                    yield rows(np.frombuffer(sure, np.int64).reshape(4, -1))
                single.append(np.frombuffer(own, np.int64).reshape(4, -1))
                known.append(np.frombuffer(told, np.int64))
        if single:
            columns = np.concatenate(single, axis=1)
            columns = columns[:, np.argsort(columns[0], kind="stable")]
            anchor = columns[0]
            same = anchor[1:] == anchor[:-1]
            again = np.zeros(len(anchor), bool)
            again[1:] |= same
            again[:-1] |= same
            again |= np.isin(anchor, np.concatenate(known))
            yield rows(columns[:, again])

    return blocks.mapInArrow(met, "k long, mark long, anchor long, start long, count long")


def _contexts(texts: DataFrame, buckets: int, window: int) -> DataFrame:
    """Blocks of the runs' bytes by bucket of the anchor; equal runs of a batch but the earliest are marked as removed already."""

    def made(batches):
        import pyarrow as pa

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            best, gone = {}, []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for k, mark, text, runs in zip(batch.column("k").to_pylist(), batch.column("mark").to_pylist(), texts, batch.column("runs").to_pylist(), strict=True):
                for run in runs:
                    anchor, start, count = run["anchor"], run["start"], run["count"]
                    key, own = (anchor, text[start : start + count + window - 1]), (k, mark, start)
                    if key not in best:
                        best[key] = own
                    elif own != best[key]:
                        gone.append((*max(own, best[key]), count))
                        best[key] = min(own, best[key])
            out: dict[int, list] = {}
            for (anchor, data), own in best.items():
                out.setdefault(anchor % buckets, []).append((anchor, *own, data))
            blocks = [(b, _pack(*zip(*(x[:4] for x in own), strict=True), [len(x[4]) for x in own]), squeeze(b"".join(x[4] for x in own)), b"") for b, own in out.items()]
            for at in range(0, len(gone), 1 << 16):
                part = gone[at : at + (1 << 16)]
                blocks.append((part[0][2] % buckets, b"", b"", _pack(*zip(*part, strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in blocks], pa.int32()), *(pa.array([x[j] for x in blocks], pa.binary()) for j in (1, 2, 3))], ["bucket", "heads", "data", "gone"])

    return texts.mapInArrow(made, "bucket int, heads binary, data binary, gone binary").repartitionById(buckets, "bucket")


def _removed_windows(blocks: DataFrame, window: int) -> DataFrame:
    """``k, mark, start, count``: ranges of window starts that also start earlier."""

    def sorted_out(batches):
        import pyarrow as pa

        def rows(k, mark, start, count):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (k, mark, start, count)], ["k", "mark", "start", "count"])

        best: dict = {}
        gone = []
        for batch in batches:
            for heads, data, told in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if told:
                    yield rows(*np.frombuffer(told, np.int64).reshape(4, -1))
                data, at = zstandard.decompress(data) if data else b"", 0
                for anchor, k, mark, start, length in np.frombuffer(heads, np.int64).reshape(5, -1).T.tolist():
                    key, own = (anchor, data[at : at + length]), (k, mark, start)
                    at += length
                    if (other := best.get(key)) is None:
                        best[key] = own
                    elif own != other:
                        gone.append((*max(own, other), length - window + 1))
                        best[key] = min(own, other)
        if gone:
            yield rows(*zip(*gone, strict=True))
        order = sorted(best, key=lambda x: x[0])
        at = 0
        while at < len(order):
            end, size = at, 0
            while end < len(order) and (size < SORTED or order[end][0] == order[end - 1][0]):
                size += len(order[end][1]) - window + 1
                end += 1
            found = _later_windows([(*best[x], x) for x in order[at:end]], window)
            if len(found[0]):
                yield rows(*found)
            at = end

    return blocks.mapInArrow(sorted_out, "k long, mark long, start long, count long")


def _later_windows(runs: list, window: int):
    """Of runs (k, mark, start, (anchor, bytes)), sorted by anchor: the ranges of windows that are not the earliest of their class."""
    data = np.frombuffer(b"".join(x[3][1] for x in runs), np.uint8)
    lengths = np.array([len(x[3][1]) for x in runs])
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    counts = lengths - window + 1
    run = np.repeat(np.arange(len(runs)), counts)
    offset = np.arange(len(run)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    anchors = np.array([x[3][0] for x in runs])
    group = np.concatenate(([0], np.cumsum(anchors[1:] != anchors[:-1])))[run]
    classes = equal_classes(data, begin[run] + offset, group, window)
    heads = np.array([x[:3] for x in runs], np.int64).reshape(-1, 3)
    k, mark, start = heads[run, 0], heads[run, 1], heads[run, 2] + offset
    order = np.lexsort((start, mark, k, classes))
    later = np.zeros(len(run), bool)
    later[order[1:]] = classes[order[1:]] == classes[order[:-1]]
    found = np.flatnonzero(later)  # by run and offset, so that ranges stand together
    if not len(found):
        return [], [], [], []
    new = np.concatenate(([True], (np.diff(found) > 1) | (np.diff(run[found]) > 0)))
    first = found[new]
    return k[first], mark[first], start[first], np.diff(np.concatenate((np.flatnonzero(new), [len(found)])))


def kept_and_spans(text: bytes, starts: list[int], counts: list[int], window: int = WINDOW) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``text``, and its maximal removed runs (start, end), from ranges of removed windows."""
    spans: list[list[int]] = []
    for a, b in sorted((s, s + c + window - 1) for s, c in zip(starts, counts, strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    left, at = [], 0
    for a, b in spans:
        left.append(text[at:a])
        at = b
    left.append(text[at:])
    return b"".join(left), [(a, b) for a, b in spans]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (the bytes left), ``spans``."""
    # A bucket holds the runs of so many bytes of text (about), whatever the input's size.
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-total // BUCKET_BYTES))
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)), text_of(text_col)
    # Only where ids repeat do rows need a second key.
    unique = docs.groupBy(key.alias("k")).count().filter("count > 1").isEmpty()
    rows = docs.select(key.alias("k"), (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("mark"), text.alias("text"))
    runs = _repeated_runs(_packed_runs(rows, buckets, window))
    # Repeated rows are one document: its runs and its text go on once, and the result is joined to all of them.
    gather = F.collect_list if unique else F.collect_set
    runs = runs.groupBy("k", "mark").agg(gather(F.struct("anchor", "start", "count")).alias("runs"))
    texts = rows.join(runs, ["k", "mark"]).select("k", "mark", "text", "runs")
    if not unique:
        texts = texts.dropDuplicates(["k", "mark"])
    removed = _removed_windows(_contexts(texts, buckets, window), window)
    removed = removed.groupBy("k", "mark").agg(F.collect_list(F.struct("start", "count")).alias("removed"))
    final = rows.join(removed, ["k", "mark"], "left").select("k", "text", "removed")

    def cut_out(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text, gone in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    left, spans = kept_and_spans(text, [x["start"] for x in gone or ()], [x["count"] for x in gone or ()], window)
                    out.append((len(text), len(text) - len(left), len(spans), sha256(left).hexdigest(), left, [{"start": a, "end": b} for a, b in spans]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    found = final.mapInArrow(cut_out, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>")
    own = F.when(F.col("k") != LEAST_ID, F.col("k")).cast(docs.schema[id_col].dataType)
    return found.select(own.alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")

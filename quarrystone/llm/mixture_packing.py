"""Mixture-controlled packing: sequences in which every source has its share of the tokens.

A source's documents, each its token ids and an end id, form a queue.  Sequences (windows) are filled by deficit round
robin: each window gives every source that is not yet empty a quantum of ``capacity`` tokens times its weight; a source
may take what it has been given and not yet used, its deficit, and carries the rest to the next window.  A source is
served once its deficit reaches ``least`` tokens, so that many small sources do not shred their documents; what then is
left of a window goes to the greatest deficits.  By default a source's weight is its number of tokens, so every window
mirrors the whole table and all queues end together; given weights hold until a source is empty.

Tasks work on slices of virtual time (a queue's position over its weight).  Slice k holds the positions between the
floors of its ends in each queue, documents cut where they cross; what the floors leave of a quantum is the deficit that
the slice begins with, so deficits are carried over partitions as they are over windows, and every slice has the same
mixture whatever the sources' sizes.  A source with a third of all rows is spread over all slices.

Positions in the queues need no sort: the tokenizing pass, which writes the ids once, counts each source's tokens inside
its task, and a table with one row for a task and source gives the starts.  That table is broadcast if counted small, else
joined by a shuffle.  Only the ids are shuffled, once, to slices of about ``slice_tokens`` tokens.

A slice's last tokens, fewer than a window, go into sequences whose lengths are the powers of two that add up to them,
so no sequence needs padding.

Defined cases: a null text is empty; an empty document is the end id alone; null is a source of its own; ids may be null
or repeat, each row is packed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict, deque
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.llm.common import broadcast_if_small, cut, text_of, written
from quarrystone.llm.token_counts import CHUNK, HUGE, MEMO, OVERLAP, TOKENIZER, resynchronised, tokenizer

CAPACITY, END = 4096, 2
#: Tokens of a slice, which one task holds, and the fewest that a source is served at a time.
SLICE_TOKENS, LEAST = 4_000_000, 64


#: Fixed: the pre-tokenizer's pattern for this vocabulary, and the same over lower-case letters of the first 256 characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")
_PLAIN = re.compile(r"[ \t\n\r\v\f!-~A-Za-zÀ-ÖØ-öø-ÿ]*")
#: A byte that no plain text has ends each piece, in place of the vocabulary's mark of a word's end.
MARK = "\x01"


@lru_cache(maxsize=2)
def piece_encoding(name: str):
    """This vocabulary for the faster library, or None if it is no byte-level BPE with marked ends whose ids follow its merges.

    A token with the end mark becomes its bytes and ``MARK``.  Those of one byte come before all merges by their ids, so
    the mark joins its byte first, as in the vocabulary's own library.
    """
    import public_tokenizers
    import tiktoken

    with open(name if os.path.sep in name else public_tokenizers.path(name), encoding="utf-8") as file:
        whole = json.load(file)
    vocab, merges, suffix = whole["model"].get("vocab", {}), whole["model"].get("merges", []), whole["model"].get("end_of_word_suffix")
    joined = ["".join(x if isinstance(x, list) else x.split(" ")) for x in merges]
    if not suffix or PATTERN not in json.dumps(whole["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\") or [vocab.get(x) for x in joined] != list(range(512, 512 + len(merges))):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}
    ranks = {}
    for token, k in vocab.items():
        ends = token.endswith(suffix)
        if set(token.removesuffix(suffix)) <= names.keys():
            ranks[bytes(names[c] for c in token.removesuffix(suffix)) + MARK.encode() * ends] = k
    ranks[MARK.encode()] = 1 << 20  # never left alone
    return tiktoken.Encoding(name, pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of texts as packed numbers.

    Plain texts (ASCII and Latin-1 letters) are cut into the pre-tokenizer's pieces and encoded by the faster library.  In
    others, the tokenizer's own library encodes words, which are remembered: it cannot join across white space.
    """

    def __init__(self, name: str = TOKENIZER, end: int = END):
        self.encoder, self.fast, self.known = tokenizer(name), piece_encoding(name), {}
        self.kind = np.dtype("<u2" if self.encoder.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = self.packed([end])

    def packed(self, ids) -> bytes:
        return np.asarray(ids, self.kind).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id."""
        plain = [self.fast is not None and _PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        rest = iter(self.by_words([t.encode() for t, p in zip(texts, plain, strict=True) if not p]))
        return [(self.by_pieces(t) if p else next(rest)) + self.end for t, p in zip(texts, plain, strict=True)]

    def by_pieces(self, text: str) -> bytes:
        pieces = _PIECES.findall(text.lower())
        return self.fast.encode_to_numpy(MARK.join(pieces) + MARK).astype(self.kind).tobytes() if pieces else b""

    def by_words(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() if len(t) <= HUGE else None for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
        known = self.known
        new = list(set().union(*filter(None, words)).difference(known))
        found = self.encoder.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        known.update(zip(new, (self.packed(x.ids) for x in found), strict=True))
        return [b"".join(map(known.__getitem__, ws)) if ws is not None else self.huge(t.decode()) for t, ws in zip(texts, words, strict=True)]

    def huge(self, text: str) -> bytes:
        return b"".join(self.packed(run[2]) for run in resynchronised(self.encoder, text, CHUNK, OVERLAP))


@lru_cache(maxsize=2)
def encoder(name: str, end: int) -> Encoder:
    return Encoder(name, end)


def tokenized(docs: DataFrame, id_col: str, text_col: str, source_col: str, name: str, end: int) -> DataFrame:
    """``_id``, ``_source``, ``_task``, ``_before`` (tokens of the source before it in the task), ``_n``, ``_ids``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), text_of(text_col).alias("_text"))

    def worked(batches):
        import pyarrow as pa

        own, before, task = encoder(name, end), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = own.ids(part.column(2).to_pylist())
                places, sizes = [], [len(x) // own.kind.itemsize for x in ids]
                for source, n in zip(part.column(1).to_pylist(), sizes, strict=True):
                    places.append(before[source])
                    before[source] += n
                columns = [part.column(0), part.column(1), pa.array([task] * len(ids), pa.int32()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_source", "_task", "_before", "_n", "_ids"])

    return rows.mapInArrow(worked, f"_id {rows.schema['_id'].dataType.simpleString()}, _source string, _task int, _before long, _n long, _ids binary")


class Slices:
    """Where ``count`` slices of virtual time, which ends at ``most`` / ``over``, cut a queue of ``size`` tokens with ``weight``."""

    def __init__(self, count: int, most: int, over: int):
        self.count, self.most, self.over = count, most, over

    def bound(self, k: int, weight: int, size: int) -> int:
        return min(size, k * weight * self.most // (self.count * self.over))

    def carried(self, k: int, weight: int, size: int) -> float:
        """The part of a token that the slices before ``k`` owe the queue."""
        exact = k * weight * self.most / (self.count * self.over)
        return exact - self.bound(k, weight, size) if exact < size else 0.0

    def of(self, begin: int, end: int, weight: int, size: int):
        """(slice, begin, end) of the pieces that the positions ``begin`` to ``end`` fall into."""
        k = begin * self.count * self.over // (weight * self.most)
        while self.bound(k, weight, size) > begin:
            k -= 1
        while begin < end:
            while (upto := self.bound(k + 1, weight, size)) <= begin:
                k += 1
            yield k, begin, min(end, upto)
            begin = min(end, upto)


def lengths(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Full windows, then the powers of two that add up to the rest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def round_robin(queues: dict, weights: dict, deficits: dict, windows: list[int], least: int = LEAST):
    """For each window its takes (queue, tokens), in order; ``queues`` has the tokens each queue holds.

    Sums of deficits stay what they were: a window gives as many tokens as it takes.  An empty queue's deficit is void.
    """
    left, order = {q: n for q, n in queues.items() if n}, deque(sorted(queues, key=lambda q: (q is None, q)))
    deficits = defaultdict(float, deficits)
    for size in windows:
        total, takes, room = sum(weights[q] for q in left), [], size
        for q in left:
            deficits[q] += size * weights[q] / total
        served = {}
        for q in order:
            take = min(int(deficits[q] + 1e-6), room, left.get(q, 0))
            if take and (take >= least or take == left[q]):
                served[q], room = take, room - take
        while room:  # what is owed less than ``least``, and roundings, go to the greatest deficits
            open_ = [q for q in left if left[q] > served.get(q, 0)]
            q = max(open_, key=lambda x: deficits[x] - served.get(x, 0))
            more = min(room, left[q] - served.get(q, 0))
            served[q], room = served.get(q, 0) + more, room - more
        for q in order:
            if take := served.get(q):
                takes.append((q, take))
                deficits[q] -= take
                left[q] -= take
                if not left[q]:
                    del left[q], deficits[q]
        order.rotate(-1)
        yield takes


def _filled(rows: list[tuple], k: int, cuts: Slices, capacity: int, least: int):
    """Pieces (id, start, length, document's tokens, sequence, offset, first token in the row, row) of slice ``k``.

    ``rows``: (id, source, position, start in the document, tokens, document's tokens, weight, size), by position.
    """
    queues, held, weights, deficits = defaultdict(deque), defaultdict(int), {}, {}
    for at, (_, source, _, _, n, _, weight, size) in enumerate(rows):
        queues[source].append([at, 0])
        held[source] += n
        weights[source], deficits[source] = weight, cuts.carried(k, weight, size)
    windows = lengths(sum(held.values()), capacity)
    for number, takes in enumerate(round_robin(held, weights, deficits, windows, least)):
        offset = 0
        for source, tokens in takes:
            queue = queues[source]
            while tokens:
                at, used = queue[0]
                key, _, _, start, n, whole, _, _ = rows[at]
                take = min(tokens, n - used)
                yield key, start + used, take, whole, (k << 24) + number, offset, used, at
                tokens, offset = tokens - take, offset + take
                if used + take == n:
                    queue.popleft()
                else:
                    queue[0][1] += take


def pack_mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict | None = None,
    capacity: int = CAPACITY,
    least: int = LEAST,
    slice_tokens: int = SLICE_TOKENS,
    name: str = TOKENIZER,
    end: int = END,
) -> DataFrame:
    """One row for each piece: id, ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    ``weights`` gives sources positive whole numbers (others weigh 1).
    """
    base, _ = written(tokenized(docs, id_col, text_col, source_col, name, end))
    sums = base.groupBy("_source", "_task").agg(F.sum("_n").alias("_sum"))
    upto = F.sum("_sum").over(W.partitionBy("_source").orderBy("_task").rowsBetween(W.unboundedPreceding, 0))
    starts = sums.select("_source", "_task", (upto - F.col("_sum")).alias("_start"), F.sum("_sum").over(W.partitionBy("_source")).alias("_size"))
    weight = F.col("_size")
    if weights is not None:
        known = [F.when(F.col("_source").eqNullSafe(F.lit(source)), F.lit(int(own))) for source, own in weights.items()]
        weight = F.coalesce(*known, F.lit(1))
    starts = cut(starts.withColumn("_weight", weight.cast("long")))
    sources = starts.groupBy("_source").agg(F.max("_size").alias("size"), F.max("_weight").alias("weight"))
    longest, total = sources.agg(F.max_by(F.struct("size", "weight"), F.col("size") / F.col("weight")), F.sum("weight")).first()
    most, over = (longest.size, longest.weight) if longest else (1, 1)
    cuts = Slices(max(1, -(-(total or 0) * most // (over * slice_tokens))), most, over)
    kind, id_kind = encoder(name, end).kind.str, base.schema["_id"].dataType.simpleString()

    right = broadcast_if_small(starts.withColumnsRenamed({"_source": "_of", "_task": "_by"}))
    placed = base.join(right, (F.col("_task") == F.col("_by")) & F.col("_source").eqNullSafe(F.col("_of")))
    placed = placed.select("_id", "_source", (F.col("_start") + F.col("_before")).alias("_at"), "_n", "_weight", "_size", "_ids")

    def parted(batches):
        import pyarrow as pa

        wide = np.dtype(kind).itemsize
        for batch in batches:
            found = []
            at, n, weight, size = (batch.column(c).to_pylist() for c in (2, 3, 4, 5))
            ids = batch.column(6)
            for row in range(batch.num_rows):
                own = ids[row].as_buffer()
                for k, begin, upto in cuts.of(at[row], at[row] + n[row], weight[row], size[row]):
                    found.append((row, k, begin, begin - at[row], upto - begin, own[(begin - at[row]) * wide : (upto - at[row]) * wide]))
            rows, *rest, parts = zip(*found, strict=True) if found else [()] * 6
            take = pa.array(rows, pa.int64())
            columns = [pa.array(x, pa.int64()) for x in rest]
            kept = [batch.column(c).take(take) for c in (0, 1, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array([bytes(x) for x in parts], pa.binary())], ["_id", "_source", "_n", "_weight", "_size", "_slice", "_at", "_start", "_length", "_ids"])

    parts = placed.mapInArrow(parted, f"_id {id_kind}, _source string, _n long, _weight long, _size long, _slice long, _at long, _start long, _length long, _ids binary")

    def packed(table):
        import pyarrow as pa

        table = table.sort_by("_at")
        k, ids = table.column("_slice")[0].as_py(), table.column("_ids").to_pylist()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("_id", "_source", "_at", "_start", "_length", "_n", "_weight", "_size")), strict=True))
        ids = [np.frombuffer(x, kind).astype("<u4").tobytes() for x in ids]
        keys, start, length, whole, sequence, offset, used, row = zip(*_filled(rows, k, cuts, capacity, least), strict=True)
        values = [ids[r][4 * a : 4 * (a + n)] for r, a, n in zip(row, used, length, strict=True)]
        columns = [pa.array(keys, table.schema.field("_id").type), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array(values, pa.binary()), *(pa.array(x, pa.int64()) for x in (whole, sequence, offset))]
        return pa.Table.from_arrays(columns, ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    found = parts.repartition(cuts.count, "_slice").groupBy("_slice").applyInArrow(packed, f"_id {id_kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return found.withColumnRenamed("_id", id_col)

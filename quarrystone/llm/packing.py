"""Best-fit packing: documents' token ids into sequences of a fixed capacity.

Bounded-space online best fit.  A document is its token ids and an end id.  One longer than the capacity is cut into full
pieces behind a first piece that takes the rest.  Full pieces are sequences of their own; every other piece goes into the
open bin with the least free space that still holds it, found by one shift in a bitset keyed by free space.  A fixed
number of bins is open: when a new one would exceed it, the fullest closes first.  The pieces of a batch are offered
longest first, which is still online: a piece is placed once and never moved, and memory is the bins' free space and one
batch, whatever the input.

Tasks pack on their own, so nothing is shuffled and a lost task repeats alone; each leaves at most its open bins
part-filled.  Sequence numbers are the task's number and a counter.

Defined cases: a null text is empty; an empty document is the end id alone; ids may be null or repeat, each row is packed;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import slices, text_of

CAPACITY, END = 1024, 2
OPEN_BINS = 8192
#: The vocabulary of byte_bpe_50k.json as ranks, for the faster of the two libraries; the ids are the same.
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: The contract's own library reads texts with so long a run of white space, for which the faster one's stack is too small.
LIBRARY = "byte_bpe_50k.json"
_LONG_BLANK = re.compile(r"\s{4096}")


@lru_cache(maxsize=2)
def encoding(name: str = RANKS):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


@lru_cache(maxsize=2)
def library(name: str = LIBRARY):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def token_ids(text: str, name: str = RANKS, end: int = END) -> np.ndarray:
    """The ids of ``text`` and the end id, as little-endian unsigned 32-bit numbers."""
    found = None
    if not _LONG_BLANK.search(text):
        try:
            found = encoding(name).encode_to_numpy(text, allowed_special="all")
        except ValueError:  # what else is too deep for its patterns
            found = None
    if found is None:
        found = np.array(library(LIBRARY).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(found, np.uint32(end)).astype("<u4", copy=False)


class Bins:
    """Open bins keyed by free space; ``place`` returns (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most, self.made, self.open = capacity, most, 0, 0
        self.bits, self.at = 0, [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        if length == self.capacity:
            self.made += 1
            return self.made - 1, 0
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own = self._pop(free)
        else:
            if self.open >= self.most:  # the fullest closes
                self._pop((self.bits & -self.bits).bit_length() - 1)
            free, own = self.capacity, self.made
            self.made += 1
        if free > length:
            self.at[free - length].append(own)
            self.bits |= 1 << (free - length)
            self.open += 1
        return own, self.capacity - free

    def _pop(self, free: int) -> int:
        own = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return own


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, name: str = RANKS) -> DataFrame:
    """One row for each piece: id, ``piece``, ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``sequence_id``, ``offset``."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def packed(batches):
        import pyarrow as pa

        bins, base = Bins(capacity, open_bins), TaskContext.get().partitionId() << 36
        for batch in batches:
            ids = [token_ids(t, name) for part in slices(batch) for t in part.column(1).to_pylist()]
            pieces = []  # (row, piece, start, length)
            for row, own in enumerate(ids):
                first = (len(own) - 1) % capacity + 1
                pieces.append((row, 0, 0, first))
                pieces += [(row, k, start, capacity) for k, start in enumerate(range(first, len(own), capacity), 1)]
            pieces.sort(key=lambda x: -x[3])
            for at in range(0, len(pieces), 4096):
                part = pieces[at : at + 4096]
                places = [bins.place(length) for *_, length in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([x[0] for x in part], pa.int64())),
                        pa.array([x[1] for x in part], pa.int32()),
                        pa.array([x[2] for x in part], pa.int64()),
                        pa.array([x[3] for x in part], pa.int64()),
                        pa.array([ids[row][start : start + n].tobytes() for row, _, start, n in part], pa.binary()),
                        pa.array([base + x[0] for x in places], pa.int64()),
                        pa.array([x[1] for x in places], pa.int64()),
                    ],
                    ["_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(packed, f"_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")
    return found.withColumnRenamed("_id", id_col)

"""Token counts of whole texts.

Huge texts are encoded in overlapping chunks with offsets.  Two neighbouring chunks are spliced at a boundary in their
overlap that is proven to be stable: a place that no pre-token reaches across (a change between letters, digits, other
characters and white space, or any place between digits) and no normalisation either (no combining mark, apostrophe or
letter that lower-cases into several stands there), so that nothing on one side can change the tokens on the other; as a
check, both encodings must have the same tokens from the boundary before it to the one after it.  Where that fails the
overlap is widened, until at last the two chunks are one.  Where a chunk holds no boundary at all, as in a very long run
of letters, it is lengthened to the next ones instead, so every character is encoded a bounded number of times and the
time is linear in the text.  Memory follows the chunk, or the longest run without a boundary.

Shorter texts are cut at every white space by the same argument, and the counts of words seen before are remembered in a
table of bounded size; only new words are encoded.

The work is one pass over the rows without a shuffle: tasks hold one Arrow batch and one chunk.

Defined cases: a null text is empty; an empty text has no tokens; a null id stays null; an empty table gives an empty result; strings of special tokens inside texts count as the
library's default has it (one token); repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import text_of

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of a text that is cut into chunks; characters of a chunk and of the first overlap.
HUGE, CHUNK, OVERLAP = 65_536, 32_768, 256
#: Words whose counts a worker remembers; then it starts anew.
MEMO = 1_000_000

#: Boundaries at the end of an overlap that are tried, and those a chunk without any is lengthened by.
TRIED, AHEAD = 8, 4
LETTER, DIGIT, OTHER, SPACE = 1, 2, 3, 4


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """A tokenizer of the ``tokenizers`` library, by the name of a public file or by path; loaded once in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The pre-tokenizer's class of each code point that Unicode 3.2 knew; 0 for the rest, marks, apostrophe and U+0130."""
    kinds = {"L": LETTER, "N": DIGIT, "P": OTHER, "S": OTHER}
    table = np.array([kinds.get(unicodedata.ucd_3_2_0.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[[0x27, 0x130]] = 0
    return table


def boundaries(text: str) -> np.ndarray:
    """Places in ``text`` across which its tokens never reach."""
    kind = _classes()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    left, right = kind[:-1], kind[1:]
    return np.flatnonzero((left > 0) & (right > 0) & ((left != right) | (left == DIGIT))) + 1


def _encode(encoder, text: str, at: int) -> np.ndarray:
    """Start, end and id of each token (columns), positions counted in the whole text."""
    found = encoder.encode(text, add_special_tokens=False)
    places = np.array(found.offsets, np.int64).reshape(-1, 2).T + at
    return np.concatenate((places, np.array(found.ids, np.int64)[None]))


def _splice(left: np.ndarray, right: np.ndarray, places: np.ndarray) -> int | None:
    """One of ``places``, boundaries that both chunks cover, around which their tokens are the same; or None."""
    for k in range(len(places) - 2, max(0, len(places) - 2 - TRIED), -1):
        before, here, after = places[k - 1], places[k], places[k + 1]
        own, other = (tokens[:, (tokens[1] > before) & (tokens[0] < after)] for tokens in (left, right))
        if np.array_equal(own, other) and ((own[1] <= here) | (own[0] >= here)).all():
            return int(here)
    return None


def resynchronised(encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The tokens of ``text`` (start, end, id as columns), in runs, from overlapping chunks."""
    places, size = boundaries(text), len(text)
    done, end = 0, min(chunk, size)
    left = _encode(encoder, text[:end], 0)
    while end < size:
        inside = places[np.searchsorted(places, done, "right") : np.searchsorted(places, end)]
        if len(inside) < 3:  # nowhere to splice: the chunk goes on to some boundaries ahead
            ahead = places[np.searchsorted(places, max(end, done + 1)) :][AHEAD - 1 :]
            end = int(ahead[0]) if len(ahead) else size
            left = _encode(encoder, text[done:end], done)
            continue
        upto, width, splice, right = min(size, end + chunk), overlap, None, left
        while splice is None:
            start = max(done, min(end - width, int(inside[-3])))
            right = _encode(encoder, text[start:upto], start)
            if start == done:  # the overlap is all that is not yet done: both chunks are one now
                break
            splice = _splice(left, right, inside[np.searchsorted(inside, start) :])
            width *= 2
        if splice is not None:
            yield left[:, (left[0] >= done) & (left[0] < splice)]
            done = splice
        left, end = right, upto
    yield left[:, left[0] >= done]


class Counter:
    """Counts the tokens of texts given as UTF-8; lives as long as the Python worker, over many tasks."""

    def __init__(self, name: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.encoder, self.huge, self.chunk, self.overlap, self.known = tokenizer(name), huge, chunk, overlap, {}

    def count(self, texts: list[bytes]) -> list[int]:
        words = [t.split() if len(t) <= self.huge else None for t in texts]  # bytes are split at the six ASCII white spaces
        if len(self.known) > MEMO:
            self.known.clear()
        known = self.known
        new = [w for w in set().union(*filter(None, words)) if w not in known]
        found = self.encoder.encode_batch([w.decode() for w in new], add_special_tokens=False)
        known.update(zip(new, map(len, found), strict=True))
        return [sum(map(known.__getitem__, ws)) if ws is not None else self.count_huge(t.decode()) for t, ws in zip(texts, words, strict=True)]

    def count_huge(self, text: str) -> int:
        return sum(run.shape[1] for run in resynchronised(self.encoder, text, self.chunk, self.overlap))


@lru_cache(maxsize=2)
def counter(name: str, huge: int, chunk: int, overlap: int) -> Counter:
    return Counter(name, huge, chunk, overlap)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens)."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def counted(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        count = counter(name, huge, chunk, overlap).count
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = pa.array(count(part.column(1).cast(pa.binary()).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), counts], ["_id", "n_bytes", "n_tokens"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(counted, f"_id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

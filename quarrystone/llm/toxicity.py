"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

Channel: a writer may swap letters for look-alike digits and signs, put white space, signs or invisible signs between
letters, split a word, and repeat letters.  A token that shows such signs becomes a lattice of the letters each character may stand for (or of
nothing, for separators and repeated letters), and Viterbi decoding finds the reading that is likeliest under a
character trigram model, whose counts Spark gathers from all documents.  In a run of single characters each space may be
kept or dropped, so the decoding finds where words end; as three letters say little of that, a run is read once for each
of some costs of a kept space, and as one word, in which the lexicon's longer words count wherever they stand.  A gap that is wider than the least of its run is dearer
to drop than to keep.  An invisible sign stands for nothing or for a space, so its text is read both ways.  Neighbouring
tokens that together spell a longer word of the lexicon are a lattice whose spaces may be dropped too, and count as
that word if the decoding joins them ("stu pid", but not "pen is").  Tokens and runs of any length are decoded: what the likeliest path begins
with is settled piece by piece.  A token without letters is decoded if it has look-alikes; digits in it are taken for
themselves unless the letters are far likelier.  A doubled look-alike is read as one letter and as two.

Score: a lexicon of restored words and word beginnings, each with its probability of standing in a toxic document.  It is learnt from
labelled documents outside the held-out fold, at most ``SAMPLE`` of them, taken by a hash of their id.  A feature counts
once for each group of near copies (documents with the same least hash of three words in a row), so that copies of one
document prove little.  Features whose shrunk probability is at least ``EVIDENCE`` are evidence.  The score is that of a small logistic model over the
evidence of the restored text: the strongest one, how many words of it there are, and the length of the text.  It is
fitted to the same bounded sample with a toxic document counted ``COST`` times, so evidence adds up and texts without
evidence are told apart by their length.  Where the sample has no toxic document every score is ``FLOOR``.

Look-alikes stand for Latin letters; letters of other scripts are one class of the model and pass through as they are.

Sizes: the trigram table has 64 ** 3 entries at most and the lexicon is bounded by the sample; only these two, and
four numbers for each row of the sample, go to the driver.  All else is passes over the rows without a shuffle of texts.

Defined cases: a null or empty text is one without evidence and words; a null id is in fold crc32 of the empty text; of contradicting
labels of one id the higher counts; labels that are null do not count; without labels nothing is toxic; repeated rows
are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from math import log, log1p
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import cut, slices, text_of

FOLDS, SAMPLE, FLOOR = 5, 10_000, 0.02
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6)
#: A feature's probability is shrunk towards PRIOR as if seen in STRENGTH more documents; at least LEAST
#: toxic ones must have it, and the number of toxic documents in the sample to the power GROWTH.
PRIOR, STRENGTH, LEAST, GROWTH, EVIDENCE = 0.1, 4.0, 5, 0.35, 0.6

#: What a toxic document that is missed costs, in clean ones that are rejected.
COST = 3.0

#: What characters may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " .-_*~^'`,/\\"
#: Costs of the channel, in nats.
SWAP, DROP, REPEAT, KEEP = 1.0, 0.7, 0.4, 3.0
#: Costs of a kept space in a run of single characters; each gives a reading, from few words to many.
GAPS = (2.0, 0.7, -0.5, -1.5)
#: What dropping a gap that is wider than the others of its run costs, and keeping it.
WIDE, WIDE_DROP, WIDE_KEEP = "\t", 3.0, 0.0
#: Lexicon words of so many letters count inside a spaced run that is read as one word, and where they are split.
INSIDE = 5
#: Decoding settles its reading after so many characters, but for the last ones.
PIECE, OPEN = 256, 128
#: Tokens, and fragments, whose readings a task remembers.
MEMO = 100_000

_LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s++\S){2,}(?!\S)")
_MAYBE_SPACED = re.compile(r"\s\S\s++\S\s++\S\s")
#: Signs without width: soft hyphen, joiners, marks of direction.
_HIDDEN = re.compile("[\u00ad\u034f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_GAP = re.compile(r"\s+")
_DOUBLE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1\1")
_EDGE = ".,;:?\"'()[]{}<>*_-~`/\\«»“”„…"

WIDTH = 64
#: Characters whose trigrams are counted at one time.
STEP = 1 << 17
BREAK, OTHER, REST = 0, 27, 60


def _alphabet() -> np.ndarray:
    """Classes of the first 256 code points: break, a to z, others, the lower-case letters of Latin-1."""
    table = np.full(256, OTHER, np.int64)
    table[[9, 10, 11, 12, 13, 32]] = BREAK
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[0xDF:0x100] = np.arange(28, 28 + 33) - (np.arange(0xDF, 0x100) > 0xF7)
    table[0xF7] = OTHER
    return table


_TABLE = _alphabet()


def classes(text: str) -> np.ndarray:
    """The character class of each code point of a lower-cased text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 256, _TABLE[np.minimum(points, 255)], REST)


def _parts(text: str, length: int = 1 << 20):
    """Parts of bounded length, cut where one ends."""
    return (text[at : at + length] for at in range(0, len(text), length))


def trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``code``, ``n``: how often each three character classes follow one another, over all texts."""

    def counted(batches):
        import pyarrow as pa

        total = np.zeros(WIDTH**3, np.int64)
        for batch in batches:
            for rows in slices(batch):
                for part in _parts("\n".join(rows.column(0).to_pylist()).lower()):
                    whole = f" {part} "
                    for at in range(0, len(whole) - 2, STEP):
                        c = classes(whole[at : at + STEP + 2])
                        total += np.bincount((c[:-2] * WIDTH + c[1:-1]) * WIDTH + c[2:], minlength=WIDTH**3)
        code = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Channel:
    """Restores disguised tokens under a trigram model given as counts by code."""

    def __init__(self, counts: dict[int, int]):
        grams = np.zeros(WIDTH**3)
        grams[list(counts)] = list(counts.values())
        grams = grams.reshape(WIDTH, WIDTH, WIDTH)
        for c in (*range(1, OTHER), *range(OTHER + 1, REST)):
            grams[c, c, c] = 0  # a stretched word must not teach that letters are stretched
        pairs, single = grams.sum(0), grams.sum((0, 1))
        p1 = (single + 0.5) / (single.sum() + 0.5 * WIDTH)
        p2 = (pairs + 10 * p1) / (pairs.sum(1, keepdims=True) + 10)
        p3 = (grams + 10 * p2) / (grams.sum(2, keepdims=True) + 10)
        self.cost = (-np.log(p3)).ravel().tolist()

    def decode(self, token: str, gap: float = GAPS[0], doubles: bool = False) -> str:
        """The likeliest reading of a lower-cased token, or of characters with spaces or ``WIDE`` ones between them.

        A kept space costs ``gap``; with ``doubles``, every look-alike is a letter of its own.
        """
        paths = {(BREAK, BREAK): (0.0, "")}
        settled: list[str] = []
        for at, options in enumerate(self.lattice(token, gap, doubles)):
            paths = self._step(paths, options)
            if at % PIECE == PIECE - 1:
                paths = self._settle(paths, settled)
        settled.append(min(self._step(paths, [(" ", 0.0)]).values())[1])
        return "".join(settled).strip()

    def lattice(self, token: str, gap: float = GAPS[0], doubles: bool = False):
        """For each character of a token what it may stand for, with the cost of that."""
        letters = token.replace(" ", "").replace(WIDE, "")
        stutters = _RUN.search(letters) or len(_DOUBLE.findall(letters)) > 1
        number = not _LETTERS.search(letters)
        before = ""
        for ch in token:
            options = []
            if ch == " ":
                options += [("", DROP), (" ", gap)]
            elif ch == WIDE:
                options += [("", WIDE_DROP), (" ", WIDE_KEEP)]
            elif ch.isalpha():
                options.append((ch, 0.0))
                if ch == before and stutters:
                    options.append(("", REPEAT))
            else:
                itself = number and ch.isdigit()
                options += [(x, KEEP if itself else SWAP) for x in LOOKALIKES.get(ch, "")]
                if ch == before and ch in LOOKALIKES and not doubles and not itself:
                    options.append(("", SWAP + REPEAT))
                if ch in SEPARATORS:
                    options.append(("", DROP))
                elif itself or not (doubles and options):
                    options.append((ch, 0.0 if itself else KEEP))
            if ch not in (" ", WIDE):
                before = ch
            yield options

    def _settle(self, paths, settled):
        """The paths that begin as the likeliest does, without that beginning, which ``settled`` takes."""
        best = min(paths.values())[1]
        begin = best[: max(0, len(best) - OPEN)]
        settled.append(begin)
        return {key: (so_far, text[len(begin) :]) for key, (so_far, text) in paths.items() if text.startswith(begin)}

    def _step(self, paths, options):
        following: dict = {}
        for (a, b), (so_far, text) in paths.items():
            for out, noise in options:
                if out:
                    point = ord(out)
                    c = int(_TABLE[point]) if point < 256 else REST
                    key, now = (b, c), so_far + noise + self.cost[(a * WIDTH + b) * WIDTH + c]
                else:
                    key, now = (a, b), so_far + noise
                if key not in following or now < following[key][0]:
                    following[key] = (now, text + out)
        return following

    def words(self, token: str) -> tuple[str, ...]:
        """The words of a lower-cased token, as written and as restored."""
        core = token.strip(_EDGE)
        if core.isalpha() and not _DOUBLE.search(core):
            return (core,)
        written = _LETTERS.findall(core)
        core = core.rstrip("!")
        if not written and not any(c in LOOKALIKES for c in core):
            return ()
        if core.isalpha() and not _RUN.search(core):
            return (core, _DOUBLE.sub(r"\1", core))
        odd = [c for c in core if not c.isalpha()]
        if written and odd and min(map(len, written)) >= 3 and not _RUN.search(core) and all(c not in LOOKALIKES for c in odd):
            return tuple(written)  # words joined by signs
        read = [self.decode(core)]
        if not _RUN.search(core) and any(x in LOOKALIKES for x in _DOUBLE.findall(core)):
            read.append(self.decode(core, doubles=True))
        return tuple(dict.fromkeys(written + _LETTERS.findall(" ".join(read))))

    def spaced_words(self, run: str, wanted: Lexicon | None = None) -> tuple[str, ...]:
        """The words of a lower-cased run of single characters, and those of ``wanted`` anywhere in its letters."""
        letters = run.split()
        gaps = [len(gap) for gap in _GAP.findall(run)]
        least = min(gaps)
        spaced = letters[0] + "".join((" " if gap == least else WIDE) + ch for gap, ch in zip(gaps, letters[1:], strict=True))
        whole = self.decode("".join(letters))
        found = _LETTERS.findall(" ".join([whole, *(self.decode(spaced, gap) for gap in GAPS)]))
        for n in wanted.lengths if wanted else ():
            found += [w for w in (whole[at : at + n] for at in range(len(whole) - n + 1)) if w in wanted]
        return tuple(dict.fromkeys(found))

    def split_words(self, tokens: list[str], wanted: Lexicon, memo: dict[str, str]) -> list[str]:
        """The longer words of ``wanted`` that neighbouring tokens spell together, where the lattice joins them."""
        found = []
        for at in range(len(tokens) - 1):
            first = tokens[at].lstrip(_EDGE)
            spelt = first if first.isalpha() else self._fragment(first, memo)
            if spelt not in wanted.starts:
                continue
            parts = [spelt]
            for token in tokens[at + 1 : at + 1 + wanted.longest]:
                part = token.rstrip(_EDGE)
                parts.append(part if part.isalpha() else self._fragment(part, memo))
                spelt += parts[-1]
                if not parts[-1]:
                    break
                if spelt in wanted and len(spelt) >= INSIDE and self.decode(" ".join(parts), 0.0) == spelt:
                    found.append(spelt)
                if part != token or spelt not in wanted.starts:
                    break
        return found

    def _fragment(self, token: str, memo: dict[str, str]) -> str:
        """What a token with other characters than letters reads as, if that is one word."""
        own = memo.get(token)
        if own is None:
            reading = self.decode(token) if any(c in LOOKALIKES for c in token) and len(token) <= OPEN else ""
            own = memo[token] = reading if reading.isalpha() else ""
        return own


class Lexicon(dict):
    """Features and their probabilities, with what looking for words in runs and in neighbours needs."""

    def __init__(self, known: dict[str, float]):
        super().__init__(known)
        longer = [w for w in known if len(w) >= INSIDE and w[-1] != "*"]
        self.lengths = sorted({len(w) for w in longer})
        self.longest = max(self.lengths, default=0)
        self.starts = {w[:n] for w in longer for n in range(1, len(w))}


def features(words: tuple[str, ...] | list[str], wanted=None) -> tuple[str, ...]:
    """Words and their beginnings, marked by a star; only those in ``wanted``, where that is given."""
    found = [*words, *(f"{w[:n]}*" for w in words for n in STEMS if len(w) > n)]
    return tuple(f for f in dict.fromkeys(found) if wanted is None or f in wanted)


def restored_features(text: str, channel: Channel, memo: dict, wanted: Lexicon | None = None) -> tuple[set[str], list[str]]:
    """The features of a text, as written and as restored, and its tokens."""
    low = text.lower()
    readings = [low]
    if _HIDDEN.search(low):
        readings = [_HIDDEN.sub("", low), _HIDDEN.sub(" ", low)]
    if len(memo) > MEMO:
        memo.clear()
    fragments = memo.setdefault(None, {})
    if len(fragments) > MEMO:
        fragments.clear()
    found: set[str] = set()
    for reading in readings:
        tokens = reading.split()
        for token in set(tokens):
            own = memo.get(token)
            if own is None:
                own = memo[token] = features(channel.words(token), wanted)
            found.update(own)
        if _MAYBE_SPACED.search(f" {reading} "):
            for match in _SPACED.finditer(reading):
                found.update(features(channel.spaced_words(match[0], wanted), wanted))
        if wanted:
            found.update(channel.split_words(tokens, wanted, fragments))
    return found, readings[0].split()


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == 0


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(labels, texts with labels) of at most ``sample`` ids that are not held out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out("_id")).groupBy("_id").agg(F.max("_label").alias("_label"))
    known = cut(known.orderBy(F.xxhash64("_id"), "_id").limit(sample))  # a bounded sample, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(known), "_id").select("_id", "_label", "_text")
    return known, cut(rows)


def learn(known: DataFrame, rows: DataFrame, channel) -> dict[str, float]:
    """Evidence features and their probabilities."""

    def seen_in(batches):
        import pyarrow as pa

        memo: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                out = []
                for label, text in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns), strict=True):
                    own, tokens = restored_features(text, channel.value, memo)
                    copies = min((crc32(" ".join(tokens[k : k + 3]).encode()) for k in range(max(1, len(tokens) - 2))), default=0)
                    out += [(feature, copies, label) for feature in own]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int32()))], ["feature", "copies", "label"])

    seen = rows.select("_label", "_text").mapInArrow(seen_in, "feature string, copies long, label int").groupBy("feature", "copies").agg(F.max("label").alias("label"))
    # The more there are to learn from, the more features stand in toxic documents only by chance.
    least = max(LEAST, round(known.filter("_label = 1").count() ** GROWTH))
    counts = seen.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    shrunk = (F.col("k") + PRIOR * STRENGTH) / (F.col("n") + STRENGTH)
    return {r["feature"]: r["p"] for r in counts.filter(F.col("k") >= least).select("feature", shrunk.alias("p")).filter(F.col("p") >= EVIDENCE).collect()}


def evidence(text: str, channel: Channel, memo: dict, known: Lexicon) -> tuple[float, float, float]:
    """Of a text: log odds of its strongest evidence (0 without any), log of how many words of evidence, log of how many words."""
    found, tokens = restored_features(text, channel, memo, known)
    best = max((known[f] for f in found), default=None)
    words = sum(not f.endswith("*") for f in found)
    return (0.0 if best is None else log(best / (1 - best)), 0.0 if best is None else log(max(1, words)) + 1.0, log1p(len(tokens)))


def _inputs(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of ``evidence`` as the inputs of the logistic model; length counts apart with and without evidence.

    ``lengths``: the least, mean and greatest of the sample; what is outside counts as the nearest.
    """
    some = (x[:, 1] > 0).astype(float)
    length = np.clip(x[:, 2], lengths[0], lengths[2]) - lengths[1]
    return np.stack((np.ones(len(x)), some, x[:, 0], np.maximum(0, x[:, 1] - 1), length * some, length * (1 - some)), axis=1)


def fitted(x: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights of the logistic model by Newton's method and the sample's lengths, or None without toxic rows."""
    if not labels.any():
        return None
    lengths = np.array([x[:, 2].min(), x[:, 2].mean(), x[:, 2].max()])
    inputs = _inputs(x, lengths)
    weights = np.zeros(inputs.shape[1])
    costs = np.where(labels > 0, COST, 1.0)
    keep = np.full(len(weights), ridge)
    keep[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-inputs @ weights))
        slope = inputs.T @ (costs * (labels - p)) - keep * weights
        step = np.linalg.solve((inputs * (costs * p * (1 - p))[:, None]).T @ inputs + np.diag(keep), slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights, lengths


def scores_of(texts: list[str], channel: Channel, memo: dict, known: Lexicon, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), FLOOR)
    weights, lengths = model
    return 1 / (1 + np.exp(-_inputs(np.array([evidence(t, channel, memo, known) for t in texts]), lengths) @ weights))


def batch_scores(batch, at: int, *learnt) -> np.ndarray:
    """The scores of an Arrow batch, whose column ``at`` has the texts."""
    return np.concatenate([np.empty(0), *(scores_of([t or "" for t in part.column(at).to_pylist()], *learnt) for part in slices(batch))])


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int):
    """What a score needs, on all tasks: the channel, the lexicon and the weights."""
    context = docs.sparkSession.sparkContext
    counts = {r["code"]: r["n"] for r in trigrams(docs, text_col).collect()}  # 64 ** 3 rows at most
    channel = context.broadcast(Channel(counts))
    known, rows = labelled(docs, labels, id_col, text_col, label_col, sample)
    lexicon = context.broadcast(Lexicon(learn(known, rows, channel)))

    def described(batches):
        import pyarrow as pa

        memo: dict = {}
        for batch in batches:
            found = [evidence(t, channel.value, memo, lexicon.value) for part in slices(batch) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in found], pa.float64()) for k in range(3))], ["_id", "_label", "a", "b", "c"])

    kind = rows.schema["_id"].dataType.simpleString()
    # One row an id, so as many as the sample has at most; sorted, so that the fit is the same each time.
    drawn = rows.mapInArrow(described, f"_id {kind}, _label int, a double, b double, c double").groupBy("_id").agg(F.max("_label"), F.max("a"), F.max("b"), F.max("c")).orderBy("_id").collect()
    points = np.array([tuple(r)[1:] for r in drawn], float).reshape(-1, 4)
    return channel, lexicon, fitted(points[:, 1:], points[:, 0])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row for each input row: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if the score is at least 0.5)."""
    channel, lexicon, model = _model(docs, labels, id_col, text_col, label_col, sample)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def scored(batches):
        import pyarrow as pa

        memo: dict = {}
        for batch in batches:
            scores = batch_scores(batch, 1, channel.value, memo, lexicon.value, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["_id", "score"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(scored, f"_id {kind}, score double")
    return found.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under 0.5."""
    channel, lexicon, model = _model(docs, labels, id_col, text_col, label_col, sample)
    at = docs.columns.index(text_col)

    def clean(batches):
        import pyarrow as pa

        memo: dict = {}
        for batch in batches:
            scores = batch_scores(batch, at, channel.value, memo, lexicon.value, model)
            yield batch.filter(pa.array(scores < 0.5, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)

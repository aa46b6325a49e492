"""Document fingerprints: canonical exact digest.

The canonical form of a text is Unicode normal form C, case-folded, normalised again, with each run of white space one
space and none at either end.  A fingerprint is 128 bits of xxhash over it, two 64-bit hashes with different seeds.
Rows with equal hashes meet in a group and their canonical bytes are compared; should two different forms share a
bucket, all fingerprints are made anew from the next seed, so fingerprints are equal exactly when the forms are.

Normalisation and folding call the ICU library that Spark carries, through the SQL function ``java_method``; plain ASCII
texts need neither and are lower-cased.  The byte comparison reads texts only of buckets with several rows: a bucket
with one row needs none, and copies are combined before the shuffle, so a group with a third of all rows sends one row
a task.

The next document of each is found without a global sort in one task: ranges of ids are windows of their own, and the
first row of each range is also sent to the range before it.  Where every row has an id of its own and a bounded number of
ranges will do, they are cut at quantiles of the ids and the texts are shuffled once.  Else the narrow rows (id, hash,
number) are sorted over ranges first, their places are the keys from then on, and the texts are joined to those: many rows
with one id, or without any, are split as evenly as others, and nothing broadcast grows with the input.

Defined cases: a null text is empty; a null id sorts first; rows with one id follow each other by a hash of the text;
with a single row the next document is the row itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.llm.common import broadcast_if_small, cut, ids_name_rows, partitions, text_of

SPACES = r"[\s\p{Z}\x{85}]+"
SEEDS = 8
FIRST = -(2**63)
#: Ranges of ids that are cut at quantiles, at most: their edges are broadcast as one array.
MOST_EDGES = 4096
#: Bytes of text in a range of ids (about).
RANGE_BYTES = 1 << 25


def canonical(text: Column) -> Column:
    plain = F.octet_length(text) == F.char_length(text)
    call = lambda owner, name, *args: F.java_method(F.lit(owner), F.lit(name), *args)
    composed = lambda x: call("com.ibm.icu.text.Normalizer", "compose", x, F.lit(False))
    folded = composed(call("com.ibm.icu.lang.UCharacter", "foldCase", composed(text), F.lit(True)))
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), SPACES, " "))


def wide_hash(form: Column, seed: int = 0) -> Column:
    """32 hex digits."""
    half = lambda k: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(k), form))), 16, "0")
    return F.concat(half(2 * seed), half(2 * seed + 1))


def fingerprint(rows: DataFrame, text_cols: list[str], key_col: str, texts_of=None, digest=wide_hash) -> DataFrame:
    """``rows`` with ``<column>_fp`` in place of each of its text columns, equal exactly for equal canonical forms.

    ``texts_of(hashed, column, keys)`` gives the texts (one column) of the rows with these keys, to be compared;
    by default they are taken from ``rows``.
    """
    for seed in range(SEEDS):
        hashed = cut(rows.select([F.col(c) for c in rows.columns if c not in text_cols] + [digest(canonical(F.col(c)), seed).alias(f"{c}_fp") for c in text_cols]))
        members = _members(hashed, text_cols, key_col)
        found = None
        for c in text_cols:
            keys = broadcast_if_small(members.filter(F.col("of") == c).select(key_col).distinct())
            texts = texts_of(hashed, c, keys) if texts_of else rows.select(key_col, c).join(keys, key_col, "left_semi").select(c)
            forms = texts.toDF("text").select(canonical(F.col("text")).alias("form"))
            found = forms if found is None else found.unionByName(forms)
        buckets = found.groupBy(digest(F.col("form"), seed).alias("fp")).agg(F.min("form").alias("a"), F.max("form").alias("b"))
        if buckets.filter("a <> b").isEmpty():
            return hashed
    raise ValueError("no seed tells all texts apart")


def _members(hashed: DataFrame, text_cols: list[str], key_col: str) -> DataFrame:
    """The rows (key, column) in buckets with several rows."""
    long = hashed.select(key_col, F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(f"{c}_fp").alias("fp")) for c in text_cols])).alias("x")).select(key_col, "x.of", "x.fp")
    several = long.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp")
    return cut(long.join(several, "fp", "left_semi").select(key_col, "of"))


def _edges(rows: DataFrame, slices: int) -> DataFrame:
    """``_edges``: one row with sorted quantiles of ``_key``, the least first, at most ``slices`` of them."""
    cuts = F.percentile_approx("_key", [k / slices for k in range(slices)], 100 * slices)
    return cut(rows.agg(F.array_sort(F.array_distinct(F.concat(F.array(F.coalesce(F.min("_key"), F.lit(FIRST))), F.coalesce(cuts, F.array().cast("array<bigint>"))))).alias("_edges")))


def _range_of(edges: Column, at: Column) -> Column:
    """The place of the last of the sorted ``edges`` that is not above ``at``, by halving."""
    steps = F.sequence(F.lit(1), F.lit(MOST_EDGES.bit_length() + 1))

    def halved(x, _):
        middle = F.floor((x["low"] + x["high"]) / 2).cast("int")
        above = F.get(edges, middle) > at
        return F.struct(F.when(above, x["low"]).otherwise(middle).alias("low"), F.when(above, middle).otherwise(x["high"]).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(edges).alias("high")), halved)["low"]


def _dealt_by_quantiles(rows: DataFrame, slices: int) -> DataFrame:
    """``rows`` with ``_slot``, a range of keys, and ``_lent``: a range's first row is also in the range before, as its end."""
    rows = rows.crossJoin(F.broadcast(_edges(rows, slices)))  # one row: the ranges' edges, each some row's key
    edges, last = F.col("_edges"), F.size("_edges") - 1
    rows = rows.withColumn("_own", _range_of(edges, F.col("_key")))
    lent = F.when(F.get(edges, F.col("_own")) == F.col("_key"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    dealt = rows.select("_key", "_id", "own", "_own", last.alias("_last"), F.explode(lent).alias("_lent"))
    slot = F.when(~F.col("_lent"), F.col("_own")).when(F.col("_own") == 0, F.col("_last")).otherwise(F.col("_own") - 1)
    return dealt.select("_key", "_id", "own", "_lent", slot.alias("_slot"))


def _placed(docs: DataFrame, slices: int) -> DataFrame:
    """``_id``, ``own`` with ``_key``, the place of each row by id and hash: ranges of 2^33 places, each filled from its beginning."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("_row"), "_id", "own"))
    order = [F.col("_id").asc_nulls_first(), "_hash", "_row"]
    narrow = rows.select("_row", "_id", F.xxhash64("own").alias("_hash"))
    places = cut(narrow.repartitionByRange(slices, *order).sortWithinPartitions(*order).select("_row")).select("_row", F.monotonically_increasing_id().alias("_key"))
    return rows.join(places, "_row").select("_key", "_id", "own")


def _dealt_by_places(rows: DataFrame) -> DataFrame:
    """The same for keys that are places."""
    slot = F.shiftright("_key", 33)
    firsts = cut(rows.filter(F.col("_key") % (1 << 33) == 0).select(slot.alias("_of")))  # one narrow row for each range
    before = W.orderBy("_of")
    previous = firsts.select("_of", F.coalesce(F.lag("_of").over(before), F.max("_of").over(before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_slot"))
    lent = rows.filter(F.col("_key") % (1 << 33) == 0).join(broadcast_if_small(previous), slot == F.col("_of"))
    return rows.select("_key", "_id", "own", F.lit(False).alias("_lent"), slot.alias("_slot")).unionByName(lent.select("_key", "_id", "own", F.lit(True).alias("_lent"), "_slot"))


def keyed(docs: DataFrame, id_col: str, text_col: str, slices: int | None = None) -> tuple[DataFrame, int | None]:
    """``_key`` (a number of its own for each row, in the order of ids), ``_id``, ``own``; how many quantiles will do, or None for places."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("own"))
    if slices is None:  # a range holds so many bytes of text (about), whatever the input's size
        total = rows.agg(F.sum(F.octet_length("own").cast("long"))).first()[0] or 0
        slices = max(4 * partitions(rows.sparkSession), -(-total // RANGE_BYTES))
    if slices <= MOST_EDGES and ids_name_rows(docs, id_col):
        return rows.select(F.col("_id").alias("_key"), "_id", "own"), slices
    return _placed(rows, slices), None


def with_next(rows: DataFrame, slices: int | None) -> DataFrame:
    """``rows`` of ``keyed`` with ``next_text`` and ``next_key``: of the next row by key, after the last of the first."""
    dealt = _dealt_by_places(rows) if slices is None else _dealt_by_quantiles(rows, slices)
    order = W.partitionBy("_slot").orderBy("_lent", "_key")
    following = dealt.select("*", F.lead("own").over(order).alias("next_text"), F.lead("_key").over(order).alias("next_key"))
    return following.filter("NOT _lent").select("_key", "_id", "own", "next_text", "next_key")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    quarter = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.char_length(text) - quarter), F.substr(following, F.lit(1), quarter))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The likeness of two exact digests is 1 where they are equal, else 0.
    """
    docs, slices = keyed(docs, id_col, text_col)
    texts = with_next(docs, slices).withColumn("changed", edited(F.col("own"), F.col("next_text")))
    texts = texts.select("_key", "_id", "next_key", F.char_length("own").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"), "own", "changed")

    def texts_of(hashed: DataFrame, column: str, keys: DataFrame) -> DataFrame:
        own = docs.join(keys, "_key", "left_semi").select("_key", "own")
        if column == "own":
            return own.select("own")
        pairs = hashed.join(keys, "_key", "left_semi").select("_key", "next_key")
        ahead = broadcast_if_small(pairs.select(F.col("next_key").alias("_key")))
        following = docs.join(ahead, "_key", "left_semi").select(F.col("_key").alias("next_key"), F.col("own").alias("next_text"))
        return own.join(pairs, "_key").join(following, "next_key").select(edited(F.col("own"), F.col("next_text")))

    prints = fingerprint(texts, ["own", "changed"], "_key", texts_of)
    prints = _with_next_print(prints)
    return prints.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        F.col("own_fp").alias("fingerprint"),
        F.col("changed_fp").alias("edited_fingerprint"),
        (F.col("own_fp") == F.col("changed_fp")).cast("double").alias("near_edited"),
        (F.col("own_fp") == F.col("next_fp")).cast("double").alias("near_next"),
    )


def _with_next_print(prints: DataFrame) -> DataFrame:
    """``prints`` with ``next_fp``, the fingerprint of the next document."""
    return prints.join(prints.select(F.col("_key").alias("next_key"), F.col("own_fp").alias("next_fp")), "next_key")

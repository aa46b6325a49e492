"""Trie of conversation prefixes, by vertical bitmaps.

A conversation is its turns in order; a node is a distinct sequence of first turns.  ``blocks`` and ``heads`` may rebuild
conversations first: conversation c takes its first h turns from conversation c - c mod ``blocks``, h being the CRC-32 of
its decimal id mod ``heads``, and keeps its own turns after its first h.

Turns travel as digests (128 bits of role and text, the lengths included) and byte counts; texts are never shuffled.  They
are sorted by (conversation, turn) over ranges that may end inside a conversation, so that one that holds a third of all
turns is many tasks, and identical turns are dealt on by a number of their rows.  A prefix's key is a polynomial of its
turns modulo 2^127 - 1, which composes: the key of a whole follows from the keys of its parts.  So a first pass gives each
range the summary of the conversation (and of the base) at its ends, and a fold over one small row for each range tells
every range in which conversation it begins, at what depth and key.  At random, two of n prefixes of m turns share a key
with probability n^2 m / 2^128.

A range is worked through in shards of at most 512 conversations.  A shard's vertical index has, for each (depth, turn), a
bitset of conversations; the shard's trie is walked depth first, each child being its parent's bitset met with the postings
of its lowest member's next turn, one intersection for a node.  A node yields its popcount, its least member, its members
and its end list; nodes of all shards are summed by key.

Sums over subtrees need no walk over the merged trie.  A node belongs to its least member, whose nodes are then the lower
part of its path; a node's subtree is that part below itself and, for every other member, all nodes that belong to it.
So a subtree's sum is a sum over members, of which only nodes that are shared need any.

End lists stay lists by shard, ascending over shards.  SHA-256 reads a list in order, so ``ends_digests`` streams each
node's lists through one task with one hash state, whatever their length.

Defined cases: null roles and texts are empty; turns that tie are ordered by their digests, repeated rows are turns of
their own; rows without a conversation id belong to none; ids below zero have bases by the floor; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from hashlib import sha256
from typing import NamedTuple

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.llm.common import cut, partitions, text_of, written

BLOCKS, HEADS = 5, 9
PRIME = (1 << 127) - 1
BASE = int.from_bytes(sha256(b"conversation prefix").digest()[:15], "big")
#: Conversations and turns of a shard; rows of a range.
SHARD, SHARD_TURNS, RANGE_ROWS = 512, 65_536, 500_000


class Run(NamedTuple):
    """Some successive turns of one conversation: how many, the first ones, and the key of what is left without the first j."""

    n: int
    head: list
    tails: list

    @staticmethod
    def of(turns: list, most: int) -> Run:
        tails, key, power = [0] * (most + 1), 0, 1
        for j in range(len(turns) - 1, -1, -1):
            key, power = (key + turns[j][0] * power) % PRIME, power * BASE % PRIME
            if j <= most:
                tails[j] = key
        return Run(len(turns), turns[:most], tails)

    def then(self, other: Run) -> Run:
        most, power = len(self.tails) - 1, pow(BASE, other.n, PRIME)
        tails = [(self.tails[j] * power + other.tails[0]) % PRIME if j <= self.n else other.tails[j - self.n] for j in range(most + 1)]
        return Run(self.n + other.n, (self.head + other.head)[:most], tails)


def prefix_key(turns, key: int = 0) -> int:
    for digest, _ in turns:
        key = (key * BASE + digest) % PRIME
    return key


class Place(NamedTuple):
    """Where a range begins: the open conversation and its run so far, its block and the first turns of the block's base, and whether the range's last conversation goes on behind it."""

    conv: int | None
    run: Run | None
    block: int | None
    base: list
    goes_on: bool


def fold(summaries: list[dict], most: int) -> dict[int, Place]:
    """Each range's place, from the summaries of all ranges in order."""
    conv = run = block = None
    base, places = [], {}
    for k, s in enumerate(summaries):
        following = summaries[k + 1]["first"] if k + 1 < len(summaries) else None
        places[s["range"]] = Place(conv, run, block, base, s["last"] == following)
        own = Run(*s["run"])
        run = run.then(own) if s["last"] == conv else own
        base = ((base if s["last_block"] == block else []) + s["base"])[:most]
        conv, block = s["last"], s["last_block"]
    return places


def _batches(batches):
    """Blocks, conversations, numbers of first turns and turns of Arrow batches, as Python lists."""
    for batch in batches:
        turns = [(int.from_bytes(d) % PRIME or 1, n) for d, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        if turns:
            yield batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), turns


def _summary(batches, most: int):
    """What ``fold`` needs of a range.  Only the last block of a batch is looked at turn by turn."""
    found, conv, block, run, base = None, None, None, None, []
    for blocks, convs, _, turns in _batches(batches):
        found = found or {"range": TaskContext.get().partitionId(), "first": convs[0]}
        at = len(blocks) - 1
        while at and blocks[at - 1] == blocks[-1]:
            at -= 1
        if block != blocks[-1]:
            block, conv, base = blocks[-1], None, []
        while at < len(convs):
            upto = at
            while upto < len(convs) and convs[upto] == convs[at]:
                upto += 1
            own = Run.of(turns[at:upto], most)
            run = run.then(own) if conv == convs[at] else own
            conv, at = convs[at], upto
            if conv == block:
                base = run.head
    if found:
        yield found | {"last": conv, "last_block": block, "run": run, "base": base}


class Shard:
    """Segments of conversations, and the nodes on them."""

    def __init__(self):
        self.segments, self.turns = [], 0

    def add(self, conv: int, key: int, depth: int, turns: list, begins: bool, ends: bool) -> None:
        """Turns of ``conv`` behind a prefix of ``depth`` turns; ``begins``: no other segment has counted its root."""
        self.segments.append((conv, key, depth, turns, begins, ends))
        self.turns += len(turns)

    def nodes(self):
        """(key, depth, parent's key, bytes of the last turn, members, ends).

        A prefix that segments begin behind is counted elsewhere; here it has no parent and members, only ends.
        """
        postings, stops, roots = {}, {}, {}
        for i, (_, key, depth, turns, begins, _) in enumerate(self.segments):
            bit = 1 << i
            for table, at in ((roots, (key, depth, begins)), (stops, depth + len(turns)), *((postings, (k, t[0])) for k, t in enumerate(turns, depth + 1))):
                table[at] = table.get(at, 0) | bit
        stack = [(key, depth, None, None, members, begins) for (key, depth, begins), members in roots.items()]
        while stack:
            key, depth, parent, size, members, counted = stack.pop()
            over = members & stops.get(depth, 0)
            ends = [self.segments[i][0] for i in _places(over) if self.segments[i][5]]
            if counted or ends:
                yield key, depth, parent, size, [self.segments[i][0] for i in _places(members)] if counted else [], ends
            rest = members & ~over
            while rest:
                _, _, start, turns, _, _ = self.segments[(rest & -rest).bit_length() - 1]
                digest, size = turns[depth - start]
                child = rest & postings[depth + 1, digest]
                stack.append(((key * BASE + digest) % PRIME, depth + 1, key, size, child, True))
                rest &= ~child


def _places(bits: int):
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


_NODES = "key_high long, key_low long, depth long, parent_high long, parent_low long, bytes long, n long, conv_id long, members array<long>, ends array<long>"


def _halves(key: int | None) -> tuple:
    if key is None:
        return None, None
    low = key & ((1 << 64) - 1)
    return key >> 64, low - (1 << 64) if low >> 63 else low


def _arrow(shard: Shard):
    import pyarrow as pa

    rows = [(*_halves(key), depth, *_halves(parent), size, len(members), members[0] if members else None, members, ends) for key, depth, parent, size, members, ends in shard.nodes()]
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())] * 2
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [x.split()[0] for x in _NODES.split(", ")])


class _Open:
    """The conversation that a range is at, and its turns that no shard has yet."""

    def __init__(self, conv: int, h: int, base: list):
        self.conv, self.h, self.base, self.rank = conv, h, base, 0
        self.key, self.depth, self.turns, self.begins = 0, 0, [], True

    def goes_on(self, run: Run) -> None:
        """It began in an earlier range with ``run``."""
        rest = max(0, run.n - self.h)
        self.key = (prefix_key(self.base[: self.h]) * pow(BASE, rest, PRIME) + run.tails[self.h]) % PRIME
        self.depth, self.rank, self.begins = min(self.h, len(self.base)) + rest, run.n, False

    def into(self, shard: Shard, ends: bool) -> None:
        turns = self.base[: self.h] + self.turns if self.begins else self.turns
        shard.add(self.conv, self.key, self.depth, turns, self.begins, ends)
        if not ends:
            self.key, self.depth, self.turns, self.begins = prefix_key(turns, self.key), self.depth + len(turns), [], False


def _walk(batches, place: Place | None, most: int):
    """The nodes of a range, shard by shard."""
    shard, conv = Shard(), None
    block, base = (place.block, place.base) if place else (None, [])
    for blocks, convs, heads, turns in _batches(batches):
        for b, c, h, turn in zip(blocks, convs, heads, turns, strict=True):
            if conv is None or conv.conv != c:
                if conv is not None:
                    conv.into(shard, True)
                    if len(shard.segments) >= SHARD or shard.turns >= SHARD_TURNS:
                        yield _arrow(shard)
                        shard = Shard()
                if b != block:
                    block, base = b, []
                first, conv = conv is None, _Open(c, 0 if c == b else h, base)
                if first and place.conv == c:
                    conv.goes_on(place.run)
            if c == b and conv.rank < most:
                base = [*base, turn]
            if conv.rank >= conv.h:
                conv.turns.append(turn)
            conv.rank += 1
            if len(conv.turns) >= SHARD_TURNS:  # a long conversation goes on in the next shard
                conv.into(shard, False)
                yield _arrow(shard)
                shard = Shard()
    if conv is not None:
        conv.into(shard, not place.goes_on)
        yield _arrow(shard)


def _sorted(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, blocks: int, heads: int) -> DataFrame:
    """``block``, ``conv``, ``head`` (the most first turns that it takes from its base), ``digest``, ``bytes``: sorted ranges, written once."""
    spark = turns.sparkSession
    role, text, conv = text_of(role_col), text_of(text_col), F.col(conv_col).cast("long")
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        (conv - F.pmod(conv, F.lit(blocks))).alias("block"),
        conv.alias("conv"),
        (F.crc32(conv.cast("string").cast("binary")) % heads).cast("int").alias("head"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.col(turn_col).alias("_turn"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ["block", "conv", F.col("_turn").asc_nulls_first(), "digest", "_row"]
    ranges = max(partitions(spark), -(-turns.count() // RANGE_ROWS))
    return cut(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("_turn", "_row"))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", blocks: int = 1, heads: int = 1) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes, and the end lists.

    Nodes: ``key_high``, ``key_low`` (together the prefix's key), ``conv_id`` (least member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``.  End lists: the two keys and ``ends``, ids in ascending
    order; a node's lists ascend by their first ids and do not overlap.
    """
    spark, most = turns.sparkSession, heads - 1
    rows = _sorted(turns, conv_col, turn_col, role_col, text_col, blocks, heads)

    def summary(batches):
        import pyarrow as pa

        for found in _summary(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(found)])], ["found"])

    summaries = sorted((json.loads(x.found) for x in rows.mapInArrow(summary, "found string").collect()), key=lambda s: s["range"])  # a small row for each range
    places = spark.sparkContext.broadcast(fold(summaries, most))

    def walk(batches):
        yield from _walk(batches, places.value.get(TaskContext.get().partitionId()), most)

    partial, _ = written(rows.mapInArrow(walk, _NODES))
    key, parent = ["key_high", "key_low"], ["parent_high", "parent_low"]
    merged = partial.groupBy(key).agg(
        *(F.max(c).alias(c) for c in ("depth", *parent, "bytes")), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")
    )
    kids = merged.filter("depth > 0").groupBy(parent).agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed(dict(zip(parent, key, strict=True)))
    nodes = cut(merged.join(kids, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # Only shared nodes, and leaves, have anything to sum.
    saved = (F.col("n") - 1) * F.coalesce("bytes", F.lit(0))
    counted = nodes.filter("n > 1 OR n_children = 0").select(*key, "conv_id", "n", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), saved.alias("saved"))
    belonging = counted.groupBy(F.col("conv_id").alias("member")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    shared = nodes.filter("n > 1").select(*key, "conv_id")
    others = partial.select(*key, "members").join(shared, key).select(*key, "conv_id", F.explode("members").alias("member")).filter("member <> conv_id")
    others = others.join(belonging, "member").groupBy(key).agg(F.sum("leaf").alias("leaf_o"), F.sum("saved").alias("saved_o"))
    below = W.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    own = counted.select(*key, "n", F.sum("leaf").over(below).alias("leaf"), F.sum("saved").over(below).alias("saved")).filter("n > 1").drop("n")
    sums = own.join(others, key, "left").select(*key, (F.col("leaf") + F.coalesce("leaf_o", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("saved_o", F.lit(0))).alias("saved_tokens"))
    above = nodes.select(F.col("key_high").alias("parent_high"), F.col("key_low").alias("parent_low"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums, key, "left").join(above, parent, "left").select(
        *key, "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens")
    )
    return found, partial.filter(F.size("ends") > 0).select(*key, "ends")


def ends_digests(ends: DataFrame) -> DataFrame:
    """``key_high``, ``key_low``, ``ends_sha256``: the hash of each node's end list, decimal ids joined by commas."""

    def hashed(batches):
        import pyarrow as pa

        open_, state, found = None, None, []

        def out():
            columns = list(zip(*found, strict=True)) if found else [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["key_high", "key_low", "ends_sha256"])

        for batch in batches:
            for high, low, ids in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if open_ != (high, low):
                    if state is not None:
                        found.append((*open_, state.hexdigest()))
                    open_, state = (high, low), sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ids)).encode())
            yield out()
            found.clear()
        if state is not None:
            found.append((*open_, state.hexdigest()))
            yield out()

    rows = ends.repartition("key_high", "key_low").sortWithinPartitions("key_high", "key_low", F.col("ends")[0])
    return rows.mapInArrow(hashed, "key_high long, key_low long, ends_sha256 string")


def trie_digests(conversations: DataFrame) -> DataFrame:
    """The contract's columns, over conversations rebuilt from the first turns of every fifth."""
    nodes, ends = prefix_trie(conversations, blocks=BLOCKS, heads=HEADS)
    found = nodes.join(ends_digests(ends), ["key_high", "key_low"], "left")
    return found.drop("key_high", "key_low").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
d AS (
  SELECT conv_id, turn, md5(strlen(role)::VARCHAR || ':' || role || text) AS d, strlen(text)::BIGINT AS b FROM t),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS pos FROM d),
c AS (
  SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, pos, d, b FROM c JOIN o ON o.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, pos, d, b FROM c JOIN o ON o.conv_id = c.conv_id AND pos >= h),
p AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, b,
         string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b FROM p GROUP BY k, depth),
kids AS (
  SELECT left(k, (depth - 1) * 32) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
subtrees AS (
  SELECT left(k, i * 32) AS k, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * b)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS i FROM m) GROUP BY 1),
ends AS (
  SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY conv_id) GROUP BY k)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM m JOIN subtrees USING (k) LEFT JOIN ends USING (k) LEFT JOIN m u ON m.depth > 0 AND u.k = left(m.k, (m.depth - 1) * 32)
"""

"""N-gram Jaccard join over a token-group matrix.

Documents are sets of word shingles; two link when the shared part of their union is at least the threshold, and a
document's component is all it reaches by links.

1. Documents with equal sets are one node.
2. Similar nodes are put into groups such that no link crosses groups.  All shingles are ordered by the number of sets
   they stand in, rarest first.  Sets that link share one of the first n - ceil(t n) + 1 shingles of each, so nodes that
   share such a key are candidates, and a group is a component of candidates.  A shingle of one set alone is no key, and
   a passage, line or phrase that very many documents share is a key only of documents that hold little else.
3. Inside a group, nodes lie in blocks; a task holds two blocks.  It keeps the token-group matrix of small subgroups: the
   union of each subgroup's shingles.  A query node's shingles in that union bound its overlap with every member, so
   only subgroups that can reach the threshold are opened, and there the overlap is counted exactly.  A subgroup is not
   opened either if the query is linked to all of it already.
   A group of several blocks first meets one block of pivots.  What the pivots link is one component then, and only the
   rest of the group is compared with all of it.
4. The links found, one spanning forest a task, make the components.

How often shingles occur is counted over all documents: batches of documents send each distinct shingle, packed as one
number with its owner's place in the batch, to the bucket of its hash; the buckets answer the batches with what occurs
more than once.  A shingle that many documents of a batch hold is sent once with its count, so no shingle, however
frequent, is a hot key; the batch keeps the owners.  The number of buckets follows the number of shingles, so a task's
share does not grow with the input.  Nothing is proportional to the pairs of a group that its pivots link.

Nodes are found again by their least id.  Where ids are null or repeat, all of this runs over numbers given to the rows,
which are written once, and the components' least ids are taken at the end.

Defined cases: a null text is empty; sets without shingles link with nothing and are their own component; a document
with fewer words than a shingle has is one shingle; a null id never names a component if there is another in it;
repeated rows link with each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import broadcast_if_small, cut, ids_name_rows, numbered, partitions, text_of
from quarrystone.llm.components import components
from quarrystone.llm.hashing import mix, shingles

#: Nodes of a block (about), its shingles (about), and nodes of a subgroup.
BLOCK, BLOCK_SHINGLES, SUBGROUP = 96, 1 << 21, 16
#: Shingles of a batch that is counted at once, and of a bucket (about); owners a batch can have.
BATCH_SHINGLES, BUCKET_SHINGLES, OWNERS = 1 << 21, 1 << 21, (1 << 16) - 1
#: A shingle with more owners in a batch is sent once, with their number.
SHARED = 8

_LOW48, _LOW16 = np.uint64((1 << 48) - 1), np.uint64((1 << 16) - 1)
_8, _16, _24, _40 = (np.uint64(x) for x in (8, 16, 24, 40))


def _star(keys: np.ndarray, nodes: np.ndarray):
    """Of (key, node) pairs: one pair a key with its least node, and edges of all other nodes to that."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
    first = np.flatnonzero(new)
    least = nodes[first][np.cumsum(new) - 1] if len(keys) else nodes
    other = least != nodes
    edges = np.unique(np.stack((nodes[other], least[other])), axis=1) if other.any() else np.empty((2, 0), np.uint64)
    return keys[first], nodes[first], edges


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a, np.uint64).tobytes() for a in arrays)


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """``_id``, ``n``, ``h1``, ``h2`` of each document: the size of its set and two hashes of it."""

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            heads = [set_name(shingles(t, width)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in heads], pa.int64()) for k in range(3))], ["_id", "n", "h1", "h2"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(made, f"_id {kind}, n long, h1 long, h2 long")


def set_name(tokens: np.ndarray) -> tuple[int, int, int]:
    if not len(tokens):
        return 0, 0, 0
    return len(tokens), int(np.sum(mix(tokens)).view(np.int64)), int(np.bitwise_xor.reduce(mix(tokens ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64))


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> _40) * np.uint64(buckets)) >> _24


def _numbers(blob: bytes, rows: int = 1) -> np.ndarray:
    return np.frombuffer(blob, np.uint64).reshape(rows, -1)


class Batch:
    """Distinct sets whose shingles are counted together."""

    def __init__(self):
        self.known, self.tokens, self.names, self.size = set(), [], [], 0

    def add(self, tokens: np.ndarray) -> None:
        name = set_name(tokens)
        if len(tokens) and name not in self.known:
            self.known.add(name)
            self.tokens.append(tokens)
            self.names.append(name)
            self.size += len(tokens)

    def postings(self, buckets: int):
        """(bucket, single, shared) for each bucket, and ``owned``.

        ``single``: shingles (48 bits) with their owner (16 bits).  ``shared``: shingles of many owners and their counts.
        ``owned``: the shared shingles and their owners, which the batch keeps.
        """
        tokens = np.concatenate(self.tokens)
        owners = np.repeat(np.arange(len(self.tokens), dtype=np.uint64), [len(t) for t in self.tokens])
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        counts = np.diff(np.append(first, len(tokens)))
        many = np.repeat(counts > SHARED, counts)
        owned = tokens[many], owners[many]
        shared, shared_counts = tokens[first][counts > SHARED], counts[counts > SHARED].astype(np.uint64)
        tokens, owners = tokens[~many], owners[~many]
        bounds = np.searchsorted(_bucket(tokens, buckets), np.arange(buckets + 1, dtype=np.uint64))
        shared_bounds = np.searchsorted(_bucket(shared, buckets), np.arange(buckets + 1, dtype=np.uint64))
        single = (tokens & _LOW48) << _16 | owners
        found = []
        for b in np.flatnonzero((bounds[1:] > bounds[:-1]) | (shared_bounds[1:] > shared_bounds[:-1])).tolist():
            part = slice(shared_bounds[b], shared_bounds[b + 1])
            found.append((b, _blob(single[bounds[b] : bounds[b + 1]]), _blob(shared[part] & _LOW48, shared_counts[part])))
        return found, owned


def _postings(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    """``bucket``, ``batch``, ``single``, ``shared``; and one row a batch with its ``sets`` and ``owned``, for itself."""

    def made(batches):
        import pyarrow as pa

        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("single", "shared", "sets", "owned"))])

        def sent(own):
            found, owned = own.postings(buckets)
            sets = np.array(own.names, np.int64).T.view(np.uint64)
            found.append((number % buckets, b"", b"", _blob(*sets), _blob(*owned)))
            for at in range(0, len(found), 1024):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (x[0], number, *x[1:]), strict=False)) for x in found[at : at + 1024]], schema)

        own = Batch()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).cast(pa.binary()).to_pylist():
                    own.add(shingles(text, width))
                    if own.size >= BATCH_SHINGLES or len(own.names) == OWNERS:
                        yield from sent(own)
                        number, own = number + 1, Batch()
        if own.size:
            yield from sent(own)

    return rows.select("_text").mapInArrow(made, "bucket int, batch long, single binary, shared binary, sets binary, owned binary")


def frequent(single: list[np.ndarray], shared: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each batch's ``single``: what occurs more than once, as rank (frequency up to 255, 8 bits; shingle, 40) and owner.

    And the distinct ``shared`` shingles (given with counts) with their ranks.
    """
    low = np.concatenate([*(x >> _16 for x in single), shared[0]])
    weights = np.concatenate([np.ones(len(low) - shared.shape[1], np.uint64), shared[1]])
    order = np.argsort(low)
    sorted_low = low[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_low[1:] != sorted_low[:-1]))) if len(low) else np.empty(0, np.int64)
    total = np.empty(len(low), np.uint64)
    if len(low):
        total[order] = np.repeat(np.add.reduceat(weights[order], first), np.diff(np.append(first, len(low))))
    rank = np.minimum(total, np.uint64(255)) << _40 | low >> _8
    out, at = [], 0
    for x in single:
        own = slice(at, at := at + len(x))
        out.append((rank[own] << _16 | x & _LOW16)[total[own] > 1])
    return out, np.unique(np.stack((low[at:], rank[at:])), axis=1)


def _answers(postings: DataFrame, buckets: int) -> DataFrame:
    """``batch``, ``bucket``, ``ranks`` (of frequent shingles, with owners), ``shared`` (shingles, ranks), ``sets``, ``owned``."""

    def counted(batches):
        import pyarrow as pa

        schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("ranks", "shared", "sets", "owned"))])
        by: dict[int, list] = {}
        for batch in batches:
            for bucket, number, single, shared, sets, owned in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sets is not None:
                    yield pa.RecordBatch.from_pylist([{"batch": number, "bucket": bucket, "ranks": b"", "shared": b"", "sets": sets, "owned": owned}], schema)
                else:
                    by.setdefault(bucket, []).append((number, _numbers(single)[0], _numbers(shared, 2)))
        for bucket, own in by.items():
            ranks, answers = frequent([x[1] for x in own], np.concatenate([x[2] for x in own], axis=1))
            for (number, _, shared), found in zip(own, ranks, strict=True):
                back = answers[:, np.isin(answers[0], shared[0])]
                if len(found) or back.size:
                    yield pa.RecordBatch.from_pylist([{"batch": number, "bucket": bucket, "ranks": _blob(found), "shared": _blob(*back)}], schema)

    return postings.repartitionById(buckets, "bucket").mapInArrow(counted, "batch long, bucket int, ranks binary, shared binary, sets binary, owned binary")


def prefix_keys(sizes: np.ndarray, ranks: np.ndarray, owners: np.ndarray, buckets: np.ndarray, num: int, den: int):
    """(key, owner) of the keys of each set, given its frequent shingles' ranks; what is not given occurs once, which is rarer."""
    order = np.lexsort((buckets, ranks, owners))
    ranks, owners, buckets = ranks[order], owners[order], buckets[order]
    counts = np.bincount(owners.astype(np.int64), minlength=len(sizes))
    place = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)
    wanted = sizes - -(-num * sizes // den) + 1 - (sizes - counts)
    own = place < np.repeat(wanted, counts)
    return mix(ranks[own] ^ mix(buckets[own] + np.uint64(1))), owners[own]


def _key_blocks(answers: DataFrame, num: int, den: int, buckets: int, target: int) -> DataFrame:
    """Blocks of candidate keys by bucket: ``keys`` (key, node) and ``edges`` between nodes that meet in the batch."""

    def made(table):
        import pyarrow as pa

        parts, sets, owned = [], None, None
        shared_ranks: dict[int, np.ndarray] = {}
        for bucket, ranks, shared, own_sets, own_owned in zip(*(table.column(c).to_pylist() for c in ("bucket", "ranks", "shared", "sets", "owned")), strict=True):
            if own_sets is not None:
                sets, owned = _numbers(own_sets, 3), _numbers(own_owned, 2)
                continue
            found = _numbers(ranks)[0]
            parts.append((found >> _16, found & _LOW16, np.full(len(found), bucket, np.uint64)))
            shared_ranks[bucket] = _numbers(shared, 2)
        tokens, owners = owned
        of = _bucket(tokens, buckets)
        bounds = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
        for bucket, known in shared_ranks.items():
            part = slice(bounds[bucket], bounds[bucket + 1])
            if bounds[bucket + 1] > bounds[bucket]:
                at = np.searchsorted(known[0], tokens[part] & _LOW48)
                parts.append((known[1][at], owners[part], np.full(len(at), bucket, np.uint64)))
        if not parts:
            return schema_of(pa).empty_table()
        keys, owner = prefix_keys(sets[0].astype(np.int64), *(np.concatenate([p[k] for p in parts]) for k in range(3)), num, den)
        keys, nodes, edges = _star(keys, sets[1][owner.astype(np.int64)])
        of_key, of_edge = keys % np.uint64(target), edges[0] % np.uint64(target)
        order, edge_order = np.argsort(of_key, kind="stable"), np.argsort(of_edge, kind="stable")
        names = np.arange(target + 1, dtype=np.uint64)
        ends, edge_ends = np.searchsorted(of_key[order], names), np.searchsorted(of_edge[edge_order], names)
        out = []
        for b in np.flatnonzero((ends[1:] > ends[:-1]) | (edge_ends[1:] > edge_ends[:-1])).tolist():
            part, mine = order[ends[b] : ends[b + 1]], edge_order[edge_ends[b] : edge_ends[b + 1]]
            out.append({"bucket": b, "keys": _blob(keys[part], nodes[part]), "edges": _blob(edges[0][mine], edges[1][mine])})
        return pa.Table.from_pylist(out, schema_of(pa))

    def schema_of(pa):
        return pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("edges", pa.binary())])

    return answers.groupBy("batch").applyInArrow(made, "bucket int, keys binary, edges binary")


def _candidates(blocks: DataFrame, buckets: int) -> DataFrame:
    """``a``, ``b``: edges (by ``h1``) that connect all nodes that share a key."""

    def met(batches):
        import pyarrow as pa

        by: dict[int, list] = {}
        for batch in batches:
            for bucket, keys, edges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _numbers(edges, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])
                by.setdefault(bucket, []).append(_numbers(keys, 2))
        for own in by.values():
            found = _star(*np.concatenate(own, axis=1))[2].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    return blocks.repartitionById(buckets, "bucket").mapInArrow(met, "a long, b long")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that span what is linked among ``left``, or between ``left`` and ``right`` if given (positions in left + right)."""
    sets = left + (right or [])
    lengths = np.array([len(s) for s in sets])
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids.astype(np.int32), np.cumsum(lengths)[:-1])
    asked, held = range(len(left)), range(len(left), len(sets)) if right is not None else range(len(left))
    held = sorted(held, key=lambda i: (int(sets[i][0]), lengths[i]))  # similar sets share their least shingle
    groups = [held[k : k + SUBGROUP] for k in range(0, len(held), SUBGROUP)]
    matrix = np.zeros((len(groups), len(vocabulary) // 8 + 1), np.uint8)  # bits: a row a subgroup, a column a shingle
    flat, starts, least = [], [], []
    for g, members in enumerate(groups):
        flat.append(np.concatenate([ids[i] for i in members]))
        starts.append(np.concatenate(([0], np.cumsum(lengths[members])[:-1])))
        own = np.zeros(len(vocabulary), bool)
        own[flat[-1]] = True
        bits = np.packbits(own)
        matrix[g, : len(bits)] = bits
        least.append(min(lengths[members]))
    least, forest, found = np.array(least), Forest(len(sets)), []
    mark = np.zeros(len(vocabulary), np.int32)
    for q in asked:
        n = lengths[q]
        bound = (matrix[:, ids[q] >> 3] >> (7 - (ids[q] & 7)).astype(np.uint8) & 1).sum(1)  # overlap with any member is at most this; the union at least the larger set
        opened = np.flatnonzero((bound * den >= num * np.maximum(n, least)))
        if not len(opened):
            continue
        mark[ids[q]] = 1
        for g in opened:
            own = forest.root(q)
            if all(forest.root(i) == own for i in groups[g]):
                continue
            shared = np.add.reduceat(mark[flat[g]], starts[g])
            sizes = lengths[groups[g]]
            for k in np.flatnonzero(shared * den >= num * (sizes + n - shared)):
                i = groups[g][k]
                a, b = forest.root(q), forest.root(i)
                if a != b:
                    forest.up[a] = b
                    found.append((q, i))
        mark[ids[q]] = 0
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row for each input row: id, ``n_shingles``, ``component_id`` (least id reached by links of at least num / den)."""
    if ids_name_rows(docs, id_col):
        return _components_by_id(docs, id_col, text_col, width, num, den)
    rows = cut(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    found = cut(rows.select("_row", "_id").join(_components_by_id(rows, "_row", "_text", width, num, den), "_row"))
    least = found.groupBy("component_id").agg(F.min("_id").alias("_least"))
    return found.join(least, "component_id").select(F.col("_id").alias(id_col), "n_shingles", F.col("_least").alias("component_id"))


def candidate_groups(rows: DataFrame, total: int, width: int, num: int, den: int) -> DataFrame:
    """``node`` (``h1``), ``root``: groups of nodes (of ``_text``) that no link leaves.  ``total``: shingles of all rows, about."""
    least = partitions(rows.sparkSession)
    buckets = max(least, -(-total // BUCKET_SHINGLES))
    target = max(least, buckets // 16)
    answers = _answers(_postings(rows, width, buckets), buckets)
    return components(_candidates(_key_blocks(answers, num, den, buckets, target), target))


def _components_by_id(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """``jaccard_components`` of rows that each have an id of their own."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    sets = cut(_sets(rows, width))
    total = sets.agg(F.sum("n")).first()[0] or 0
    candidates = candidate_groups(rows, total, width, num, den)
    nodes = sets.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = nodes.join(candidates.withColumnRenamed("node", "h1"), "h1")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_members"), F.sum("n").alias("_shingles"))
    members = cut(members.join(sizes.filter("_members > 1"), "root").select("root", "rep", "h1", "h2", _blocks("_members", "_shingles").alias("_blocks")))
    labels = components(_links(rows, members, width, num, den))
    # A node begins with its least id (null last), so the least node of a component has the component's least id.
    named = nodes.select("h1", "h2", "n", "rep", "copies", _node().alias("node")).join(labels, "node", "left")
    shared = cut(named.filter("copies > 1 OR root IS NOT NULL").select("h1", "h2", "n", F.coalesce("root.rep", "rep").alias("component_id")))
    return sets.join(shared, ["h1", "h2", "n"], "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def _blocks(members: str, shingles_: str):
    return F.ceil(F.greatest(F.col(members) / BLOCK, F.col(shingles_) / BLOCK_SHINGLES)).cast("int")


def _node():
    return F.struct(F.col("rep").isNull().alias("none"), F.col("rep"), F.col("h1"), F.col("h2"))


def _links(rows: DataFrame, members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``a``, ``b``: links between nodes (as ``_node`` names them), enough to span every component."""
    kind = members.schema["rep"].dataType.simpleString()
    texts = rows.join(broadcast_if_small(members), F.col("_id") == F.col("rep")).select("root", "rep", "h1", "h2", "_blocks", "_text")

    def tokenised(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                tokens = [shingles(t, width) for t in part.column("_text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names[:-1]), pa.array([t.tobytes() for t in tokens], pa.binary())], [*part.schema.names[:-1], "tokens"])

    held = cut(texts.mapInArrow(tokenised, f"root long, rep {kind}, h1 long, h2 long, _blocks int, tokens binary"))
    held = held.select("root", "_blocks", _node().alias("node"), "tokens")
    own = F.pmod(F.xxhash64("node.h1", "node.h2"), F.col("_blocks")).cast("int")
    # Block 0 is the pivots': it meets every block of its group.
    met = F.when(own == 0, F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array(own))
    found = cut(_verified(held.select("root", "node", "tokens", (own == 0).alias("asks"), F.explode(met).alias("y")).withColumn("x", F.lit(0)), kind, num, den))
    large = held.filter("_blocks > 1")
    if large.isEmpty():
        return found
    labels = components(found).withColumnRenamed("root", "part")
    large = cut(large.join(labels, "node", "left").select("root", "node", "tokens", F.coalesce("part", "node").alias("part")))
    parts = large.groupBy("root", "part").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("tokens") / 8).alias("_s"))
    main = parts.groupBy("root").agg(F.max_by("part", F.struct("_n", "part")).alias("main"), F.sum("_n").alias("_all_n"), F.sum("_s").alias("_all_s"), F.max(F.struct("_n", "part", "_s")).alias("_of"))
    rest = main.filter("_all_n > _of._n").select("root", "main", F.expr("_all_n - _of._n").alias("_n"), F.expr("_all_s - _of._s").alias("_s"), F.expr("_of._n").alias("_main_n"), F.expr("_of._s").alias("_main_s"))
    rest = rest.select("root", "main", _blocks("_n", "_s").alias("_rest"), _blocks("_main_n", "_main_s").alias("_main"))
    dealt = large.join(broadcast_if_small(cut(rest)), "root").select("root", "node", "tokens", (F.col("part") != F.col("main")).alias("_in"), "_rest", "_main")
    hashed = F.xxhash64("node.h1", "node.h2")
    asked, other = F.pmod(hashed, F.col("_rest")).cast("int"), F.pmod(hashed, F.col("_main")).cast("int")
    each = F.sequence(F.lit(0), F.col("_rest") - 1)
    # The rest's blocks meet each other (x <= y) and, beyond them, the main part's.
    of_rest = F.concat(
        F.transform(each, lambda k: F.struct(F.least(asked, k).alias("x"), F.greatest(asked, k).alias("y"), (asked <= k).alias("asks"))),
        F.transform(F.sequence(F.lit(0), F.col("_main") - 1), lambda k: F.struct(asked.alias("x"), (F.col("_rest") + k).alias("y"), F.lit(True).alias("asks"))),
    )
    of_main = F.transform(each, lambda k: F.struct(k.alias("x"), (F.col("_rest") + other).alias("y"), F.lit(False).alias("asks")))
    dealt = dealt.select("root", "node", "tokens", F.explode(F.when(F.col("_in"), of_rest).otherwise(of_main)).alias("_to")).select("root", "node", "tokens", "_to.*")
    return found.unionByName(cut(_verified(dealt, kind, num, den)))


def _verified(dealt: DataFrame, kind: str, num: int, den: int) -> DataFrame:
    """``a``, ``b``: links between what ``asks`` and what does not in each (``root``, ``x``, ``y``); or inside, if all ask."""

    def verified(table):
        import pyarrow as pa

        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        seen, sides, names = set(), ([], []), ([], [])
        for k, (asks, node, tokens) in enumerate(zip(*(table.column(c).to_pylist() for c in ("asks", "node", "tokens")), strict=True)):
            if (key := (node["h1"], node["h2"], len(tokens))) not in seen:
                seen.add(key)
                sides[not asks].append(np.frombuffer(tokens, np.uint64))
                names[not asks].append(k)
        pairs = linked_pairs(sides[0], None if x == y else sides[1], num, den) if sides[0] and (x == y or sides[1]) else []
        both, nodes = names[0] + names[1], table.column("node")
        nodes = nodes.cast(pa.struct([pa.field(f.name, f.type) for f in nodes.type]))
        return pa.table([nodes.take(pa.array([both[p[k]] for p in pairs], pa.int64())) for k in (0, 1)], ["a", "b"])

    node = f"struct<none:boolean,rep:{kind},h1:bigint,h2:bigint>"
    return dealt.groupBy("root", "x", "y").applyInArrow(verified, f"a {node}, b {node}")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, that stay if one document of each component stays: the one with the least id."""
    if ids_name_rows(docs, id_col):
        found = _components_by_id(docs, id_col, text_col, width, num, den)
        kept = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept"))
        return docs.join(kept, docs[id_col] == kept["_kept"], "left_semi")
    rows = numbered(docs)
    plain = rows.select("_row", F.col("_doc")[id_col].alias("_id"), F.col("_doc")[text_col].alias("_text"))
    found = plain.select("_row", "_id").join(_components_by_id(plain, "_row", "_text", width, num, den), "_row")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_row"))).alias("first")
    kept = found.groupBy("component_id").agg(first).select(F.col("first._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_doc.*")

"""Prefix trie of conversations in balanced parentheses.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it.

Plan. (1) Each conversation becomes a path of 16-byte digests of its turns; texts go no further. (2) Paths are range
partitioned and sorted with their ids, so that a node's members stand together and a group of copies of any size spreads
over partitions; a partition is cut into shards of SHARD turns at most. (3) A shard writes its trie as balanced parentheses, with a
tree of the least and largest excess of blocks: findclose delimits the subtrees, ranks of "()" pairs count leaves,
cumulative arrays over the preorder give members and savings. (4) Only nodes on the paths of a shard's first and last conversation,
its spines, can have members in other shards. Their parts are summed over the same encoding of the spines; all other
nodes are settled where they are found. (5) The ids that end at a spine's node come in runs of RUN and are hashed in order
as they stream by.

Scale. One shuffle of turns by conversation, one of paths by range. A task holds one shard, or one conversation where that is
longer: 16 bytes a turn. One task merges two paths of a shard, about one turn in SHARD / 2 x the depth of
the trie. A digest chain is inherently sequential, so the ids of one node meet in one task, but as a stream.

Defined results: null roles and texts are empty; turns go by number, null first, equal ones by role, then digest;
rows without a conversation id are left out; repeated rows are turns of their own; without rows there are no nodes, not even a
root; extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, settled, sized, small_batches, table

#: Turns of a shard, but for a single conversation that is longer.
SHARD = 1 << 17
#: Parentheses of a block.
BLOCK = 64
#: Ids in a row of those that end at a spine's node.
RUN = 4096
NOBODY = sha256(b"").hexdigest()
_FAR = np.int64(1 << 40)


def paths(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, said: for each conversation its turns in order, as digest and bytes of text."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary")))
    one = F.struct(F.col(turn).alias("turn"), who.alias("role"), digest.alias("digest"), F.octet_length(what).cast("long").alias("size"))
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), one.alias("one")).filter(F.col("conv_id").isNotNull())
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("said")).select("conv_id", F.transform("said", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("said"))


def rebuilt(known: DataFrame) -> DataFrame:
    """conv_id, said: conversation c begins with the first h turns of conversation c - c % 5 in place of its own; h is crc32(c) % 9."""
    base = F.col("conv_id") - F.col("conv_id") % 5
    heads = known.filter(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.slice("said", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    kept = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.filter("said", lambda x: F.lit(False)))
    rest = F.slice("said", F.col("h") + 1, F.size("said"))
    return known.withColumns({"base": base, "h": h}).join(heads, "base", "left").select("conv_id", F.concat(kept, rest).alias("said"))


class Trie:
    """Sorted paths as balanced parentheses; nodes are numbered in preorder, 0 is the root."""

    def __init__(self, turns: np.ndarray, lengths: np.ndarray) -> None:
        """turns: a row of two numbers for each turn of all paths, one path after another."""
        n, self.lengths = len(lengths), lengths
        self.begins = np.cumsum(lengths) - lengths
        both = np.minimum(lengths[1:], lengths[:-1])
        path = np.repeat(np.arange(n - 1), both)
        k = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        differ = (turns[self.begins[path] + k] != turns[self.begins[path + 1] + k]).any(axis=1)
        common = both.copy()
        np.minimum.at(common, path[differ], k[differ])
        self.common = np.concatenate([[0], common]).astype(np.int64)
        opens, closes = lengths - self.common, np.append(lengths[:-1] - self.common[1:], lengths[-1] + 1)
        opens[0] += 1
        bits = np.repeat(np.tile(np.array([True, False]), n), np.stack([opens, closes], axis=1).ravel())
        self.excess = np.cumsum(np.where(bits, 1, -1))
        self.opened = np.flatnonzero(bits)
        self.depth = self.excess[self.opened] - 1
        self.ends = np.cumsum(opens) - 1  # the node at which each path ends
        places = np.arange(len(turns)) - np.repeat(self.begins, lengths)
        self.origin = np.concatenate([[-1], np.flatnonzero(places >= np.repeat(self.common, lengths))])  # a node's last turn
        self._blocks()
        self.close = self.findclose(self.opened)
        self.last = np.cumsum(bits)[self.close] - 1  # the last node of each subtree
        pairs = np.concatenate([[0], np.cumsum(bits[:-1] & ~bits[1:])])
        self.leaves = pairs[self.close] - pairs[self.opened]
        self._levels = np.sort(self.depth * len(self.depth) + np.arange(len(self.depth)))
        self.parent = np.append([-1], self.on_level(self.depth[1:] - 1, np.arange(1, len(self.depth))))

    def _blocks(self) -> None:
        """Least and largest excess of blocks, and of two of these, and so on."""
        fill = -len(self.excess) % BLOCK
        low = np.append(self.excess, np.full(fill, _FAR)).reshape(-1, BLOCK).min(axis=1)
        high = np.append(self.excess, np.full(fill, -_FAR)).reshape(-1, BLOCK).max(axis=1)
        self.low, self.high = [], []
        while True:
            if len(low) > 1 and len(low) % 2:
                low, high = np.append(low, _FAR), np.append(high, -_FAR)
            self.low.append(low)
            self.high.append(high)
            if len(low) == 1:
                return
            low, high = low.reshape(-1, 2).min(axis=1), high.reshape(-1, 2).max(axis=1)

    def _within(self, at: np.ndarray, want: np.ndarray, out: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Looks from at on to the block's end for the excess wanted; which: entries of out to fill; returns those that aren't found."""
        missed = []
        while len(at):
            inside = at < len(self.excess)
            hit = np.zeros(len(at), bool)
            hit[inside] = self.excess[at[inside]] == want[inside]
            out[which[hit]] = at[hit]
            ended = ~hit & (~inside | (at % BLOCK == BLOCK - 1))
            missed.append(which[ended])
            go = ~hit & ~ended
            at, want, which = at[go] + 1, want[go], which[go]
        return np.concatenate(missed) if missed else np.zeros(0, np.int64)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the first place behind it where the excess is one less."""
        out, want = np.full(len(at), -1), self.excess[at] - 1
        inner = (at + 1) % BLOCK != 0
        every = np.arange(len(at))
        left = np.concatenate([every[~inner], self._within(at[inner] + 1, want[inner], out, every[inner])])
        block = at[left] // BLOCK
        for level in range(len(self.low)):
            if not len(left):
                break
            right = np.minimum(block + 1, len(self.low[level]) - 1)
            found = (block % 2 == 0) & (right > block) & (self.low[level][right] <= want[left]) & (want[left] <= self.high[level][right])
            down, of = right[found], left[found]
            for lower in range(level - 1, -1, -1):
                down = down * 2
                down += ~((self.low[lower][down] <= want[of]) & (want[of] <= self.high[lower][down]))
            self._within(down * BLOCK, want[of], out, of)
            left, block = left[~found], block[~found] // 2
        return out

    def on_level(self, depth: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """The last node of such depth that is numbered upto at most."""
        return self._levels[np.searchsorted(self._levels, depth * len(self.depth) + upto, side="right") - 1] % len(self.depth)

    def below(self, weight: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        summed = np.concatenate([[0], np.cumsum(weight)])
        return summed[self.last + 1] - summed[: len(weight)]

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value of the paths that lead through each node."""
        begin, end = np.searchsorted(self.ends, np.arange(len(self.depth))), np.searchsorted(self.ends, self.last, side="right")
        return np.minimum.reduceat(np.append(values, np.iinfo(np.int64).max), np.stack([begin, end], axis=1).ravel())[::2]

    def steps(self, i: int) -> np.ndarray:
        """The nodes of path i from the root on."""
        depth = np.arange(self.lengths[i] + 1)
        return self.on_level(depth, np.full(len(depth), self.ends[i]))


def _keys(path: bytes) -> list[bytes]:
    """A key for each prefix of a path, the empty one too."""
    state = blake2b(digest_size=16)
    out = [state.digest()]
    for k in range(0, len(path), 16):
        state.update(path[k : k + 16])
        out.append(state.digest())
    return out


NODES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
SPINES = pa.schema([("path", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("sizes", "low", "n", "kids", "leaves", "saved"))])
ENDS = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_ALL = pa.schema([*NODES, *SPINES, *ENDS])
_DDL = "conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path binary, sizes array<long>, low array<long>, n array<long>, kids array<long>, leaves array<long>, saved array<long>, key binary, first long, ids string"


def _rows(columns: dict[str, object], n: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type, from_pandas=False) if f.name in columns else pa.nulls(n, f.type) for f in _ALL], schema=_ALL)


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _shard(ids: np.ndarray, path: list[bytes], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The settled nodes of a shard, its spines, and the ids that end on these."""
    lengths = np.array([len(p) // 16 for p in path], np.int64)
    flat = np.concatenate([*sizes, np.zeros(0, np.int64)])
    t = Trie(np.frombuffer(b"".join(path), np.uint64).reshape(-1, 2), lengths)
    size = np.append([0], flat[t.origin[1:]])
    begin, end = np.searchsorted(t.ends, np.arange(len(size))), np.searchsorted(t.ends, np.arange(len(size)), side="right")
    n = t.below(end - begin)
    low, kids = t.least(ids), np.bincount(t.parent[1:], minlength=len(size))
    spine = t.close >= len(t.excess) - (lengths[-1] + 1)
    spine[: lengths[0] + 1] = True
    first, last = np.arange(lengths[0] + 1), t.steps(len(path) - 1)
    key = {int(v): k for nodes, p in ((first, path[0]), (last, path[-1])) for v, k in zip(nodes, _keys(p), strict=True)}
    saved = t.below(np.where(spine, 0, (n - 1) * size))
    own = np.flatnonzero(~spine)
    under = spine[t.parent[own]]
    if len(own):
        hashes = [sha256(_joined(ids[a:b]).encode()).hexdigest() if b > a else NOBODY for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True)]
        parents = t.parent[own]
        yield _rows({
            "conv_id": low[own], "depth": t.depth[own], "n_convs": n[own], "n_children": kids[own], "n_leaves": t.leaves[own], "saved_tokens": saved[own], "ends_sha256": hashes,
            "parent_conv_id": pa.array(low[parents], pa.int64(), mask=under), "parent_key": [key[v] if u else None for v, u in zip(parents.tolist(), under.tolist(), strict=True)],
        }, len(own))
    beside = np.bincount(t.parent[own], minlength=len(size))
    leaves = t.below((kids == 0) & ~spine)
    told, parts = np.zeros(len(size), bool), []
    for i, nodes in ((0, first), (len(path) - 1, last))[: len(path)]:
        new = ~told[nodes]  # what both spines share is told once
        told[nodes] = True
        parts.append((path[i], sizes[i], np.where(new, low[nodes], np.iinfo(np.int64).max), *(np.where(new, x[nodes], 0) for x in (n, beside, leaves, saved))))
    yield _rows(dict(zip(SPINES.names, zip(*parts, strict=True), strict=True)), len(parts))
    runs = [(key[v], int(ids[a]), _joined(ids[a : min(a + RUN, end[v])])) for v in np.flatnonzero(spine).tolist() for a in range(begin[v], end[v], RUN)]
    if runs:
        yield _rows(dict(zip(ENDS.names, zip(*runs, strict=True), strict=True)), len(runs))


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows of conv_id, path, sizes into shards of so many turns."""
    ids: list[int] = []
    path: list[bytes] = []
    sizes: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for i, p, s in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], strict=True):
            if ids and held + len(p) // 16 + 1 > most:
                yield from _shard(np.array(ids, np.int64), path, sizes)
                ids, path, sizes, held = [], [], [], 0
            ids.append(i)
            path.append(p)
            sizes.append(s.values.to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(p) // 16 + 1
    if ids:
        yield from _shard(np.array(ids, np.int64), path, sizes)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of all spines, from the parts that shards tell: a trie of the spines."""
    rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[0])
    if not rows:
        return
    lengths = np.array([len(r[0]) // 16 for r in rows], np.int64)
    t = Trie(np.frombuffer(b"".join(r[0] for r in rows), np.uint64).reshape(-1, 2), lengths)
    flat = np.concatenate([np.array(r[1], np.int64) for r in rows] + [np.zeros(0, np.int64)])
    size = np.append([0], flat[t.origin[1:]])
    path = np.repeat(np.arange(len(rows)), lengths + 1)
    depth = np.arange(len(path)) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1)
    node = t.on_level(depth, t.ends[path])
    low = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(low, node, np.concatenate([np.array(r[2], np.int64) for r in rows]))
    n, kids, leaves, saved = (np.zeros(len(size), np.int64) for _ in range(4))
    for k, total in enumerate((n, kids, leaves, saved)):
        np.add.at(total, node, np.concatenate([np.array(r[3 + k], np.int64) for r in rows]))
    kids += np.bincount(t.parent[1:], minlength=len(size))
    leaves += t.below(kids == 0)
    saved += t.below((n - 1) * size)
    states, keys = [blake2b(digest_size=16)], [blake2b(digest_size=16).digest()]
    for (whole, *_), common in zip(rows, t.common.tolist(), strict=True):
        del states[common + 1 :]
        for k in range(16 * common, len(whole), 16):
            states.append(states[-1].copy())
            states[-1].update(whole[k : k + 16])
            keys.append(states[-1].digest())
    above = pa.array(low[np.maximum(t.parent, 0)], pa.int64(), mask=t.parent < 0)
    yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(low), pa.array(t.depth), above, pa.array(n), pa.array(kids), pa.array(leaves), pa.array(saved)], names=["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 from rows of key, first, ids in this order: a key's ids stream by."""
    rows = (r for batch in batches for r in zip(batch[0].to_pylist(), batch[2].to_pylist(), strict=True))
    for key, parts in itertools.groupby(rows, key=lambda r: r[0]):
        state = sha256(next(parts)[1].encode())
        for _, ids in parts:
            state.update(b"," + ids.encode())
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def nodes(known: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node of the trie of conv_id, said."""
    return settled(lambda: _nodes(known, shard))


def _nodes(known: DataFrame, shard: int) -> DataFrame:
    small_batches(known.sparkSession)
    one: Column = F.unhex(F.array_join(F.transform("said", lambda x: F.hex(x["digest"])), ""))
    flat = materialise(known.select("conv_id", one.alias("path"), F.transform("said", lambda x: x["size"]).alias("sizes")))
    ordered = flat.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = materialise(ordered.mapInArrow(lambda batches: _shards(batches, shard), _DDL))
    spines = found.filter("path is not null").select(*SPINES.names).coalesce(1)
    merged = materialise(spines.mapInArrow(_merged, "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"))
    ends = found.filter("first is not null").select(*ENDS.names).repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own = found.filter("depth is not null")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    under = own.filter("parent_key is not null").join(sized(parents), "parent_key").withColumn("parent_conv_id", F.col("above"))
    on = merged.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))
    return own.filter("parent_key is null").select(*names).union(under.select(*names)).union(on.select(*names))


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the trie of the conversations as they are."""
    return nodes(paths(turns, conv, turn, role, text))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations."""
    return nodes(rebuilt(paths(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = """
with said as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
own as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, md5(strlen(role) || ':' || role || text)) as pos from said),
ids as (
  select conv_id, list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::varchar) + 1), lambda k: ascii(substr(conv_id::varchar, k::int, 1))::bigint)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) as crc
  from (select distinct conv_id from said)),
convs as (select conv_id, conv_id - conv_id % 5 as base, xor(crc, 4294967295) % 9 as h from ids),
parts as (
  select c.conv_id, 0 as own, o.pos, o.role, o.text from convs c join own o on o.conv_id = c.base and o.pos <= c.h
  union all
  select c.conv_id, 1 as own, o.pos, o.role, o.text from convs c join own o on o.conv_id = c.conv_id and o.pos > c.h),
turns as (
  select conv_id, strlen(text) as bytes, md5(strlen(role) || ':' || role || text) as digest, row_number() over (partition by conv_id order by own, pos) as depth from parts),
steps as (
  select conv_id, depth, bytes, md5(string_agg(digest, '') over (partition by conv_id order by depth)) as node from turns
  union all
  select conv_id, 0, 0, '' from convs),
lasts as (select conv_id, max(depth) as depth from steps group by conv_id),
ends as (
  select s.node, sha256(string_agg(s.conv_id::varchar, ',' order by s.conv_id)) as ends_sha256 from steps s join lasts l on s.conv_id = l.conv_id and s.depth = l.depth group by s.node),
nodes as (select node, depth, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes from steps group by node, depth),
above as (
  select n.node, n.depth, n.n_convs, n.bytes, s.node as top, s.depth as top_depth from nodes n join steps s on s.conv_id = n.conv_id and s.depth <= n.depth),
kids as (select top as node, count(*) as n_children from above where top_depth = depth - 1 group by top),
sums as (
  select a.top as node, sum((a.n_convs - 1) * a.bytes) as saved_tokens, count(*) filter (where k.node is null) as n_leaves
  from above a left join kids k on k.node = a.node group by a.top)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from nodes n join sums s on s.node = n.node left join kids k on k.node = n.node left join ends e on e.node = n.node
left join above a on a.node = n.node and a.top_depth = n.depth - 1 left join nodes p on p.node = a.top
"""

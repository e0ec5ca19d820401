"""Near-duplicates by HyperMinHash sketches.

Two documents link when the Jaccard similarity of their sets of five-word shingles is 0.85 or more; the result is one row a
document with the component that links hold together.

Plan. (1) One pass over the texts gives each its set's fingerprint and a sketch: the set's hashes fall into BUCKETS buckets,
and a bucket keeps of its least hash the number of leading zeros (6 bits) and the MANTISSA bits behind the first one. Empty
buckets take the register of a bucket chosen by hash, the same for all sets. Rows with equal sets are one class. (2) Every BAND
registers make a band, 64 bits that are compared as they are. Classes that share a band are candidates: at 0.85 a pair misses all
32 bands once in 2e10 pairs. (3) A pair's registers give the collision-corrected Jaccard estimate; pairs under ESTIMATE, eight
standard deviations below 0.85, go. (4) The rest is verified on full sets, read by hash of whole words.

A list of classes with one band isn't expanded: its least member is tried against the others; lists whose members still
lie in several components get a second try with another member, and what remains then is cut into blocks of BLOCK
members. Two blocks meet in one task: by sketches for the members that have a likely partner of another component (in the first band that the
two share), then these alone by whole sets, where links enough to join their components come out. So a
hot list is dealt over many tasks, its pairs are never rows, and no link between components is lost.

Scale. One pass over the texts for sketches (256 bytes a document), one shuffle of 32 bands of 8 bytes a class; sets are made and shuffled
for candidates only.

Defined results are those of jaccard: a null or empty text, or one of separators only, has no shingles and links with nothing;
fewer than five words are one shingle; rows that share an id are one document with the text that sorts first, and each
gets its result; null ids come back with a null component, no shingles, and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, settled, sized, small_batches, table
from .jaccard import _mix, _ordered, _unplanes, components, sets_of, shingle_sets, verified

PERCENT = 85
BUCKETS = 128
#: Bits of a register behind its leading zeros.
MANTISSA = 10
#: Registers of a band: four of 16 bits are one 64-bit number.
BAND = 4
#: Pairs of a lower estimate aren't verified; the estimate's standard deviation at 0.85 is 0.032.
ESTIMATE = 0.6
#: Sets of fewer shingles link with no other set: 5 of 6 is less than 0.85.
SMALLEST = 6
#: Members of a list's block in the last try, and hashes of their sets, about.
BLOCK, HASHES = 512, 2_000_000
_SHIFT = np.uint64(64 - (BUCKETS - 1).bit_length())
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << _SHIFT


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BUCKETS registers for each sorted set of hashes; sets without hashes have zeros."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    filled = np.zeros((len(sets), BUCKETS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, _EDGES)
        filled[i] = full = np.diff(at, append=len(s)) > 0
        least = s[at[full]] << (np.uint64(64) - _SHIFT)  # what follows the bucket's bits
        zeros = 53 - np.frexp((least >> np.uint64(11)).astype(float))[1].astype(np.int64)
        zeros = np.minimum(zeros, int(_SHIFT) - MANTISSA - 1)
        behind = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out[i, full] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | behind.astype(np.uint16)
    some = filled.any(axis=1)
    row, bucket = np.nonzero(~filled & some[:, None])
    known, step = out.copy(), 0
    while len(row):
        step += 1
        source = (_mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(step * BUCKETS)) % np.uint64(BUCKETS)).astype(np.int64)[bucket]
        hit = filled[row, source]
        out[row[hit], bucket[hit]] = known[row[hit], source[hit]]
        row, bucket = row[~hit], bucket[~hit]
    return out


@cache
def _chance(quarters_a: int, quarters_b: int) -> float:
    """The chance that a bucket's registers agree for two sets without common hashes, of 2 ** (quarters / 4) hashes each."""
    a, b = (2 ** (q / 4) / BUCKETS for q in (quarters_a, quarters_b))
    zeros = np.arange(int(_SHIFT) - MANTISSA)[:, None]
    low = (0.5 ** (zeros + 1)) * (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA))
    high = low + 0.5 ** (zeros + 1) / (1 << MANTISSA)
    hit = lambda n: (np.exp(-n * low) - np.exp(-n * high)) / (1 - np.exp(-n))
    return float((hit(a) * hit(b)).sum())


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for agreement by chance. Sets of na and nb hashes; shapes broadcast."""
    agree = (a == b).sum(axis=-1) / BUCKETS
    quarters = [np.round(4 * np.log2(np.maximum(n, 1))).astype(int) for n in np.broadcast_arrays(na, nb)]
    pairs, back = np.unique(np.stack([q.ravel() for q in quarters], axis=1), axis=0, return_inverse=True)
    chance = np.array([_chance(int(x), int(y)) for x, y in pairs])[back].reshape(agree.shape)
    return np.maximum(0, (agree - chance) / (1 - chance))


def sketches(docs: DataFrame) -> DataFrame:
    """id, n (size of the set), fp (its fingerprint), sketch for each row of id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch[1].to_pylist()))
            rows = registers(sets)
            yield pa.record_batch([batch[0], pa.array([len(s) for s in sets], pa.int64()), pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "n", "fp", "sketch"])

    return docs.mapInArrow(run, "id long, n long, fp binary, sketch binary")


def bands(known: DataFrame) -> DataFrame:
    """band, key, id, n: a row for each band of id, n, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = BUCKETS // BAND
            keys = np.frombuffer(b"".join(batch[2].to_pylist()), np.int64)
            ids, sizes = (np.repeat(batch[k].to_numpy(), n) for k in (0, 1))
            yield pa.record_batch([pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows)), pa.array(keys), pa.array(ids), pa.array(sizes)], names=["band", "key", "id", "n"])

    return known.select("id", "n", "sketch").mapInArrow(run, "band int, key long, id long, n long")


def likely(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sketches in id, n, sketch make a similarity of 0.85 possible."""
    side = lambda k: known.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch[k].to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (4, 5))
                mask = pa.array(estimates(sa, sb, batch[2].to_numpy(), batch[3].to_numpy()) >= ESTIMATE)
                yield pa.record_batch([batch[0].filter(mask), batch[1].filter(mask)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _pairs_of_blocks(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of a meeting that are compared, and with which: of two blocks the first with the second, of one block each with those behind it."""
    one = own == own.min()
    return (one, ~one) if not one.all() else (one, one)


def _hopeful(rows: pa.Table) -> pa.Table:
    """The members of a meeting that have a likely partner of another component, whose first common band is this one."""
    own, ids, n, component = (rows[c].to_numpy() for c in ("own", "id", "n", "component"))
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
    band = sketch.view(np.int64)
    one, other = _pairs_of_blocks(own)
    keep = np.zeros(len(ids), bool)
    for i in np.flatnonzero(one):
        j = np.flatnonzero(other & (component != component[i]) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])))
        # a pair with several bands in common is for the first of them
        j = j[(band[j] == band[i]).argmax(axis=1) == rows["band"][0].as_py()]
        if len(j) and len(j := j[estimates(sketch[i], sketch[j], n[i], n[j]) >= ESTIMATE]):
            keep[j] = keep[i] = True
    return rows.select(["band", "key", "meeting", "own", "id", "component"]).filter(pa.array(keep))


def _spanning(rows: pa.Table) -> pa.Table:
    """Links between the members of a meeting that are enough to join the components which links of whole sets join."""
    own, ids, n, root = (rows[c].to_numpy() for c in ("own", "id", "n", "component"))
    root, (one, other), out = root.copy(), _pairs_of_blocks(own), [np.zeros((0, 2), np.int64)]
    sets = [_unplanes(x.as_py()) for x in rows["tokens"]]
    # an inverted list for each hash: an i's lists tell what it shares with every other
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    order = np.argsort(number, kind="stable")
    holder, after = np.repeat(np.arange(len(ids)), n)[order], np.cumsum(np.bincount(number))
    for i in np.flatnonzero(one):
        own_numbers = number[ends[i] - n[i] : ends[i]]
        length = after[own_numbers] - np.append([0], after)[own_numbers]
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(after[own_numbers] - length, length)
        shared = np.bincount(holder[at], minlength=len(ids))
        for j in np.flatnonzero(other & (root != root[i]) & (100 * shared >= PERCENT * (n + n[i] - shared))):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append(np.sort(np.array([[ids[i], ids[j]]]), axis=1))
    both = np.concatenate(out)
    return pa.table({"a": both[:, 0], "b": both[:, 1]})


def _remaining(left: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links enough to join what links join of the different components in the lists band, key, id, component; block meets block in one row."""
    rows = left.join(known.select("id", "n", "sketch"), "id")
    sizes = rows.groupBy("band", "key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / HASHES)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    # a member of block x goes to the meetings (x, y) and (y, x) with every block y
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.least("own", y).cast("long") * (1 << 31) + F.greatest("own", y)))
    met = dealt.withColumn("meeting", other).select("band", "key", "meeting", "own", "id", "n", "component", "sketch")
    kind = "band int, key long, meeting long, own int, id long, component long"
    hopeful = materialise(met.groupBy("band", "key", "meeting").applyInArrow(_hopeful, kind))
    sets = sets_of(docs, materialise(hopeful.select("id").distinct()))
    return hopeful.join(sets, "id").groupBy("band", "key", "meeting").applyInArrow(_spanning, "a long, b long").distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (id, n_shingles, class: least id with an equal set), links between classes, components (id, component)."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    first = materialise(sketches(read))
    if not first.groupBy("id").count().filter("count > 1").isEmpty():
        read = read.groupBy("id").agg(F.min("text").alias("text"))
        first = materialise(sketches(read))
    shared = materialise(first.filter("n > 0").groupBy("fp").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("fp", "class"))
    members = materialise(first.select("id", "n", "fp").join(sized(shared), "fp", "left").select("id", "n", F.coalesce("class", "id").alias("class")))
    copies = materialise(members.filter("id <> class").select("id"))
    known = materialise(first.filter(F.col("n") >= SMALLEST).join(sized(copies), "id", "left_anti").select("id", "n", "sketch"))
    banded = bands(known)
    pivots = banded.groupBy("band", "key").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a < last").select("band", "key", "a")
    rows = materialise(banded.join(pivots, ["band", "key"]))
    tried = materialise(rows.filter("a <> id").select("a", F.col("id").alias("b")).distinct())
    links = materialise(verified(read, materialise(likely(tried, known)), PERCENT))
    labels = components(links)
    for last in (False, True):
        own = rows.join(labels, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("component"))
        several = own.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band", "key")
        left = materialise(own.join(several, ["band", "key"], "left_semi"))
        if left.isEmpty():
            break
        if last:
            links = materialise(links.union(_remaining(left, known, read)))
        else:
            other = left.groupBy("band", "key").agg(F.min_by(F.struct("id", "component"), F.xxhash64("key", "id")).alias("x"))
            more = _ordered(left.join(other, ["band", "key"]).filter("component <> x.component").select(F.col("id").alias("a"), F.col("x.id").alias("b")))
            more = materialise(more.join(tried, ["a", "b"], "left_anti"))
            links = materialise(links.union(verified(read, materialise(likely(more, known)), PERCENT)))
        labels = components(links)
    return members.select("id", F.col("n").alias("n_shingles"), "class"), links, labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept (the document has its component's least id) for each row of docs."""

    def make() -> DataFrame:
        members, _, labels = link(docs, key, text)
        return members.join(sized(labels.withColumnRenamed("id", "class")), "class", "left").select("id", "n_shingles", F.coalesce("component", "class").alias("component_id"))

    known = settled(make)
    ids = docs.select(F.col(key).alias(key))
    out = ids.join(known, ids[key] == known["id"], "left").select(key, F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every two sets that share a shingle are compared, links are followed to their ends: for small tables.
LINKS_SQL = r"""
with recursive texts as (select doc_id, min(text) as text from documents where doc_id is not null group by doc_id),
words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from texts),
sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, (len(w) - 3)::bigint), lambda k: list_aggregate(w[k:k + 4], 'string_agg', ' ')))
    when len(w) > 0 then [list_aggregate(w, 'string_agg', ' ')] else [] end as s from words),
shingles as (select doc_id, unnest(s) as shingle from sets),
shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as n from shingles x join shingles y on x.shingle = y.shingle and x.doc_id < y.doc_id group by 1, 2),
pairs as (
  select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= {percent} * (len(x.s) + len(y.s) - n)),
links as (select a, b from pairs union all select b, a from pairs),
reach(doc_id, other) as (
  select doc_id, doc_id from texts union select r.doc_id, l.b from reach r join links l on l.a = r.other),
classes as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(len(s.s), 0)::bigint as n_shingles, c.component_id{more}
from documents d left join sets s on s.doc_id = d.doc_id left join classes c on c.doc_id = d.doc_id
"""
ORACLE_SQL = LINKS_SQL.format(percent=PERCENT, more=", d.doc_id is not distinct from c.component_id as kept")

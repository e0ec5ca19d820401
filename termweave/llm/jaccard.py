"""N-gram Jaccard join with token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of five-word shingles is 0.8 or more. The join
is exact and returns classes of linked documents.

Plan. (1) Documents with equal sets are one class from the start. (2) Shingles are counted over all classes;
those in more than RARE of them are frequent. (3) All sets share one order, rare shingles first, then
frequent ones by how frequent they are. A set's prefix is extended until two sets that link must share, inside both prefixes, several rare
shingles or a pair of frequent ones of one token class: with m_c frequent tokens of class c in the prefix and r rare ones, the
guarantee needs max(0, r - (k - 1)) + sum of max(0, m_c - 1) >= size - ceil(0.8 size) + 1, where k grows
with the size: then either k rare shingles are shared or a pair of frequent ones. The bound is
made for each band of partners' sizes by itself, with the overlap that the two sizes take, and token
classes are cut by hash, as many as fit the two bands.
(4) Rare shingles are posted alone, in lists of RARE at most, and shared ones counted by pair; frequent
ones are posted as pairs. (5) Candidates are
verified on whole sets. A list of pairs isn't expanded: its least member is tried against the rest; lists
whose members still lie in several components get a second try with another member for each list, and what
then remains is tried pairwise between components only. Pairs inside a component can't change it.

Scale. Shingles are 64-bit hashes. Counting and rare postings move as packed arrays, counted once for each
task before the shuffle, so a shingle of a third of all documents costs one entry a task. Only frequent
shingles, at most HEAVY of them, are broadcast: if there are more, RARE doubles until they fit, which
changes the cost and not the result. Texts are shuffled only when the ids to read are too many to broadcast.

Defined results: a null or empty text, or one of separators only, has no shingles and links with nothing;
fewer than five words are one shingle; null ids come back with a null component; rows that share an id are
one document with the text that sorts first, and each gets its result; words are split at ASCII white
space and A-Z are lower-cased, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, settled, sized, small_batches, table

WORDS = 5
#: Sets of fewer shingles than this link with no other set: 3 of 4 is less than 0.8.
SMALLEST = 4
#: A shingle in more classes than this is frequent.
RARE = 16
#: Frequent shingles that are broadcast at most (9 bytes each).
HEAVY = 2_000_000
#: Shingles, or postings, that a task packs at a time.
PACK = 1_000_000
#: Shingles, repeated ones too, that one bucket of the counts gets, about; the number of buckets follows from it.
BUCKET = 1_000_000
#: Bytes of text hashed at a time.
SEGMENT = 1 << 18

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _PLACES[0]
    x = (x ^ (x >> np.uint64(27))) * _PLACES[1]
    return x ^ (x >> np.uint64(31))


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LETTERS[65:91] = _LETTERS[97:123]
_powers: list[np.ndarray] = []


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and hashes of the words in bytes that start and end at separators; a hash depends on the word alone."""
    if not _powers or len(_powers[0]) < len(data):
        n = max(len(data), SEGMENT + 1)
        _powers[:] = [np.cumprod(np.full(n, p, np.uint64)) for p in (_ODD, _INVERSE)]
    blank = _SEPARATORS[data]
    edges = np.diff(blank.astype(np.int8), prepend=1, append=1)
    begins, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    summed = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _powers[0][: len(data)], out=summed[1:])
    return begins, _mix((summed[ends] - summed[begins]) * _powers[1][begins])


def _words(text: bytes) -> np.ndarray:
    """Word hashes of one text of any length, a segment at a time."""
    out, at = [], 0
    while at < len(text):
        end = min(at + SEGMENT, len(text))
        while end < len(text) and not _SEPARATORS[text[end]]:
            end += 1
        out.append(_word_hashes(np.frombuffer(text, np.uint8, end - at, at))[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _shingles(words: np.ndarray) -> np.ndarray:
    """The set of shingles, in order of hash."""
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        return _mix((words * _PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = np.zeros(n - WORDS + 1, np.uint64)
    for k in range(WORDS):
        total += words[k : n - WORDS + 1 + k] * _PLACES[k]
    return np.unique(_mix(total))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text its set of shingles; short texts are hashed together."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    at = 0
    while at < len(raw):
        group, held = [], 0
        while at < len(raw) and (not group or held + len(raw[at]) < SEGMENT):
            held += len(raw[at]) + 1
            group.append(raw[at])
            at += 1
        if len(group) == 1:
            yield _shingles(_words(group[0]))
            continue
        begins, words = _word_hashes(np.frombuffer(b" ".join(group), np.uint8))
        bounds = np.searchsorted(begins, np.cumsum([0, *(len(x) + 1 for x in group)]))
        yield from (_shingles(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    return zip(batch[0].to_pylist(), shingle_sets(batch[1].to_pylist()), strict=True)


def _planes(x: np.ndarray) -> bytes:
    """Sorted numbers byte by byte, so that the shuffle's compression finds the high bytes alike."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _by_bucket(tokens: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Sorted tokens cut into n ranges of hashes."""
    bounds = np.searchsorted(tokens, np.array([(k << 64) // n for k in range(1, n)], np.uint64)) if n > 1 else []
    edges = [0, *bounds, len(tokens)]
    return ((k, slice(a, b)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a)


def classes(docs: DataFrame) -> DataFrame:
    """id, n (size of the set), fp (the set's fingerprint) for each row of id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), blake2b(s.tobytes(), digest_size=16).digest()) for _, s in _sets(batch)]
            yield pa.record_batch([batch[0], pa.array([n for n, _ in sets], pa.int64()), pa.array([f for _, f in sets], pa.binary())], names=["id", "n", "fp"])

    return docs.mapInArrow(run, "id long, n long, fp binary")


def counts(docs: DataFrame, least: int, buckets: int) -> DataFrame:
    """token, n: shingles in more than least of the rows of id, text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            rows = [(k, _planes(tokens[s]), n[s].astype(np.uint32).tobytes()) for k, s in _by_bucket(tokens, buckets)]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "tokens", "n"])

        size = 0
        for batch in batches:
            for _, s in _sets(batch):
                if len(s) >= SMALLEST:
                    held.append(s)
                    size += len(s)
                if size >= PACK:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([_unplanes(x) for x in rows["tokens"]])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["n"]])
        order = np.argsort(tokens, kind="stable")
        tokens, n = tokens[order], n[order].astype(np.int64)
        begins = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
        summed = np.add.reduceat(n, begins)
        many = summed > least
        return pd.DataFrame({"token": tokens[begins][many].view(np.int64), "n": summed[many]})

    return docs.mapInArrow(pack, "bucket int, tokens binary, n binary").groupBy("bucket").applyInPandas(total, "token long, n long")


def needed(n: int) -> int:
    """Tokens by which a prefix must exceed what two linked sets may lack: n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def shared_rare(n: int, rare: int) -> int:
    """Rare tokens that a set of n must share with another for a candidate, if no pair of frequent ones does.

    More than one only where the set has rare tokens to spare: each one asked for takes a rare token from what the
    prefix covers, and a prefix of rare tokens alone posts no pairs.
    """
    return max(1, min(4, n // 16, rare - needed(n) + 1))


@cache
def _size_steps(upto: int) -> np.ndarray:
    """Least sizes of the bands that sizes fall into: every size by itself at first, then steps of a twenty-fifth."""
    out = [SMALLEST]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, out[-1] * 26 // 25))
    return np.array(out)


def partners(n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """For each band of sizes that a set of n can link with: the two bands in order, the set's side of them (0 if they are
    one band, 1 for the lower, 2 for the upper), the tokens by which the prefix must exceed what the set may lack of any
    such partner, and the number of token classes for the two bands.

    An overlap of ceil(4/9 (n + m)) is what a similarity of 0.8 takes for sizes n and m.
    """
    steps = _size_steps(1 << (2 * n).bit_length())
    at = lambda size: int(np.searchsorted(steps, size, side="right")) - 1
    own = at(n)
    for other in range(at(-(-4 * n // 5)), at(5 * n // 4) + 1):
        least = max(int(steps[other]), -(-4 * n // 5))
        small, large = (int(steps[k]) for k in sorted((own, other)))
        yield min(own, other), max(own, other), (own != other) + (own > other), n + (-4 * (n + least) // 9) + 1, max(1, (large + (-4 * (small + large) // 9) + 1) // 2)


def combinations(heavy: np.ndarray, rare: int, n: int) -> np.ndarray:
    """Signatures of pairs of frequent tokens, of one token class each, in the prefixes of a set of n with so many rare tokens.

    The two lowest bits hold the side: sets of one band meet on side 0, those of two bands on sides 1 and 2.
    """
    out, k = [], shared_rare(n, rare)
    for low, high, side, lack, cut in partners(n):
        # a partner may ask for fewer shared rare tokens, which makes more candidates and loses none
        need = lack - max(0, rare - (k - 1))
        if need <= 0:
            continue
        pair = np.uint64(low * 100_003 + high)
        salt = np.uint64((low * 100_003 + high) * int(_ODD) % (1 << 64))
        group = (_mix(heavy ^ salt) % np.uint64(cut)).astype(np.int64)
        # tokens are in the common order; a token counts once its class has one before it
        order = np.argsort(group, kind="stable")
        seen = np.zeros(len(heavy), bool)
        seen[order[1:]] = group[order][1:] == group[order][:-1]
        enough = np.searchsorted(np.cumsum(seen), need) + 1  # the whole set when it never is: then every pair is posted
        order = order[order < enough]
        g, t = group[order], heavy[order]
        for d in range(1, len(g)):
            same = g[d:] == g[:-d]
            if not same.any():
                break
            out.append(_mix(t[:-d][same] * _PLACES[2] + t[d:][same] * _PLACES[3] + pair) & ~np.uint64(3) | np.uint64(side))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def frequent_tokens(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in order, and how frequent each is, in quarters of an octave, from rows of token, n."""
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (4 * np.log2(rows["n"].to_numpy(float))).astype(np.uint8)[order]


def postings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Two kinds of rows: bucket, tokens, ids (packed postings of rare tokens), or id, n, pairs (signatures of a set with frequent tokens in its prefix)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    names = ["bucket", "tokens", "ids", "least", "id", "n", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (heavy_tokens, how_frequent), held, rows, size, n_pairs = shared.value, [], [], 0, 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def packed() -> list[tuple]:
            tokens, lengths = np.concatenate([t for _, _, t in held]), [len(t) for _, _, t in held]
            ids = np.repeat(np.array([i for i, _, _ in held], np.int64), lengths)
            least = np.repeat(np.array([k for _, k, _ in held], np.uint8), lengths)
            held.clear()
            order = np.argsort(tokens, kind="stable")
            tokens, ids, least = tokens[order], ids[order], least[order]
            return [(k, _planes(tokens[s]), _planes(ids[s]), least[s].tobytes(), None, None, None) for k, s in _by_bucket(tokens, buckets)]

        for batch in batches:
            for i, s in _sets(batch):
                n = len(s)
                if n < SMALLEST:
                    continue
                lack, known, at = needed(n), np.zeros(n, bool), np.zeros(n, np.int64)
                if len(heavy_tokens):
                    at = np.minimum(np.searchsorted(heavy_tokens, s), len(heavy_tokens) - 1)
                    known = heavy_tokens[at] == s
                rare = s[~known]
                k = shared_rare(n, len(rare))
                rare = rare[: lack + k - 1]
                if len(rare):
                    held.append((i, k, rare))
                    size += len(rare)
                if len(rare) < lack + k - 1 and len(pairs := combinations(s[known][np.argsort(how_frequent[at[known]], kind="stable")], len(rare), n)):
                    rows.append((None, None, None, None, i, n, pairs.view(np.int64)))
                    n_pairs += len(pairs)
            if size >= PACK:
                rows, size = rows + packed(), 0
            if rows and (not size or n_pairs >= PACK // 4):
                yield batch_of(rows)
                rows, n_pairs = [], 0
        rows += packed() if held else []
        if rows:
            yield batch_of(rows)

    return docs.mapInArrow(run, "bucket int, tokens binary, ids binary, least binary, id long, n long, pairs array<long>")


def rare_pairs(posted: DataFrame) -> DataFrame:
    """a < b: ids that share as many rare tokens as the smaller demand of the two; a list has as many ids as a rare token has classes at most."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([_unplanes(x) for x in rows["tokens"]])
        ids = np.concatenate([_unplanes(x) for x in rows["ids"]]).view(np.int64)
        least = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["least"]])
        order = np.argsort(tokens, kind="stable")
        tokens, ids, least = tokens[order], ids[order], least[order]
        out = [np.zeros((0, 3), np.int64)]
        for d in range(1, len(tokens)):
            same = np.flatnonzero(tokens[d:] == tokens[:-d])
            if not len(same):
                break
            both = np.sort(np.stack([ids[same], ids[same + d]], axis=1), axis=1)
            out.append(np.column_stack([both, np.minimum(least[same], least[same + d])]))
        both, n = np.unique(np.concatenate(out), axis=0, return_counts=True)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "least": both[:, 2], "shared": n})

    lists = posted.filter("bucket is not null").select("bucket", "tokens", "ids", "least")
    found = lists.groupBy("bucket").applyInPandas(pairs, "a long, b long, least long, shared long")
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least")).filter("shared >= least").select("a", "b")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n, tokens (packed) of the sets of rows of id, text whose ids are among ids (a written table of distinct ones)."""
    texts = docs.join(sized(ids), "id", "left_semi")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in _sets(batch)]
            yield pa.record_batch([batch[0], pa.array([len(s) for s in sets], pa.int64()), pa.array([_planes(s) for s in sets], pa.binary())], names=["id", "n", "tokens"])

    return materialise(texts.select("id", "text").mapInArrow(packed, "id long, n long, tokens binary"))


def verified(docs: DataFrame, pairs: DataFrame, percent: int = 80) -> DataFrame:
    """Those of the pairs a, b (a written table) whose sets reach the similarity, in percent. A pair's whole sets meet in its row."""
    sets = sets_of(docs, materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    sizes = sets.select("id", "n")
    fit = pairs.join(sizes.toDF("b", "nb"), "b").join(sizes.toDF("a", "na"), "a").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    met = fit.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b").join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").select("a", "b", "ta", "tb")

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for ta, tb in zip(batch[2], batch[3], strict=True):
                ta, tb = ta.as_py(), _unplanes(tb.as_py())
                if ta != last[0]:
                    last = (ta, _unplanes(ta))
                a = last[1]
                both = np.concatenate([a, tb])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(a) + len(tb) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch[0].filter(mask), batch[1].filter(mask)], names=["a", "b"])

    return met.mapInArrow(holds, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component: the least id that links lead to, for each id of links a, b (a written table).

    Labels fall to the least among neighbours, then follow the label's own label; both are joins by id.
    """
    edges = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = materialise(edges)
    labels = materialise(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("id"), "component"))
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        fallen = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("next"))
        new = materialise(fallen.join(jump, "to", "left").select("id", "old", F.least("to", "next").alias("component")))
        labels = new.select("id", "component")
        if new.filter("component <> old").isEmpty():
            return labels


def _facing(value: Column, best: Callable[[Column], Column] = F.min) -> Column:
    """Of a list's rows, the best value of each side: of side 0, of 1 and of 2."""
    return F.struct(*[best(F.when(F.col("side") == k, value)).alias(f"s{k}") for k in range(3)])


def _opposite(struct: str) -> Column:
    """What _facing holds for a row's partners: side 0 meets itself, 1 and 2 each other."""
    return F.when(F.col("side") == 0, F.col(f"{struct}.s0")).when(F.col("side") == 1, F.col(f"{struct}.s2")).otherwise(F.col(f"{struct}.s1"))


def _unsettled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, side, id, n, component of the lists in which partners lie in several components."""
    own = rows.join(labels, "id", "left").select("sig", "side", "id", "n", F.coalesce("component", "id").alias("component"))
    several = own.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.countDistinct("side").alias("sides"), F.max("side").alias("last"))
    return own.join(several.filter("low < high and (last = 0 or sides = 2)").select("sig"), "sig", "left_semi")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (id, n_shingles, class: least id with an equal set), links between classes that make the components, components (id, component)."""
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    first = materialise(classes(read))
    if not first.groupBy("id").count().filter("count > 1").isEmpty():
        read = read.groupBy("id").agg(F.min("text").alias("text"))
        first = materialise(classes(read))
    # only sets that several rows have need a class; the rows of one set never meet but in partial counts
    shared = materialise(first.filter("n > 0").groupBy("fp").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("fp", "class"))
    members = materialise(first.join(sized(shared), "fp", "left").select("id", "n", F.coalesce("class", "id").alias("class")))
    copies = materialise(members.filter((F.col("id") != F.col("class")) | (F.col("n") < SMALLEST)).select("id"))
    unique = read.join(sized(copies), "id", "left_anti").select("id", "text")
    total = members.filter(F.col("id") == F.col("class")).agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET + 1)
    common = materialise(counts(unique, RARE, buckets))
    rare = RARE
    while common.filter(F.col("n") > rare).limit(HEAVY + 1).count() > HEAVY:
        rare *= 2
    frequent = common.filter(F.col("n") > rare).toPandas()
    posted = materialise(postings(unique, frequent_tokens(frequent), buckets))
    pairs = posted.filter("id is not null").select("id", "n", F.explode("pairs").alias("pair"))
    rows = pairs.select("id", "n", F.expr("pair & ~3L").alias("sig"), F.expr("pair & 3L").alias("side"))
    pivots = rows.groupBy("sig").agg(_facing(F.col("id")).alias("p"), F.min("id").alias("low"), F.max("id").alias("high"))
    star = rows.join(pivots.filter("low < high and (p.s0 is not null or p.s1 is not null and p.s2 is not null)").select("sig", "p"), "sig").select(_opposite("p").alias("a"), F.col("id").alias("b"))
    tried = materialise(rare_pairs(posted).union(_ordered(star.filter("a <> b"))).distinct())
    links = materialise(verified(read, tried))
    labels = components(links)
    for last in (False, True):
        left = materialise(_unsettled(rows, labels))
        if left.isEmpty():
            break
        if last:
            met = F.expr("l.side = 0 and r.side = 0 and l.id < r.id or l.side = 1 and r.side = 2")
            more = left.alias("l").join(left.alias("r"), "sig").filter(met).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.struct("l.n", "l.component").alias("l"), F.struct("r.n", "r.component").alias("r"))
        else:
            other = left.groupBy("sig").agg(_facing(F.struct("id", "n", "component"), lambda x: F.min_by(x, F.xxhash64("sig", "id"))).alias("x"))
            more = left.join(other, "sig").select(F.col("id").alias("a"), _opposite("x").alias("r"), F.struct("n", "component").alias("l")).select("a", "r.id", "l", "r").withColumnRenamed("id", "b")
        more = _ordered(more.filter((F.col("l.component") != F.col("r.component")) & (5 * F.least("l.n", "r.n") >= 4 * F.greatest("l.n", "r.n"))))
        more = materialise(more.join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        links = materialise(links.union(verified(read, more)))
        tried = tried.union(more)
        labels = components(links)
    return members.select("id", F.col("n").alias("n_shingles"), "class"), links, labels


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id for each row of docs."""
    known = settled(lambda: _known(docs, key, text))
    ids = docs.select(F.col(key).alias(key))
    return ids.join(known, ids[key] == known["id"], "left").select(key, F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "component_id")


def _known(docs: DataFrame, key: str, text: str) -> DataFrame:
    members, _, labels = link(docs, key, text)
    return members.join(sized(labels.withColumnRenamed("id", "class")), "class", "left").select("id", "n_shingles", F.coalesce("component", "class").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that have the least key of their component, all columns; rows without a key stay."""
    gone = settled(lambda: join(docs.filter(F.col(key).isNotNull()), key, text).filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("__gone")).distinct())
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    return docs.select(row, F.col(key).alias("__key")).join(sized(gone), F.col("__key") == F.col("__gone"), "left_anti").select("__row.*")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))

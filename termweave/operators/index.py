"""Index tables: positional tokens, postings, statistics, bigrams, covariates. Each is one shuffle at most."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import tokens as token_array


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos, term: the base relation."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(token_array(F.col(text))).alias("pos", "term"))


def doc_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, len without a shuffle."""
    return docs.select(F.col(key).alias("doc_id"), F.size(token_array(F.col(text))).cast("long").alias("len"))


def postings(toks: DataFrame) -> DataFrame:
    """term, doc_id, tf, positions (in order). A list is one term of one document, so it is bounded by the document."""
    return toks.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


#: Terms that a task works on at once.
TERMS_AT_ONCE = 500_000


def slices_of(batch: pa.RecordBatch, column: int, most: int = TERMS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about most elements of a column of lists, or bytes of a column of texts; one row at least."""
    length = pc.binary_length if pa.types.is_string(batch[column].type) else pc.list_value_length
    ends = np.cumsum(pc.fill_null(length(batch[column]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def places_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in its list of each element of a column of lists."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def document_postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """postings() of tokens() of texts, made inside the row: no token is shuffled. Rows of one key aren't joined."""
    rows = docs.select(F.col(key).alias("doc_id"), token_array(F.col(text)).alias("__t"))
    schema = StructType([StructField("term", StringType()), rows.schema["doc_id"], StructField("tf", LongType()), StructField("positions", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_of(whole, 1):
                row, place = places_of(batch[1])
                if not len(row):
                    continue
                coded = batch[1].flatten().dictionary_encode()
                unit = row * len(coded.dictionary) + coded.indices.to_numpy()
                order = np.argsort(unit, kind="stable")
                first = np.flatnonzero(np.diff(unit[order], prepend=-1))
                ends = np.append(first, len(order))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
                at = order[first]
                yield pa.record_batch([coded.dictionary.take(coded.indices.take(pa.array(at))), batch[0].take(pa.array(row[at])), pa.array(np.diff(ends)), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def written_postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """postings() of texts, written to the shared folder; those of rows that share a key are joined."""
    own = document_postings(docs, key, text)
    if docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        own = own.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return cut(own)


def counts(toks: DataFrame) -> DataFrame:
    return toks.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(toks: DataFrame) -> DataFrame:
    """term, cf, df: two partial aggregations, the first by term and document."""
    return counts(toks).groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def document_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, cf, df in one shuffle of a row for each term and task: a document's tokens are told twice inside the row, all of them for cf and each once for df."""
    both = docs.select(token_array(F.col(text)).alias("__t")).select(F.posexplode(F.array("__t", F.array_distinct("__t"))).alias("once", "__t"))
    return both.select("once", F.explode("__t").alias("term")).groupBy("term").agg(F.count_if(F.col("once") == 0).alias("cf"), F.count_if(F.col("once") == 1).alias("df"))


def collection_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """n_docs, coll_len: one row."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(token_array(F.col(text))).cast("long")).alias("coll_len"))


def bigrams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t1, t2 for each pair of neighbours; made inside the row, without a window or a join."""
    t = F.col("__t")
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("t1"), b.alias("t2")))
    return docs.select(F.col(key).alias("doc_id"), token_array(F.col(text)).alias("__t")).select("doc_id", F.inline(pairs))


def unordered_pairs(docs: DataFrame, width: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t_lo, t_hi for each two different terms less than width apart; also made inside the row."""
    t = F.col("__t")
    near = F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.lit(width - 1)), lambda y: F.struct(F.least(x, y).alias("t_lo"), F.greatest(x, y).alias("t_hi")))))
    return docs.select(F.col(key).alias("doc_id"), token_array(F.col(text)).alias("__t")).select("doc_id", F.inline(near)).filter("t_lo <> t_hi")


#: Pairs that are counted together before a unit of them reports, and candidates that are broadcast at most (8 bytes each).
UNIT, CANDIDATES = 4_000_000, 2_000_000
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _pairs_of(terms: pa.Array, width: int, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of pairs less than width apart and the places of their terms, a distance at a time, from lists of hashed terms; of unordered pairs those of two different terms."""
    flat = terms.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(terms)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
    for d in range(1, width):
        x, y = flat[:-d], flat[d:]
        at = np.flatnonzero((row[:-d] == row[d:]) & (ordered | (x != y)))
        x, y = x[at], y[at]
        first, last = (x, y) if ordered else (np.minimum(x, y), np.maximum(x, y))
        key = first * _SPREAD[0] + (last ^ (last >> np.uint64(29))) * _SPREAD[1]
        yield key ^ (key >> np.uint64(32)), at, at + d


_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 29, 32))


def run_hashes(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of every run of n of hashed terms, each of the bits of h (n or more terms) mixed twice, by other numbers."""
    m = len(h) - (n - 1)
    key, check = np.full(m, n, np.uint64), np.full(m, ~np.uint64(n), np.uint64)
    for i in range(n):
        x = h[i : i + m]
        key = (key ^ x) * _MIX[0]
        key ^= key >> _MIX[3]
        check = (check + (x ^ (x >> _MIX[2]))) * _MIX[1]
        check ^= check >> _MIX[3]
    return key.view(np.int64), (check >> _MIX[3]).astype(np.uint32).view(np.int32)


def _unit_counts(hashed: DataFrame, keys_of: Callable[[pa.Array], Iterator[tuple]], k: int | None, least: int) -> DataFrame:
    """key, n: for each unit of about UNIT keys its k most frequent ones, or all that come least times or more in it; and a row without a key for the unit itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            # ties at the cut may go: a unit's best only have to give a lower bound
            at = np.argsort(-n, kind="stable")[:k] if k is not None else np.flatnonzero(n >= least)
            head = lambda x: pa.array([x], pa.int64())
            return pa.record_batch([pa.concat_arrays([head(None), pa.array(keys[at].view(np.int64))]), pa.concat_arrays([head(len(keys)), pa.array(n[at], pa.int64())])], names=["key", "n"])

        for batch in (part for whole in batches for part in slices_of(whole, 0)):
            for found in keys_of(batch[0]):
                held.append(found[0])
                size += len(found[0])
                if size >= UNIT:
                    yield report()
                    size = 0
        if size:
            yield report()

    return hashed.mapInArrow(run, "key long, n long")


def _most_frequent(docs: DataFrame, k: int, text: str, keys_of: Callable[[pa.Array], Iterator[tuple]], told: Callable[..., pa.RecordBatch], schema: str, best: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """best of what is counted by name: keys_of tells the keys in lists of hashed terms and where they stand, told their names and counts (schema), best the k most frequent.

    What is counted isn't shuffled. Every unit of about UNIT keys reports its k best, whose sums bound the k-th best count from
    below; a key that reaches the bound has its share of it in some unit, so the keys that have that there are all
    candidates, and only these are counted by name. The second pass may cut its units otherwise; if it has more of them, it is made again with their number. Keys are hashes: two of one key only raise its counts, and
    counting by name parts them again.
    """
    spark = docs.sparkSession
    rows = docs.select(token_array(F.col(text)).alias("__t"))
    # hashes are made once, for both passes; names are told from the texts
    hashed = cut(rows.select(F.transform("__t", lambda x: F.xxhash64(x)).alias("__h")))
    reported = cut(_unit_counts(hashed, keys_of, k, 0))
    units = reported.filter("key is null").count()
    bound = reported.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(k).agg(F.min("n"), F.count(F.lit(1))).first()
    # by name a key's count may be less than by hash, which takes two of one key among the best: the bound then falls
    least = (bound[0] or 0) if bound[1] == k else 0
    while True:
        candidates = cut(_unit_counts(hashed, keys_of, None, max(1, -(-least // max(units, 1)))))
        if (seen := candidates.filter("key is null").count()) > units:
            units = seen
            continue
        wanted = candidates.filter("key is not null").select("key").distinct()
        if wanted.limit(CANDIDATES + 1).count() > CANDIDATES:
            shared = None
        else:
            shared = spark.sparkContext.broadcast(np.sort(wanted.toPandas()["key"].to_numpy(np.int64).view(np.uint64)))

        def named(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices_of(whole, 1)):
                terms = batch[0].flatten()
                for keys, *places in keys_of(batch[1]):
                    if shared is not None and len(keys):
                        known = shared.value
                        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                        places = [x[hit] for x in places]
                    for a in range(0, len(places[0]), 100_000):
                        yield told(terms, *[x[a : a + 100_000] for x in places])

        both = rows.select("__t", F.transform("__t", lambda x: F.xxhash64(x)).alias("__h"))
        top = cut(best(both.mapInArrow(named, schema)))
        last = top.agg(F.min("n"), F.count(F.lit(1))).first()
        reached = last[0] if last[1] == k else 0
        if least <= max(reached, 1):
            return top
        least = reached


def top_pairs(docs: DataFrame, k: int, width: int = 2, ordered: bool = True, text: str = "text") -> DataFrame:
    """first, last, n: the k most frequent pairs of terms less than width apart, ties by terms; unordered pairs are of two different terms, first the lesser. See _most_frequent()."""
    ends = (F.col("x"), F.col("y")) if ordered else (F.least("x", "y"), F.greatest("x", "y"))

    def told(terms: pa.Array, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        a, b = terms.take(pa.array(x)).dictionary_encode(), terms.take(pa.array(y)).dictionary_encode()
        width = max(len(b.dictionary), 1)
        pairs, n = np.unique(a.indices.to_numpy().astype(np.int64) * width + b.indices.to_numpy(), return_counts=True)
        return pa.record_batch([a.dictionary.take(pa.array(pairs // width)), b.dictionary.take(pa.array(pairs % width)), pa.array(n, pa.int64())], names=["x", "y", "n"])

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(ends[0].alias("first"), ends[1].alias("last")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "first", "last").limit(k)

    return _most_frequent(docs, k, text, lambda lists: _pairs_of(lists, width, ordered), told, "x string, y string, n long", best)


def _grams_of(terms: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of runs of 1 to most terms, where they begin and how long they are, a length at a time, from lists of hashed terms."""
    flat, (row, _) = terms.flatten().to_numpy(zero_copy_only=False).view(np.uint64), places_of(terms)
    for n in range(1, min(most, len(flat)) + 1):
        at = np.flatnonzero(row[: len(row) - (n - 1)] == row[n - 1 :])
        yield run_hashes(flat, n)[0].view(np.uint64)[at], at, np.full(len(at), n)


def top_grams(docs: DataFrame, k: int, most: int, text: str = "text") -> DataFrame:
    """size, gram, n: the k most frequent runs of 1 to most terms, ties by length and terms. See _most_frequent()."""

    def told(terms: pa.Array, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        # the runs of one call have one length
        length = int(size[0])
        found = pc.binary_join_element_wise(*[terms.take(pa.array(at + i)) for i in range(length)], " ").value_counts()
        return pa.record_batch([pa.array(np.full(len(found), length, np.int32)), found.field("values"), found.field("counts")], names=["size", "gram", "n"])

    def best(grams: DataFrame) -> DataFrame:
        return grams.groupBy("size", "gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "size", "gram").limit(k)

    return _most_frequent(docs, k, text, lambda lists: _grams_of(lists, most), told, "size int, gram string, n long", best)


def covariate_cells(docs: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, n: documents by two variables."""
    return docs.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def covariate_range(cells: DataFrame, x: tuple, y: tuple) -> DataFrame:
    return cells.filter(F.col("x").between(*x) & F.col("y").between(*y))


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table for each; tokens and postings sorted by term, so that a term's lookup skips row groups, and by document, so that a frequent term is dealt over many files."""
    for name, df in tables.items():
        by = [c for c in ("term", "doc_id", "no", "pos") if c in df.columns]
        (df.repartitionByRange(*by).sortWithinPartitions(*by) if "term" in df.columns else df).write.mode("overwrite").parquet(f"{folder}/{name}")


def build(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> StoredIndex:
    """Writes postings, counts of terms, lengths and variables (all columns but the text) of a corpus under folder, and opens it."""
    kept = written_postings(docs, key, text)
    stats = kept.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    save({"postings": kept, "terms": stats, "lengths": doc_stats(docs, key, text), "variables": docs.drop(text)}, folder)
    return StoredIndex(docs.sparkSession, folder)


class StoredIndex:
    """Tables that build() wrote. A query's terms are pushed down to the scan, which reads the row groups that may hold them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def postings(self, terms: list[str]) -> DataFrame:
        return self.table("postings").filter(F.col("term").isin(sorted(set(terms))))

    def tokens(self, terms: list[str]) -> DataFrame:
        """doc_id, pos, term of these terms alone: what matching, phrases and ranking read."""
        return self.postings(terms).select("doc_id", F.explode("positions").alias("pos"), "term")

    def terms(self) -> DataFrame:
        return self.table("terms")

    def lengths(self) -> DataFrame:
        return self.table("lengths")

    def variables(self) -> DataFrame:
        return self.table("variables")

    def names_of(self, ids: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
        return self.variables().join(ids.select(key).distinct(), key, "left_semi").select(key, name)

    def ids_of(self, names: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
        return self.variables().join(names.select(name).distinct(), name, "left_semi").select(key, name)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only if the session names none and all its tasks run in the driver's process."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-termweave-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


#: For each thread the paths that cut() has written in each open scratch().
_scope = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes inside are removed at the end: for callers that have written or collected their result by then."""
    _scope.open = [*getattr(_scope, "open", []), []]
    try:
        yield
    finally:
        for path in _scope.open.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts the lineage and survives lost executors. See scratch() for when it goes."""
    spark = df.sparkSession
    path = f"{shared(spark)}/termweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if getattr(_scope, "open", None):
        _scope.open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)

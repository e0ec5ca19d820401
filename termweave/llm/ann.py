"""Approximate nearest neighbours with a permutation index.

Each vector is represented by its NEAREST pivots in order of nearness. The index is dealt over shards; a
shard posts its vectors in pivot inverted files (for each pivot: vectors and the rank it has for them).
Queries visit every shard in blocks: footrule distances over the query's pivots are summed from the posted
ranks, the best part of the shard by footrule is reranked by exact inner products, and the shard's best
are merged over shards with a top-k. Cuts keep ties: vectors as far by footrule as the last one reranked are
reranked too, and of equal scores the smaller ids win, however many vectors share a score.

Vectors that are equal are indexed once, with as many of their smallest ids as any answer can need, so a
vector that a third of all rows share costs one entry. Shards and blocks have a bounded size each, set by
hash; the number of (shard, block) tasks grows with the data.

Pivots are a bounded sample: the PIVOTS distinct vectors with the smallest hashes. Every row is indexed.
Recall against brute force is measured in the tests (0.9 at least).

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part;
vectors of several lengths are several tables, as no inner product joins them (over WIDTHS lengths are an
error); null ids take no part; of rows that share an id the least vector counts; ties in score go to the
smaller id; a query with fewer than k candidates gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table

#: Pivots, how many of them represent a vector, and the part of a shard (at least LEAST vectors) that is reranked.
PIVOTS, NEAREST, PART, LEAST = 512, 48, 0.35, 400
#: Vectors in a shard and queries in a block, about.
SHARD, BLOCK = 6_000, 1_000
#: Lengths of vectors that one table may have.
WIDTHS = 16


def _usable(vector: Column) -> Column:
    # comparisons with null or NaN: NaN counts as greater than anything in Spark
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def represent(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds perm: the numbers of the nearest pivots by inner product of unit vectors, nearest first."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors
    schema = T.StructType([*vectors.schema, T.StructField("perm", T.ArrayType(T.ShortType()))])
    at = vectors.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _matrix(batch[at], p.shape[1]) @ p.T
            perm = np.argsort(-near, axis=1, kind="stable")[:, :NEAREST].astype(np.int16)
            offsets = np.arange(0, perm.size + 1, perm.shape[1], dtype=np.int32)
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(perm.ravel()))], names=schema.names)

    return vectors.mapInArrow(run, schema)


class InvertedFiles:
    """A shard: for each pivot the vectors that have it among their nearest, and its ranks."""

    def __init__(self, perms: np.ndarray, n_pivots: int):
        self.n, self.width = perms.shape
        pivot, row, rank = perms.ravel(), np.repeat(np.arange(self.n), self.width), np.tile(np.arange(self.width), self.n)
        order = np.argsort(pivot, kind="stable")
        self.rows, self.ranks = row[order], rank[order]
        self.begins = np.searchsorted(pivot[order], np.arange(n_pivots + 1))

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distance to every vector of the shard; a pivot that one side lacks counts as of rank width.

        Without any shared pivot it is all of both sides' distances to that rank; each shared one takes off its own two and adds the difference.
        """
        w = self.width
        out = np.full(self.n, w * (w + 1), dtype=np.float64)
        parts = [slice(self.begins[p], self.begins[p + 1]) for p in perm]
        rows = np.concatenate([self.rows[s] for s in parts])
        gain = np.concatenate([np.abs(self.ranks[s] - r) - (w - r) - (w - self.ranks[s]) for r, s in enumerate(parts)])
        return out + np.bincount(rows, weights=gain, minlength=self.n)


def search(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is a query its k nearest other rows by inner product."""
    spark = rows.sparkSession
    read = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    read = read.filter(F.col("id").isNotNull()).filter(_usable(F.col("vector")))
    read = materialise(read.groupBy("id").agg(F.min(F.struct("vector", "query")).alias("x")).select("id", F.transform("x.vector", lambda x: x + 0.0).alias("vector"), "x.query"))
    widths = [r.width for r in read.select(F.size("vector").alias("width")).distinct().orderBy("width").limit(WIDTHS + 1).collect()]
    if len(widths) > WIDTHS:
        raise ValueError(f"vectors of over {WIDTHS} lengths")
    found = [_search(read.filter(F.size("vector") == width), k) for width in widths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def nearest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score and then by id, best first; of any number of equal scores too."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products by one sum for each row, which comes out alike wherever a vector stands."""
    return (vectors * query).sum(axis=1)


def _search(read: DataFrame, k: int) -> DataFrame:
    """search() over id, vector (all of one length), query."""
    read = read.withColumn("hash", F.md5(F.array_join(F.transform("vector", lambda x: F.hex(x.cast("string").cast("binary"))), ",")))
    # of equal vectors the k + 1 smallest ids: one may be the query's own
    order = Window.partitionBy("hash").orderBy("id")
    members = read.select("hash", "id", "vector").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    entries = materialise(members.groupBy("hash").agg(F.min("id").alias("id"), F.min("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids")))
    sample = entries.orderBy(F.xxhash64("hash"), "hash").limit(PIVOTS).select("vector").collect()
    pivots = np.array([r.vector for r in sample])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    wanted = read.filter("query").groupBy("hash").agg(F.min("vector").alias("vector"))
    n, n_queries = entries.count(), wanted.count()
    n_shards, n_blocks = n // SHARD + 1, n_queries // BLOCK + 1
    dealt = lambda n, salt: F.pmod(F.xxhash64("hash", F.lit(salt)), F.lit(n)).cast("int")
    shards = represent(entries.select("hash", "vector", "ids").withColumn("shard", dealt(n_shards, "shard")), pivots).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = represent(wanted.withColumn("block", dealt(n_blocks, "block")), pivots).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    n_pivots = len(pivots)

    def visit(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"hash": [], "ids": [], "score": []})
        index = index.sort_values("hash", ignore_index=True)
        vectors, ids = np.stack(index["vector"].to_list()), index["ids"].to_list()
        files = InvertedFiles(np.stack(index["perm"].to_list()), n_pivots)
        first = np.array([x[0] for x in ids])
        part = min(len(index), max(LEAST, int(PART * len(index))))
        out: tuple[list, list, list] = ([], [], [])
        for h, q, perm in zip(queries["hash"], queries["vector"], queries["perm"], strict=True):
            far = files.footrule(perm)
            near = np.flatnonzero(far <= np.partition(far, part - 1)[part - 1])
            score = products(vectors[near], q)
            best = nearest(score, first[near], k + 1)
            out[0].extend([h] * len(best))
            out[1].extend(ids[i] for i in near[best])
            out[2].extend(score[best].tolist())
        return pd.DataFrame({"hash": out[0], "ids": out[1], "score": out[2]})

    found = shards.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block")).applyInPandas(visit, "hash string, ids array<long>, score double")
    by_score = lambda by, own: Window.partitionBy(by).orderBy(F.desc("score"), own)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("score"), F.get("ids", F.lit(0))))).filter(F.col("r") <= k + 1)
    each = best.select("hash", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(by_score("hash", "vec_id"))).filter(F.col("r") <= k + 1)
    asked = read.filter("query").select("hash", F.col("id").alias("query_id"))
    pairs = asked.join(each.select("hash", "vec_id", "score"), "hash").filter(F.col("vec_id") != F.col("query_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(by_score("query_id", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)

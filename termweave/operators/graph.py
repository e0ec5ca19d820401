"""PageRank over an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import cut, shared

#: Nodes up to which scores are broadcast to the edges (16 bytes each); beyond it edges and scores are stored in the same buckets.
BROADCAST_NODES = 1_000_000
#: Nodes of each bucket, about, of the edges and scores of a larger graph.
BUCKET_NODES = 100_000


def pagerank(edges: DataFrame, jump: float = 0.15, steps: int = 1000, tolerance: float = 1e-3, weighted: bool = True) -> DataFrame:
    """node, score. Edges (src, dst) count as often as they occur, or once if not weighted; nodes without edges out spread their score over all.

    Nodes are numbered once, so that steps move numbers only. A step is a join of edges with scores and a sum by
    target, which is pre-aggregated in each task, so a target of a third of all edges costs a row for each task; its
    result is written to the shared folder. What dangling nodes hold and how much changed come from one aggregate of it.
    """
    links = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")) if weighted else edges.select("src", "dst").distinct().withColumn("n", F.lit(1).cast("long")))
    degree = links.groupBy("src").agg(F.sum("n").alias("degree"))
    names = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().join(degree, F.col("node") == F.col("src"), "left").select("node", "degree")
    nodes = cut(names.withColumn("id", F.monotonically_increasing_id()))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    small = n <= BROADCAST_NODES
    sent = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    ids = nodes.select("node", "id", "degree")
    share = links.join(sent(ids.select(F.col("node").alias("src"), F.col("id").alias("from"), "degree")), "src").join(sent(ids.select(F.col("node").alias("dst"), F.col("id").alias("to"))), "dst")
    share = share.select("from", "to", (F.col("n") / F.col("degree")).alias("part"))
    first = nodes.select("id", F.col("degree").isNull().alias("open"), F.lit(1.0 / n).alias("score"))
    if not small:
        return _pagerank_in_buckets(nodes, share, first, n, jump, steps, tolerance)
    share, rank = cut(share), cut(first)
    lost = rank.agg(F.sum(F.when(F.col("open"), F.col("score")))).first()[0] or 0.0
    for _ in range(steps):
        got = share.join(sent(rank.select(F.col("id").alias("from"), "score")), "from").groupBy(F.col("to").alias("id")).agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        score = jump / n + (1 - jump) * (F.coalesce("got", F.lit(0.0)) + lost / n)
        new = cut(rank.withColumnRenamed("score", "old").join(got, "id", "left").select("id", "open", "old", score.alias("score")))
        change, lost = new.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("open"), F.col("score"))), F.lit(0.0))).first()
        rank = new.select("id", "open", "score")
        if change < tolerance:
            break
    return nodes.select("node", "id").join(rank.select("id", "score"), "id").select("node", "score")


def _pagerank_in_buckets(nodes: DataFrame, share: DataFrame, first: DataFrame, n: int, jump: float, steps: int, tolerance: float) -> DataFrame:
    """pagerank() from parts of edges (from, to, part) and scores (id, open, score), both in the same buckets: a step shuffles sums by target alone."""
    spark, place, names = nodes.sparkSession, f"{shared(nodes.sparkSession)}/termweave-{uuid.uuid4().hex}", []
    buckets = -(-n // BUCKET_NODES)

    def stored(rows: DataFrame, key: str) -> DataFrame:
        names.append(name := f"pagerank_{uuid.uuid4().hex}")
        rows.repartition(buckets, key).write.bucketBy(buckets, key).option("path", f"{place}/{name}").saveAsTable(name)
        return spark.table(name)

    share, rank = stored(share, "from"), stored(first, "id")
    lost = rank.agg(F.sum(F.when(F.col("open"), F.col("score")))).first()[0] or 0.0
    for _ in range(steps):
        got = share.join(rank.select(F.col("id").alias("from"), "score"), "from").groupBy(F.col("to").alias("id")).agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        score = jump / n + (1 - jump) * (F.coalesce("got", F.lit(0.0)) + lost / n)
        new = stored(rank.withColumnRenamed("score", "old").join(got, "id", "left").select("id", "open", "old", score.alias("score")), "id")
        change, lost = new.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("open"), F.col("score"))), F.lit(0.0))).first()
        rank = new.select("id", "open", "score")
        if change < tolerance:
            break
    out = cut(nodes.select("node", "id").join(rank.select("id", "score"), "id").select("node", "score"))
    for name in names:
        spark.sql(f"drop table {name}")
    return out

"""Runs, judgments and features: filters, pools, overlap, votes, normalisation, average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_allowed(run: DataFrame, allowed: DataFrame, on: list[str], most: int | None = None) -> DataFrame:
    """The run's rows with a partner in allowed, and the first rows of each query only where most is given."""
    out = run.join(allowed, on, "left_semi")
    return out if most is None else out.withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter(F.col("__r") <= most).drop("__r")


def fill_pool(pool: DataFrame, run: DataFrame) -> DataFrame:
    """qid, doc_id, score for every pooled document: the run's reciprocal rank, 0 without one."""
    return pool.join(run.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left").select("qid", "doc_id", F.round(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)), 6).alias("score"))


def pool(runs: DataFrame, depth: int) -> DataFrame:
    """qid, doc_id, n_runs of documents that some run has within depth."""
    return runs.filter(F.col("rank") <= depth).groupBy("qid", "doc_id").agg(F.count_distinct("system").alias("n_runs"))


def overlap(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """qid, overlap: the part of the first depth documents that two runs share."""
    top = lambda x: x.filter(F.col("rank") <= depth).select("qid", "doc_id")
    both = top(a).join(top(b), ["qid", "doc_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return top(a).select("qid").union(top(b).select("qid")).distinct().join(both, "qid", "left").select("qid", F.round(F.coalesce("n", F.lit(0)) / depth, 6).alias("overlap"))


def votes(judgments: DataFrame, by: list[str], label: str) -> DataFrame:
    """by, n_yes, n_no, relevant (a tie counts as yes), agreement."""
    yes, no = F.count_if(F.col(label) > 0).alias("n_yes"), F.count_if(F.col(label) <= 0).alias("n_no")
    v = judgments.groupBy(*by).agg(yes, no)
    return v.withColumn("relevant", F.col("n_yes") >= F.col("n_no")).withColumn("agreement", F.round(F.greatest("n_yes", "n_no") / (F.col("n_yes") + F.col("n_no")), 6))


def z_scores(features: DataFrame) -> DataFrame:
    """qid, doc_id, fid, z from long features: means and deviations by feature are an aggregate, joined back."""
    s = features.groupBy("fid").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0)
    return features.join(s, "fid").select("qid", "doc_id", "fid", F.round(z, 6).alias("z"))


def impute_least(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair (qid, doc_id) with every feature of its query; a missing one is the query's least."""
    least = features.groupBy("qid", "fid").agg(F.min("value").alias("least"))
    return pairs.join(least, "qid").join(features, ["qid", "doc_id", "fid"], "left").select("qid", "doc_id", "fid", F.coalesce("value", "least").alias("value"))


def average_precision(run: DataFrame, qrels: DataFrame, cut: int = 5) -> DataFrame:
    """qid, ap, p_at: over all relevant documents of the query; queries without any are left out."""
    good = qrels.filter("grade > 0").select("qid", "doc_id").distinct()
    n = good.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    hits = run.join(good, ["qid", "doc_id"]).withColumn("seen", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    by = hits.groupBy("qid").agg(F.sum(F.col("seen") / F.col("rank")).alias("s"), F.count_if(F.col("rank") <= cut).alias("k"))
    return n.join(by, "qid", "left").select("qid", F.round(F.coalesce("s", F.lit(0.0)) / F.col("n_rel"), 6).alias("ap"), F.round(F.coalesce("k", F.lit(0)) / cut, 6).alias("p_at"))


def overlap_of_documents(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """qid, doc_id, overlap for every document of either run: its query's overlap."""
    either = a.select("qid", "doc_id").union(b.select("qid", "doc_id")).distinct()
    return either.join(overlap(a, b, depth), "qid")


def vote_details(judgments: DataFrame, by: list[str], label: str, worker: str, time: str) -> DataFrame:
    """by, histogram (label:count by label), n_workers, total_time."""
    counted = judgments.groupBy(*by, F.col(label).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "n"))), lambda x: F.concat_ws(":", x["l"], x["n"])), ",")
    histogram = counted.groupBy(*by).agg(shown.alias("histogram"))
    rest = judgments.groupBy(*by).agg(F.count_distinct(worker).alias("n_workers"), F.round(F.sum(time), 4).alias("total_time"))
    return histogram.join(rest, by)


def per_label(judgments: DataFrame, labels: list[str]) -> DataFrame:
    """label, positive, negative: judgments by label, from one column for each label."""
    sides = F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("v")) for x in labels])
    return judgments.select(F.inline(sides)).groupBy("label").agg(F.count_if(F.col("v") > 0).alias("positive"), F.count_if(F.col("v") <= 0).alias("negative"))


def wide(features: DataFrame, fids: list[str]) -> DataFrame:
    """qid, doc_id, a column for each of fids, and max, min, sum, avg of these; features are complete (impute_least)."""
    own = [F.max(F.when(F.col("fid") == f, F.col("value"))).alias(f) for f in fids]
    out = features.groupBy("qid", "doc_id").agg(*own)
    row = F.array(*fids)
    total = F.aggregate(row, F.lit(0.0), lambda a, x: a + x)
    return out.select("qid", "doc_id", *fids, F.array_max(row).alias("max"), F.array_min(row).alias("min"), F.round(total, 6).alias("sum"), F.round(total / len(fids), 6).alias("avg"))


def tuned(measures: DataFrame, folds: DataFrame) -> DataFrame:
    """fold, system, ap, p_at: for each fold of queries the run that is best on the other folds, and its means on this one.

    measures: system, qid, ap, p_at; folds: qid, fold. Of equals the run that sorts first.
    """
    own = measures.join(folds, "qid")
    sums = own.groupBy("system", "fold").agg(F.sum("ap").alias("s"), F.count(F.lit(1)).alias("n"), F.avg("ap").alias("ap"), F.avg("p_at").alias("p_at"))
    whole = own.groupBy("system").agg(F.sum("ap").alias("all_s"), F.count(F.lit(1)).alias("all_n"))
    scored = sums.join(whole, "system").filter("all_n > n").withColumn("train", F.round((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")), 9))
    best = F.min_by(F.struct("system", "ap", "p_at"), F.struct(-F.col("train"), F.col("system"))).alias("x")
    return scored.groupBy("fold").agg(best).select("fold", "x.system", F.round("x.ap", 6).alias("ap"), F.round("x.p_at", 6).alias("p_at"))


def folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    """key, fold: the first eight hexadecimal digits of a hash of the key, modulo k."""
    return rows.select(key).distinct().select(key, F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(k)).alias("fold"))


def evaluated(scored: DataFrame, cuts: list[int]) -> DataFrame:
    """n, tp, accuracy (tp / n), precision (tp / positives) and p_<k> of (item_id, score, positive); above 0 counts as found.

    Ranks reach as far as the largest of cuts only.
    """
    whole = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("score") > 0) & F.col("positive")).alias("tp"), F.count_if("positive").alias("kind"))
    best = scored.orderBy(F.desc("score"), "item_id").limit(max(cuts))
    best = best.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")))
    at = best.agg(*[F.round(F.count_if(F.col("positive") & (F.col("r") <= k)) / k, 6).alias(f"p_{k}") for k in cuts])
    shown = whole.select("n", "tp", F.round(F.try_divide("tp", "n"), 6).alias("accuracy"), F.round(F.try_divide("tp", "kind"), 6).alias("precision"))
    return shown.join(F.broadcast(at))


def joined_with_skipped(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """matched, skipped: rows of an inner join, and rows of left without a partner."""
    keys = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    both = left.select(*on).join(keys, on, "left")
    return both.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("matched"), F.count_if(F.col("__n").isNull()).alias("skipped"))

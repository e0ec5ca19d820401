"""Query expansion and entity relevance over ranked lists: softmax posteriors, relevance models, LCE, entity scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import cut


def posteriors(scored: DataFrame, by: str = "qid") -> DataFrame:
    """Adds posterior: the softmax of score within each query."""
    whole = Window.partitionBy(by)
    e = F.exp(F.col("score") - F.max("score").over(whole))
    return scored.withColumn("__e", e).withColumn("posterior", F.col("__e") / F.sum("__e").over(whole)).drop("__e")


def relevance_model(top: DataFrame, toks: DataFrame, doc_stats: DataFrame, terms: int = 30, drop: list[str] | None = None) -> DataFrame:
    """qid, term, weight: mean over the ranked documents (qid, doc_id, posterior) of posterior times tf / length, the best terms of each query."""
    tf = toks.join(top.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.filter(~F.col("term").isin(drop)) if drop else tf
    joined = top.join(tf, "doc_id").join(doc_stats, "doc_id")
    n = top.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    weight = joined.groupBy("qid", "term").agg(F.sum(F.col("posterior") * F.col("tf") / F.col("len")).alias("w")).join(n, "qid").select("qid", "term", F.round(F.col("w") / F.col("n"), 9).alias("weight"))
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("weight"), "term"))
    return weight.withColumn("r", r).filter(F.col("r") <= terms).drop("r")


def expanded(query: dict[str, float], expansion: DataFrame, original: float = 0.8) -> list[tuple[str, float]]:
    """Terms and weights of a query mixed with expansion terms (a few rows)."""
    rows = expansion.select("term", "weight").collect()
    total, own = sum(r.weight for r in rows) or 1.0, sum(query.values()) or 1.0
    out = {t: original * w / own for t, w in query.items()}
    for r in rows:
        out[r.term] = out.get(r.term, 0.0) + (1 - original) * r.weight / total
    return sorted(out.items())


def mixed(queries: dict[str, dict[str, float]], expansion: DataFrame, original: float = 0.8) -> dict[str, dict[str, float]]:
    """Weighted queries with the terms of expansion (qid, term, weight; a few rows a query) mixed in: original of the weight stays with the query."""
    own: dict[str, dict[str, float]] = {q: {} for q in queries}
    for r in expansion.select("qid", "term", "weight").collect():
        own[r.qid][r.term] = own[r.qid].get(r.term, 0.0) + r.weight
    out = {}
    for q, terms in queries.items():
        whole, more = sum(terms.values()) or 1.0, sum(own[q].values()) or 1.0
        out[q] = {t: original * terms.get(t, 0.0) / whole + (1 - original) * own[q].get(t, 0.0) / more for t in [*terms, *(t for t in own[q] if t not in terms)]}
    return out


def local_contexts(top: DataFrame, toks: DataFrame, doc_stats: DataFrame, stats: DataFrame, mu: float = 1000.0, k: int = 30, drop: list[str] | None = None) -> DataFrame:
    """qid, term, score for the ranked lists (qid, doc_id, score): a query's k best terms that occur in its documents twice or more.

    A term's score is the sum over its query's documents of score + ln((tf + mu cf/C) / (len + mu)) - ln(cf/C); documents
    without the term count too, so terms meet all documents of their own query, which are a short list.
    """
    own = top.join(doc_stats, "doc_id").select("qid", "doc_id", "score", "len")
    tf = toks.join(top.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.filter(~F.col("term").isin(drop)) if drop else tf
    terms = own.join(tf, "doc_id").groupBy("qid", "term").agg(F.sum("tf").alias("n")).filter("n > 1").select("qid", "term")
    coll = stats.agg(F.sum("cf").alias("coll"))
    # an equi-join on the query: its terms with its ranked documents, both short lists
    pairs = terms.join(stats.select("term", "cf"), "term").join(own, "qid").join(tf, ["doc_id", "term"], "left").join(F.broadcast(coll))
    p = F.col("cf") / F.col("coll")
    one = F.col("score") + F.ln((F.coalesce("tf", F.lit(0)) + mu * p) / (F.col("len") + mu)) - F.ln(p)
    scored = pairs.groupBy("qid", "term").agg(F.round(F.sum(one), 6).alias("score"))
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "term"))
    return scored.withColumn("r", r).filter(F.col("r") <= k).drop("r")


def sweep(top: DataFrame, toks: DataFrame, doc_stats: DataFrame, stats: DataFrame, docs: tuple[int, ...], depth: int, drop: list[str] | None = None, mu: float = 1000.0) -> DataFrame:
    """n_docs, qid, term, score, rank: local_contexts() from the first so many documents of ranked lists (qid, doc_id, score), for all numbers in one job; a
    shallower list is its first ranks."""
    numbers = F.array(*[F.lit(n) for n in sorted(set(docs))])
    placed = top.withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))
    # a query's list of one length counts as a query of its own
    lists = placed.withColumn("n_docs", F.explode(F.filter(numbers, lambda n: n >= F.col("__r")))).select(F.struct("n_docs", "qid").alias("qid"), "doc_id", "score")
    terms = local_contexts(lists, toks, doc_stats, stats, mu, depth, drop)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "term")).cast("long")
    return terms.withColumn("rank", rank).select("qid.n_docs", "qid.qid", "term", "score", "rank")


#: Scores of an entity from each document that mentions it: posterior, mentions c, document length l, collection frequency cf and length.
ENTITY_METHODS = ("rm", "drm", "gdrm", "gnb")


def entity_scores(top: DataFrame, mentions: DataFrame, doc_stats: DataFrame, coll: DataFrame, places: int = 6) -> DataFrame:
    """phrase_id and a score for each of ENTITY_METHODS, rounded to places, over ranked documents (doc_id, posterior) of any number."""
    # written once: texts are searched for mentions in one pass
    c = cut(mentions.groupBy("phrase_id", "doc_id").agg(F.count(F.lit(1)).alias("c")))
    cf = c.groupBy("phrase_id").agg(F.sum("c").alias("cf"))
    x = c.join(top.select("doc_id", "posterior"), "doc_id").join(doc_stats, "doc_id").join(cf, "phrase_id").join(F.broadcast(coll.select("coll_len")))
    rate: Column = F.col("c") / F.col("len")
    background = F.col("cf") / F.col("coll_len")
    scores = {"rm": F.col("posterior") * rate, "drm": F.col("posterior") * rate / background, "gdrm": F.ln("posterior") + F.ln(rate) - F.ln(background), "gnb": F.ln(rate) - F.ln(background)}
    return x.groupBy("phrase_id").agg(*[F.round(F.sum(s), places).alias(m) for m, s in scores.items()])

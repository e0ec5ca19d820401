"""Boolean, phrase and passage matching, and ranked retrieval. Query sides are short lists of the caller's and broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens as token_array
from .index import cut


def _frame(toks: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(toks.sparkSession.createDataFrame(rows, schema))


def match(toks: DataFrame, terms: list[str], least: int | None = None) -> DataFrame:
    """doc_id, n_present: documents with at least that many of the terms (None: all of them, 1: any)."""
    terms = sorted(set(terms))
    found = toks.filter(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count_distinct("term").alias("n_present"))
    return found.filter(F.col("n_present") >= (len(terms) if least is None else least))


def phrases(toks: DataFrame, wanted: dict[int, list[str]]) -> DataFrame:
    """phrase_id, doc_id, start, size: every place of every phrase, overlapping ones too.

    Each token votes for the start it would have as part of a phrase; a place is there when all parts voted.
    """
    parts = [(p, t, k, len(terms)) for p, terms in wanted.items() for k, t in enumerate(terms)]
    votes = toks.join(_frame(toks, parts, "phrase_id int, term string, offset int, size int"), "term")
    placed = votes.select("phrase_id", "doc_id", (F.col("pos") - F.col("offset")).alias("start"), "size")
    return placed.groupBy("phrase_id", "doc_id", "start", "size").agg(F.count(F.lit(1)).alias("n")).filter("n = size").drop("n")


def passages(toks: DataFrame, terms: list[str], width: int) -> DataFrame:
    """doc_id, pos, n_present: starts of unordered windows of width over all terms that the document has.

    A start holds when every term present in the document comes again at or after it, and the last of these
    lies within the width. Windows run over the query terms' tokens of one document only.
    """
    terms = sorted(set(terms))
    own = toks.filter(F.col("term").isin(terms)).select("doc_id", "pos", "term")
    ahead = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy("doc_id")
    nexts = [F.min(F.when(F.col("term") == t, F.col("pos"))).over(ahead).alias(f"next{k}") for k, t in enumerate(terms)]
    has = [F.max((F.col("term") == t).cast("int")).over(whole).alias(f"has{k}") for k, t in enumerate(terms)]
    seen = own.select("doc_id", "pos", *nexts, *has)
    far = [F.when(F.col(f"has{k}") == 1, F.coalesce(F.col(f"next{k}"), F.lit(1 << 30))).otherwise(-1) for k in range(len(terms))]
    last = reduce(lambda a, b: F.greatest(a, b), far)
    present = reduce(lambda a, b: a + b, [F.col(f"has{k}") for k in range(len(terms))])
    return seen.filter(last + 1 - F.col("pos") <= width).select("doc_id", "pos", present.cast("long").alias("n_present"))


def relaxed_passages(toks: DataFrame, terms: list[str], width: int, enough: int = 10) -> DataFrame:
    """Passages of documents with all terms, or with fewer until there are enough; the threshold is found in the same job."""
    found = passages(toks, terms, width)
    n = len(set(terms))
    by = found.agg(*[F.count_if(F.col("n_present") >= k).alias(str(k)) for k in range(1, n + 1)])
    chosen = reduce(lambda rest, k: F.when(F.col(str(k)) >= enough, k).otherwise(rest), range(2, n + 1), F.lit(1))
    return found.join(F.broadcast(by.select(chosen.alias("k")))).filter("n_present >= k").drop("k")


def jelinek_mercer(tf: Column, length: Column, cf: Column, coll: Column, weight: float = 0.8) -> Column:
    """weight is the document's."""
    return F.ln((1 - weight) * cf / coll + weight * tf / length)


def dirichlet(tf: Column, length: Column, cf: Column, coll: Column, mu: float = 1500.0) -> Column:
    return F.ln(tf + mu * F.when(cf > 0, cf / coll).otherwise(0.5 / coll)) - F.ln(length + mu)


def likelihood(docs: DataFrame, queries: dict[str, dict[str, float]], smoothing: str = "dirichlet", k: int | None = 10, within: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """qid, doc_id, score, rank: the k best documents of weighted queries (qid to term to weight), in one scan of the texts.

    A document's query terms are picked out inside its row and written with its length; frequencies are sums over these
    few terms, and scores an expression of the row, so no token is shuffled. Candidates have any of a query's terms;
    terms that occur nowhere are dropped; weights are taken by their sum. within (doc_id) leaves other documents out,
    but not of the statistics. Queries are short lists of the caller's.
    """
    terms = sorted({t for own in queries.values() for t in own})
    t = token_array(F.col(text))
    view = cut(docs.select(F.col(key).alias("doc_id"), t.alias("__t")).select("doc_id", F.size("__t").cast("long").alias("len"), F.filter("__t", lambda x: x.isin(terms)).alias("own")))
    coll = view.agg(F.sum("len")).first()[0] or 0
    cf = {r.term: r.n for r in view.select(F.explode("own").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = jelinek_mercer if smoothing in ("jm", "linear") else dirichlet
    rows = view.filter(F.size("own") > 0)
    rows = rows if within is None else rows.join(within.select("doc_id").distinct(), "doc_id", "left_semi")

    def scored(qid: str, own: dict[str, float]) -> Column:
        known = {x: w for x, w in own.items() if cf.get(x)}
        tf = lambda x: F.size(F.filter("own", lambda y: y == x))
        total = sum(known.values())
        score = reduce(lambda a, b: a + b, [w * model(tf(x), F.col("len"), F.lit(cf[x]), F.lit(coll)) for x, w in known.items()], F.lit(0.0)) / F.lit(total or 1.0)
        any_ = F.arrays_overlap("own", F.array(*map(F.lit, known))) if known else F.lit(False)
        return F.when(any_, F.struct(F.lit(qid).alias("qid"), F.round(score, 6).alias("score")))

    made = F.array_compact(F.array(*[scored(q, own) for q, own in queries.items()]))
    return ranked(rows.select("doc_id", F.inline(made)).select("qid", "doc_id", "score"), k)


#: Documents of a block, about, that are left out together where none of them can be among the best.
BLOCK = 128


def likelihood_of_many(toks: DataFrame, doc_stats: DataFrame, queries: DataFrame, k: int | None = 10, smoothing: str = "dirichlet", coll_len: int | None = None, block: int = BLOCK) -> DataFrame:
    """qid, doc_id, score, rank for any number of queries (qid, term, weight of 0 or more): nothing of either side is collected.

    A score is what the query and the document's length say for a document without any of the terms, and a gain for each posting
    that matches. So rows are made for matching postings alone. Documents fall into blocks by hash; a block's largest count of each term bounds its
    documents' gains, its shortest document their lengths' part. The k best documents by the rarest term of a query give a score that
    the k best reach at least; a query's blocks whose bound is under that are passed over before their postings are read. Joins are by
    term and block, so a frequent term is dealt over all its blocks.
    """
    sizes = doc_stats.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("coll")).first()
    coll = F.lit(float((sizes["coll"] if coll_len is None else coll_len) or 0))
    of = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, sizes["n"] // block)))
    tf = toks.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    own = cut(tf.join(doc_stats, "doc_id").select("term", of.alias("block"), "doc_id", "tf", "len"))
    known = cut(queries.join(own.groupBy("term").agg(F.sum("tf").alias("cf")), "term").select("qid", "term", F.col("weight").cast("double").alias("weight"), "cf"))
    linear, p, mu, share = smoothing in ("jm", "linear"), F.col("cf") / coll, 1500.0, 0.8
    # what a term without a posting gives; how much more a posting gives, from its count, or from its part of the document
    base = F.ln((1 - share) * p) if linear else F.ln(mu * p)
    rate = lambda tf, length: tf / length if linear else tf
    gain = lambda x: F.col("weight") * F.log1p(share * x / ((1 - share) * p) if linear else x / (mu * p))
    long = lambda length: F.lit(0.0) if linear else F.ln(length + mu)
    score = lambda gains, length: (F.col("base") + gains) / F.col("total") - long(length)
    whole = known.groupBy("qid").agg(F.sum("weight").alias("total"), F.sum(F.col("weight") * base).alias("base")).filter("total > 0")
    lists = own.groupBy("term", "block").agg(F.max(rate(F.col("tf"), F.col("len"))).alias("most"), F.min("len").alias("shortest"))
    bounds = lists.join(known, "term").groupBy("qid", "block").agg(F.sum(gain(F.col("most"))).alias("gains"), F.min("shortest").alias("shortest"))
    kept = bounds.join(whole, "qid")
    if k is not None:
        rarest = known.groupBy("qid").agg(F.min_by(F.struct("term", "weight", "cf"), F.struct("cf", "term")).alias("x")).select("qid", "x.*")
        some = own.join(rarest, "term").join(whole, "qid").select("qid", score(gain(rate(F.col("tf"), F.col("len"))), F.col("len")).alias("low"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("low")))
        floor = some.withColumn("place", place).filter(F.col("place") == k).select("qid", "low")
        # bounds and scores are sums in another order: a margin far above what that changes
        kept = kept.join(floor, "qid", "left").filter(F.col("low").isNull() | (score(F.col("gains"), F.col("shortest")) >= F.col("low") - 1e-6))
    wanted = kept.select("qid", "block", "base", "total").join(known, "qid")
    gains = own.join(wanted, ["term", "block"]).groupBy("qid", "doc_id", "len", "base", "total").agg(F.sum(gain(rate(F.col("tf"), F.col("len")))).alias("gains"))
    return ranked(gains.select("qid", "doc_id", F.round(score(F.col("gains"), F.col("len")), 6).alias("score")), k)


def query_likelihood(toks: DataFrame, doc_stats: DataFrame, queries: dict[str, list[str]], smoothing: str = "dirichlet", k: int | None = 10, coll_len: int | None = None) -> DataFrame:
    """qid, doc_id, score, rank: the k best documents of each query, all queries in one job.

    Candidates have any of a query's terms; terms that occur nowhere are dropped; repeated terms count as
    often as they stand in the query; the score is their mean.
    """
    wanted = [(q, t, float(terms.count(t))) for q, terms in queries.items() for t in dict.fromkeys(terms)]
    return likelihood_of_many(toks, doc_stats, _frame(toks, wanted, "qid string, term string, weight double"), k, smoothing, coll_len)


def counted(queries: dict[str, list[str]]) -> dict[str, dict[str, float]]:
    """Queries as lists of terms as weighted ones: a term weighs as often as it stands there."""
    return {q: {t: float(terms.count(t)) for t in dict.fromkeys(terms)} for q, terms in queries.items()}


def synonyms(toks: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """name, doc_id, pos of the places where any term of a group stands, each place once."""
    rows = [(name, t) for name, terms in groups.items() for t in set(terms)]
    return toks.join(_frame(toks, rows, "name string, term string"), "term").select("name", "doc_id", "pos").distinct()


def meaningful(terms: list[str], stopwords: list[str]) -> list[str]:
    """The terms without stopwords, each once, unless all are stopwords."""
    once = list(dict.fromkeys(terms))
    return [t for t in once if t not in stopwords] or once


def ranked(scored: DataFrame, k: int | None = None, by: str = "qid", doc: str = "doc_id") -> DataFrame:
    """Adds rank, from 1 by descending score and then by doc; only the k best where given."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), doc)).cast("long"))
    return out if k is None else out.filter(F.col("rank") <= k)


def sequential_dependence(toks: DataFrame, doc_stats: DataFrame, query: list[str], k: int = 10, weights: tuple[float, float, float] = (0.8, 0.15, 0.05), mu: float = 1500.0, stopwords: list[str] | None = None, longest: int = 2, within: DataFrame | None = None) -> DataFrame:
    """doc_id, score, rank: unigrams, runs of two to longest neighbours in order, and pairs within 8 tokens, each Dirichlet-smoothed with its own frequency.

    within (doc_id) leaves other documents out of the ranking, but not of the frequencies. The documents that hold a
    unit meet all units of the query: a cross join with a short list of the caller's.
    """
    stop = set(stopwords or [])
    units = [("u", [t]) for t in query if t not in stop]
    if len(query) > 1:
        near = list(zip(query[:-1], query[1:], strict=True))
        units += [("o", query[i : i + n]) for n in range(2, longest + 1) for i in range(len(query) - n + 1)]
        units += [("w", list(p)) for p in near if p[0] not in stop and p[1] not in stop and p[0] != p[1]]
    own = cut(toks.filter(F.col("term").isin(sorted(set(query)))))
    total = {kind: sum(1 for k2, _ in units if k2 == kind) for kind in "uow"}
    share = dict(zip("uow", weights, strict=True)) if len(query) > 1 else {"u": 1.0}
    found = []
    for n, (kind, terms) in enumerate(units):
        if kind == "u":
            hits = own.filter(F.col("term") == terms[0]).select("doc_id")
        elif kind == "o":
            hits = phrases(own, {0: terms}).select("doc_id")
        else:
            hits = passages(own.filter(F.col("term").isin(terms)), terms, 8).filter("n_present = 2").select("doc_id")
        found.append(hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tf")).select("doc_id", F.lit(n).alias("unit"), "tf"))
    tf = reduce(DataFrame.unionByName, found)
    cf = tf.groupBy("unit").agg(F.sum("tf").alias("cf"))
    weight = _frame(toks, [(n, share[kind] / total[kind]) for n, (kind, _) in enumerate(units)], "unit int, weight double").join(cf, "unit")
    coll = doc_stats.agg(F.sum("len").alias("coll"))
    ranked_ = tf.select("doc_id").distinct()
    ranked_ = ranked_ if within is None else ranked_.join(within.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = ranked_.crossJoin(F.broadcast(weight)).join(tf, ["doc_id", "unit"], "left").join(doc_stats, "doc_id").join(F.broadcast(coll))
    scored = pairs.groupBy("doc_id").agg(F.sum(F.col("weight") * dirichlet(F.coalesce("tf", F.lit(0)), F.col("len"), F.col("cf"), F.col("coll"), mu)).alias("score"))
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def _bag(toks: DataFrame, terms: list[str], width: int, stopwords: list[str]) -> DataFrame:
    return relaxed_passages(toks, meaningful(terms, stopwords), width).select("doc_id", F.col("pos").alias("start"), F.lit(width).alias("size"))


#: Ways to find a query's hits by name: doc_id, start, size from tokens, terms, a width and stopwords.
METHODS = {
    "phrase": lambda toks, terms, width, stopwords: phrases(toks, {0: terms}).select("doc_id", "start", "size"),
    "window": lambda toks, terms, width, stopwords: passages(toks, terms, width).filter(F.col("n_present") == len(set(terms))).select("doc_id", F.col("pos").alias("start"), F.lit(width).alias("size")),
    "bag": _bag,
}


def find_hits(toks: DataFrame, terms: list[str], method: str = "phrase", width: int = 32, stopwords: list[str] | None = None) -> DataFrame:
    """doc_id, start, size of a query's hits by one of METHODS; an unknown method is an error."""
    if method not in METHODS:
        raise KeyError(f"no method {method}; known: {', '.join(sorted(METHODS))}")
    return METHODS[method](toks, terms, width, stopwords or [])

"""What occurs near hits: slices, merged slices, counts and pointwise mutual information."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, spaced
from ..functions.text import tokens as token_array
from .index import cut, places_of, slices_of
from .spans import overlapping, stabbed


def slices(hits: DataFrame, left: int, right: int) -> DataFrame:
    """doc_id, begin, end around hits (doc_id, start, size); begins are held at 0."""
    return hits.select("doc_id", F.greatest(F.col("start") - left, F.lit(0)).alias("begin"), (F.col("start") + F.col("size") + right).alias("end"))


def merged(cut: DataFrame) -> DataFrame:
    """Slices of one document that touch or overlap as one."""
    before = Window.partitionBy("doc_id").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)
    opened = cut.distinct().withColumn("new", F.coalesce(F.max("end").over(before) < F.col("begin"), F.lit(True)).cast("int"))
    return opened.withColumn("island", F.sum("new").over(upto)).groupBy("doc_id", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")


def inside(toks: DataFrame, cut: DataFrame) -> DataFrame:
    """Tokens of the slices."""
    return stabbed(toks, cut).select("doc_id", "begin", "pos", "term")


def term_counts(toks: DataFrame, cut: DataFrame) -> DataFrame:
    return inside(toks, cut).groupBy("term").agg(F.count(F.lit(1)).alias("qpf"))


def pmi(qpf: Column, cf: Column, n_hits: Column, coll: Column) -> Column:
    """How much likelier the term is near a hit than by chance; not a logarithm."""
    return (qpf / coll) / ((cf / coll) * (n_hits / coll))


def pmi_terms(toks: DataFrame, stats: DataFrame, hits: DataFrame, left: int = 5, right: int = 5, least: int = 4, k: int = 30) -> DataFrame:
    """term, qpf, cf, pmi: the k best terms near hits, with more than least occurrences there."""
    near = term_counts(toks, merged(slices(hits, left, right)))
    coll = stats.agg(F.sum("cf").alias("coll"))
    n = hits.agg(F.count(F.lit(1)).alias("n_hits"))
    joined = near.filter(F.col("qpf") > least).join(stats.select("term", "cf"), "term").join(F.broadcast(coll)).join(F.broadcast(n))
    scored = joined.select("term", "qpf", "cf", F.round(pmi(*map(F.col, ("qpf", "cf", "n_hits", "coll"))), 6).alias("pmi"))
    return scored.orderBy(F.desc("pmi"), "term").limit(k)


def near_phrase(docs: DataFrame, phrase: list[str], left: int = 5, right: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_hits, near (the terms of its merged slices, in order) for each document with a hit: one scan without a shuffle.

    A token is near a hit if one begins among the places that reach it; those are as many as the slice is wide.
    """
    m = len(phrase)

    def starts(t: Column) -> Column:
        return F.transform(t, lambda x, i: reduce(lambda a, b: a & b, [F.coalesce(F.get(t, i + k) == p, F.lit(False)) for k, p in enumerate(phrase)]))

    def reached(s: Column, i: Column) -> Column:
        first = F.greatest(i - (m + right) + 2, F.lit(1))
        return F.exists(F.slice(s, first, i + left + 2 - first), lambda x: x)

    def found(t: Column) -> Column:
        return let(starts(t), lambda s: F.struct(F.size(F.filter(s, lambda x: x)).cast("long").alias("n_hits"), F.when(F.exists(s, lambda x: x), F.filter(t, lambda x, i: reached(s, i))).alias("near")))

    rows = docs.select(F.col(key).alias("doc_id"), let(token_array(F.col(text)), lambda t: F.when(reduce(lambda a, b: a & b, [F.array_contains(t, p) for p in set(phrase)]), found(t))).alias("x"))
    # made by a generator, so that the filter isn't worked out on its own
    return rows.select("doc_id", F.inline(F.filter(F.array("x"), lambda x: x["n_hits"] > 0)))


def pmi_terms_of(docs: DataFrame, phrase: list[str], left: int = 5, right: int = 5, least: int = 4, k: int = 30, text: str = "text") -> DataFrame:
    """term, qpf, cf, pmi as pmi_terms() gives, from two scans of the texts: one for what is near, one to count these terms."""
    near = cut(near_phrase(docs, phrase, left, right, text=text))
    qpf = cut(near.select(F.explode("near").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("qpf")).filter(F.col("qpf") > least))
    whole = docs.select(token_array(F.col(text)).alias("__t"))
    cf = cut(whole.select(F.explode("__t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf")))
    one = near.agg(F.coalesce(F.sum("n_hits"), F.lit(0)).alias("n_hits")).join(cf.agg(F.sum("cf").alias("coll")))
    scored = qpf.join(cf, "term").join(F.broadcast(one))
    return scored.select("term", "qpf", "cf", F.round(pmi(*map(F.col, ("qpf", "cf", "n_hits", "coll"))), 6).alias("pmi")).orderBy(F.desc("pmi"), "term").limit(k)


#: Bytes of terms that a task looks at together, and pairs whose names are broadcast at most.
AT_ONCE, PAIRS = 12_000_000, 2_000_000


def _token_rows(docs: DataFrame, text: str, terms: str | None) -> DataFrame:
    """__s, the tokens of each row with spaces between: a column of them, or the text's, written for all the scans that follow."""
    return cut(docs.select(spaced(F.col(text)).alias("__s"))) if terms is None else docs.select(F.col(terms).alias("__s"))


def _coded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Vocabulary, numbers of the terms in it, their rows and places, of parts of batches with one column of spaced tokens, of about most bytes."""
    for batch in (part for whole in batches for part in slices_of(whole, 0, most)):
        lists = pc.split_pattern(batch[0].filter(pc.greater(pc.binary_length(batch[0]), 0)), " ")
        row, place = places_of(lists)
        if len(row):
            coded = lists.flatten().dictionary_encode()
            yield coded.dictionary, coded.indices.to_numpy().astype(np.int64), row, place


def _starts(vocabulary: pa.Array, ids: np.ndarray, row: np.ndarray, phrase: list[str]) -> np.ndarray:
    """Where a phrase begins among terms."""
    m, own = len(phrase), pc.fill_null(pc.index_in(pa.array(phrase, vocabulary.type), vocabulary), -1).to_numpy()
    n = max(len(ids) - (m - 1), 0)
    return np.flatnonzero(reduce(lambda a, b: a & b, [ids[k : n + k] == x for k, x in enumerate(own)]) & (row[:n] == row[m - 1 :]))


def _named(vocabulary: pa.Array, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([vocabulary.take(pa.array(first)), vocabulary.take(pa.array(second)), pa.array(n, pa.int64())], names=["t1", "t2", "n"])


def near_pairs(rows: DataFrame, phrase: list[str], left: int = 5, right: int = 5) -> DataFrame:
    """t1, t2, n, coll of rows of __s (tokens with spaces between): how often two are neighbours in the merged slices of a phrase; a row without terms tells its hits as n, and coll, all terms.

    Two neighbours are in one merged slice if both are in slices, since slices that touch are merged. Parts of a task are counted with numpy, and what they tell is summed in one shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vocabulary, ids, row, place in _coded(batches, AT_ONCE):
            at = _starts(vocabulary, ids, row, phrase)
            begin, end = at - np.minimum(place[at], left), np.minimum(at + len(phrase) + right, np.searchsorted(row, row[at], "right"))
            ends = np.bincount(begin, minlength=len(ids) + 1) - np.bincount(end, minlength=len(ids) + 1)
            inside_ = np.cumsum(ends)[:-1] > 0
            x = np.flatnonzero(inside_[:-1] & inside_[1:] & (row[:-1] == row[1:]))
            keys, n = np.unique(ids[x] * len(vocabulary) + ids[x + 1], return_counts=True)
            yield _named(vocabulary, keys // len(vocabulary), keys % len(vocabulary), n).append_column("coll", pa.nulls(len(n), pa.int64()))
            yield pa.record_batch([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([len(at)]), pa.array([len(ids)])], names=["t1", "t2", "n", "coll"])

    told = rows.select("__s").mapInArrow(run, "t1 string, t2 string, n long, coll long")
    return told.groupBy("t1", "t2").agg(F.sum("n").alias("n"), F.sum("coll").alias("coll"))


def pair_counts(rows: DataFrame, wanted: DataFrame, phrase: list[str] | None = None) -> DataFrame:
    """t1, t2, n of rows of __s (tokens with spaces between): how often each two of wanted (t1, t2) are neighbours, with a phrase only in rows that hold it; without t2, how often t1 stands in all rows.

    Up to PAIRS pairs are broadcast, and a task tells its sums once, at its end. With more, parts of a task tell all their pairs and terms, and the wanted ones are found by a join.
    """
    spark = rows.sparkSession
    pairs = wanted.select("t1", "t2").distinct()
    if pairs.limit(PAIRS + 1).count() > PAIRS:
        shared = None
    else:
        asked = pairs.toArrow()
        first, second = (asked[c].combine_chunks().cast(pa.string()) for c in ("t1", "t2"))
        known = pa.concat_arrays([first, second]).unique()
        if not len(known):
            return spark.createDataFrame([], "t1 string, t2 string, n long")
        places = [pc.index_in(x, known).to_numpy().astype(np.int64) for x in (first, second)]
        shared = spark.sparkContext.broadcast((known, np.sort(places[0] * len(known) + places[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = lambda terms, n: pa.record_batch([terms, pa.nulls(len(n), pa.string()), pa.array(n, pa.int64())], names=["t1", "t2", "n"])
        if shared is not None:
            known, keys = shared.value
            n_terms, n_pairs = np.zeros(len(known), np.int64), np.zeros(len(keys), np.int64)
        for vocabulary, ids, row, _ in _coded(batches, AT_ONCE):
            side = row[:-1] == row[1:]
            if phrase is not None:
                holds = np.zeros(row[-1] + 1, bool)
                holds[row[_starts(vocabulary, ids, row, phrase)]] = True
                side &= holds[row[:-1]]
            if shared is None:
                keys, n = np.unique((ids[:-1] * len(vocabulary) + ids[1:])[side], return_counts=True)
                yield _named(vocabulary, keys // len(vocabulary), keys % len(vocabulary), n)
                yield alone(vocabulary, np.bincount(ids, minlength=len(vocabulary)))
                continue
            own = pc.fill_null(pc.index_in(vocabulary, known), -1).to_numpy().astype(np.int64)[ids]
            n_terms += np.bincount(own[own >= 0], minlength=len(known))
            x = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0) & side)
            found = own[x] * len(known) + own[x + 1]
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            n_pairs += np.bincount(at[keys[at] == found], minlength=len(keys))
        if shared is not None:
            for a in range(0, len(keys), 100_000):
                at = a + np.flatnonzero(n_pairs[a : a + 100_000])
                yield _named(known, keys[at] // len(known), keys[at] % len(known), n_pairs[at])
            for a in range(0, len(known), 100_000):
                at = a + np.flatnonzero(n_terms[a : a + 100_000])
                yield alone(known.take(pa.array(at)), n_terms[at])

    told = rows.select("__s").mapInArrow(run, "t1 string, t2 string, n long")
    if shared is None:
        told = told.filter("t2 is null").unionByName(told.filter("t2 is not null").groupBy("t1", "t2").agg(F.sum("n").alias("n")).join(pairs, ["t1", "t2"], "left_semi"))
    return told.groupBy("t1", "t2").agg(F.sum("n").alias("n"))


def bounded_bigrams(docs: DataFrame, phrase: list[str], left: int = 5, right: int = 5, least: int = 4, text: str = "text", terms: str | None = None) -> tuple[DataFrame, DataFrame]:
    """t1, t2, qpf, low, high of neighbours in slices (a gap between slices parts them) with more than least occurrences there, and n_hits, coll.

    low and high bound how often two stand together at all: as often as in the documents with a hit at least, as often as the rarer of them
    at most. terms names a column of spaced tokens that is read instead of the text.
    """
    rows = _token_rows(docs, text, terms)
    told = cut(near_pairs(rows, phrase, left, right))
    near = told.filter(F.col("t1").isNotNull() & (F.col("n") > least)).select("t1", "t2", F.col("n").alias("qpf"))
    counted_ = cut(pair_counts(rows, near, phrase))
    low = counted_.filter("t2 is not null").withColumnRenamed("n", "low")
    one, two = (counted_.filter("t2 is null").select(F.col("t1").alias(t), F.col("n").alias(f"cf_{t}")) for t in ("t1", "t2"))
    bounds = near.join(low, ["t1", "t2"]).join(one, "t1").join(two, "t2").select("t1", "t2", "qpf", "low", F.least("cf_t1", "cf_t2").alias("high"))
    return cut(bounds), cut(told.filter("t1 is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"), F.sum("coll").alias("coll")))


def pmi_bigrams(docs: DataFrame, phrase: list[str], left: int = 5, right: int = 5, least: int = 4, k: int = 30, text: str = "text", approximate: bool = False, terms: str | None = None) -> DataFrame:
    """t1, t2, qpf, cf, pmi: the k best neighbours in slices, with exact frequencies; approximate: with their upper bounds, without counting.

    A pair's PMI lies between those by the bounds of its frequency. The k-th best lower end leaves out pairs whose upper end doesn't reach it;
    only what is left and whose bounds differ is counted over all documents. terms names a column of spaced tokens that is read instead of the text.
    """
    rows = _token_rows(docs, text, terms)
    bounds, one = bounded_bigrams(rows, phrase, left, right, least, terms="__s")
    score = lambda cf: pmi(F.col("qpf"), F.col(cf), F.col("n_hits"), F.col("coll"))
    ends = bounds.join(F.broadcast(one)).withColumns({"worst": score("high"), "best": score("low")})
    if approximate:
        known = ends.withColumn("cf", F.col("high"))
    else:
        kth = ends.orderBy(F.desc("worst")).limit(k).agg(F.min("worst"), F.count(F.lit(1))).first()
        # a margin above what rounding changes
        open_ = cut(ends.filter(F.col("best") >= (kth[0] - 1e-6 if kth[1] == k else 0.0)))
        exact = pair_counts(rows, open_.filter("low < high")).filter("t2 is not null").withColumnRenamed("n", "exact")
        known = open_.join(exact, ["t1", "t2"], "left").withColumn("cf", F.coalesce("exact", "low"))
    return known.select("t1", "t2", "qpf", "cf", F.round(score("cf"), 6).alias("pmi")).orderBy(F.desc("pmi"), "t1", "t2").limit(k)


def near_hits(rows: DataFrame, phrase: list[str]) -> DataFrame:
    """doc_id, start, size of every place of one phrase in rows of doc_id, __t (terms): found inside the row."""
    t = F.col("__t")
    at = F.filter(F.transform(t, lambda x, i: i), lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(t, i + k) == p, F.lit(False)) for k, p in enumerate(phrase)]))
    return rows.select("doc_id", F.explode(at).alias("start")).select("doc_id", "start", F.lit(len(phrase)).alias("size"))


def snippets(docs: DataFrame, phrase: list[str], left: int, right: int, most: int = 200, text: str = "text") -> DataFrame:
    """doc_id, start, snippet: the first hit of each of the first documents with one, by id, with the terms around it."""
    rows = docs.select("doc_id", token_array(F.col(text)).alias("__t"))
    hits = near_hits(rows, phrase).groupBy("doc_id").agg(F.min("start").alias("start")).orderBy("doc_id").limit(most)
    first = F.greatest(F.col("start") - left, F.lit(0))
    around = F.slice("__t", first + 1, F.col("start") + len(phrase) + right - first)
    return rows.join(hits, "doc_id").select("doc_id", F.col("start").cast("long").alias("start"), F.array_join(around, " ").alias("snippet"))


def pmi_entities(hits: DataFrame, mentions: DataFrame, coll: DataFrame, left: int = 5, right: int = 5, least: int = 1, k: int = 30) -> DataFrame:
    """phrase_id, qpf, cf, pmi: dictionary phrases near hits; a phrase counts once for each slice it overlaps."""
    near = overlapping(merged(slices(hits, left, right)), mentions).groupBy("phrase_id").agg(F.count(F.lit(1)).alias("qpf")).filter(F.col("qpf") >= least)
    cf = mentions.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("cf"))
    n = hits.agg(F.count(F.lit(1)).alias("n_hits"))
    joined = near.join(cf, "phrase_id").join(F.broadcast(coll)).join(F.broadcast(n))
    scored = joined.select("phrase_id", "qpf", "cf", F.round(pmi(*map(F.col, ("qpf", "cf", "n_hits", "coll_len"))), 6).alias("pmi"))
    return scored.orderBy(F.desc("pmi"), "phrase_id").limit(k)

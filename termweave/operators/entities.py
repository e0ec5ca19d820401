"""A dictionary of phrases that name entities: mentions in texts, ambiguity, expansion of mentions, scores of entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.text import tokens as token_array
from .blooms import bloom, may_hold
from .index import cut, places_of, run_hashes, slices_of

#: Phrases up to which a dictionary's hashes are broadcast (16 bytes each and their terms); beyond it a Bloom filter of them is, and what passes is shuffled.
BROADCAST_PHRASES = 500_000


def names(items: DataFrame, size: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """phrase, terms, entity: every run of size terms of an item names the item, once."""
    t = F.col("__t")
    runs = F.transform(F.sequence(F.lit(1), F.size(t) - (size - 1)), lambda i: F.slice(t, i, size))
    rows = items.select(F.col(key).alias("entity"), token_array(F.col(text)).alias("__t")).filter(F.size("__t") >= size)
    return rows.select("entity", F.explode(runs).alias("terms")).distinct().select(F.array_join("terms", " ").alias("phrase"), "terms", "entity")


def _runs_of(rows: DataFrame, sizes: list[int], only: Broadcast | None = None) -> DataFrame:
    """Columns of rows (but the last, __t: array<string>) with start, size, hash, check for each run of these sizes of __t; only: sorted hashes, other runs are left out."""
    kept = rows.columns[:-1]
    hashed = rows.select(*kept, F.transform("__t", lambda x: F.xxhash64(x)).alias("__h"))
    schema = StructType([*[rows.schema[c] for c in kept], *[StructField(c, k) for c, k in (("start", IntegerType()), ("size", IntegerType()), ("hash", LongType()), ("check", IntegerType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_of(whole, len(kept)):
                h = batch[len(kept)].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                row, place = places_of(batch[len(kept)])
                for n in sizes:
                    if len(h) < n:
                        continue
                    key, check = run_hashes(h, n)
                    own = row[: len(key)] == row[n - 1 :]
                    if only is not None:
                        known = only.value
                        own &= known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else False
                    i = np.flatnonzero(own)
                    for a in range(0, len(i), 100_000):
                        x = i[a : a + 100_000]
                        of = pa.array(row[x])
                        yield pa.record_batch([*[batch[c].take(of) for c in range(len(kept))], pa.array(place[x], pa.int32()), pa.array(np.full(len(x), n, np.int32)), pa.array(key[x]), pa.array(check[x])], names=schema.names)

    return hashed.mapInArrow(run, schema)


def mentions(docs: DataFrame, dictionary: DataFrame, phrase: str = "phrase", key: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """phrase, doc_id, start, size: every place of every phrase of a dictionary (phrase, terms: array<string>), overlapping ones too.

    Terms are hashed once, and runs of the sizes that the dictionary has by their terms' hashes: 64 bits to meet the
    dictionary by and 32 that are mixed otherwise to tell. A frequent word in many phrases makes no rows. While the
    dictionary has at most most phrases (None: BROADCAST_PHRASES), its hashes are broadcast, other runs aren't made rows,
    and no run is shuffled; of a larger one the bits of a Bloom filter are asked, and only runs that pass it are shuffled.
    """
    known = dictionary.select(F.col(phrase).alias("phrase"), F.col("terms").alias("__t")).distinct().filter(F.size("__t") > 0)
    known = cut(known)
    sizes = sorted(r["size"] for r in known.select(F.size("__t").alias("size")).distinct().collect())
    # the run of all terms of a phrase is the phrase
    known = cut(_runs_of(known.select("phrase", F.size("__t").alias("__n"), "__t"), sizes).filter("size = __n").drop("start", "__n"))
    most, n = BROADCAST_PHRASES if most is None else most, known.count()
    rows = docs.select(F.col(key).alias("doc_id"), token_array(F.col(text)).alias("__t"))
    if n > most:
        placed = may_hold(_runs_of(rows, sizes), "hash", bloom(known, "hash", n), n)
        return placed.join(known, ["hash", "check", "size"]).select("phrase", "doc_id", "start", "size")
    only = docs.sparkSession.sparkContext.broadcast(np.sort(known.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64)))
    return _runs_of(rows, sizes, only).join(F.broadcast(known), ["hash", "check", "size"]).select("phrase", "doc_id", "start", "size")


def detected(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """doc_id, no, start, size, entity: what a tagger of texts tells, in its order: by where hits end, the longest first of those that end at one place.

    A run of terms that stands in the dictionary (terms, entity) several times is told once, with its first entity in order of
    entities. no counts from 0 in each document.
    """
    known = dictionary.groupBy("terms").agg(F.min("entity").alias("entity")).select("terms", F.array_join("terms", " ").alias("phrase"), "entity")
    found = mentions(docs, known, "phrase", key, text, most).join(known.select("phrase", "entity"), "phrase")
    order = Window.partitionBy("doc_id").orderBy(F.col("start") + F.col("size"), F.desc("size"))
    return found.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("no"), F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"), "entity")


def ambiguity(dictionary: DataFrame) -> DataFrame:
    """phrase, entity, n for each entity of a phrase that names several (n of them)."""
    distinct = dictionary.select("phrase", "entity").distinct()
    n = distinct.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return distinct.join(n, "phrase").select("phrase", "entity", "n")


def collisions(dictionary: DataFrame) -> DataFrame:
    """n_entities, n_phrases: how many phrases name so many entities."""
    n = dictionary.select("phrase", "entity").distinct().groupBy("phrase").agg(F.count(F.lit(1)).alias("n_entities"))
    return n.groupBy("n_entities").agg(F.count(F.lit(1)).alias("n_phrases"))


def expanded(hits: DataFrame, ambiguous: DataFrame, kept: str = "phrase") -> DataFrame:
    """Hits with entity (string): a row for each entity that an ambiguous phrase names, else the phrase itself."""
    known = ambiguous.select(F.col("phrase").alias("__p"), F.col("entity").cast("string").alias("__e"))
    return hits.join(known, F.col(kept) == F.col("__p"), "left").withColumn("entity", F.coalesce("__e", kept)).drop("__p", "__e")


def suggested(dictionary: DataFrame, query: list[str]) -> DataFrame:
    """phrase, n_entities of the phrases whose terms hold the query's terms in a row, in order of the phrase."""
    t, n = F.col("terms"), len(query)
    asked = F.array(*map(F.lit, query))
    holds = F.exists(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.slice(t, i, n) == asked)
    return dictionary.filter(holds).groupBy("phrase").agg(F.count_distinct("entity").alias("n_entities"))


def lengths(dictionary: DataFrame) -> DataFrame:
    """size, n: phrases by number of terms."""
    return dictionary.select("phrase", F.size("terms").cast("long").alias("size")).distinct().groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def frequencies(hits: DataFrame) -> DataFrame:
    """freq, n: phrases by number of their hits."""
    return hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("freq")).groupBy("freq").agg(F.count(F.lit(1)).alias("n"))


def priors(counts: DataFrame) -> DataFrame:
    """phrase, entity, n, log_p: the log share of an entity in the uses of a phrase (phrase, entity, n)."""
    total = counts.groupBy("phrase").agg(F.sum("n").alias("total"))
    return counts.join(total, "phrase").select("phrase", "entity", "n", F.ln(F.col("n") / F.col("total")).alias("log_p"))


def log_pmi(near: DataFrame, frequency: DataFrame, n_near: DataFrame, coll: DataFrame) -> DataFrame:
    """phrase, log_pmi from near (phrase, qpf), frequency (phrase, cf) and one row each of n_near (n_hits) and coll (coll_len)."""
    joined = near.join(frequency, "phrase").join(F.broadcast(n_near)).join(F.broadcast(coll.select("coll_len")))
    p = (F.col("qpf") / F.col("coll_len")) / ((F.col("cf") / F.col("coll_len")) * (F.col("n_hits") / F.col("coll_len")))
    return joined.select("phrase", "qpf", "cf", F.ln(p).alias("log_pmi"))


def split_evenly(scored: DataFrame, dictionary: DataFrame) -> DataFrame:
    """entity, score: sum over its phrases of log_pmi less the log of how many entities the phrase names."""
    distinct = dictionary.select("phrase", "entity").distinct()
    n = distinct.groupBy("phrase").agg(F.count(F.lit(1)).alias("k"))
    one = F.col("log_pmi") - F.ln("k")
    return scored.join(distinct, "phrase").join(n, "phrase").groupBy("entity").agg(F.round(F.sum(one), 6).alias("score"))


def with_entity_prior(scored: DataFrame, dictionary: DataFrame, prior: DataFrame) -> DataFrame:
    """entity, score: sum over its phrases of log_pmi plus the entity's own score (entity, escore), less the log of how many phrases name it."""
    distinct = dictionary.select("phrase", "entity").distinct()
    n = distinct.groupBy("entity").agg(F.count(F.lit(1)).alias("k"))
    one = F.col("log_pmi") + F.col("escore") - F.ln("k")
    return scored.join(distinct, "phrase").join(n, "entity").join(prior, "entity").groupBy("entity").agg(F.round(F.sum(one), 6).alias("score"))


def linked(scored: DataFrame, prior: DataFrame) -> DataFrame:
    """entity, score: sum over its phrases of log_pmi plus log_p of (phrase, entity, log_p)."""
    return scored.join(prior, "phrase").groupBy("entity").agg(F.round(F.sum(F.col("log_pmi") + F.col("log_p")), 6).alias("score"))


def category_pmi(counted: DataFrame, over: int = 4, k: int = 5) -> DataFrame:
    """category, pmi: the k best of (category, near, total) that come more than over times near; the share near against the share overall."""
    whole = counted.agg(F.sum("near").alias("all_near"), F.sum("total").alias("all_total"))
    p = (F.col("near") / F.col("all_near")) / (F.col("total") / F.col("all_total"))
    return counted.filter(F.col("near") > over).join(F.broadcast(whole)).select("category", F.round(F.ln(p), 6).alias("pmi")).orderBy(F.desc("pmi"), "category").limit(k)


#: Scores of an entity over ranked documents, and the same with the posterior of the name: rm and drm multiply by it, gdrm and gnb add its log.
METHODS = ("rm", "drm", "gdrm", "gnb", "wrm", "wdrm", "wgdrm", "wgnb")


def relevance(top: DataFrame, hits: DataFrame, named: DataFrame, doc_stats: DataFrame, coll: DataFrame) -> DataFrame:
    """entity and a score for each of METHODS, over ranked documents (doc_id, posterior), hits (phrase, doc_id) and named (phrase, entity, log_p)."""
    c = cut(hits.groupBy("phrase", "doc_id").agg(F.count(F.lit(1)).alias("c")))
    cf = c.groupBy("phrase").agg(F.sum("c").alias("cf"))
    x = c.join(top.select("doc_id", "posterior"), "doc_id").join(doc_stats, "doc_id").join(cf, "phrase").join(F.broadcast(coll.select("coll_len"))).join(named, "phrase")
    rate, background = F.col("c") / F.col("len"), F.col("cf") / F.col("coll_len")
    scores = {"rm": F.col("posterior") * rate, "drm": F.col("posterior") * rate / background, "gdrm": F.ln("posterior") + F.ln(rate) - F.ln(background), "gnb": F.ln(rate) - F.ln(background)}
    scores |= {f"w{m}": s * F.exp("log_p") if m in ("rm", "drm") else s + F.col("log_p") for m, s in scores.items()}
    return x.groupBy("entity").agg(*[F.round(F.sum(s), 6).alias(m) for m, s in scores.items()])


def expert_scores(scores: DataFrame, dictionary: DataFrame) -> DataFrame:
    """entity and the mean of each score over all forms that name the entity, those without a score as 0; from scores by phrase."""
    measured = [c for c in scores.columns if c != "phrase"]
    forms = dictionary.select("phrase", "entity").distinct()
    n = forms.groupBy("entity").agg(F.count(F.lit(1)).alias("forms"))
    total = forms.join(scores, "phrase").groupBy("entity").agg(*[F.sum(c).alias(c) for c in measured])
    return total.join(n, "entity").select("entity", *[F.round(F.col(c) / F.col("forms"), 6).alias(c) for c in measured])


def spread_scores(hits: DataFrame, top: DataFrame, dictionary: DataFrame, odds: DataFrame) -> DataFrame:
    """entity, score: sum over mentions of 1 / mentions of the entity, times sum over documents of 1 / entities of the document times posterior times odds.

    hits: phrase, doc_id; top: doc_id, posterior; odds: entity, odds.
    """
    own = hits.select("phrase", "doc_id").join(dictionary.select("phrase", "entity").distinct(), "phrase")
    # written once: texts are searched for mentions in one pass
    by = cut(own.groupBy("entity", "doc_id").agg(F.count(F.lit(1)).alias("c")))
    n_mentions = by.groupBy("entity").agg(F.sum("c").alias("m"))
    n_entities = by.groupBy("doc_id").agg(F.count(F.lit(1)).alias("e"))
    x = by.join(n_mentions, "entity").join(n_entities, "doc_id").join(top.select("doc_id", "posterior"), "doc_id").join(odds, "entity")
    return x.groupBy("entity").agg(F.round(F.sum(F.col("c") / F.col("m") / F.col("e") * F.col("posterior") * F.col("odds")), 6).alias("score"))


def bag_scores(hits: DataFrame, queries: DataFrame, weight: float = 0.8) -> DataFrame:
    """qid, doc_id, score: Jelinek-Mercer over documents as bags of phrases; queries: qid, phrase, weight. A document's length is its number of hits."""
    c = cut(hits.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("c")))
    length = c.groupBy("doc_id").agg(F.sum("c").alias("len"))
    cf = c.groupBy("phrase").agg(F.sum("c").alias("cf"))
    coll = c.agg(F.sum("c").alias("coll"))
    asked = cut(queries.join(cf, "phrase").join(F.broadcast(coll)).select("qid", "phrase", "weight", ((1 - weight) * F.col("cf") / F.col("coll")).alias("p")))
    # all of a query's phrases as if a document had none of them, and what each that it has adds
    whole = asked.groupBy("qid").agg(F.sum(F.col("weight") * F.ln("p")).alias("base"), F.sum("weight").alias("total"))
    gain = F.col("weight") * (F.ln(F.col("p") + weight * F.col("c") / F.col("len")) - F.ln("p"))
    gains = c.join(length, "doc_id").join(asked, "phrase").groupBy("qid", "doc_id").agg(F.sum(gain).alias("gains"))
    return gains.join(F.broadcast(whole), "qid").select("qid", "doc_id", F.round((F.col("base") + F.col("gains")) / F.col("total"), 6).alias("score"))

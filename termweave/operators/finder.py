"""What a caller asks for at once: a phrase with all that is near it, a page of sentences, running numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens as token_array
from . import cooccur, index, search


def find_phrase(docs: DataFrame, query: list[str], mentions: DataFrame | None = None, method: str = "phrase", width: int = 32, stopwords: list[str] | None = None, count: int = 200, pull_slices: bool = False, score_terms: bool = False, num_terms: int = 30, min_term_frequency: int = 4, find_entities: bool = False, num_entities: int = 30, min_entity_frequency: int = 4, left: int = 1, right: int = 1, text: str = "text") -> DataFrame:
    """kind, name, n, score, doc_id as one table of what is asked.

    hits: how many there are (n). result: the first hit (n, its place) of each of the first count documents, with the terms from left before to right
    behind it as name if pull_slices. term (score_terms): how often (n) more than min_term_frequency it stands in the merged slices around hits, and its PMI as
    score; entity (find_entities): how many slices mention it, min_entity_frequency at least, and its PMI, of mentions (phrase, doc_id, start, size).
    Hits are found by one of search.METHODS; an unknown one is an error.
    """
    toks = index.tokens(docs, text=text)
    hits = index.cut(search.find_hits(toks, query, method, width, stopwords))
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda kind, rows, name, n, score, doc: rows.select(F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"), score.alias("score"), doc.alias("doc_id"))
    key = docs.schema["doc_id"].dataType.simpleString()
    out = shape("hits", hits.agg(F.count(F.lit(1)).alias("x")), F.lit(""), F.col("x"), none("double"), none(key))
    first = hits.groupBy("doc_id").agg(F.min(F.struct("start", "size")).alias("x")).orderBy("doc_id").limit(count).select("doc_id", "x.*")
    if pull_slices:
        begin = F.greatest(F.col("start") - left, F.lit(0))
        told = docs.select("doc_id", token_array(F.col(text)).alias("__t")).join(F.broadcast(first), "doc_id")
        first = told.select("doc_id", "start", F.array_join(F.slice("__t", begin + 1, F.col("start") + F.col("size") + right - begin), " ").alias("terms"))
    out = out.unionByName(shape("result", first, F.col("terms") if pull_slices else F.lit(""), F.col("start"), none("double"), F.col("doc_id")))
    if score_terms:
        terms = cooccur.pmi_terms(toks, index.document_terms(docs, text), hits, left, right, min_term_frequency, num_terms)
        out = out.unionByName(shape("term", terms, F.col("term"), F.col("qpf"), F.col("pmi"), none(key)))
    if find_entities:
        if mentions is None:
            raise ValueError("entities are found among mentions")
        coll = index.collection_stats(docs, text).select("coll_len")
        named = cooccur.pmi_entities(hits, mentions.withColumnRenamed("phrase", "phrase_id"), coll, left, right, min_entity_frequency, num_entities)
        out = out.unionByName(shape("entity", named, F.col("phrase_id"), F.col("qpf"), F.col("pmi"), none(key)))
    return out


def search_sentences(sentences: DataFrame, terms: list[str], operation: str = "or", offset: int = 0, count: int = 10) -> DataFrame:
    """doc_id, no, total_hits of a page of the sentences (doc_id, no, terms) with any (or) or all (and) of the terms, in order of documents and numbers.

    total_hits counts all of them; a page behind the last hit has no rows. Without terms nothing matches.
    """
    if operation not in ("or", "and"):
        raise ValueError(f"no operation {operation}")
    asked = sorted(set(terms))
    if not asked:
        return sentences.select("doc_id", "no", F.lit(0).cast("long").alias("total_hits")).filter(F.lit(False))
    wanted = F.array(*map(F.lit, asked))
    holds = F.arrays_overlap("terms", wanted) if operation == "or" else F.size(F.array_intersect("terms", wanted)) == len(asked)
    found = index.cut(sentences.filter(holds).select("doc_id", "no"))
    total = found.agg(F.count(F.lit(1)).alias("total_hits"))
    return found.orderBy("doc_id", "no").offset(offset).limit(count).join(F.broadcast(total))


def running(rows: DataFrame, by: list[str], order: list[str], name: str = "no") -> DataFrame:
    """Adds the place of each row among those of its by, from 0 in order: a group of any size is dealt over the ranges of a sort.

    Ranges are written once and numbered by what they hold; what stands before a range's rows of a group is a sum over a row for each range and group that
    begins or ends in it.
    """
    ordered = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = index.cut(ordered.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # ids of one range grow by one from row to row
    return placed.join(offsets, [*by, "__part"]).withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__first", "__before")

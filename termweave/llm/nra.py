"""Ranked lexical search by sequential reads of impact-sorted lists (NRA: no random access).

Each item asks for the k documents of highest score. A term's impact on a document is an integer that depends on the term's
weight, its occurrences and the document's length; a score sums the impacts of the item's terms, repeats included.

Plan. (1) One scan of the texts makes segments: the postings of about SEGMENT occurrences of the items' terms, of whole
documents, one row each; nothing is shuffled but counts by term. (2) With the counts known, each segment's lists are sorted by
impact, and the heads of its lists give lower bounds of some of its documents' scores; the k-th best of all segments is a
threshold that no result falls below. (3) Each segment answers each item: all lists are read on from the front in steps that double; a
document's interval goes from the sum of what was read of it to that plus the last impacts read of the lists that haven't shown it.
Once a document that no list has shown can't reach the threshold (its own, or that of the k-th lower bound here), only
documents whose upper end reaches it are followed. Reading goes on until none of these is open, that is until membership, ties
and scores are settled. (4) The k best of the segments' answers are ranked by item.

Scale. Texts are read once and postings stay with the task that made them, so a common term costs each segment its own part of
the list. Items come in blocks of about TERMS terms of theirs (of one item, if it has more), which are broadcast; each
block scans the texts. Shuffled are a count for each term and segment, and k rows at most for each item and segment.

Defined results: terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased; null texts have
none. Each row of documents with a key is a document of its own, rows without one are left out of the counts too. Rows that
share an item's id are one item with the text that sorts first; an item without id is left out, one without terms
has no results. Documents of equal score go by id, equal ids by length of document. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, settled, small_batches, table

#: Postings of a segment, but for a single document that has more.
SEGMENT = 1 << 18
#: Terms of the items of a block, about, with each item's own counted apart.
TERMS = 200_000
#: Entries of each list that make the first bounds.
HEAD = 64
#: Bytes that end a term become blanks, A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _counted(items: DataFrame, item: str, text: str) -> DataFrame:
    """item_id, n_terms (its distinct ones), terms, counts: one row for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms(t)) for t in batch[1].to_pylist()]
            yield pa.record_batch([batch[0], pa.array([len(c) for c in found], pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["item_id", "n_terms", "terms", "counts"])

    one = items.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    return one.mapInArrow(run, "item_id long, n_terms long, terms array<binary>, counts array<long>")


class Items:
    """A block of items, on the driver and in each task: their terms by number, and for each item its terms and how often they occur."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.number = {t: k for k, t in enumerate(sorted({t for ts in rows["terms"] for t in ts}))}
        self.ids = [int(i) for i in rows["item_id"]]
        self.terms = [np.array([self.number[t] for t in ts], np.int64) for ts in rows["terms"]]
        self.counts = [np.array(c, np.int64) for c in rows["counts"]]


def _array(x: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(x, kind)


_SEGMENT = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("keys", pa.binary()), ("lengths", pa.binary()), ("lists", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary()), ("tfs", pa.binary())])


def segments(docs: DataFrame, items: Items, most: int) -> DataFrame:
    """Rows of n_docs, n_terms (of documents with a term) and packed: keys and lengths of documents with postings; the numbers and sizes of lists, and their postings' documents and occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(items.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        keys: list[int] = []
        lengths: list[int] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = n_docs = n_terms = 0

        def packed() -> pa.RecordBatch:
            term = np.concatenate([t for t, _ in held] + [np.zeros(0, np.int32)])
            tf = np.concatenate([f for _, f in held] + [np.zeros(0, np.int32)])
            doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for t, _ in held])
            order = np.argsort(term, kind="stable")
            lists, sizes = np.unique(term, return_counts=True)
            row = [n_docs, n_terms, np.array(keys, "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), lists.astype("<i4").tobytes(), sizes.astype("<i4").tobytes(), doc[order].astype("<i4").tobytes(), tf[order].astype("<i4").tobytes()]
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _SEGMENT, strict=True)], schema=_SEGMENT)

        for batch in batches:
            for key, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                found = Counter(filter(number.__contains__, words))
                if found:
                    keys.append(key)
                    lengths.append(len(words))
                    held.append((np.fromiter((number[t] for t in found), np.int32, len(found)), np.fromiter(found.values(), np.int32, len(found))))
                    size += len(found)
                if size >= most:
                    yield packed()
                    keys, lengths, held, size, n_docs, n_terms = [], [], [], 0, 0, 0
        if n_docs:
            yield packed()

    return docs.mapInArrow(run, "n_docs long, n_terms long, keys binary, lengths binary, lists binary, sizes binary, docs binary, tfs binary")


def _frequencies(found: DataFrame) -> DataFrame:
    """term, df over all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists, sizes in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                yield pa.record_batch([pa.array(_array(lists)), pa.array(_array(sizes).astype(np.int64))], names=["term", "df"])

    return found.select("lists", "sizes").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k largest, in no order."""
    return scores if len(scores) <= k else np.partition(scores, len(scores) - k)[len(scores) - k :]


class Lists:
    """A segment's lists by impact."""

    def __init__(self, lists: bytes, sizes: bytes, docs: bytes, impacts: bytes, n: int) -> None:
        self.lists, self.docs, self.impacts, self.n = _array(lists), _array(docs), _array(impacts, "<i8"), n
        self.ends = np.cumsum(_array(sizes).astype(np.int64))
        self.begins = self.ends - _array(sizes)

    def of(self, wanted: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, end and factor of the lists for an item's terms that occur here."""
        at = np.minimum(np.searchsorted(self.lists, wanted), len(self.lists) - 1)
        here = self.lists[at] == wanted
        return self.begins[at[here]], self.ends[at[here]], counts[here]

    def read(self, begin: np.ndarray, upto: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document, impact with its factor and list of the entries from begin to upto of each list."""
        n = upto - begin
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        return self.docs[at], self.impacts[at] * factor[which], which

    def heads(self, wanted: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
        """Lower bounds of k documents at most, from the first entries of the lists."""
        begin, end, factor = self.of(wanted, counts)
        doc, impact, _ = self.read(begin, np.minimum(begin + HEAD, end), factor)
        low = np.zeros(self.n, np.int64)
        np.add.at(low, doc, impact)
        return _best(low[low > 0], k)

    def search(self, wanted: np.ndarray, counts: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of those that may be among the k best, all that do and reach the threshold; and how many entries were read."""
        begin, end, factor = self.of(wanted, counts)
        none, n_read, step, at = np.zeros(0, np.int64), 0, HEAD, begin
        low, open_to_all = np.zeros(self.n, np.int64), True
        follow = np.ones(self.n, bool)
        shown_doc, shown_list = none.astype(np.int32), none
        while True:
            upto = np.minimum(at + step, end)
            doc, impact, which = self.read(at, upto, factor)
            n_read += len(doc)
            kept = follow[doc]
            doc, impact, which = doc[kept], impact[kept], which[kept]
            np.add.at(low, doc, impact)
            at, step = upto, 2 * step
            # no entry behind is larger than the last one read
            rest = np.where(at < end, self.impacts[np.maximum(at - 1, 0)] * factor, 0) if len(at) else none
            unseen = int(rest.sum())
            shown_doc, shown_list = np.concatenate([shown_doc, doc]), np.concatenate([shown_list, which])
            seen = np.unique(shown_doc)
            floor = max(threshold, 1, int(_best(low[seen], k).min()) if len(seen) >= k else 0)
            if open_to_all and unseen >= floor:
                continue
            open_to_all = False
            missing = np.full(self.n, unseen)
            np.subtract.at(missing, shown_doc, rest[shown_list])
            may = seen[low[seen] + missing[seen] >= floor]
            if not (missing[may] > 0).any():
                return may, low[may], n_read
            follow = np.zeros(self.n, bool)
            follow[may] = True
            kept = follow[shown_doc]
            shown_doc, shown_list = shown_doc[kept], shown_list[kept]


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _indexed(found: DataFrame, items: Items, weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """keys, lists, sizes, docs, impacts with lists by impact, and bounds: item's number and lower bounds of k documents."""
    sent = found.sparkSession.sparkContext.broadcast((items.terms, items.counts, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts, w = sent.value
        for batch in batches:
            for keys, lengths, lists, sizes, docs, tfs in zip(*(batch[c].to_pylist() for c in ("keys", "lengths", "lists", "sizes", "docs", "tfs")), strict=True):
                term, doc = np.repeat(_array(lists), _array(sizes)), _array(docs)
                tf, m = _array(tfs).astype(np.int64), 75 + (25 * _array(lengths, "<i8") * n) // total
                impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                order = np.lexsort((-impact, term))
                own = [lists, sizes, doc[order].tobytes(), impact[order].astype("<i8").tobytes()]
                index = Lists(*own, len(m))
                low = [index.heads(t, c, k).tolist() if len(own[2]) else [] for t, c in zip(wanted, counts, strict=True)]
                bounds = [{"item": i, "low": x} for i, x in enumerate(low) if x]
                yield pa.record_batch([*(pa.array([x], pa.binary()) for x in (keys, lengths, *own)), pa.array([bounds], pa.list_(pa.struct([("item", pa.int32()), ("low", pa.list_(pa.int64()))])))], names=["keys", "lengths", "lists", "sizes", "docs", "impacts", "bounds"])

    return found.filter("length(lists) > 0").mapInArrow(run, "keys binary, lengths binary, lists binary, sizes binary, docs binary, impacts binary, bounds array<struct<item:int,low:array<long>>>")


def _answers(index: DataFrame, items: Items, thresholds: dict[int, int], k: int) -> DataFrame:
    """item_id, doc_id, length, score, n_read: each segment's documents that may be among an item's k best."""
    sent = index.sparkSession.sparkContext.broadcast((items.ids, items.terms, items.counts, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, counts, least = sent.value
        for batch in batches:
            for keys, lengths, lists, sizes, docs, impacts in zip(*(batch[c].to_pylist() for c in ("keys", "lengths", "lists", "sizes", "docs", "impacts")), strict=True):
                key, length = _array(keys, "<i8"), _array(lengths, "<i8")
                segment, rows = Lists(lists, sizes, docs, impacts, len(key)), []
                for i, (t, c) in enumerate(zip(wanted, counts, strict=True)):
                    doc, score, n_read = segment.search(t, c, k, least.get(i, 0))
                    best = np.lexsort((length[doc], key[doc], -score))[:k]
                    rows.append((np.full(len(best), ids[i]), key[doc[best]], length[doc[best]], score[best], np.full(len(best), n_read)))
                yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*rows, strict=True)], names=["item_id", "doc_id", "length", "score", "n_read"])

    return index.drop("bounds").mapInArrow(run, "item_id long, doc_id long, length long, score long, n_read long")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", segment: int = SEGMENT, block: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    return settled(lambda: _ranked(docs, items, k, key, text, item, segment, block))


def _ranked(docs: DataFrame, items: DataFrame, k: int, key: str, text: str, item: str, segment: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    asked = materialise(_counted(items, item, text).filter("n_terms > 0"))
    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null")
    blocks = (asked.agg(F.sum("n_terms")).first()[0] or 0) // block + 1
    out = spark.createDataFrame([], "item_id long, doc_id long, length long, score long")
    for b in range(blocks):
        items_now = Items(asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "terms", "counts").toPandas())
        if not items_now.ids:
            continue
        found = materialise(segments(read, items_now, segment))
        n, total = found.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n:
            break
        weights = np.zeros(len(items_now.number), np.int64)
        for r in _frequencies(found).collect():  # a row for each term of the block at most
            weights[r.term] = weight(r.df, n)
        index = materialise(_indexed(found, items_now, weights, n, total, k))
        lows = index.select(F.explode("bounds").alias("b")).select("b.item", F.explode("b.low").alias("low"))
        kth = lows.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).filter(F.col("place") == k)
        thresholds = {r["item"]: r["low"] for r in kth.select("item", "low").collect()}  # a row for each item of the block at most
        out = out.union(materialise(_answers(index, items_now, thresholds, k).drop("n_read")))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "length")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with items as (select item_id, min(text) as text from benchmark where item_id is not null group by item_id),
asked as (
  select item_id, term, count(*) as qtf from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from items)
  group by all),
docs as (
  select row_number() over () as no, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where doc_id is not null and text is not null),
sizes as (select no, doc_id, len(terms)::bigint as n from docs where len(terms) > 0),
whole as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes),
postings as (
  select no, term, count(*) as tf from (select no, unnest(terms) as term from docs)
  where term in (select term from asked) group by all),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, whole group by term, n_docs),
scored as (
  select a.item_id, p.no, sum(a.qtf * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + ((25 * s.n * g.n_docs) // g.n_terms)))))::bigint as score
  from asked a join postings p on p.term = a.term join weights w on w.term = a.term join sizes s on s.no = p.no cross join whole g
  group by a.item_id, p.no),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id, n) as rank, doc_id, score
  from scored c join sizes s on s.no = c.no where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""

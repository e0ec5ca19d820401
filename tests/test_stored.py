"""Stored corpora: joins without a shuffle, pushed filters, pruned folders, segments; Bloom filters and taggers."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from termweave.operators import blooms, entities, index, search, segments, store


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(k, "\n".join(" ".join(rng.choices(["a", "b", "c", "of", "the", "x"], k=rng.randrange(0, 9))) for _ in range(rng.randrange(1, 6))), rng.choice(["de", "en", None]), rng.randrange(4000)) for k in range(80)]
    return spark.createDataFrame([*rows, (80, None, "de", None), (81, "", "07", 3)], "doc_id long, text string, lang string, n_chars long")


@pytest.fixture(scope="module")
def kept(spark, docs):
    hits = search.phrases(index.tokens(docs), {1: ["of", "the"]}).select(F.lit("of the").alias("phrase"), "doc_id", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"))
    spans = spark.createDataFrame([(0, "b", 0, 2), (1, "i", 1, 3)], "doc_id long, tag string, begin long, end long")
    out = store.store(docs, f"{index.shared(spark)}/{uuid.uuid4().hex}", hits, spans, buckets=3)
    yield out
    out.close()


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def all_buckets(spark):
    """Buckets that are read show in the plan only while a scan of them keeps to buckets."""
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_tables_of_documents_join_without_a_shuffle(kept, docs, no_broadcast):
    plan = _plan(kept.tokens_of_sentences())
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    plan = _plan(kept.around_hits(2, 2))
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    toks = {(r.doc_id, r.pos, r.term) for r in index.tokens(docs).collect()}
    assert {(r.doc_id, r.pos, r.term) for r in kept.table("tokens").collect()} == toks
    rows = kept.tokens_of_sentences().collect()
    assert {(r.doc_id, r.pos, r.term) for r in rows} == toks and all(r.begin <= r.pos for r in rows)
    assert kept.sentences().count() == docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n"))).count()


def test_hits_are_read_by_bucket_and_pushed_filter(kept, all_buckets):
    plan = _plan(kept.hits_of(["of the"]))
    assert "SelectedBucketsCount: 1 out of 3" in plan and "PushedFilters" in plan and "EqualTo(phrase,of the)" in plan
    assert kept.hits_of(["of the"]).count() == kept.table("hits").count() > 20 and kept.hits_of(["none"]).count() == 0
    one = kept.table("hits").select("doc_id").limit(1)
    assert kept.hits_in(one).select("doc_id").distinct().count() == 1
    assert [(r.doc_id, r.begin, r.end) for r in kept.spans(["b"]).collect()] == [(0, 0, 2)]


def test_slices_are_held_within_documents(spark, kept, docs):
    wanted = spark.createDataFrame([(0, 0, 3), (0, 0, 3), (1, 2, 500), (1, 500, 600), (999, 0, 2)], "doc_id long, begin long, end long")
    terms = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    got = {(r.doc_id, r.begin, r.end): r.terms for r in kept.slices(wanted).collect()}
    assert got == {k: v for k, v in {(0, 0, 3): terms[0][:3], (1, 2, 500): terms[1][2:]}.items() if v}


def test_a_store_opens_again(spark, kept, all_buckets):
    kept.close()
    again = store.CorpusStore(spark, kept.folder)
    assert again.buckets == 3 and again.table("tokens").count() > 100 and "SelectedBucketsCount: 1 out of 3" in _plan(again.hits_of(["of the"]))


def test_cells_are_folders(spark, docs):
    cells = store.CovariateStore(spark, f"{index.shared(spark)}/{uuid.uuid4().hex}", "n_chars", "lang", 500).write(docs)
    rows = docs.collect()
    assert {r.doc_id for r in cells.between((700, 1800), ["de"]).collect()} == {r.doc_id for r in rows if r.lang == "de" and r.n_chars is not None and 700 <= r.n_chars <= 1800}
    assert cells.between((0, 10_000)).columns == docs.columns and cells.between((0, 10_000), ["07"]).count() == 1
    assert cells.documents().count() == 82 and cells.documents().filter("n_chars is null").count() == 1
    plan = _plan(cells.between((700, 1800), ["de"]))
    assert "PartitionFilters: [isnotnull(x_bin" in plan and "y_cell" in plan.split("PartitionFilters")[1]
    wanted = spark.createDataFrame([(r.n_chars, r.lang) for r in rows[:5]] + [(3, "07")], "x long, y string")
    want = {r.doc_id for r in rows if (r.n_chars, r.lang) in {(w.x, w.y) for w in wanted.collect()} and r.lang is not None}
    assert {r.doc_id for r in cells.of_cells(wanted).collect()} == want
    assert "y_cell" in _plan(cells.of_cells(wanted)).split("PartitionFilters: [")[1].split("]")[0]


def test_a_grown_index_equals_one_of_all(spark, docs):
    named = docs.withColumn("name", F.concat(F.lit("n"), F.col("doc_id") % 70))
    folder = f"{index.shared(spark)}/{uuid.uuid4().hex}"
    with pytest.raises(ValueError):
        segments.GrowingIndex(spark, folder).terms()
    grown = segments.GrowingIndex(spark, folder)
    for k in range(3):  # ids over 70 repeat names of earlier appends, or of their own
        grown.append(named.filter((F.col("doc_id") % 3 == k)))
    order = {r.doc_id: (r.doc_id % 3, r.doc_id) for r in docs.collect()}
    first = {}
    for d in sorted(order, key=order.get):
        first.setdefault(d % 70, d)
    whole = index.build(named.filter(F.col("doc_id").isin(list(first.values()))), f"{folder}-whole")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert len(grown.live) == 3 and grown.version == 3
    for reopened in (segments.GrowingIndex(spark, folder), segments.GrowingIndex(spark, folder).compact(), segments.GrowingIndex(spark, folder)):
        assert key(reopened.terms()) == key(whole.terms()) and key(reopened.lengths()) == key(whole.lengths())
        assert key(reopened.tokens(["of", "x"])) == key(whole.tokens(["of", "x"]))
    assert segments.GrowingIndex(spark, folder).version == 4 and len(segments.GrowingIndex(spark, folder).live) == 1


def test_bloom_filters_lose_no_key(spark):
    keys, others = spark.range(5000).select((F.col("id") * 3).alias("h")), spark.range(60_000).select((F.col("id") * 3 + 1).alias("h"))
    for most in (blooms.BLOCKS, 40):
        bits = blooms.bloom(keys, "h", 5000, most)
        assert bits.count() <= most
        assert blooms.may_hold(keys, "h", bits, 5000, most).count() == 5000
    bits = blooms.bloom(keys, "h", 5000)
    assert blooms.may_hold(others, "h", bits, 5000).count() < 60_000 / 100
    assert blooms.may_hold(keys, "h", blooms.bloom(keys.limit(0), "h", 0), 0).count() == 0


def test_large_dictionaries_are_asked_before_the_shuffle(spark):
    rng = random.Random(2)
    texts = spark.createDataFrame([(k, " ".join(rng.choices([f"w{x}" for x in range(500)], k=400))) for k in range(40)], "doc_id long, text string")
    known = spark.createDataFrame([(f"w{a} w{b}", [f"w{a}", f"w{b}"]) for a in range(0, 60) for b in range(60)], "phrase string, terms array<string>")
    found = entities.mentions(texts, known, most=10)
    want = sorted(map(tuple, entities.mentions(texts, known).collect()))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan()
    exchanged = [int(m.group(1)) for m in __import__("re").finditer(r"\b(\d+) rows", plan.toString())]
    assert "LeftSemi" in plan.toString(), exchanged


def test_a_tagger_tells_the_longest_first(spark):
    # patterns of the sizes 2 and 3 over numbers, and a document in which they overlap
    known = spark.createDataFrame([(1, ["1", "2", "3"]), (2, ["2", "2", "2"]), (3, ["2", "2", "3"]), (4, ["0", "0"]), (9, ["0", "0"]), (5, ["2", "3"])], "entity long, terms array<string>")
    text = "1 2 3 0 0 2 2 3 2 2 2 2 3 2 1 2 3"
    for most in (None, 0):
        got = entities.detected(spark.createDataFrame([(7, text)], "doc_id long, text string"), known, most=most).orderBy("no").collect()
        assert [(r.start, r.entity) for r in got] == [(0, 1), (1, 5), (3, 4), (5, 3), (6, 5), (8, 2), (9, 2), (10, 3), (11, 5), (14, 1), (15, 5)]
        assert [r.no for r in got] == list(range(len(got)))

"""The phrase finder, sentence pages, running numbers, bounded neighbours, seeds and hashes against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termweave.functions import text
from termweave.operators import cooccur, entities, expansion, finder, index, labeling, search


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    return [" ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randrange(0, 80))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([*enumerate(texts), (500, None)], "doc_id long, text string")


def test_pages_of_sentences(spark):
    rows = [(d, n, w) for d in (2, 1) for n, w in enumerate([["a", "b"], ["a"], ["c"], ["b", "b", "a"], []])]
    s = spark.createDataFrame(rows, "doc_id long, no long, terms array<string>")
    page = lambda *a: [(r.doc_id, r.no, r.total_hits) for r in finder.search_sentences(s, *a).collect()]
    assert page(["a", "b"]) == [(d, n, 6) for d in (1, 2) for n in (0, 1, 3)]
    assert page(["b", "a", "a"], "and") == [(d, n, 4) for d in (1, 2) for n in (0, 3)]
    assert page(["a", "b"], "or", 2, 3) == [(1, 3, 6), (2, 0, 6), (2, 1, 6)] and page(["a"], "or", 6, 3) == [] == page([])
    with pytest.raises(ValueError):
        finder.search_sentences(s, ["a"], "not")


def test_running_numbers_of_one_large_group(spark):
    rng = random.Random(2)
    rows = [("hot" if k % 3 else f"g{k % 50}", rng.randrange(1000), k) for k in range(3000)] + [(None, 5, 0), ("hot", None, 1)]
    want, order = {}, Counter()
    for g, x, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        want[g, x, k] = order[g]
        order[g] += 1
    df = spark.createDataFrame(rows, "g string, x long, k long").repartition(5)
    assert {(r.g, r.x, r.k): r.no for r in finder.running(df, ["g"], ["x", "k"]).collect() if r.g is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert finder.running(df.limit(0), ["g"], ["x"]).count() == 0


def test_finder_options(spark, docs, texts):
    mentions = entities.mentions(docs, spark.createDataFrame([("w0 w3", ["w0", "w3"]), ("w5", ["w5"])], "phrase string, terms array<string>"))
    toks = index.tokens(docs)
    hits = search.find_hits(toks, ["w1", "w2"], "phrase")
    plain = finder.find_phrase(docs, ["w1", "w2"], count=3).collect()
    rows = [t.split() for t in texts]
    at = [(d, i) for d, t in enumerate(rows) for i in range(len(t) - 1) if t[i : i + 2] == ["w1", "w2"]]
    assert [(r.kind, r.n) for r in plain if r.kind == "hits"] == [("hits", len(at))] and {r.kind for r in plain} == {"hits", "result"}
    firsts = {d: min(i for e, i in at if e == d) for d in sorted({d for d, _ in at})[:3]}
    assert {r.doc_id: r.n for r in plain if r.kind == "result"} == firsts
    whole = finder.find_phrase(docs, ["w1", "w2"], mentions, count=3, pull_slices=True, score_terms=True, num_terms=5, min_term_frequency=1, find_entities=True, min_entity_frequency=2, left=2, right=3).collect()
    assert {r.doc_id: r.name for r in whole if r.kind == "result"} == {d: " ".join(rows[d][max(0, i - 2) : i + 5]) for d, i in firsts.items()}
    terms = cooccur.pmi_terms(toks, index.term_stats(toks), hits, 2, 3, 1, 5).collect()
    assert sorted((r.name, r.n, r.score) for r in whole if r.kind == "term") == sorted((r.term, r.qpf, r.pmi) for r in terms) and terms
    named = cooccur.pmi_entities(hits, mentions.withColumnRenamed("phrase", "phrase_id"), index.collection_stats(docs).select("coll_len"), 2, 3, 2, 30).collect()
    assert sorted((r.name, r.n, r.score) for r in whole if r.kind == "entity") == sorted((r.phrase_id, r.qpf, r.pmi) for r in named) and named
    assert finder.find_phrase(docs, ["w1", "w2"], method="window", width=5).filter("kind = 'hits'").first().n > 0
    with pytest.raises(KeyError):
        finder.find_phrase(docs, ["w1"], method="other")
    with pytest.raises(ValueError):
        finder.find_phrase(docs, ["w1"], find_entities=True)


def test_bounds_leave_most_neighbours_uncounted(spark, docs, texts):
    phrase = ["w1", "w2"]
    rows = [t.split() for t in texts]
    coll, cf = sum(map(len, rows)), Counter((a, b) for t in rows for a, b in zip(t, t[1:], strict=False))
    n, near = 0, Counter()
    for t in rows:
        at = [i for i in range(len(t) - 1) if t[i : i + 2] == phrase]
        n += len(at)
        inside = {i for p in at for i in range(max(0, p - 5), p + 7)}
        near.update((t[i], t[i + 1]) for i in range(len(t) - 1) if i in inside and i + 1 in inside)
    best = sorted((-round((q / coll) / ((cf[p] / coll) * (n / coll)), 6), p, q) for p, q in near.items() if q > 1)
    for k in (3, 10, 10_000):
        got = [(-r.pmi, (r.t1, r.t2), r.qpf) for r in cooccur.pmi_bigrams(docs, phrase, 5, 5, 1, k).collect()]
        assert got == best[:k]
    bounds, one = cooccur.bounded_bigrams(docs, phrase, 5, 5, 1)
    told = {(r.t1, r.t2): (r.low, r.high) for r in bounds.collect()}
    assert one.first().n_hits == n and all(a <= cf[p] <= b for p, (a, b) in told.items())
    # pairs of rare terms beside the phrase: their upper ends leave the common ones behind
    planted = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, f"w1 w2 zz yy w0 w0 {'w0 ' * 9}") for k in range(6)], "doc_id long, text string"))
    bounds, _ = cooccur.bounded_bigrams(planted, phrase, 5, 5, 1)
    rows = {(r.t1, r.t2): (r.qpf / r.high, r.qpf / r.low) for r in bounds.collect()}
    worst = sorted((x for x, _ in rows.values()), reverse=True)[0]
    assert rows["zz", "yy"][0] == 1.0 and sum(best >= worst for _, best in rows.values()) < len(rows) / 2
    assert [(r.t1, r.t2) for r in cooccur.pmi_bigrams(planted, phrase, 5, 5, 1, 1).collect()] == [min(p for p, (_, best) in rows.items() if best == 1.0)]


def test_strings_hash_as_numbered_vocabularies_do(spark):
    def plain(s):
        h = 0
        for u in s.encode("utf-16-le")[::2], s.encode("utf-16-le")[1::2]:
            pass
        data = s.encode("utf-16-le")
        for k in range(0, len(data), 2):
            h = (31 * h + data[k] + 256 * data[k + 1]) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    words = ["", "a", "Aa", "BB", "hello world", "straße", "日本語", "𝐀b𝐁", "x" * 500]
    got = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", text.string_hash(F.col("w")).alias("h")).collect()}
    assert got == {w: plain(w) for w in words} and got["Aa"] == got["BB"] == 2112


def test_growing_seeds_equal_training_anew(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(k, rng.sample([f"f{x}" for x in range(12)], rng.randrange(0, 6))) for k in range(90)], "item_id long, features array<string>")
    judged = spark.createDataFrame([(k, k % 3 == 0, p) for p, k in enumerate(rng.sample(range(90), 60), 1)] + [(k, False, None) for k in (1000,)], "item_id long, positive boolean, place int")
    got = {}
    for r in labeling.seed_curve(items, judged, [1, 5, 40, 500]).collect():
        got.setdefault(r.seeds, {})[r.item_id] = r.score
    for n in (1, 5, 40, 500):
        weights = labeling.difference_weights(items, judged.filter(F.col("place") <= n)).select("feature", F.col("weight").cast("double").alias("weight"))
        want = {r.item_id: r.score for r in labeling.score_all(items, weights).collect()}
        assert {k: v for k, v in got[n].items() if k != 1000} == {r.item_id: want.get(r.item_id, 0.0) for r in judged.filter("item_id <> 1000").collect()} and got[n][1000] == 0


def test_sweeps_equal_lists_one_by_one(spark, docs):
    toks, stats = index.tokens(docs), index.doc_stats(docs)
    top = search.likelihood(docs, {"a": {"w3": 1.0}, "b": {"w9": 1.0}}, "dirichlet", 8)
    got = {(r.n_docs, r.qid, r["rank"], r.term, r.score) for r in expansion.sweep(top, toks, stats, index.term_stats(toks), (2, 8), 6).collect()}
    for n in (2, 8):
        one = expansion.local_contexts(top.filter(F.col("rank") <= n), toks, stats, index.term_stats(toks), k=6).collect()
        assert {(q, t, s) for m, q, _, t, s in got if m == n} == {(r.qid, r.term, r.score) for r in one}
    assert {r for n, q, r, *_ in got if n == 8 and q == "a"} == set(range(1, 7))


def test_class_names_of_tags(spark):
    tags = ["schema.org/Person", "schema.org/Person:Name", "<m>:schema.org/Place:geo", "bare", "a/b/c", "bare:x"]
    got = {r.t: [tuple(c) for c in r.c] for r in spark.createDataFrame([(t,) for t in tags], "t string").select("t", labeling.class_names(F.col("t")).alias("c")).collect()}
    assert got == {"schema.org/Person": [("label", "person"), ("obj", "person")], "schema.org/Person:Name": [("label", "person:name"), ("prop", "name")], "<m>:schema.org/Place:geo": [("label", "place:geo"), ("prop", "geo")], "bare": [("label", "bare"), ("obj", "bare")], "a/b/c": [], "bare:x": [("label", "bare:x"), ("prop", "x")]}


def test_rows_of_frequent_classes(spark):
    tokens = [(1, "s1", ["x/A"], ["F1", "f2", "f2"]), (2, "s1", [], ["f1"]), (3, "s2", ["x/A:p", "x/A"], ["no"]), (4, "s3", [], []), (5, "s4", ["x/Rare"], ["f2"]), (6, "s4", ["x/A"], None)]
    df = spark.createDataFrame(tokens, "item_id long, sentence string, tags array<string>, features array<string>")
    ids = spark.createDataFrame([("f1", 7), ("f2", 3)], "term string, id long")
    got = sorted((r.kind, r.name, r.class_id, r.item_id, r.line) for r in labeling.class_rows(df, ids, 2).collect())
    assert got == [("label", "a", 1, 1, "1 3:1 7:1"), ("label", "a", 1, 3, "1"), ("label", "a", 1, 6, "1"), ("null", "far", 0, 4, "0"), ("null", "near", 0, 2, "0 7:1"), ("null", "near", 0, 5, "0 3:1"), ("obj", "a", 2, 1, "2 3:1 7:1"), ("obj", "a", 2, 3, "2"), ("obj", "a", 2, 6, "2")]
    assert labeling.class_rows(df.limit(0), ids).count() == 0


def test_scratch_removes_what_was_cut_inside(spark, docs):
    from pathlib import Path

    tables = lambda: set(Path(index.shared(spark).removeprefix("file:")).glob("termweave-*"))
    kept = index.cut(docs)
    before = tables()
    with index.scratch(spark):
        assert cooccur.pmi_bigrams(docs, ["w1", "w2"]).count() > 0 and len(tables()) > len(before)
        with index.scratch(spark):
            inner = index.cut(docs.limit(3))
            assert inner.count() == 3
        index.cut(docs)
    assert tables() == before and kept.count() == docs.count()

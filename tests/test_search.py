"""Small corpora with results worked out by hand."""

from termweave.functions import text
from termweave.operators import cooccur, entities, graph, index, labeling, runs, search
from termweave.plans import catalog

TOY = ["this is the time for all good men to come to the party", "the quick brown fox jumped over the lazy dog", "any dog would want to go to a party"]


def toks(spark):
    return index.tokens(spark.createDataFrame(list(enumerate(TOY)), "doc_id long, text string"))


def rows(df, *c):
    return sorted(tuple(r[x] for x in c) for r in df.collect())


def test_phrases(spark):
    t = toks(spark)
    assert rows(search.phrases(t, {1: ["over", "the"]}), "doc_id", "start") == [(1, 5)]
    words = {78: "party", 90: "dog", 80: "lazy dog", 77: "all good men", 79: "quick brown fox", 144: "not in here"}
    d = spark.createDataFrame([(k, v.split()) for k, v in words.items()], "phrase_id int, terms array<string>")
    want = [(0, 5, 3, 77), (0, 12, 1, 78), (1, 1, 3, 79), (1, 7, 2, 80), (1, 8, 1, 90), (2, 1, 1, 90), (2, 8, 1, 78)]
    docs = spark.createDataFrame(list(enumerate(TOY)), "doc_id long, text string")
    assert rows(entities.mentions(docs, d, "phrase_id"), "doc_id", "start", "size", "phrase") == want


def test_overlapping_patterns(spark):
    doc = "1 2 3 0 0 2 2 3 2 2 2 2 3 2 1 2 3"
    t = index.tokens(spark.createDataFrame([(0, doc)], "doc_id long, text string"))
    found = search.phrases(t, {1: ["1", "2", "3"], 2: ["2", "2", "2"], 3: ["2", "2", "3"], 4: ["0", "0"]})
    assert [r[0] for r in rows(found, "start")] == [0, 3, 5, 8, 9, 10, 14]


def test_match_and_passages(spark):
    t = toks(spark)
    assert rows(search.match(t, ["dog", "party"]), "doc_id") == [(2,)]
    assert rows(search.match(t, ["dog", "party"], 1), "doc_id") == [(0,), (1,), (2,)]
    assert rows(search.passages(t, ["to", "party"], 3).filter("n_present = 2"), "doc_id", "pos") == [(0, 10), (2, 6)]


def test_merged_slices_touch(spark):
    cut = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (2, 0, 1)], "doc_id long, begin int, end int")
    assert rows(cooccur.merged(cut), "doc_id", "begin", "end") == [(1, 0, 5), (1, 7, 9), (2, 0, 1)]


def test_pagerank_votes_and_precision(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string")
    got = {r.node: r.score for r in graph.pagerank(e, tolerance=1e-3).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and got["a"] > got["b"] > got["c"]
    v = runs.votes(spark.createDataFrame([("x", 1), ("x", 0), ("y", 0)], "item string, label int"), ["item"], "label")
    assert rows(v, "item", "relevant") == [("x", True), ("y", False)]
    run = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "qid string, doc_id long, rank long")
    rel = spark.createDataFrame([("q", 1, 1), ("q", 3, 1)], "qid string, doc_id long, grade int")
    assert rows(runs.average_precision(run, rel), "ap") == [(0.833333,)]


def test_perceptron_separates(spark):
    data = [(1, k, k % 2 == 0, ["even"] if k % 2 == 0 else ["odd"]) for k in range(10)]
    w = labeling.train_perceptron(spark.createDataFrame(data, "label_id long, item_id long, positive boolean, features array<string>"))
    got = {r.feature: r.weight for r in w.collect()}
    assert got["even"] > got.get("odd", 0)


def test_text(spark):
    df = spark.createDataFrame([("See spot run. See spot bark.", "Café_Noir (film)", "a<b>c</b>")], "t string, n string, m string")
    r = df.select(text.sentences("t").alias("s"), text.normal_name(df["n"]).alias("n"), text.between(df["m"], "<b>", "</b>").alias("m")).first()
    assert r.s == ["See spot run.", "See spot bark."] and r.n == "cafe noir" and r.m == "c"


def test_catalog_has_sql_for_known_names():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)

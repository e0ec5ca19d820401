"""Interval joins and markup spans: pairs against brute force, keys of the plan, very long documents, crossing and unclosed tags."""

import random
import time

from pyspark.sql import functions as F

from termweave.operators import cooccur, lookup, spans


def test_each_pair_comes_once(spark):
    rng = random.Random(1)
    places = [(rng.randrange(3), rng.randrange(900)) for _ in range(600)]
    made = [(rng.randrange(3), b, b + rng.choice([0, 1, 5, 64, 65, 300])) for b in (rng.randrange(900) for _ in range(150))]
    p = spark.createDataFrame([(d, x, k) for k, (d, x) in enumerate(places)], "doc_id long, pos long, k long")
    i = spark.createDataFrame([(d, b, e, k) for k, (d, b, e) in enumerate(made)], "doc_id long, begin long, end long, j long")
    want = sorted((k, j) for k, (d, x) in enumerate(places) for j, (d2, b, e) in enumerate(made) if d == d2 and b <= x < e)
    for width in (1, 64, 5000):
        assert sorted((r.k, r.j) for r in spans.stabbed(p, i, width).collect()) == want
    h = spark.createDataFrame([(d, x, k % 7, k) for k, (d, x) in enumerate(places)], "doc_id long, start long, size long, k long")
    want = sorted((k, j) for k, (d, x) in enumerate(places) for j, (d2, b, e) in enumerate(made) if d == d2 and b < x + k % 7 and x < e)
    for width in (1, 64, 5000):
        assert sorted((r.k, r.j) for r in spans.overlapping(i, h, width).collect()) == want
    assert spans.stabbed(p, i.limit(0)).count() == 0 == spans.overlapping(i, h.limit(0)).count()


def test_hits_that_touch_do_not_overlap(spark):
    hits = spark.createDataFrame([(0, 0, 1, 3), (0, 7, 1, 1), (0, 10, 14, 2)], "doc_id long, start long, size long, id long")
    find = lambda start, size: [r.id for r in spans.overlapping(spark.createDataFrame([(0, start, start + size)], "doc_id long, begin long, end long"), hits).orderBy("id").collect()]
    assert find(8, 1) == [] and find(7, 1) == [1] and find(0, 30) == [1, 2, 3] and find(6, 1) == []


def test_the_key_holds_a_bucket(spark):
    toks = spark.createDataFrame([(1, 0, "a")], "doc_id long, pos int, term string")
    cut = spark.createDataFrame([(1, 0, 5)], "doc_id long, begin int, end int")
    for df in (cooccur.inside(toks, cut), lookup.tokens_in_spans(toks, cut.selectExpr("doc_id", "'line' as tag", "1L as no", "begin", "end"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.split("\n") if "Join Inner" in x]
        assert joins and all("(__bucket#" in x for x in joins)


def test_a_document_of_a_million_tokens_in_lines(spark):
    n, lines = 1_000_000, 50_000
    toks = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), (F.col("id") % 100).cast("string").alias("term"))
    cut = spark.range(lines).select(F.lit(1).alias("doc_id"), (F.col("id") * 20).alias("begin"), (F.col("id") * 20 + 20).alias("end"))
    began = time.time()
    got = {r.term: r.qpf for r in cooccur.term_counts(toks, cut).collect()}
    assert got == {str(k): n // 100 for k in range(100)} and time.time() - began < 60


def _found(text):
    tokens, found = spans.scanned(text.lower())
    return tokens, [(t, b, e, d) for t, _, b, e, d in found]


def test_spans_of_markup():
    assert _found("<a>See spot run</a>. <b>See spot bark.</b>") == (["see", "spot", "run", "see", "spot", "bark"], [("a", 0, 3, 0), ("b", 3, 6, 0)])
    # nested ones of a name, crossing ones, one that stays open, one that was never opened
    assert _found("<p>x <p>y</p> z</p> w")[1] == [("p", 0, 3, 0), ("p", 1, 2, 1)]
    assert _found("<b>x <i>y</b> z</i> w")[1] == [("b", 0, 2, 0), ("i", 1, 3, 1)]
    assert _found("x <b>y z")[1] == [("b", 1, 3, 0)] and _found("x</b> y")[1] == []
    # void elements, scripts, styles and comments hold nothing; attributes are no tokens
    assert _found('a<br>b <img alt="no token">c') == (["a", "b", "c"], [("br", 1, 1, 0), ("img", 2, 2, 0)])
    assert _found("<p>a <script>if (x < y) </p> '</b>'</script> b</p>") == (["a", "b"], [("p", 0, 2, 0), ("script", 1, 1, 1)])
    assert _found("<!-- <b>no</b> --> yes <STYLE type='x'>p{}</style>") == (["yes"], [("style", 1, 1, 0)])
    assert _found("<script>never closed") == (["never", "closed"], [("script", 0, 2, 0)])
    assert _found("2 < 3 and 4 > 1 <> <3") == (["2"] + ["1", "3"], []) and _found("") == ([], []) and _found("<p") == (["p"], [])


def test_markup_spans_of_pages(spark):
    rows = [(1, "<A>See</A> <b>Spot</b>", "x"), (1, "<A>See</A> <b>Spot</b>", "x"), (2, None, "x"), (None, "<b>x</b>", "x"), (3, "<p>" * 3000 + "deep", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, tag string")
    got = spans.markup_spans(pages, ["a", "b"]).orderBy("doc_id", "no").collect()
    assert [(r.doc_id, r.tag, r.no, r.begin, r.end, r.depth) for r in got] == [(None, "b", 0, 0, 1, 0), *[(1, "a", 0, 0, 1, 0)] * 2, *[(1, "b", 1, 1, 2, 0)] * 2]
    deep = spans.markup_spans(pages, ["p"]).agg(F.max("depth"), F.min("end"), F.count("*")).first()
    assert tuple(deep) == (2999, 1, 3000)

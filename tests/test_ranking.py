"""Composed queries, block bounds and resumed scans against plain Python and against each other."""

import math
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termweave.operators import index, labeling, nodes, search
from termweave.operators.nodes import All, Any, Combine, Near, Phrase, Require, Synonym, Term


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    weights = [1 / (k + 1) for k in range(30)]
    return [" ".join(rng.choices(words, weights, k=rng.randrange(0, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string").withColumn("len", F.lit("clash"))


def _plain(texts, queries, smoothing, k):
    rows = {i: t.split() for i, t in enumerate(texts)}
    cf, coll = Counter(x for r in rows.values() for x in r), sum(map(len, rows.values()))
    out = []
    for q, own in queries.items():
        known = {t: w for t, w in own.items() if cf[t] and w > 0}
        scores = []
        for i, r in rows.items():
            tf, n = Counter(r), len(r)
            if any(tf[t] for t in known):
                one = lambda t, tf=tf, n=n: math.log(0.2 * cf[t] / coll + 0.8 * tf[t] / n) if smoothing == "jm" else math.log((tf[t] + 1500 * cf[t] / coll) / (n + 1500))
                scores.append((-round(sum(w * one(t) for t, w in known.items()) / sum(known.values()), 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("smoothing", ["dirichlet", "jm"])
def test_many_queries_equal_plain_scores_in_blocks_of_any_size(spark, docs, texts, smoothing):
    rng = random.Random(7)
    queries = {f"q{k}": {f"w{rng.randrange(32)}": float(rng.randrange(1, 4)) for _ in range(rng.randrange(1, 6))} for k in range(20)} | {"none": {"nowhere": 1.0}}
    asked = spark.createDataFrame([(q, t, w) for q, own in queries.items() for t, w in own.items()], "qid string, term string, weight double")
    toks, stats = index.tokens(docs), index.doc_stats(docs)
    for k in (3, 10, 1000):
        want = _plain(texts, queries, smoothing, k)
        for block in (1, 20, 100_000):
            got = sorted((r.qid, r["rank"], r.doc_id, r.score) for r in search.likelihood_of_many(toks, stats, asked, k, smoothing, block=block).collect())
            assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert search.likelihood_of_many(toks, stats, asked.limit(0)).count() == 0 and search.likelihood_of_many(index.tokens(docs.limit(0)), index.doc_stats(docs.limit(0)), asked).count() == 0


def test_blocks_out_of_reach_make_no_rows(spark):
    """One rare term, and one that stands in every document: only the blocks of the rare one's documents are read."""
    rows = [(k, "common " * (1 + k % 3) + ("rare rare rare rare" if k % 500 == 7 else "")) for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([("q", "rare", 1.0), ("q", "common", 1.0)], "qid string, term string, weight double")
    found = search.likelihood_of_many(index.tokens(docs), index.doc_stats(docs), asked, 5, block=20)
    got = [r.doc_id for r in found.orderBy("rank").collect()]
    assert len(got) == 5 and all(d % 500 == 7 for d in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    metrics = found._jdf.queryExecution().executedPlan()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan, metrics


def _places(node, t):
    """Places of a node by plain Python."""
    if isinstance(node, Term):
        return [i for i, x in enumerate(t) if x == node.term]
    own = [_places(c, t) for c in node.children]
    if isinstance(node, Synonym):
        return sorted({p for x in own for p in x})
    if isinstance(node, Phrase):
        at = [sum(c.width() for c in node.children[:k]) for k in range(len(own))]
        return [p for p in own[0] if all(p + a in x for a, x in zip(at, own, strict=True))]
    return [p for p in sorted({p for x in own for p in x}) if all(any(p <= q < p + node.size for q in x) for x in own)]


def test_nested_nodes_count_as_in_plain_python(spark, docs, texts):
    a, b, c = Term("w1"), Term("w2"), Term("w3")
    pair = Phrase((Synonym((a, b)), c))
    queries = {"1": pair, "2": Near((a, pair, Term("w0")), 5), "3": Phrase((pair, Term("w0"))), "4": Synonym((Phrase((a, b)), Phrase((b, a)))), "5": Near((a, a), 3), "6": Term("no")}
    rows, units = nodes.counts(docs, queries)
    assert units == list(queries.values())
    got = {r.doc_id: (r.len, list(r.tf)) for r in rows.collect()}
    assert got == {**{i: (len(t.split()), [len(_places(u, t.split())) for u in units]) for i, t in enumerate(texts)}, 900: (0, [0] * 6)}
    assert max(x[1][1] for x in got.values()) > 0 and rows._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    with pytest.raises(ValueError):
        Synonym((a, pair)).width()


def test_composed_scores_and_conditions(spark, docs, texts):
    a, b, c = Term("w4"), Term("w5"), Term("w6")
    queries = {"sum": Combine((0.7, 0.3), (a, Combine((1.0, 2.0), (b, Phrase((b, c)))))), "if": Require((All((a, Any((b, c)))), Combine((1.0,), (a,)))), "one": a}
    got = {(r.qid, r.doc_id): r.score for r in nodes.run(docs, queries, None).collect()}
    rows = [t.split() for t in texts]
    coll = sum(map(len, rows))
    cf = {u: sum(len(_places(u, t)) for t in rows) for u in (a, b, c, Phrase((b, c)))}

    def score(u, t):
        return math.log(len(_places(u, t)) + 1500 * (cf[u] / coll if cf[u] else 0.5 / coll)) - math.log(len(t) + 1500)

    for i, t in enumerate(rows):
        has = {u: bool(_places(u, t)) for u in cf}
        if has[a] or has[b] or has[Phrase((b, c))]:
            assert abs(got.pop(("sum", i)) - (0.7 * score(a, t) + 0.3 * (score(b, t) + 2 * score(Phrase((b, c)), t)) / 3)) < 2e-6
        if has[a] and (has[b] or has[c]):
            assert abs(got.pop(("if", i)) - score(a, t)) < 2e-6
        if has[a]:
            assert abs(got.pop(("one", i)) - score(a, t)) < 2e-6
    assert not got
    with pytest.raises(TypeError):
        nodes.run(docs, {"x": All((a, b))})
    one = {(r.doc_id, r.score) for r in nodes.run(docs, {"q": Combine((1.0, 1.0), (a, b))}, 20).collect()}
    assert one == {(r.doc_id, r.score) for r in search.likelihood(docs, {"q": {"w4": 1.0, "w5": 1.0}}, "dirichlet", 20).collect()}
    assert nodes.run(docs.limit(0), {"q": a}).count() == 0


def test_scans_go_on_where_the_last_one_ended(spark):
    rng = random.Random(4)
    items = spark.createDataFrame([(k * 3, rng.sample([f"f{x}" for x in range(20)], rng.randrange(0, 6))) for k in range(200)], "item_id long, features array<string>")
    weights = spark.createDataFrame([*((f"f{x}", float(x % 7) - 3) for x in range(20)), (None, 0.25)], "feature string, weight double")
    labeling.write_scored_order(items.repartition(7), path := f"{index.shared(spark)}/{uuid.uuid4().hex}")
    stored = spark.read.parquet(path)
    whole, last = labeling.scan(stored, weights, 1000, 15)
    assert last == 199 * 3
    for page in (1, 90, 100, 200):
        best, at, pages = None, None, 0
        while True:
            best, at_next = labeling.scan(stored, weights, page, 15, at, best)
            if at_next is None:
                break
            at, pages = at_next, pages + 1
            if page == 1 and pages == 3:
                break
        if page > 1:
            assert sorted(map(tuple, best.collect())) == sorted(map(tuple, whole.collect())) and pages == -(-200 // page)
        else:
            assert at == 6 and best.count() == 3
    best, at = labeling.scan(stored, weights, 10, 5, 10_000)
    assert at is None and best.count() == 0
    plan = labeling.score_all(stored.filter("item_id > 300"), weights)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(item_id,300)" in plan

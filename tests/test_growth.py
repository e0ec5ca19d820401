"""Work, memory and files that grow no faster than the tables."""

import math
import random
import uuid
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave import plans
from termweave.functions import text
from termweave.operators import cooccur, entities, graph, index, lookup, nodes, spans, store
from termweave.operators.nodes import Phrase, Synonym, Term


def test_bag_scores_are_made_of_matches_alone(spark):
    """Forty queries of fifty phrases, documents of three: a row for each match, none for the phrases that a document lacks."""
    rows = [(d, f"p{(7 * d + k) % 60}") for d in range(90) for k in (0, 1, 1, 5)]
    asked = [(q, f"p{(q + k) % 80}", 1.0 + k % 3) for q in range(40) for k in range(50)]
    made = entities.bag_scores(spark.createDataFrame(rows, "doc_id long, phrase string"), spark.createDataFrame(asked, "qid long, phrase string, weight double"))
    assert "LeftOuter" not in made._jdf.queryExecution().toString()
    c, cf = Counter(rows), Counter(p for _, p in rows)
    want = {}
    for q in range(40):
        own = [(p, w) for x, p, w in asked if x == q and cf[p]]
        for d in {d for d, p in c if p in dict(own)}:
            want[q, d] = sum(w * math.log(0.2 * cf[p] / len(rows) + 0.8 * c[d, p] / 4) for p, w in own) / sum(w for _, w in own)
    got = {(r.qid, r.doc_id): r.score for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)



@pytest.mark.parametrize("name", ["spread_scores", "expert_scores", "entity_relevance_ranked"])
def test_mentions_are_searched_for_once(spark, name):
    """What comes of texts is written before it is used: the plan of the scores reads no text."""
    df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in "".join(f for f in df.inputFiles())


def test_a_store_has_buckets_by_its_texts_length(spark, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_CHARS", 100)
    monkeypatch.setattr(store, "BUCKETS", 2)
    docs = spark.createDataFrame([(i, "of the sea " * 9) for i in range(10)], "doc_id long, text string")
    hits = spark.createDataFrame([("of the", i, 0, 2) for i in range(10)], "phrase string, doc_id long, start long, size long")
    kept = store.store(docs, f"{index.shared(spark)}/{uuid.uuid4().hex}", hits)
    assert kept.buckets == 10 and kept.table("tokens").count() == 270
    # hits of one phrase are written by several tasks
    assert len(kept.hits_of(["of the"]).inputFiles()) > 1 and kept.hits_of(["of the"]).count() == 10
    kept.close()


def test_a_frequent_term_is_saved_by_several_tasks(spark):
    rows = spark.range(4000).selectExpr("'the' term", "id doc_id", "0 pos")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.save({"tokens": rows}, path := f"{index.shared(spark)}/{uuid.uuid4().hex}")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = spark.read.parquet(f"{path}/tokens")
    assert len(got.inputFiles()) > 1 and got.distinct().count() == 4000


def test_postings_inside_the_row_equal_those_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(index, "TERMS_AT_ONCE", 3)
    texts = [(1, "a b a, c"), (2, None), (3, ""), (4, "b b b"), (1, "a d"), (None, "x a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    plain = lambda df: sorted(map(repr, df.select("term", "doc_id", "tf", "positions").collect()))
    assert plain(index.written_postings(docs)) == plain(index.postings(index.tokens(docs)))
    assert "Exchange" not in index.document_postings(docs)._jdf.queryExecution().executedPlan().toString()


def test_units_of_pairs_end_inside_a_batch(spark, monkeypatch):
    """A long text gives 7 x 5000 pairs: no unit holds more than UNIT and one distance of it."""
    monkeypatch.setattr(index, "UNIT", 4000)
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 4999}" for i in range(5000)))], "doc_id long, text string")
    hashed = docs.select(F.transform(text.tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    got = index._unit_counts(hashed, lambda lists: index._pairs_of(lists, 8, False), 5, 0)
    assert got.filter("key is null").count() == 7


def test_top_grams_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(index, "UNIT", 20)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (0, 1, 2, 9, 40, 70)]
    c = Counter()
    for t in texts:
        w = t.split()
        c.update((n, " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    want = sorted(c.items(), key=lambda x: (-x[1], *x[0]))[:12]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    assert [((r.size, r.gram), r.n) for r in index.top_grams(docs, 12, 3).select(F.col("size"), "gram", "n").orderBy(F.desc("n"), "size", "gram").toPandas().itertuples()] == want


def test_a_large_dictionary_is_cut_down_to_what_texts_may_hold(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 90 + k}" for k in range(100))) for i in range(30)], "doc_id long, text string")
    said = spark.createDataFrame([(1, 1, "u", "x w5 w6 w7 w8 y")], "conv_id long, turn long, role string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    said.write.parquet(f"{tmp_path}/conversations.parquet")
    sizes, plain = [], entities.mentions
    monkeypatch.setattr(entities, "mentions", lambda docs, known, **more: (sizes.append(known.count()), plain(docs, known, **more))[1])
    assert sorted(map(tuple, plans.QUERIES["dictionary_large"](spark, str(tmp_path)).collect())) == [("w5 w6 w7", 1), ("w6 w7 w8", 1)]
    assert sizes[0] < 60


def test_pages_are_scanned_a_few_at_a_time(spark, monkeypatch):
    held = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: held.append(run))
    spans.marked_up(spark.createDataFrame([(1, "")], "page_id long, html string"))
    batch = pa.record_batch([pa.array(range(100)), pa.array(["<p>a b</p>"] * 100)], names=["doc_id", "html"])
    made = list(held[0](iter([batch])))
    assert max(map(len, made)) <= 32 and sum(map(len, made)) == 100


def test_pagerank_of_a_large_graph_in_buckets(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i % 40}", f"n{(i * i + 3 * i) % 61}") for i in range(400)], "src string, dst string")
    want = {r.node: r.score for r in graph.pagerank(edges, weighted=False).collect()}
    monkeypatch.setattr(graph, "BROADCAST_NODES", 5)
    monkeypatch.setattr(graph, "BUCKET_NODES", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    made, writer = [], graph.shared
    monkeypatch.setattr(graph, "shared", lambda s: made.append(writer(s)) or made[-1])
    try:
        got = {r.node: r.score for r in graph.pagerank(edges, weighted=False).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert made and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pagerank_")]


def test_texts_are_cut_into_tokens_once_for_neighbours_and_their_ranking(spark, monkeypatch):
    """Every scan but the first reads tokens that are written: only that plan holds the tokenizer."""
    made, cut = [], index.cut
    for module in (cooccur, index, nodes):
        monkeypatch.setattr(module, "cut", lambda df: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    df = plans.QUERIES["pmi_bigram_rerank"](spark, "/root/testdata/sf0.001")
    made.append(df._jdf.queryExecution().optimizedPlan().toString())
    assert len(made) > 3 and sum("documents.parquet" in p or "regexp" in p for p in made) == 1 and df.count() == 20


@pytest.mark.parametrize("most", [3, 2_000_000])
@pytest.mark.parametrize("broadcast", [True, False])
def test_neighbours_are_counted_in_parts(spark, monkeypatch, most, broadcast):
    monkeypatch.setattr(cooccur, "AT_ONCE", most)
    monkeypatch.setattr(cooccur, "PAIRS", 1000 if broadcast else 0)
    rng = random.Random(4)
    texts = [[rng.choice("abcdef") for _ in range(n)] for n in (0, 1, 2, 9, 40, 70)] + [["x", "a"], ["b", "x"], ["a", "b"], list("abxxxxxxxxab"), list("abxxxxxxxxxab")]
    rows = spark.createDataFrame([(" ".join(t),) for t in texts] + [(None,)], "__s string")
    near, hits, whole, held = Counter(), 0, Counter(), Counter()
    for t in texts:
        at = [i for i in range(len(t) - 1) if t[i : i + 2] == ["a", "b"]]
        inside = {i for p in at for i in range(max(0, p - 3), p + 7)}
        pairs = list(zip(t, t[1:], strict=False))
        hits += len(at)
        near.update(p for i, p in enumerate(pairs) if i in inside and i + 1 in inside)
        whole.update(pairs)
        held.update(pairs if at else [])
    told = {(r.t1, r.t2): (r.n, r.coll) for r in cooccur.near_pairs(rows, ["a", "b"], 3, 5).collect()}
    assert told.pop((None, None)) == (hits, sum(map(len, texts))) and told == {p: (n, None) for p, n in near.items()}
    wanted = [p for p in whole if "c" not in p] + [("zz", "a")]
    asked = spark.createDataFrame(wanted, "t1 string, t2 string")
    for phrase, want in ((None, whole), (["a", "b"], held)):
        got = {(r.t1, r.t2): r.n for r in cooccur.pair_counts(rows, asked, phrase).collect()}
        assert {p: n for p, n in got.items() if p[1]} == {p: want[p] for p in wanted if want[p]}
        assert all(got[t, None] == sum(x.count(t) for x in texts) for t in "abdef")
    assert not {p for p in cooccur.pair_counts(rows, asked.limit(0)).collect() if p.t2}


def test_spaced_tokens_are_the_tokens(spark):
    docs = spark.createDataFrame([(t,) for t in (None, "", " ", "--", "A b", " a,\tB.\n", "\u00dcber\u0301 x\u00a0\U00020000 \u0660\u00b2\U0001f600z\u2028y", "\u0130I\u0131")], "text string")
    assert all(r.a == r.b for r in docs.select(text.tokens(F.col("text")).alias("a"), text.parted(text.spaced(F.col("text"))).alias("b")).collect())


def test_spaced_lines_are_the_tokens_of_lines(spark):
    """Long stretches without a token too: time grows with their length."""
    odd = (None, "", " ", "\n", "--\n", "a", "A\nb", " a,\tB.\n", "\n\na \r\n \n-\nb c\n", "\u00dc\n\u0301x\u00a0\U00020000\n\u0660\u00b2\U0001f600\nz\u2028y\u0085w", "\u0130\nI\u0131\n\u03a3\u03a3\n", "-" * 500_000 + "a" + " \n-" * 500_000 + "b" + "\n" * 500_000)
    lines = lambda c, f: F.filter(F.transform(F.split(c, "\n"), f), lambda x: F.size(x) > 0)
    whole = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.createDataFrame([(t,) for t in odd], "text string")
    got = docs.select(lines(text.spaced_lines(F.col("text")), lambda x: F.array_remove(F.split(x, " "), "")).alias("a"), lines(whole, text.tokens).alias("b")).collect()
    assert len(got) == len(odd) and all(r.a == r.b for r in got) and got[-1].a == [["a"], ["b"]]


def test_phrases_of_nodes_meet_by_place_alone(spark):
    """Both terms of a phrase thirty thousand times in a text: their places meet in time that grows with their number."""
    docs = spark.createDataFrame([(1, "of the " * 30_000), (2, "the of")], "doc_id long, text string")
    pair = Phrase((Synonym((Term("of"), Term("in"))), Term("the")))
    rows, _ = nodes.counts(docs, {"q": Phrase((pair, Term("of")))})
    assert {r.doc_id: (r.len, list(r.tf)) for r in rows.collect()} == {1: (60_000, [29_999]), 2: (2, [0])}
    assert "array_contains" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_documents_without_an_id_are_not_ranked(spark):
    docs = spark.createDataFrame([(1, "of the"), (None, "of the the"), (2, "x")], "doc_id long, text string")
    assert [r.doc_id for r in nodes.run(docs, {"q": Term("the")}).collect()] == [1]


def test_lines_near_and_far_shuffle_counts_alone(spark):
    plan = plans.QUERIES["near_far"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(term" in plan and "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("rows", [
    [(1, "of\nthe end\nfar"), (2, "x of \n\n -- \n The y\nz"), (3, "of. the, of the\nofthe of thee\nof-\n"), (4, "often the\nof\n"), (5, "the x\n"), (6, None), (7, ""), (8, "\n"), (9, "*of* the\nof*\n"), (None, "of the q\nr"), (None, "s")],
    # texts of one id: lines of a number are one line, places lie over each other
    [(1, "of the a\nb c d e\nf"), (1, "of the a\nb c d e\nf"), (2, "g of x\ny"), (2, "h i the\nj k"), (3, "of the\nl"), (4, "of m\nn the"), (4, None), (5, "of\nthe p"), (None, "q"), (None, "of the")],
])
def test_lines_near_and_far_of_odd_texts_equal_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(f"select term, near, far from ({plans.ORACLE_SQL['near_far']})").fetchall())
    assert want and sorted(map(tuple, plans.QUERIES["near_far"](spark, str(tmp_path)).select("term", "near", "far").collect())) == want


@pytest.mark.parametrize("phrase", [["a"], ["a", "b"], ["a", "a"], ["a", "b", "a"], ["a", "b", "b", "a"]])
def test_lines_near_and_far_of_any_phrase(spark, phrase):
    """Places of a phrase that share tokens and run over several lines, against brute force."""
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "b", "ab", "c", " ", ", ", "\n", "\n"]) + rng.choice(["", " ", "\n"]) for _ in range(n)) for n in (0, 1, 5, 30, 60, 200, 400)]
    want = Counter()
    for t in texts:
        toks = [(w, no) for no, line in enumerate(t.split("\n")) for w in "".join(c if c.isalnum() else " " for c in line).split()]
        starts = [i for i in range(len(toks)) if [w for w, _ in toks[i : i + len(phrase)]] == phrase]
        near = {toks[i + k][1] for i in starts for k in range(len(phrase))}
        want.update((w, no in near) for w, no in toks)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.term: (r.near, r.far) for r in lookup.lines_near_and_far(docs, phrase).collect()}
    assert got == {w: (want[w, True], want[w, False]) for w in {w for w, _ in want}}

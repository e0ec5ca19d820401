"""Operators whose plans take another way than the plain one: the same results, on rows that make the ways differ."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termweave.functions import text
from termweave.operators import cooccur, entities, index, labeling, lookup, runs, search
from termweave.sources import readers


def _texts(spark, n=120):
    rng = random.Random(9)
    rows = [" ".join(rng.choices([f"t{k}" for k in range(12)], k=rng.randrange(0, 40))) for _ in range(n)]
    return rows, spark.createDataFrame([*enumerate(rows), (n, None), (n + 1, "")], "doc_id long, text string")


@pytest.mark.parametrize(("width", "ordered"), [(2, True), (8, False)])
def test_top_pairs_equal_counting_all(spark, monkeypatch, width, ordered):
    rows, docs = _texts(spark)
    want: Counter = Counter()
    for r in rows:
        w = r.split()
        for i, a in enumerate(w):
            for b in w[i + 1 : i + width]:
                if ordered or a != b:
                    want[(a, b) if ordered else tuple(sorted((a, b)))] += 1
    best = sorted(((-n, *p) for p, n in want.items()))[:15]
    for unit, candidates in ((4_000_000, 2_000_000), (50, 2_000_000), (50, 3)):  # one unit, many units, more candidates than are broadcast
        monkeypatch.setattr(index, "UNIT", unit)
        monkeypatch.setattr(index, "CANDIDATES", candidates)
        got = [(-r.n, r["first"], r["last"]) for r in index.top_pairs(docs, 15, width, ordered).orderBy(F.desc("n"), "first", "last").collect()]
        assert got == best
    assert len(index.top_pairs(docs, 100_000, width, ordered).collect()) == len(want)


def test_retrieval_in_rows_equals_retrieval_by_tokens(spark):
    _, docs = _texts(spark)
    t, stats = index.tokens(docs), index.doc_stats(docs)
    queries = {"a": ["t1", "t2", "t2", "nowhere"], "b": ["nowhere"], "c": ["t5"]}
    for smoothing in ("dirichlet", "jm"):
        one = search.likelihood(docs, search.counted(queries), smoothing, 20)
        two = search.query_likelihood(t, stats, queries, smoothing, 20)
        key = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.score) for r in df.collect())
        assert key(one) == key(two) != []


def test_terms_near_equal_slices(spark):
    _, docs = _texts(spark)
    t = index.tokens(docs)
    hits = search.phrases(t, {0: ["t3", "t4"]})
    for left, right in ((0, 0), (1, 4), (5, 2)):
        near = {r.term: r.n for r in cooccur.near_phrase(docs, ["t3", "t4"], left, right).select(F.explode("near").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert near == {r.term: r.qpf for r in cooccur.term_counts(t, cooccur.merged(cooccur.slices(hits, left, right))).collect()}
    one = cooccur.pmi_terms_of(docs, ["t3", "t4"], 2, 2, 1, 50).collect()
    assert one == cooccur.pmi_terms(t, index.term_stats(t), hits, 2, 2, 1, 50).collect()
    assert {(r.term, r.cf, r.df) for r in index.document_terms(docs).collect()} == {(r.term, r.cf, r.df) for r in index.term_stats(t).collect()}


def test_mentions_of_shuffled_dictionaries(spark, monkeypatch):
    rows, docs = _texts(spark)
    phrases = {"x": ["t1", "t2"], "y": ["t2"], "z": ["t2", "t1", "t2"], "none": []}
    d = spark.createDataFrame(list(phrases.items()), "phrase string, terms array<string>")
    want = sorted((p, k, i) for p, ts in phrases.items() if ts for k, r in enumerate(rows) for i in range(len(r.split())) if r.split()[i : i + len(ts)] == ts)
    for most in (500_000, 1):
        monkeypatch.setattr(entities, "BROADCAST_PHRASES", most)
        assert sorted((r.phrase, r.doc_id, r.start) for r in entities.mentions(docs, d).collect()) == want
    assert entities.mentions(docs, d.limit(0)).count() == 0


def test_match_options_and_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "de", 5, 0.5), (2, "a", "en", None, 0.1), (3, None, None, 7, None)], "doc_id long, text string, lang string, n int, x double")
    t = index.tokens(docs)
    match = lambda *a, **k: [(r.doc_id, r.missing_terms) for r in lookup.match_documents(t, *a, **k).collect()]
    assert match(["a", "b", "z"]) == [(1, "z")] and match(["a", "b", "z"], strict=True) == [] and sorted(match(["b", "a", "z"], "OR")) == [(1, "z"), (2, "z")]
    assert match(["a"], limit=1) == [(1, "")] and match(["z"], "OR") == []
    assert [r.doc_id for r in lookup.labelled(docs, "lang", "de").collect()] == [1] and lookup.labelled(docs, "absent", "x").count() == 0
    assert [(r.doc_id, r.value) for r in lookup.numbers(docs, "n").collect()] == [(1, 5), (3, 7)]
    with pytest.raises(TypeError):
        lookup.labelled(docs, "n", "5")
    with pytest.raises(TypeError):
        lookup.numbers(docs, "x")


def test_stored_index_pushes_terms_down(spark, tmp_path, capsys):
    _, docs = _texts(spark)
    stored = index.build(docs.withColumn("lang", F.lit("en")), str(tmp_path))
    again = index.StoredIndex(spark, str(tmp_path))
    again.postings(["t1", "t2"]).explain("formatted")
    assert "PushedFilters: [In(term, [t1,t2])]" in capsys.readouterr().out
    assert sorted(stored.tokens(["t1"]).collect()) == sorted(index.tokens(docs).filter("term = 't1'").select("doc_id", "pos", "term").collect())
    assert stored.lengths().count() == 122 and stored.terms().count() == 12 and set(stored.variables().columns) == {"doc_id", "lang"}


def test_text_functions(spark):
    df = spark.createDataFrame([("Éa <!-- x --> b", "a/b/c", "li\\ne"), ("", "abc", '"'), (None, None, None)], "t string, p string, j string")
    got = df.select(text.fold_accents("t" and F.col("t")).alias("f"), text.strip_comments(F.col("t")).alias("c"), text.take_after(F.col("p"), "/").alias("a"), text.take_before_last(F.col("p"), "/").alias("b"), text.remove_front(F.col("p"), "a").alias("r"), text.remove_back(F.col("p"), "c").alias("k"), text.json_unescaped(F.col("j")).alias("j"), text.counts_of(text.tokens(F.lit("b a b"))).alias("m")).collect()
    assert (got[0].f, got[0].c, got[0].a, got[0].b, got[0].r, got[0].k, got[0].j, got[0].m) == ("Ea <!-- x --> b", "Éa   b", "b/c", "a/b", "/b/c", "a/b/", "li\ne", {"a": 1, "b": 2})
    assert (got[1].a, got[1].b, got[1].j, got[2].f, got[2].a) == ("abc", "abc", None, None, None)
    merged = df.limit(1).select(text.merged_maps(text.counts_of(F.array(F.lit("x"))), text.counts_of(F.array(F.lit("x"), F.lit("y")))).alias("m")).first().m
    assert merged == {"x": 2, "y": 1}
    with pytest.raises(KeyError):
        text.tokenizer("absent")
    with pytest.raises(ValueError, match="there is"):
        text.register_tokenizer("tokens", text.tokens)
    with pytest.raises(KeyError):
        search.find_hits(df, ["a"], "absent")


def test_readers_of_odd_lines(spark, tmp_path):
    def put(name, content):
        (tmp_path / name).write_text(content)
        return str(tmp_path / name)

    assert readers.run_file(spark, put("run", "q1 Q0 d1 1 2.5 s\n\n  q1  Q0 d2 2 -1e-3 s \n")).count() == 2
    assert [r.grade for r in readers.qrels(spark, put("qrels", "1 0 d 2\n"), 1).collect()] == [1]
    xml = '<DjVuXML archive="b"><BODY><OBJECT/><OBJECT><WORD coords="1,2">Hi</WORD><WORD coords="3,4"> </WORD><WORD coords="5,6">you</WORD></OBJECT></BODY></DjVuXML>'
    assert [(r.archive, r.page, r.terms, r.boxes) for r in readers.page_scans(spark, put("b.xml", xml)).collect()] == [("b", 1, ["Hi", "you"], ["1,2", "5,6"])]
    topics = "<topics>\n<topic number='7'><title> A b </title>\n<description>x</description></topic>\n<topic number='8'><title>c</title></topic></topics>"
    assert [(r.qid, r.title, r.description) for r in readers.topics_xml(spark, put("t.xml", topics)).collect()] == [("7", "A b", "x"), ("8", "c", None)]
    assert [(r.name, r.body) for r in readers.escaped_tsv(spark, put("tsv", 'n\tt\ta\\n\\"b\\u00e9\n')).collect()] == [("n", 'a\n"bé')]
    with pytest.raises(ValueError, match="unknown kinds"):
        readers.codebook_csv(spark, put("c.csv", "a\n1\n"), {"a": "odd"})
    conll = readers.conll(spark, put("conll", "-DOCSTART- -X- O O\n\nA NN B O\nb VB I O\n\nC NN B X\n"))
    assert sorted((r.sentence, r.pos, r.word, r.ner) for r in conll.collect()) == [(1, 0, "A", "O"), (1, 1, "b", "O"), (2, 0, "C", "X")]
    assert [(r.query, r.entities) for r in readers.difficulty_tsv(spark, put("erd", "q\teasy\te1\nq\teasy\tx\te2\n")).collect()] == [("q", ["e1", "e2"])]
    assert readers.zip_codes(spark, put("zip", "01002,Amherst,MA\n99999,None,XX\n")).count() == 1


def test_classifiers_share_an_interface(spark):
    data = [(k, k % 3 == 0, [f"a{k % 3}", f"b{k % 5}"]) for k in range(60)]
    examples = spark.createDataFrame(data, "item_id long, positive boolean, features array<string>")
    for name, kind in labeling.CLASSIFIERS.items():
        one = kind()
        scored = one.score(examples.select("item_id", "features"), one.train(examples)).join(examples, "item_id")
        top = runs.evaluated(scored.select("item_id", "score", "positive"), [10, 20]).first()
        assert top.n == 60 and top.p_10 == 1.0, name

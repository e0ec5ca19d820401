"""Queries do the whole job: no prefix, subset or fixed number of steps."""

import math

from pyspark.sql import functions as F

from termweave.functions import text
from termweave.operators import expansion, labeling
from termweave.plans import catalog


def tables(folder, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def sequential(shards, passes):
    """Weights by feature after passes of perceptrons over shards of (id, positive, features), averaged after each; None is the bias."""
    weights = {None: 0.0}
    for _ in range(passes):
        total = {}
        for rows in shards:
            w = dict(weights)
            for _, positive, features in sorted(rows):
                if (sum(w.get(f, 0.0) for f in [None, *features]) > 0) != positive:
                    for f in [None, *features]:
                        w[f] = w.get(f, 0.0) + (1.0 if positive else -1.0)
            for f, x in w.items():
                total[f] = total.get(f, 0.0) + x - weights.get(f, 0.0)
        weights |= {f: weights.get(f, 0.0) + x / len(shards) for f, x in total.items()}
    return weights


def test_perceptron_in_shards_equals_brute_force(spark):
    data = [(k, k % 3 == 0, [f"a{k % 3}", f"b{k % 5}", f"c{k % 7}"]) for k in range(50)]
    df = spark.createDataFrame([(1, *x) for x in data], "label_id long, item_id long, positive boolean, features array<string>")
    at = {r.item_id: r.s for r in df.select("item_id", F.pmod(F.xxhash64("item_id"), F.lit(4)).alias("s")).collect()}
    for size, shards in ((13, [[x for x in data if at[x[0]] == k] for k in range(4)]), (50, [data])):
        got = {r.feature: r.weight for r in labeling.train_perceptron(df, 3, size).collect()}
        want = sequential([s for s in shards], 3)
        assert got == {f: round(w, 9) for f, w in want.items() if round(w, 9) or f is None}


def test_perceptron_query_reads_whole_texts_and_scores_all(spark, tmp_path):
    long = [" ".join(f"w{k}" for k in range(300)) + (" scum" if i % 2 else " fine") for i in range(6)]
    docs = spark.createDataFrame([*enumerate(long), (6, "scum"), (7, ""), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    d = tables(tmp_path, documents=docs, labels=labels)
    weights = {r.feature: r.weight for r in catalog.perceptron_train(spark, d).collect()}
    assert weights["scum"] > 0 > weights["fine"]
    words = {r.doc_id: r.w for r in docs.select("doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("w")).collect()}
    got = {r.doc_id: r.score for r in catalog.perceptron_score(spark, d).collect()}
    assert got == {i: round(weights[None] + sum(weights.get(f, 0.0) for f in w), 6) for i, w in words.items()}


def test_dictionary_holds_every_run_of_five_words(spark, tmp_path):
    items = ["a b c d e f g", "f g a b c d e", "too short", None]
    texts = ["x c d e f g y a b c d e", "g a b c d e f g", "a b c d", "", None]
    d = tables(tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark=spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    runs5 = lambda t: [(" ".join(w[i : i + 5]), i) for w in [(t or "").split()] for i in range(len(w) - 4)]
    known = {g for t in items for g, _ in runs5(t)}
    want = sorted((g, k, i) for k, t in enumerate(texts) for g, i in runs5(t) if g in known)
    assert sorted(map(tuple, catalog.dictionary_tag_whole(spark, d).collect())) == want and len(want) == 6


def test_pagerank_runs_over_all_bigrams_until_it_settles(spark, tmp_path):
    texts = ["a b c a d e f", "c b a", "g a b a", None]
    d = tables(tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    edges = {(a, b) for t in texts for w in [(t or "").split()] for a, b in zip(w[:-1], w[1:], strict=True)}
    nodes = sorted({x for e in edges for x in e})
    out = {x: [b for a, b in edges if a == x] for x in nodes}
    cur, change = dict.fromkeys(nodes, 1 / len(nodes)), 1.0
    while change >= 1e-3:
        lost = sum(cur[x] for x in nodes if not out[x])
        new = {y: 0.15 / len(nodes) + 0.85 * (sum(cur[x] / len(out[x]) for x in nodes if y in out[x]) + lost / len(nodes)) for y in nodes}
        cur, change = new, sum(abs(new[x] - cur[x]) for x in nodes)
    got = {r.node: r.score for r in catalog.pagerank_terms(spark, d).collect()}
    assert got.keys() == cur.keys() and all(abs(got[x] - cur[x]) < 1e-7 for x in nodes)


def test_entity_scores_take_posteriors_of_a_ranking_without_a_broadcast(spark, tmp_path):
    texts = ["a b c d e thing with", "thing a b c d e a b c d e", "a b c d e", "der und"]
    d = tables(tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark=spark.createDataFrame([(1, "a b c d e")], "item_id long, text string"))
    words = [t.split() for t in texts]
    query = [t for ts in catalog.TWO.values() for t in ts if any(t in w for w in words)]
    total, cf = sum(map(len, words)), {t: sum(w.count(t) for w in words) for t in query}
    scores = {k: round(sum(math.log(w.count(t) + 1500 * cf[t] / total) - math.log(len(w) + 1500) for t in query) / len(query), 6) for k, w in enumerate(words) if set(w) & set(query)}
    e = {k: math.exp(s - max(scores.values())) for k, s in scores.items()}
    p = {k: x / sum(e.values()) for k, x in e.items()}
    rate = {0: 1 / 7, 1: 2 / 11}  # document 2 has the phrase but isn't ranked
    got = catalog.entity_relevance_ranked(spark, d).collect()
    assert len(got) == 1 and abs(got[0].rm - sum(p[k] * r for k, r in rate.items())) < 2e-6
    top = spark.createDataFrame([(0, 1.0)], "doc_id long, posterior double")
    hits = spark.createDataFrame([(1, 0)], "phrase_id int, doc_id long")
    docs = spark.createDataFrame([(0, 7)], "doc_id long, len long")
    coll = spark.createDataFrame([(7,)], "coll_len long")
    plan = expansion.entity_scores(top, hits, docs, coll)._jdf.queryExecution().analyzed().toString()
    assert plan.count("strategy=broadcast") == 1  # the collection's one row

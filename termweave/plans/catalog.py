"""The registered queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import cooccur, entities, expansion, graph, index, labeling, runs, search
from ..streaming import stats

PHRASE = ["of", "the"]
TERMS = ["the", "for", "that"]
TWO = {"q1": ["thing", "with", "for"], "q2": ["der", "und", "nicht"], "q3": ["para", "con"]}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents")


def _toks(spark: SparkSession, sf: str) -> DataFrame:
    return index.tokens(_docs(spark, sf))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.phrases(_toks(spark, sf), {1: PHRASE})


@cache
def _texts() -> str:
    return "d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') w from documents)"


TOKS = f"with recursive {_texts()}, tok as (select doc_id, unnest(w) term, unnest(range(len(w))) pos from d), st as (select term, count(*) cf, count(distinct doc_id) df from tok group by term), dl as (select doc_id, len(w) len from d), coll as (select count(*) c from tok)"
HITS = f"{TOKS}, hits as (select a.doc_id, a.pos as start, 2 as size from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the'), sl as (select distinct doc_id, greatest(start - 5, 0) b, start + 7 e from hits), fl as (select *, case when max(e) over (partition by doc_id order by b, e rows between unbounded preceding and 1 preceding) >= b then 0 else 1 end n from sl), isl as (select *, sum(n) over (partition by doc_id order by b, e) i from fl), mg as (select doc_id, min(b) b, max(e) e from isl group by doc_id, i)"


def tokens_stats(s, d):
    c = index.collection_stats(_docs(s, d))
    terms = index.term_stats(_toks(s, d)).agg(F.count(F.lit(1)).alias("n_terms"))
    return c.join(F.broadcast(terms))


def term_stats_top(s, d):
    return index.document_terms(_docs(s, d)).orderBy(F.desc("cf"), "term").limit(100)


def doc_lengths(s, d):
    return index.doc_stats(_docs(s, d))


def postings_positions(s, d):
    return index.postings(_toks(s, d).filter(F.col("term").isin(TERMS))).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def match_and(s, d):
    return search.match(_toks(s, d), TERMS)


def match_or(s, d):
    return search.match(_toks(s, d), TERMS, 1)


def phrase_locate(s, d):
    return _hits(s, d).select("doc_id", F.col("start").cast("long").alias("start"))


def phrase_count_multi(s, d):
    wanted = {1: ["of", "the"], 2: ["in", "the"], 3: ["the", "the"], 4: ["to", "the", "of"], 5: ["und"]}
    return search.phrases(_toks(s, d), wanted).groupBy("phrase_id").agg(F.count(F.lit(1)).alias("n"))


def passage_windows(s, d):
    return search.passages(_toks(s, d), ["for", "that"], 8).filter("n_present = 2").select("doc_id", F.col("pos").cast("long").alias("pos"))


def bow_relaxed(s, d):
    return search.relaxed_passages(_toks(s, d), ["for", "that", "nicht"], 16).groupBy("n_present").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"))


def bigrams_top(s, d):
    return index.top_pairs(_docs(s, d), 100).withColumnsRenamed({"first": "t1", "last": "t2"})


def ubigrams_top(s, d):
    return index.top_pairs(_docs(s, d), 100, 8, ordered=False).withColumnsRenamed({"first": "t_lo", "last": "t_hi"})


def slices_merged(s, d):
    m = cooccur.merged(cooccur.slices(_hits(s, d), 5, 5))
    return m.select("doc_id", F.col("begin").cast("long").alias("b"), F.col("end").cast("long").alias("e"))


def nearby_terms(s, d):
    return cooccur.term_counts(_toks(s, d), cooccur.merged(cooccur.slices(_hits(s, d), 5, 5)))


def pmi_terms(s, d):
    return cooccur.pmi_terms_of(_docs(s, d), PHRASE, 5, 5, 4, 30)


def ql_dirichlet(s, d):
    return search.likelihood(_docs(s, d), search.counted(TWO), "dirichlet", 10)


def ql_jm(s, d):
    return search.likelihood(_docs(s, d), search.counted(TWO), "jm", 10)


def sdm(s, d):
    return search.sequential_dependence(_toks(s, d), index.doc_stats(_docs(s, d)), ["thing", "with"], 20)


def _top(s, d):
    return expansion.posteriors(ql_dirichlet(s, d))


def posteriors_softmax(s, d):
    return _top(s, d).select("qid", "doc_id", F.round("posterior", 6).alias("posterior"))


def rm1_terms(s, d):
    return expansion.relevance_model(_top(s, d), _toks(s, d), index.doc_stats(_docs(s, d)), 30, fn.STOPWORDS)


def lce_terms(s, d):
    t = _toks(s, d)
    return expansion.local_contexts(ql_dirichlet(s, d).filter("qid = 'q1'"), t, index.doc_stats(_docs(s, d)), index.term_stats(t), drop=fn.STOPWORDS).select("term", "score")


def _item_hits(s, d):
    """phrase_id (an item), doc_id, start, size: places of every run of five words of an item, for each item that holds it."""
    known = entities.names(_t(s, d, "benchmark"), 5)
    return entities.mentions(_docs(s, d), known).join(known.select("phrase", F.col("entity").alias("phrase_id")), "phrase").select("phrase_id", "doc_id", "start", "size")


def dictionary_tag(s, d):
    return _item_hits(s, d).select("phrase_id", "doc_id", F.col("start").cast("long").alias("start"))


def _all_ngrams(s, d):
    """Every distinct run of five words of the benchmark items as a phrase; its id is the run."""
    t = F.col("t")
    w = F.transform(F.sequence(F.lit(1), F.size(t) - 4), lambda i: F.slice(t, i, 5))
    items = _t(s, d, "benchmark").select(fn.tokens(F.col("text")).alias("t")).filter(F.size("t") >= 5)
    return items.select(F.explode(w).alias("terms")).distinct().select(F.array_join("terms", " ").alias("phrase_id"), "terms")


def _ngram_hits(s, d):
    return entities.mentions(_docs(s, d), _all_ngrams(s, d), "phrase_id").withColumnRenamed("phrase", "phrase_id")


def dictionary_tag_whole(s, d):
    return _ngram_hits(s, d).select(F.col("phrase_id").alias("phrase"), "doc_id", F.col("start").cast("long").alias("start"))


def entity_relevance(s, d):
    hits = _item_hits(s, d)
    docs = index.doc_stats(_docs(s, d))
    top = hits.select("doc_id").distinct().join(docs, "doc_id").withColumn("posterior", 1 / (1 + F.col("len"))).drop("len")
    return expansion.entity_scores(top, hits, docs, index.collection_stats(_docs(s, d)))


def entity_relevance_ranked(s, d):
    """Scores of the whole dictionary's phrases over the ranked documents of a query, by their softmax posteriors; all three queries' terms are one query."""
    docs = index.cut(index.doc_stats(_docs(s, d)))
    ranked = search.likelihood(_docs(s, d), search.counted({"all": [t for ts in TWO.values() for t in ts]}), "dirichlet", None)
    # every candidate is ranked, so the softmax is made of aggregates and not in the one partition of a window
    ranked = index.cut(ranked.select("doc_id", "score"))
    best = ranked.agg(F.max("score").alias("best"))
    e = ranked.join(F.broadcast(best)).select("doc_id", F.exp(F.col("score") - F.col("best")).alias("e"))
    top = e.join(F.broadcast(e.agg(F.sum("e").alias("total")))).select("doc_id", (F.col("e") / F.col("total")).alias("posterior"))
    return expansion.entity_scores(top, _ngram_hits(s, d), docs, docs.agg(F.sum("len").alias("coll_len")))


def mention_entity_prior(s, d):
    n = _docs(s, d).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("source").agg(F.sum("n").alias("total"))
    return n.join(total, "source").select("source", "lang", "n", F.round(F.ln(F.col("n") / F.col("total")), 6).alias("log_prior"))


def covariates(s, d):
    return index.covariate_cells(_docs(s, d), "lang", "source")


def sentence_search(s, d):
    c = _t(s, d, "conversations").select("conv_id", "turn", F.array_distinct(fn.tokens(F.col("text"))).alias("w"))
    return c.filter(F.arrays_overlap("w", F.array(F.lit("thing"), F.lit("with")))).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def majority_vote(s, d):
    return runs.votes(_t(s, d, "events").withColumn("yes", (F.col("value") > 50).cast("int")), ["user_id"], "yes")


def _both(s, d):
    return ql_dirichlet(s, d).withColumn("system", F.lit("dirichlet")), ql_jm(s, d).withColumn("system", F.lit("jm"))


def qpp_overlap(s, d):
    return runs.overlap(*_both(s, d), 5)


def pooling(s, d):
    a, b = _both(s, d)
    return runs.pool(a.unionByName(b), 5)


def run_metrics(s, d):
    grades = _t(s, d, "labels").select("doc_id", F.col("quality").alias("grade")).crossJoin(F.broadcast(s.createDataFrame([(q,) for q in TWO], "qid string")))
    return runs.average_precision(ql_dirichlet(s, d), grades)


def zscore_features(s, d):
    long = _docs(s, d).select(F.lit("all").alias("qid"), "doc_id", F.lit("n_chars").alias("fid"), F.col("n_chars").cast("double").alias("value"))
    return runs.z_scores(long)


def pagerank_terms(s, d):
    edges = index.bigrams(_docs(s, d)).select(F.col("t1").alias("src"), F.col("t2").alias("dst"))
    return graph.pagerank(edges, weighted=False).select("node", F.round("score", 8).alias("score"))


def _word_sets(s, d):
    return _docs(s, d).select("doc_id", F.array_distinct(fn.tokens(F.col("text"))).alias("features"))


def perceptron_train(s, d):
    rows = _word_sets(s, d).join(_t(s, d, "labels"), "doc_id")
    return labeling.train_perceptron(rows.select(F.lit(1).cast("long").alias("label_id"), F.col("doc_id").alias("item_id"), (F.col("toxic") == 1).alias("positive"), "features"), 3)


def perceptron_score(s, d):
    return labeling.score_all(_word_sets(s, d).withColumnRenamed("doc_id", "item_id"), perceptron_train(s, d)).withColumnRenamed("item_id", "doc_id")


def hash_collisions(s, d):
    return index.term_stats(_toks(s, d)).withColumn("h", F.substring(F.md5("term"), 1, 4)).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def anti_judged(s, d):
    return _docs(s, d).join(_t(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


def numeric_stats(s, d):
    v = F.col("l_quantity")
    return _t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("stddev"), F.min(v).alias("least"), F.max(v).alias("most"))


def stream_stats(s, d):
    t = stats.run_available(s, f"{d}/events.parquet*", "event_type", "value")
    return t.select("event_type", "n", "least", "most", *[F.round(c, 4).alias(c) for c in ("mean", "stddev", "total")])


QUERIES = {f.__name__: f for f in (tokens_stats, term_stats_top, doc_lengths, postings_positions, match_and, match_or, phrase_locate, phrase_count_multi, passage_windows, bow_relaxed, bigrams_top, ubigrams_top, slices_merged, nearby_terms, pmi_terms, ql_dirichlet, ql_jm, sdm, posteriors_softmax, rm1_terms, lce_terms, dictionary_tag, dictionary_tag_whole, entity_relevance, entity_relevance_ranked, mention_entity_prior, covariates, sentence_search, majority_vote, qpp_overlap, pooling, run_metrics, zscore_features, pagerank_terms, perceptron_train, perceptron_score, hash_collisions, anti_judged, numeric_stats, stream_stats)}

_IN = "('the', 'for', 'that')"
_QL = f"{TOKS}, q(qid, term) as (values {', '.join(f'({q!r}, {t!r})' for q, ts in TWO.items() for t in ts)}), tf as (select doc_id, term, count(*) tf from tok where term in (select term from q) group by all), kn as (select q.*, cf from q join st using (term)), ca as (select distinct qid, doc_id from tf join kn using (term)), pr as (select ca.qid, ca.doc_id, cf, coalesce(tf.tf, 0) tf, len, c from ca join kn using (qid) left join tf on tf.doc_id = ca.doc_id and tf.term = kn.term join dl on dl.doc_id = ca.doc_id, coll)"
_DIR = "ln(tf + 1500.0 * cf / c) - ln(len + 1500.0)"
_JM = "ln(0.19999999999999996 * cf / c + 0.8 * tf / len)"


def _ranked(name: str, formula: str) -> str:
    return f"{name}_s as (select qid, doc_id, round(avg({formula}), 6) score from pr group by all), {name} as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) rank from {name}_s) where rank <= 10)"


_BOTH = f"{_QL}, {_ranked('a', _DIR)}, {_ranked('b', _JM)}"
_POST = f"{_QL}, {_ranked('a', _DIR)}, po as (select *, exp(score - max(score) over (partition by qid)) e from a), pp as (select qid, doc_id, score, e / sum(e) over (partition by qid) posterior from po)"
_STOP = "(" + ", ".join(map(repr, fn.STOPWORDS)) + ")"
_TAG5 = f"{TOKS}, bw as (select regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') w from benchmark), g5 as (select distinct array_to_string(w[i:i + 4], ' ') phrase from (select w, unnest(range(1, len(w) - 3)) i from bw)), tag5 as (select phrase, doc_id, i - 1 as start from (select doc_id, i, array_to_string(w[i:i + 4], ' ') phrase from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d)) join g5 using (phrase))"
_TAG = f"{_TAG5}, i5 as (select distinct item_id phrase_id, array_to_string(w[i:i + 4], ' ') phrase from (select item_id, w, unnest(range(1, len(w) - 3)) i from (select item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') w from benchmark))), tag as (select phrase_id, doc_id, start from tag5 join i5 using (phrase))"


def _ranks(steps: int = 20) -> str:
    """CTEs that end in r<steps>(n, score): steps of PageRank, each kept as it is once a step has changed less than 0.001."""
    out = f"{TOKS}, ed as materialized (select distinct a.term s, b.term t from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1), dg as materialized (select s, count(*) d from ed group by s), nn as materialized (select s n from ed union select t from ed), k as materialized (select count(*)::double k from nn), r0 as materialized (select n, 1 / k score from nn, k), done0 as (select false stop)"
    for i in range(1, steps + 1):
        out += f", g{i} as materialized (select t n, sum(score / d) got from r{i - 1} join ed on n = s join dg using (s) group by t), l{i} as materialized (select coalesce(sum(score), 0) lost from r{i - 1} where n not in (select s from dg)), x{i} as materialized (select r.n, r.score old, 0.15::double / k + 0.85::double * (coalesce(got, 0) + lost / k) score from r{i - 1} r left join g{i} using (n), l{i}, k), r{i} as materialized (select n, case when stop then old else score end score from x{i}, done{i - 1}), done{i} as materialized (select stop or (select sum(abs(score - old)) from x{i}) < 1e-3 stop from done{i - 1})"
    return out


ORACLE_SQL = {
    "pagerank_terms": f"{_ranks()} select n node, round(score, 8) score from r20",
    "tokens_stats": f"{TOKS} select (select count(*) from documents) n_docs, (select c from coll) coll_len, (select count(*) from st) n_terms",
    "term_stats_top": f"{TOKS} select term, cf, df from st order by cf desc, term limit 100",
    "doc_lengths": f"{TOKS} select doc_id, len from dl",
    "postings_positions": f"{TOKS} select term, doc_id, count(*) tf, string_agg(pos, ',' order by pos) positions from tok where term in {_IN} group by all",
    "match_and": f"{TOKS} select doc_id, count(distinct term) n_present from tok where term in {_IN} group by doc_id having n_present = 3",
    "match_or": f"{TOKS} select doc_id, count(distinct term) n_present from tok where term in {_IN} group by doc_id",
    "phrase_locate": f"{HITS} select doc_id, start from hits",
    "phrase_count_multi": f"{TOKS}, p(phrase_id, t) as (values (1, ['of', 'the']), (2, ['in', 'the']), (3, ['the', 'the']), (4, ['to', 'the', 'of']), (5, ['und'])), pp as (select phrase_id, len(t) n, unnest(t) term, unnest(range(len(t))) o from p), m as (select phrase_id, doc_id, pos - o as s, n from tok join pp using (term) group by all having count(*) = n) select cast(phrase_id as integer) phrase_id, count(*) n from m group by phrase_id",
    "passage_windows": f"{TOKS}, own as (select * from tok where term in ('for', 'that')), nx as (select doc_id, pos, min(case when term = 'for' then pos end) over w a, min(case when term = 'that' then pos end) over w b from own window w as (partition by doc_id order by pos rows between current row and unbounded following)) select doc_id, pos from nx where greatest(a, b) + 1 - pos <= 8 and a is not null and b is not null",
    "bigrams_top": f"{TOKS} select a.term t1, b.term t2, count(*) n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by all order by n desc, t1, t2 limit 100",
    "ubigrams_top": f"{TOKS} select least(a.term, b.term) t_lo, greatest(a.term, b.term) t_hi, count(*) n from tok a join tok b on a.doc_id = b.doc_id and b.pos between a.pos + 1 and a.pos + 7 where a.term <> b.term group by all order by n desc, t_lo, t_hi limit 100",
    "bow_relaxed": f"{TOKS}, own as (select * from tok where term in ('for', 'that', 'nicht')), nx as (select doc_id, pos, min(case when term = 'for' then pos end) over w a, min(case when term = 'that' then pos end) over w b, min(case when term = 'nicht' then pos end) over w n, bool_or(term = 'for') over v ha, bool_or(term = 'that') over v hb, bool_or(term = 'nicht') over v hn from own window w as (partition by doc_id order by pos rows between current row and unbounded following), v as (partition by doc_id)), f as (select pos, ha::int + hb::int + hn::int n_present from nx where greatest(case when ha then coalesce(a, 1 << 30) else -1 end, case when hb then coalesce(b, 1 << 30) else -1 end, case when hn then coalesce(n, 1 << 30) else -1 end) + 1 - pos <= 16), k as (select case when count(*) filter (where n_present >= 3) >= 10 then 3 when count(*) filter (where n_present >= 2) >= 10 then 2 else 1 end k from f) select cast(n_present as bigint) n_present, count(*) n, cast(sum(pos) as bigint) sum_pos from f, k where n_present >= k group by n_present",
    "sdm": f"{TOKS}, own as (select * from tok where term in ('thing', 'with')), nx as (select doc_id, pos, min(case when term = 'thing' then pos end) over w a, min(case when term = 'with' then pos end) over w b from own window w as (partition by doc_id order by pos rows between current row and unbounded following)), tf as (select doc_id, case term when 'thing' then 0 else 1 end unit, count(*) tf from own group by all union all select x.doc_id, 2, count(*) from own x join own y on x.doc_id = y.doc_id and y.pos = x.pos + 1 where x.term = 'thing' and y.term = 'with' group by x.doc_id union all select doc_id, 3, count(*) from nx where greatest(a, b) + 1 - pos <= 8 and a is not null and b is not null group by doc_id), cf as (select unit, sum(tf) cf, case unit when 2 then 0.15 when 3 then 0.05 else 0.4 end w from tf group by unit), ds as (select distinct doc_id from tf) select ds.doc_id, round(sum(w * (ln(coalesce(tf, 0) + 1500.0 * cf / c) - ln(len + 1500.0))), 6) score from ds cross join cf left join tf on tf.doc_id = ds.doc_id and tf.unit = cf.unit join dl on dl.doc_id = ds.doc_id, coll group by ds.doc_id order by score desc, doc_id limit 20",
    "slices_merged": f"{HITS} select doc_id, b, e from mg",
    "nearby_terms": f"{HITS} select term, count(*) qpf from tok join mg on tok.doc_id = mg.doc_id and pos >= b and pos < e group by term",
    "pmi_terms": f"{HITS}, nt as (select term, count(*) qpf from tok join mg on tok.doc_id = mg.doc_id and pos >= b and pos < e group by term) select term, qpf, cf, round((qpf / c) / ((cf / c) * ((select count(*) from hits) / c)), 6) pmi from nt join st using (term), coll where qpf > 4 order by pmi desc, term limit 30",
    "ql_dirichlet": f"{_BOTH} select qid, doc_id, score, rank from a",
    "ql_jm": f"{_BOTH} select qid, doc_id, score, rank from b",
    "posteriors_softmax": f"{_POST} select qid, doc_id, round(posterior, 6) posterior from pp",
    "rm1_terms": f"{_POST}, rw as (select qid, term, round(sum(posterior * tf2 / len) / (select count(*) from pp x where x.qid = y.qid), 9) weight from (select pp.qid, pp.doc_id, posterior, term, count(*) tf2, any_value(len) len from pp join tok using (doc_id) join dl using (doc_id) where term not in {_STOP} group by all) y group by qid, term) select qid, term, weight from rw qualify row_number() over (partition by qid order by weight desc, term) <= 30",
    "lce_terms": f"{_POST}, top as (select * from pp where qid = 'q1'), t2 as (select doc_id, term, count(*) tf from tok where doc_id in (select doc_id from top) and term not in {_STOP} group by all), tt as (select term from t2 group by term having sum(tf) > 1) select term, round(sum(score + ln((coalesce(t2.tf, 0) + 1000.0 * cf / c) / (len + 1000.0)) - ln(cf / c)), 6) score from tt join st using (term) cross join top join dl on dl.doc_id = top.doc_id left join t2 on t2.term = tt.term and t2.doc_id = top.doc_id cross join coll group by term order by score desc, term limit 30",
    "dictionary_tag": f"{_TAG} select phrase_id, doc_id, start from tag",
    "dictionary_tag_whole": f"{_TAG5} select phrase, doc_id, start from tag5",
    "entity_relevance": f"{_TAG}, ec as (select phrase_id, doc_id, count(*) n from tag group by all), ef as (select phrase_id, sum(n) cf from ec group by phrase_id) select phrase_id, round(sum(1 / (1 + len) * n / len), 6) rm, round(sum(1 / (1 + len) * n / len / (cf / c)), 6) drm, round(sum(ln(1 / (1 + len)) + ln(n / len) - ln(cf / c)), 6) gdrm, round(sum(ln(n / len) - ln(cf / c)), 6) gnb from ec join ef using (phrase_id) join dl using (doc_id), coll group by phrase_id",
    "mention_entity_prior": "select source, lang, count(*) n, round(ln(count(*) / sum(count(*)) over (partition by source)), 6) log_prior from documents group by source, lang",
    "covariates": "select lang x, source y, count(*) n from documents group by all",
    "sentence_search": "select conv_id, count(*) n from (select conv_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from conversations) where list_has_any(w, ['thing', 'with']) group by conv_id",
    "majority_vote": "select user_id, count(*) filter (where value > 50) n_yes, count(*) filter (where not value > 50) n_no, n_yes >= n_no relevant, round(greatest(n_yes, n_no) / (n_yes + n_no), 6) agreement from events group by user_id",
    "qpp_overlap": f"{_BOTH} select qid, round(count(b.doc_id) / 5, 6) overlap from a left join (select * from b where rank <= 5) b using (qid, doc_id) where a.rank <= 5 group by qid",
    "pooling": f"{_BOTH} select qid, doc_id, count(*) n_runs from (select qid, doc_id from a where rank <= 5 union all select qid, doc_id from b where rank <= 5) group by all",
    "run_metrics": f"{_BOTH}, good as (select distinct doc_id from labels where quality > 0), h as (select qid, rank, row_number() over (partition by qid order by rank) seen from a where doc_id in (select doc_id from good)), m as (select qid, sum(seen / rank) s, count(*) filter (where rank <= 5) k from h group by qid), qs as (select distinct qid from q) select qid, round(coalesce(s, 0) / (select count(*) from good), 6) ap, round(coalesce(k, 0) / 5, 6) p_at from qs left join m using (qid)",
    "zscore_features": "select 'all' qid, doc_id, 'n_chars' fid, round((n_chars - avg(n_chars) over ()) / stddev_samp(n_chars) over (), 6) z from documents",
    "hash_collisions": f"{TOKS} select left(md5(term), 4) h, count(*) n from st group by h having n > 1",
    "anti_judged": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "numeric_stats": "select l_returnflag, count(l_quantity) n, round(avg(l_quantity), 6) mean, round(stddev_samp(l_quantity), 6) stddev, min(l_quantity) least, max(l_quantity) most from lineitem group by l_returnflag",
    "stream_stats": "select event_type, count(value) n, min(value) least, max(value) most, round(avg(value), 4) mean, round(stddev_samp(value), 4) stddev, round(sum(value), 4) total from events group by event_type",
}
ORACLE_SQL = {k: v.replace("with recursive", "with") for k, v in ORACLE_SQL.items()}

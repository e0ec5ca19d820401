"""Queries of weighted retrieval, expansion, reranking and the phrase finder, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import cooccur, expansion, index, search
from .catalog import _POST, HITS, PHRASE, TOKS, TWO, _docs, _hits, _t, _toks, _top
from .named import _DIC, _near

WEIGHTED = {"q1": {"thing": 3.0, "with": 1.0}, "q2": {"der": 0.5, "und": 0.25, "nosuchterm": 1.0}}


def ql_weighted(s, d):
    return search.likelihood(_docs(s, d), WEIGHTED, "dirichlet", 20)


def rm3_rerank(s, d):
    """The queries mixed with the terms of their relevance models, over all documents."""
    asked = {q: search.meaningful(ts, fn.STOPWORDS) for q, ts in TWO.items()}
    model = expansion.relevance_model(_top(s, d), _toks(s, d), index.doc_stats(_docs(s, d)), 30, [*fn.STOPWORDS, *(t for ts in TWO.values() for t in ts)])
    return search.likelihood(_docs(s, d), expansion.mixed(search.counted(asked), model), "dirichlet", 10)


def pmi_rerank(s, d):
    """The phrase's terms mixed with the terms near it, weighted by PMI, among the documents that hold the phrase."""
    near = cooccur.pmi_terms_of(_docs(s, d), PHRASE, 5, 5, 4, 20).select(F.lit("p").alias("qid"), "term", F.col("pmi").alias("weight"))
    return search.likelihood(_docs(s, d), expansion.mixed({"p": dict.fromkeys(PHRASE, 1.0)}, near), "dirichlet", 20, within=_hits(s, d))


def pmi_bigrams(s, d):
    return cooccur.pmi_bigrams(_docs(s, d), PHRASE, 5, 5, 2, 30)


def two_stage_sdm(s, d):
    """The best forty documents by query likelihood, ranked anew by sequential dependence; frequencies are the corpus's."""
    first = search.likelihood(_docs(s, d), {"q": {"thing": 1.0, "with": 1.0}}, "dirichlet", 40)
    return search.sequential_dependence(_toks(s, d), index.doc_stats(_docs(s, d)), ["thing", "with"], 20, within=first)


def sdm_runs(s, d):
    """Sequential dependence with runs of three terms too."""
    return search.sequential_dependence(_toks(s, d), index.doc_stats(_docs(s, d)), ["to", "the", "of"], 20, longest=3)


def synonym_counts(s, d):
    groups = {"articles": ["the", "der", "das", "el"], "joiners": ["and", "und", "y"]}
    return search.synonyms(_toks(s, d), groups).groupBy("name", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def find_phrase(s, d):
    """One table of what is asked for a phrase: how often it stands, the best terms and the best names near it."""
    hits = _hits(s, d).agg(F.lit("hits").alias("kind"), F.lit("").alias("name"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("score"))
    terms = cooccur.pmi_terms_of(_docs(s, d), PHRASE, 20, 20, 4, 30).select(F.lit("term").alias("kind"), F.col("term").alias("name"), F.col("qpf").alias("n"), F.col("pmi").alias("score"))
    names = _near(s, d).filter("qpf >= 4").select(F.lit("entity").alias("kind"), F.col("phrase").alias("name"), F.col("qpf").alias("n"), F.lit(None).cast("double").alias("score"))
    return hits.unionByName(terms).unionByName(names)


def snippets(s, d):
    return cooccur.snippets(_docs(s, d), PHRASE, 3, 3, 200)


def best_first(s, d):
    """The documents of each query in one row, the best first."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id")))
    return _top(s, d).groupBy("qid").agg(F.array_join(F.transform(order, lambda x: x["doc_id"].cast("string")), ",").alias("docs"))


def fact_ranking(s, d):
    """Each item asks by its first ten terms that are no stopwords, for ten documents."""
    w = F.slice(F.filter(fn.tokens(F.col("text")), lambda x: ~x.isin(fn.STOPWORDS)), 1, 10)
    asked = _t(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(w).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return search.likelihood_of_many(_toks(s, d), index.doc_stats(_docs(s, d)), asked, 10)


QUERIES = {f.__name__: f for f in (fact_ranking, ql_weighted, rm3_rerank, pmi_rerank, pmi_bigrams, two_stage_sdm, sdm_runs, synonym_counts, find_phrase, snippets, best_first)}

_STOP = "(" + ", ".join(map(repr, fn.STOPWORDS)) + ")"
_ALL = "(" + ", ".join(repr(t) for ts in TWO.values() for t in ts) + ")"
#: From wq (qid, term, w): tfw, known terms with their cf, candidates, scores.
_WQ = "wt as (select doc_id, term, count(*) tf from tok where term in (select term from wq) group by all), wk as (select qid, term, w, cf from wq join st using (term)), wc as (select distinct qid, doc_id from wk join wt using (term)), ws as (select wc.qid, wc.doc_id, round(sum(w * (ln(coalesce(wt.tf, 0) + 1500.0 * cf / c) - ln(len + 1500.0))) / sum(w), 6) score from wc join wk using (qid) left join wt on wt.doc_id = wc.doc_id and wt.term = wk.term join dl on dl.doc_id = wc.doc_id, coll group by wc.qid, wc.doc_id)"


def _best(k: int, rows: str = "ws") -> str:
    return f"select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from {rows}) where rank <= {k}"


def _values(rows) -> str:
    return ", ".join(f"('{q}', '{t}', {w!r}::double)" for q, t, w in rows)


_ORIG = {q: search.meaningful(ts, fn.STOPWORDS) for q, ts in TWO.items()}
_RM = f"{_POST}, rw as (select qid, term, round(sum(posterior * tf2 / len) / (select count(*) from pp x where x.qid = y.qid), 9) weight from (select pp.qid, pp.doc_id, posterior, term, count(*) tf2, any_value(len) len from pp join tok using (doc_id) join dl using (doc_id) where term not in {_STOP} and term not in {_ALL} group by all) y group by qid, term), rx as (select qid, term, weight from rw qualify row_number() over (partition by qid order by weight desc, term) <= 30)"
_MIX = "wq as (select qid, term, sum(w) w from (select qid, term, 0.8 * w / sum(w) over (partition by qid) w from oq union all select qid, term, 0.2 * weight / sum(weight) over (partition by qid) from rx) group by all)"
_NT = f"{HITS}, nt as (select term, count(*) qpf from tok join mg on tok.doc_id = mg.doc_id and pos >= b and pos < e group by term)"
_PMI = "round((qpf / c) / ((cf / c) * ((select count(*) from hits) / c)), 6)"
_HITS20 = HITS.replace("greatest(start - 5, 0) b, start + 7 e", "greatest(start - 20, 0) b, start + 22 e")
_DIC20 = _DIC[len(TOKS):]


def _sdm(query: list[str], units: list[tuple[str, float]], within: str = "") -> str:
    """units: a query for doc_id, tf of each unit, and its weight."""
    tf = " union all ".join(f"select doc_id, {k} unit, tf from ({q})" for k, (q, _) in enumerate(units))
    weights = " ".join(f"when {k} then {w!r}::double" for k, (_, w) in enumerate(units))
    return f"tf as materialized ({tf}), cf as (select unit, sum(tf) cf, case unit {weights} end w from tf group by unit), ds as (select distinct doc_id from tf {within}) select ds.doc_id, round(sum(w * (ln(coalesce(tf, 0) + 1500.0 * cf / c) - ln(len + 1500.0))), 6) score from ds cross join cf left join tf on tf.doc_id = ds.doc_id and tf.unit = cf.unit join dl on dl.doc_id = ds.doc_id, coll group by ds.doc_id order by score desc, doc_id limit 20"


def _one(t: str) -> str:
    return f"select doc_id, count(*) tf from tok where term = '{t}' group by doc_id"


def _run(*ts: str) -> str:
    joins = " ".join(f"join tok t{k} on t{k}.doc_id = t0.doc_id and t{k}.pos = t0.pos + {k} and t{k}.term = '{t}'" for k, t in enumerate(ts) if k)
    return f"select t0.doc_id, count(*) tf from tok t0 {joins} where t0.term = '{ts[0]}' group by t0.doc_id"


def _window(a: str, b: str, width: int = 8) -> str:
    return f"select doc_id, count(*) tf from (select doc_id, pos, min(case when term = '{a}' then pos end) over w x, min(case when term = '{b}' then pos end) over w y from tok where term in ('{a}', '{b}') window w as (partition by doc_id order by pos rows between current row and unbounded following)) where greatest(x, y) + 1 - pos <= {width} and x is not null and y is not null group by doc_id"


ORACLE_SQL = {
    "fact_ranking": f"{TOKS}, fw as (select item_id qid, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: x not in {_STOP})[1:10] w from benchmark), wq as (select qid, term, count(*)::double w from (select qid, unnest(w) term from fw) group by all), {_WQ} {_best(10)}",
    "ql_weighted": f"{TOKS}, wq(qid, term, w) as (values {_values((q, t, w) for q, ts in WEIGHTED.items() for t, w in ts.items())}), {_WQ} {_best(20)}",
    "rm3_rerank": f"{_RM}, oq(qid, term, w) as (values {_values((q, t, 1.0) for q, ts in _ORIG.items() for t in ts)}), {_MIX}, {_WQ} {_best(10)}",
    "pmi_rerank": f"{_NT}, oq(qid, term, w) as (values {_values(('p', t, 1.0) for t in PHRASE)}), rx as (select 'p' qid, term, {_PMI} weight from nt join st using (term), coll where qpf > 4 order by weight desc, term limit 20), {_MIX}, {_WQ}, wi as (select * from ws where doc_id in (select doc_id from hits)) {_best(20, 'wi')}",
    "pmi_bigrams": f"{HITS}, bp as (select a.doc_id, a.pos, a.term t1, b.term t2 from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1), nb as (select t1, t2, count(*) qpf from bp join mg on bp.doc_id = mg.doc_id and pos >= b and pos + 1 < e group by all having count(*) > 2), bc as (select t1, t2, count(*) cf from bp join nb using (t1, t2) group by all) select t1, t2, qpf, cf, {_PMI} pmi from nb join bc using (t1, t2), coll order by pmi desc, t1, t2 limit 30",
    "two_stage_sdm": f"{TOKS}, wq(qid, term, w) as (values ('q', 'thing', 1.0::double), ('q', 'with', 1.0::double)), {_WQ}, first as ({_best(40)}), {_sdm(['thing', 'with'], [(_one('thing'), 0.4), (_one('with'), 0.4), (_run('thing', 'with'), 0.15), (_window('thing', 'with'), 0.05)], 'where doc_id in (select doc_id from first)')}",
    "sdm_runs": f"{TOKS}, {_sdm(['to', 'the', 'of'], [(_one('to'), 0.8 / 3), (_one('the'), 0.8 / 3), (_one('of'), 0.8 / 3), (_run('to', 'the'), 0.05), (_run('the', 'of'), 0.05), (_run('to', 'the', 'of'), 0.05), (_window('to', 'the'), 0.025), (_window('the', 'of'), 0.025)])}",
    "synonym_counts": f"{TOKS}, g(name, term) as (values ('articles', 'the'), ('articles', 'der'), ('articles', 'das'), ('articles', 'el'), ('joiners', 'and'), ('joiners', 'und'), ('joiners', 'y')) select name, doc_id, count(*) n from tok join g using (term) group by all",
    "find_phrase": f"{_HITS20}, nt as (select term, count(*) qpf from tok join mg on tok.doc_id = mg.doc_id and pos >= b and pos < e group by term){_DIC20}, ne as (select phrase, count(*) qpf from men join mg using (doc_id) where b < start + 2 and start < e group by phrase) select 'hits' kind, '' \"name\", count(*) n, null::double score from hits union all select * from (select 'term', term, qpf, {_PMI} pmi from nt join st using (term), coll where qpf > 4 order by pmi desc, term limit 30) union all select 'entity', phrase, qpf, null from ne where qpf >= 4",
    "snippets": f"{HITS}, fi as (select doc_id, min(start) start from hits group by doc_id order by doc_id limit 200) select doc_id, start, array_to_string(w[greatest(start - 3, 0) + 1:start + 5], ' ') snippet from fi join d using (doc_id)",
    "best_first": f"{_POST} select qid, string_agg(doc_id, ',' order by score desc, doc_id) docs from pp group by qid",
}

"""Queries of composed nodes, resumed scans, expansion by neighbours, pages of sentences and the phrase finder's options, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import cooccur, expansion, finder, index, labeling, lookup, nodes, search
from ..operators.nodes import All, Any, Combine, Near, Phrase, Require, Synonym, Term
from .catalog import _POST, HITS, PHRASE, TOKS, TWO, _docs, _hits, _t, _toks, ql_dirichlet
from .judging import _CW, _items, classifier_weights
from .named import _NEAR, _mentions
from .ranking import _MIX, _WQ, _best, _values

OF, IN, THE = Term("of"), Term("in"), Term("the")
EITHER = Synonym((Phrase((OF, THE)), Phrase((IN, THE))))
CLOSE = Near((Term("for"), Term("that")), 8)


def node_synonyms(s, d):
    """Two phrases as one unit, and a window, by weights."""
    return nodes.run(_docs(s, d), {"q": Combine((0.7, 0.3), (EITHER, CLOSE))}, 20)


def node_conditions(s, d):
    """Documents with one term and any of two others, scored by two more."""
    asked = Require((All((THE, Any((Term("for"), Term("that"))))), Combine((1.0, 2.0), (Term("thing"), Term("with")))))
    return nodes.run(_docs(s, d), {"q": asked}, 20, "jm")


def node_counts(s, d):
    """A phrase whose first part is either of two terms, and a window of that phrase and a term: how often in each document."""
    inner = Phrase((Synonym((OF, IN)), THE))
    rows, _ = nodes.counts(_docs(s, d), {"phrase": inner, "window": Near((inner, Term("and")), 6)})
    return rows.filter("tf[0] > 0").select("doc_id", "len", F.col("tf")[0].alias("n_phrase"), F.col("tf")[1].alias("n_window"))


def classifier_scan(s, d):
    """Documents ranked by a classifier in scans of a third of them, each going on where the last one ended."""
    labeling.write_scored_order(_items(s, d), path := f"{index.shared(s)}/composed-{uuid.uuid4().hex}")
    stored = s.read.parquet(path)
    weights = index.cut(classifier_weights(s, d).select("feature", F.col("weight").cast("double").alias("weight")))
    page, after, best = stored.count() // 3 + 1, None, None
    for _ in range(3):
        best, after = labeling.scan(stored, weights, page, 100, after, best)
    return best


def pmi_bigrams_bounds(s, d):
    """The best neighbours near hits by the upper bounds of their frequencies."""
    return cooccur.pmi_bigrams(_docs(s, d), PHRASE, 5, 5, 2, 30, approximate=True)


def pmi_bigram_rerank(s, d):
    """The phrase's terms mixed with the ten best neighbours near it as phrases, weighted by PMI, among the documents that hold the phrase."""
    # texts are cut into tokens once, for all scans
    docs = index.cut(_docs(s, d).select("doc_id", fn.spaced(F.col("text")).alias("terms")))
    near = cooccur.pmi_bigrams(docs, PHRASE, 5, 5, 2, 10, terms="terms").collect()
    asked = Combine((1.0, 1.0), tuple(map(Term, PHRASE)))
    if near:
        more = Combine(tuple(r.pmi for r in near), tuple(Phrase((Term(r.t1), Term(r.t2))) for r in near))
        asked = Combine((0.8, 0.2), (asked, more))
    return nodes.run(docs, {"p": Require((Phrase(tuple(map(Term, PHRASE))), asked))}, 20, terms="terms")


def sentence_pages(s, d):
    """The second page of ten turns with any of three terms, and the first of those with all."""
    said = _t(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("no"), fn.tokens(F.col("text")).alias("terms"))
    any_ = finder.search_sentences(said, ["the", "of", "in"], "or", 10, 10).withColumn("operation", F.lit("or"))
    return any_.unionByName(finder.search_sentences(said, ["the", "of", "in"], "and", 0, 10).withColumn("operation", F.lit("and")))


def find_phrase_all(s, d):
    """All that the finder tells of a phrase: hits, terms and entities with their PMI, and the terms around the first hits."""
    found = finder.find_phrase(_docs(s, d), PHRASE, _mentions(s, d), pull_slices=True, score_terms=True, find_entities=True, left=20, right=20)
    return found.withColumn("name", F.when(F.col("kind") == "result", F.md5("name")).otherwise(F.col("name")))


def hash_vocabulary(s, d):
    """Terms by the 32-bit hash of their letters, those of one hash joined."""
    terms = index.document_terms(_docs(s, d)).select(fn.string_hash(F.col("term")).alias("hash"), "term")
    return terms.groupBy("hash").agg(F.array_join(F.array_sort(F.collect_list("term")), "|").alias("names"), F.count(F.lit(1)).alias("n"))


def running_numbers(s, d):
    """Turns numbered over all conversations of a role, in order."""
    rows = _t(s, d, "conversations").select("role", "conv_id", "turn")
    return finder.running(rows, ["role"], ["conv_id", "turn"]).select("role", "conv_id", "turn", F.col("no").cast("long").alias("no"))


def lce_sweep(s, d):
    """Terms of local contexts from the first two, five and ten documents of each query."""
    return expansion.sweep(ql_dirichlet(s, d), _toks(s, d), index.doc_stats(_docs(s, d)), index.term_stats(_toks(s, d)), (2, 5, 10), 20, fn.STOPWORDS)


def lce_rerank(s, d):
    """Queries mixed with the terms of their local contexts, a quarter of the weight with the query."""
    terms = expansion.local_contexts(ql_dirichlet(s, d), _toks(s, d), index.doc_stats(_docs(s, d)), index.term_stats(_toks(s, d)), k=10, drop=fn.STOPWORDS)
    model = terms.select("qid", "term", F.lit(1.0).alias("weight"))
    return search.likelihood(_docs(s, d), expansion.mixed(search.counted(TWO), model, 0.25), "dirichlet", 10)


QUERIES = {f.__name__: f for f in (node_synonyms, node_conditions, node_counts, classifier_scan, pmi_bigrams_bounds, pmi_bigram_rerank, sentence_pages, find_phrase_all, hash_vocabulary, running_numbers, lce_sweep, lce_rerank)}

_DIR = lambda tf, cf: f"(ln(coalesce({tf}, 0) + 1500.0 * (case when {cf} > 0 then {cf} / c else 0.5 / c end)) - ln(len + 1500.0))"
_JM = lambda tf, cf: f"ln(0.2::double * {cf} / c + 0.8::double * coalesce({tf}, 0) / len)"


def _pairs_of(*pairs: tuple[str, str]) -> str:
    return f"select a.doc_id, a.pos from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where (a.term, b.term) in ({', '.join(f'({x!r}, {y!r})' for x, y in pairs)})"


_EITHER = f"ph as ({_pairs_of(('of', 'the'), ('in', 'the'))})"
_WINDOW = "ft as (select doc_id, pos, term from tok where term in ('for', 'that')), nw as (select distinct f.doc_id, f.pos from ft f join ft x on x.doc_id = f.doc_id and x.term = 'for' and x.pos >= f.pos and x.pos < f.pos + 8 join ft y on y.doc_id = f.doc_id and y.term = 'that' and y.pos >= f.pos and y.pos < f.pos + 8)"
_COUNTED = "tp as (select doc_id, count(*) n from ph group by doc_id), tw as (select doc_id, count(*) n from nw group by doc_id), cp as (select coalesce(sum(n), 0) n from tp), cw_ as (select coalesce(sum(n), 0) n from tw)"
_TF = lambda t: f"(select doc_id, count(*) n from tok where term = '{t}' group by doc_id)"
_CF = lambda t: f"(select count(*) from tok where term = '{t}')"
_TOP = "select 'q' qid, doc_id, round(score, 6) score, row_number() over (order by round(score, 6) desc, doc_id) rank from sc qualify rank <= 20"
_NB = "bp as (select a.doc_id, a.pos, a.term t1, b.term t2 from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1), nb as (select t1, t2, count(*) qpf from bp join mg on bp.doc_id = mg.doc_id and pos >= b and pos + 1 < e group by all having count(*) > 2)"
_NBP = "round((qpf / c) / ((cf / c) * ((select count(*) from hits) / c)), 6)"
_SAID = "cv as (select conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from conversations)"
_HITS20 = HITS.replace("greatest(start - 5, 0) b, start + 7 e", "greatest(start - 20, 0) b, start + 22 e")
_LCE = "t2 as (select n_docs, qid, doc_id, term, count(*) tf from tp join tok using (doc_id) where term not in {stop} group by all), tt as (select n_docs, qid, term from t2 group by all having sum(tf) > 1), sc as (select tt.n_docs, tt.qid, term, round(sum(score + ln((coalesce(t2.tf, 0) + 1000.0 * cf / c) / (len + 1000.0)) - ln(cf / c)), 6) score from tt join st using (term) join tp using (n_docs, qid) join dl on dl.doc_id = tp.doc_id left join t2 on t2.term = tt.term and t2.doc_id = tp.doc_id and t2.qid = tt.qid and t2.n_docs = tt.n_docs cross join coll group by tt.n_docs, tt.qid, term)".replace("{stop}", "(" + ", ".join(map(repr, fn.STOPWORDS)) + ")")
_UNITS = "flatten(list_transform(string_split(term, ''), lambda x: case when unicode(x) > 65535 then [55296 + ((unicode(x) - 65536) >> 10), 56320 + ((unicode(x) - 65536) & 1023)] else [unicode(x)] end))"
ORACLE_SQL = {
    "node_synonyms": f"{TOKS}, {_EITHER}, {_WINDOW}, {_COUNTED}, sc as (select dl.doc_id, 0.7::double * {_DIR('tp.n', 'cp.n')} + 0.3::double * {_DIR('tw.n', 'cw_.n')} score from dl left join tp using (doc_id) left join tw using (doc_id) cross join cp cross join cw_ cross join coll where tp.n > 0 or tw.n > 0) {_TOP}",
    "node_conditions": f"{TOKS}, sc as (select dl.doc_id, ({_JM('a.n', _CF('thing'))} + 2 * {_JM('b.n', _CF('with'))}) / 3.0::double score from dl left join {_TF('thing')} a using (doc_id) left join {_TF('with')} b using (doc_id) cross join coll where (a.n > 0 or b.n > 0) and doc_id in (select doc_id from tok where term = 'the') and doc_id in (select doc_id from tok where term in ('for', 'that'))) {_TOP}",
    "node_counts": f"{TOKS}, {_EITHER}, pw as (select doc_id, pos, 1 k from ph union all select doc_id, pos, 2 from tok where term = 'and'), nw as (select distinct f.doc_id, f.pos from pw f join pw x on x.doc_id = f.doc_id and x.k = 1 and x.pos >= f.pos and x.pos < f.pos + 6 join pw y on y.doc_id = f.doc_id and y.k = 2 and y.pos >= f.pos and y.pos < f.pos + 6) select doc_id, len, a.n n_phrase, coalesce(b.n, 0) n_window from dl join (select doc_id, count(*) n from ph group by doc_id) a using (doc_id) left join (select doc_id, count(*) n from nw group by doc_id) b using (doc_id)",
    "classifier_scan": f"{_CW} select doc_id item_id, coalesce(s, 0)::double score from documents left join (select item_id, sum(weight) s from ws join cw using (feature) group by item_id) x on x.item_id = doc_id order by score desc, item_id limit 100",
    "pmi_bigrams_bounds": f"{HITS}, {_NB} select t1, t2, qpf, least(x.cf, y.cf) cf, round((qpf / c) / ((least(x.cf, y.cf) / c) * ((select count(*) from hits) / c)), 6) pmi from nb join st x on x.term = t1 join st y on y.term = t2 cross join coll order by pmi desc, t1, t2 limit 30",
    "pmi_bigram_rerank": f"{HITS}, {_NB}, bc as (select t1, t2, count(*) cf from bp join nb using (t1, t2) group by all), ex as (select t1, t2, cf, {_NBP} w from nb join bc using (t1, t2) cross join coll order by w desc, t1, t2 limit 10), xt as (select doc_id, t1, t2, count(*) n from bp join ex using (t1, t2) group by all), hd as (select distinct doc_id from hits), xs as (select dl.doc_id, sum(w * {_DIR('xt.n', 'ex.cf')}) / sum(w) s from dl join hd using (doc_id) cross join ex left join xt on xt.doc_id = dl.doc_id and xt.t1 = ex.t1 and xt.t2 = ex.t2 cross join coll group by dl.doc_id), bs as (select dl.doc_id, ({_DIR('a.n', _CF('of'))} + {_DIR('b.n', _CF('the'))}) / 2 s from dl join hd using (doc_id) left join {_TF('of')} a using (doc_id) left join {_TF('the')} b using (doc_id) cross join coll), sc as (select doc_id, case when xs.s is null then bs.s else 0.8::double * bs.s + 0.2::double * xs.s end score from bs left join xs using (doc_id)) {_TOP.replace(chr(39) + 'q' + chr(39), chr(39) + 'p' + chr(39))}",
    "sentence_pages": f"with {_SAID}, o as (select conv_id, turn, count(*) over () n from cv where list_has_any(w, ['the', 'of', 'in'])), a as (select conv_id, turn, count(*) over () n from cv where list_has_all(w, ['the', 'of', 'in'])) select conv_id doc_id, turn no, n total_hits, 'or' operation from (select * from o order by conv_id, turn limit 10 offset 10) union all select conv_id, turn, n, 'and' from (select * from a order by conv_id, turn limit 10)",
    "find_phrase_all": f"{_HITS20}, nt as (select term, count(*) qpf from tok join mg on tok.doc_id = mg.doc_id and pos >= b and pos < e group by term), fi as (select doc_id, min(start) start from hits group by doc_id order by doc_id limit 200), {_NEAR[len(TOKS) + 2 :].replace('hits as', 'hits_ as').replace('sl as', 'sl_ as').replace('fl as', 'fl_ as').replace('isl as', 'isl_ as').replace('mg as', 'mg_ as')} select 'hits' kind, '' \"name\", count(*) n, null::double score, null::bigint doc_id from hits union all select 'result', md5(array_to_string(w[greatest(start - 20, 0) + 1:start + 22], ' ')), start, null, doc_id from fi join d using (doc_id) union all select * from (select 'term', term, qpf, {_NBP} pmi, null::bigint from nt join st using (term), coll where qpf > 4 order by pmi desc, term limit 30) union all select * from (select 'entity', phrase, qpf, round(pmi, 6), null::bigint from lp where qpf >= 4 order by round(pmi, 6) desc, phrase limit 30)",
    "hash_vocabulary": f"{TOKS}, h as (select term, list_reduce(list_prepend(0::bigint, list_transform({_UNITS}, lambda u: u::bigint)), lambda h, u: (h * 31 + u) % 4294967296) h from st) select case when h >= 2147483648 then h - 4294967296 else h end hash, string_agg(term, '|' order by term) names, count(*) n from h group by h",
    "running_numbers": "select role, conv_id, turn, row_number() over (partition by role order by conv_id, turn) - 1 no from conversations",
    "lce_sweep": f"{_POST}, tp as (select n_docs, qid, doc_id, score from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) r from pp), (select unnest([2, 5, 10]) n_docs) where r <= n_docs), {_LCE} select n_docs, qid, term, score, row_number() over (partition by n_docs, qid order by score desc, term) rank from sc qualify rank <= 20",
    "lce_rerank": f"{_POST}, tp as (select 10 n_docs, qid, doc_id, score from pp), {_LCE}, rx as (select qid, term, 1.0::double weight from sc qualify row_number() over (partition by qid order by score desc, term) <= 10), oq(qid, term, w) as (values {_values((q, t, float(ts.count(t))) for q, ts in TWO.items() for t in dict.fromkeys(ts))}), {_MIX.replace('0.8', '0.25').replace('0.2 *', '0.75 *')}, {_WQ} {_best(10)}",
}

"""Queries of dictionary tagging and entity scores, with their SQL.

The dictionary: every two neighbouring words of a benchmark item name the item. Documents are ranked by the terms of the
three example queries taken as one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import cooccur, entities, expansion, index, search
from .catalog import _TAG5, TOKS, TWO, _docs, _hits, _t


def _dictionary(s, d):
    return entities.names(_t(s, d, "benchmark"), 2)


def _mentions(s, d):
    return entities.mentions(_docs(s, d), _dictionary(s, d))


def ambiguity_index(s, d):
    return entities.ambiguity(_dictionary(s, d))


def title_collisions(s, d):
    return entities.collisions(_dictionary(s, d))


def phrase_lengths(s, d):
    """Phrases of two and of five words."""
    both = _dictionary(s, d).unionByName(entities.names(_t(s, d, "benchmark"), 5))
    return entities.lengths(both)


def phrase_hist(s, d):
    return entities.frequencies(_mentions(s, d))


def suggest_entity(s, d):
    return entities.suggested(_dictionary(s, d), ["the"])


def _near(s, d):
    """phrase, qpf: phrases in the slices of twenty words around hits."""
    around = cooccur.merged(cooccur.slices(_hits(s, d), 20, 20))
    return cooccur.overlapping(around, _mentions(s, d).withColumnRenamed("phrase", "phrase_id")).groupBy(F.col("phrase_id").alias("phrase")).agg(F.count(F.lit(1)).alias("qpf"))


def entities_in_slices(s, d):
    return _near(s, d)


def entity_pmi(s, d):
    hits = _mentions(s, d).withColumnRenamed("phrase", "phrase_id")
    return cooccur.pmi_entities(_hits(s, d), hits, index.collection_stats(_docs(s, d)).select("coll_len"), 20, 20).withColumnRenamed("phrase_id", "phrase")


def _log_pmi(s, d):
    cf = _mentions(s, d).groupBy("phrase").agg(F.count(F.lit(1)).alias("cf"))
    return entities.log_pmi(_near(s, d), cf, _hits(s, d).agg(F.count(F.lit(1)).alias("n_hits")), index.collection_stats(_docs(s, d)))


def mention_expansion(s, d):
    hits = entities.expanded(_mentions(s, d), entities.ambiguity(_dictionary(s, d)))
    return hits.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def mention_entity_pmi(s, d):
    return entities.split_evenly(_log_pmi(s, d), _dictionary(s, d))


def _uses(s, d):
    """phrase, entity, n: how often the item holds the phrase."""
    return entities.mentions(_t(s, d, "benchmark"), _dictionary(s, d), key="item_id").groupBy("phrase", F.col("doc_id").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


def mention_priors(s, d):
    return entities.priors(_uses(s, d)).select("phrase", "entity", "n", F.round("log_p", 6).alias("log_p"))


def prior_pmi(s, d):
    """The entity's own score is the log of its number of words over the largest."""
    size = _t(s, d, "benchmark").select(F.col("item_id").alias("entity"), F.size(fn.tokens(F.col("text"))).alias("n")).filter("n > 0")
    prior = size.join(F.broadcast(size.agg(F.max("n").alias("most")))).select("entity", F.ln(F.col("n") / F.col("most")).alias("escore"))
    return entities.with_entity_prior(_log_pmi(s, d), _dictionary(s, d), prior)


def linker_pmi(s, d):
    return entities.linked(_log_pmi(s, d), entities.priors(_uses(s, d)))


def category_pmi(s, d):
    """Categories are the sources of documents; near are the documents with a hit."""
    near = _hits(s, d).select("doc_id").distinct().withColumn("near", F.lit(1))
    counted = _docs(s, d).join(near, "doc_id", "left").groupBy(F.col("source").alias("category")).agg(F.count("near").alias("near"), F.count(F.lit(1)).alias("total"))
    return entities.category_pmi(counted)


def _ranked(s, d):
    found = index.cut(search.likelihood(_docs(s, d), search.counted({"all": [t for ts in TWO.values() for t in ts]}), "dirichlet", None).select("doc_id", "score"))
    # every candidate is ranked, so the softmax is made of aggregates and not in the one partition of a window
    e = found.join(F.broadcast(found.agg(F.max("score").alias("best")))).select("doc_id", F.exp(F.col("score") - F.col("best")).alias("e"))
    return e.join(F.broadcast(e.agg(F.sum("e").alias("total")))).select("doc_id", (F.col("e") / F.col("total")).alias("posterior"))


def entity_scores(s, d):
    """All eight scores; the name's posterior is the share of the entity in the uses of the phrase."""
    docs = index.cut(index.doc_stats(_docs(s, d)))
    return entities.relevance(_ranked(s, d), _mentions(s, d), entities.priors(_uses(s, d)), docs, docs.agg(F.sum("len").alias("coll_len")))


def expert_scores(s, d):
    docs = index.cut(index.doc_stats(_docs(s, d)))
    by_phrase = expansion.entity_scores(_ranked(s, d), _mentions(s, d).withColumnRenamed("phrase", "phrase_id"), docs, docs.agg(F.sum("len").alias("coll_len")), 15)  # rounded once, at the end
    return entities.expert_scores(by_phrase.withColumnRenamed("phrase_id", "phrase"), _dictionary(s, d))


def spread_scores(s, d):
    """Odds: the entity's number of phrases."""
    odds = _dictionary(s, d).groupBy("entity").agg(F.count(F.lit(1)).cast("double").alias("odds"))
    return entities.spread_scores(_mentions(s, d), _ranked(s, d), _dictionary(s, d), odds)


def query_tags(s, d):
    """Queries are the turns of conversations."""
    turns = _t(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("qid"), "text")
    return entities.mentions(turns, entities.names(_t(s, d, "benchmark"), 2), key="qid").select("phrase", F.col("doc_id").alias("qid"), F.col("start").cast("long").alias("start"))


def tagged_query_rank(s, d):
    """Each item asks for its phrases, each of weight 1."""
    asked = _dictionary(s, d).select(F.col("entity").alias("qid"), "phrase", F.lit(1.0).alias("weight"))
    return entities.bag_scores(_mentions(s, d), asked)


QUERIES = {f.__name__: f for f in (ambiguity_index, title_collisions, phrase_lengths, phrase_hist, suggest_entity, entities_in_slices, entity_pmi, mention_expansion, mention_entity_pmi, mention_priors, prior_pmi, linker_pmi, category_pmi, entity_scores, expert_scores, spread_scores, query_tags, tagged_query_rank)}

# dic: phrase, entity; uses: phrase, entity, n; men: phrase, doc_id, start
_PAIRS = "w[i] || ' ' || w[i + 1] phrase from (select *, unnest(range(1, len(w))) i from"
_DIC = f"{TOKS}, bi as (select item_id entity, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') w from benchmark), u0 as (select entity, {_PAIRS} bi)), uses as (select phrase, entity, count(*) n from u0 group by all), dic as (select phrase, entity from uses), pk as (select phrase, count(*) k from dic group by phrase), men as (select phrase, doc_id, i - 1 as start from (select doc_id, i, {_PAIRS} d)) join pk using (phrase))"
_NEAR = f"{_DIC}, hits as (select a.doc_id, a.pos as start from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the'), sl as (select distinct doc_id, greatest(start - 20, 0) b, start + 22 e from hits), fl as (select *, case when max(e) over (partition by doc_id order by b, e rows between unbounded preceding and 1 preceding) >= b then 0 else 1 end n from sl), isl as (select *, sum(n) over (partition by doc_id order by b, e) i from fl), mg as (select doc_id, min(b) b, max(e) e from isl group by doc_id, i), near as (select phrase, count(*) qpf from men join mg using (doc_id) where b < start + 2 and start < e group by phrase), fq as (select phrase, count(*) cf from men group by phrase), lp as (select phrase, qpf, cf, (qpf / c) / ((cf / c) * ((select count(*) from hits) / c)) pmi from near join fq using (phrase), coll)"
_TERMS = ", ".join(f"('{t}')" for ts in TWO.values() for t in ts)
_RANKED = f"rq(term) as (values {_TERMS}), rtf as (select doc_id, term, count(*) tf from tok where term in (select term from rq) group by all), rk0 as (select term, cf from rq join st using (term)), rca as (select distinct doc_id from rtf), rsc as (select rca.doc_id, round(avg(ln(coalesce(tf, 0) + 1500.0 * cf / c) - ln(len + 1500.0)), 6) score from rca cross join rk0 left join rtf on rtf.doc_id = rca.doc_id and rtf.term = rk0.term join dl on dl.doc_id = rca.doc_id, coll group by rca.doc_id), rpo as (select doc_id, exp(score - max(score) over ()) e from rsc), rk as (select doc_id, e / sum(e) over () posterior from rpo)"
_ERM = f"{_DIC}, {_RANKED}, ec as (select phrase, doc_id, count(*) n from men group by all), ef as (select phrase, sum(n) cf from ec group by phrase), ut as (select phrase, sum(n) total from uses group by phrase), pn as (select phrase, entity, n / total p from uses join ut using (phrase)), x as (select phrase, doc_id, posterior, n / len r, cf / c g from ec join ef using (phrase) join rk using (doc_id) join dl using (doc_id), coll)"
ORACLE_SQL = {
    "ambiguity_index": f"{_DIC} select phrase, entity, k n from dic join pk using (phrase) where k > 1",
    "title_collisions": f"{_DIC} select k n_entities, count(*) n_phrases from pk group by k",
    "phrase_lengths": f"{_DIC} select 2::bigint size, count(*) n from pk union all select 5, count(distinct array_to_string(w[i:i + 4], ' ')) from (select w, unnest(range(1, len(w) - 3)) i from bi)",
    "phrase_hist": f"{_DIC} select freq, count(*) n from (select phrase, count(*) freq from men group by phrase) group by freq",
    "suggest_entity": f"{_DIC} select phrase, k n_entities from pk where ' ' || phrase || ' ' like '% the %'",
    "entities_in_slices": f"{_NEAR} select phrase, qpf from near",
    "entity_pmi": f"{_NEAR} select phrase, qpf, cf, round(pmi, 6) pmi from lp order by pmi desc, phrase limit 30",
    "mention_expansion": f"{_DIC} select case when k > 1 then cast(entity as varchar) else phrase end entity, count(*) n from men join dic using (phrase) join pk using (phrase) group by 1",
    "mention_entity_pmi": f"{_NEAR} select entity, round(sum(ln(pmi) - ln(k)), 6) score from lp join dic using (phrase) join pk using (phrase) group by entity",
    "mention_priors": f"{_DIC} select phrase, entity, n, round(ln(n / sum(n) over (partition by phrase)), 6) log_p from uses",
    "prior_pmi": f"{_NEAR}, es as (select entity, ln(len(w) / (select max(len(w)) from bi)) escore from bi where len(w) > 0), ek as (select entity, count(*) k from dic group by entity) select entity, round(sum(ln(pmi) + escore - ln(ek.k)), 6) score from lp join dic using (phrase) join ek using (entity) join es using (entity) group by entity",
    "linker_pmi": f"{_NEAR}, pr as (select phrase, entity, ln(n / sum(n) over (partition by phrase)) log_p from uses) select entity, round(sum(ln(pmi) + log_p), 6) score from lp join pr using (phrase) group by entity",
    "category_pmi": f"{_NEAR}, cc as (select source category, count(*) filter (where doc_id in (select doc_id from hits)) near, count(*) total from documents group by source) select category, round(ln((near / (select sum(near) from cc)) / (total / (select sum(total) from cc))), 6) pmi from cc where near > 4 order by pmi desc, category limit 5",
    "entity_scores": f"{_ERM} select entity, round(sum(posterior * r), 6) rm, round(sum(posterior * r / g), 6) drm, round(sum(ln(posterior) + ln(r) - ln(g)), 6) gdrm, round(sum(ln(r) - ln(g)), 6) gnb, round(sum(posterior * r * p), 6) wrm, round(sum(posterior * r / g * p), 6) wdrm, round(sum(ln(posterior) + ln(r) - ln(g) + ln(p)), 6) wgdrm, round(sum(ln(r) - ln(g) + ln(p)), 6) wgnb from x join pn using (phrase) group by entity",
    "entity_relevance_ranked": f"{_TAG5}, {_RANKED}, ec as (select phrase, doc_id, count(*) n from tag5 group by all), ef as (select phrase, sum(n) cf from ec group by phrase) select phrase phrase_id, round(sum(posterior * n / len), 6) rm, round(sum(posterior * n / len / (cf / c)), 6) drm, round(sum(ln(posterior) + ln(n / len) - ln(cf / c)), 6) gdrm, round(sum(ln(n / len) - ln(cf / c)), 6) gnb from ec join ef using (phrase) join rk using (doc_id) join dl using (doc_id), coll group by phrase",
    "expert_scores": f"{_ERM}, sp as (select phrase, sum(posterior * r) rm, sum(posterior * r / g) drm, sum(ln(posterior) + ln(r) - ln(g)) gdrm, sum(ln(r) - ln(g)) gnb from x group by phrase), fk as (select entity, count(*) k from dic group by entity) select entity, round(sum(rm) / any_value(k), 6) rm, round(sum(drm) / any_value(k), 6) drm, round(sum(gdrm) / any_value(k), 6) gdrm, round(sum(gnb) / any_value(k), 6) gnb from sp join dic using (phrase) join fk using (entity) group by entity",
    "spread_scores": f"{_ERM}, own as (select phrase, doc_id, entity from men join dic using (phrase)), m as (select entity, count(*) m from own group by entity), e as (select doc_id, count(distinct entity) e from own group by doc_id), od as (select entity, count(*) odds from dic group by entity) select entity, round(sum(1 / m / e * posterior * odds), 6) score from own join m using (entity) join e using (doc_id) join rk using (doc_id) join od using (entity) group by entity",
    "query_tags": "with b as (select regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from benchmark), p as (select distinct w[i] || ' ' || w[i + 1] phrase from (select w, unnest(range(1, len(w))) i from b)), c as (select conv_id || ':' || turn qid, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from conversations) select phrase, qid, i - 1 as start from (select qid, i, w[i] || ' ' || w[i + 1] phrase from (select qid, w, unnest(range(1, len(w))) i from c)) join p using (phrase)",
    "tagged_query_rank": f"{_DIC}, bc as (select doc_id, phrase, count(*) c from men group by all), bl as (select doc_id, sum(c) len from bc group by doc_id), bf as (select phrase, sum(c) cf from bc group by phrase), aq as (select entity qid, phrase, cf from dic join bf using (phrase)), ca as (select distinct qid, doc_id from aq join bc using (phrase)) select ca.qid, ca.doc_id, round(avg(ln((1 - 0.8::double) * cf / (select sum(c) from bc) + 0.8::double * coalesce(bc.c, 0) / len)), 6) score from ca join aq using (qid) left join bc on bc.doc_id = ca.doc_id and bc.phrase = aq.phrase join bl on bl.doc_id = ca.doc_id group by ca.qid, ca.doc_id",
}

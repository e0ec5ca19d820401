"""Queries of lookups, spans and feature lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import index, lookup, search
from .catalog import HITS, PHRASE, TERMS, TOKS, _docs, _hits, _t, _toks


def label_filter(s, d):
    return lookup.labelled(_docs(s, d), "lang", "de")


def number_pairs(s, d):
    return lookup.numbers(_docs(s, d), "n_chars")


def pull_documents(s, d):
    """Documents asked for by id (those that labels name) and by name (here the source)."""
    docs = _docs(s, d).withColumn("name", F.col("source"))
    asked = _t(s, d, "labels").select(F.col("doc_id").cast("string").alias("asked"))
    asked = asked.union(docs.select("source")).union(s.createDataFrame([("no such name",)], "asked string")).distinct()
    return lookup.pull(docs, asked).select("asked", "doc_id", "lang")


def match_documents(s, d):
    return lookup.match_documents(_toks(s, d), [*TERMS, "nosuchterm"], "AND", 200)


def match_documents_any(s, d):
    return lookup.match_documents(_toks(s, d), [*TERMS, "nosuchterm"], "OR", None)


def match_page(s, d):
    """The second page of fifty matches in order of ids."""
    return search.match(_toks(s, d), TERMS, 1).orderBy("doc_id").offset(50).limit(50)


def tag_spans(s, d):
    return lookup.line_spans(_docs(s, d)).select("doc_id", "no", "begin", "end")


def _placed(s, d):
    spans = lookup.line_spans(_docs(s, d)).unionByName(lookup.hit_spans(_hits(s, d), "phrase"))
    return lookup.tokens_in_spans(_toks(s, d), spans)


def span_tokens(s, d):
    return _placed(s, d).groupBy("doc_id", "no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("tags") > 0).alias("n_tagged"), F.sum("pos").alias("sum_pos"))


def near_far(s, d):
    return lookup.lines_near_and_far(_docs(s, d), PHRASE)


def list_tags(s, d):
    spans = lookup.line_spans(_docs(s, d)).unionByName(lookup.hit_spans(_hits(s, d), "phrase"))
    return spans.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def pull_sentences(s, d):
    """The lines of the documents that are labelled toxic."""
    wanted = _t(s, d, "labels").filter("toxic = 1").select("doc_id")
    return lookup.lines(_docs(s, d).join(wanted, "doc_id", "left_semi")).select("doc_id", "no", F.md5("line").alias("line_md5"), F.size("terms").cast("long").alias("n"))


def random_sentences(s, d):
    return lookup.sample_by_hash(lookup.lines(_docs(s, d)).select("doc_id", "no"), ["doc_id", "no"], 50)


def hash_sample(s, d):
    return lookup.sample_by_hash(_hits(s, d).select("doc_id", F.col("start").cast("long").alias("start")), ["doc_id", "start"], 100).orderBy("doc_id", "start")


def feature_whitelist(s, d):
    return lookup.feature_list(index.term_stats(_toks(s, d)))


def whitelist_intersect(s, d):
    words = lambda t: _t(s, d, t).select(F.explode(fn.tokens(F.col("text"))).alias("term"))
    return words("benchmark").intersect(words("conversations"))


def break_pairs(s, d):
    return lookup.break_pairs(lookup.line_spans(_docs(s, d)))


def ngrams_top(s, d):
    return index.top_grams(_docs(s, d), 100, 3).select(F.col("size").alias("n"), "gram", F.col("n").alias("freq"))


QUERIES = {f.__name__: f for f in (label_filter, number_pairs, pull_documents, match_documents, match_documents_any, match_page, tag_spans, span_tokens, near_far, list_tags, pull_sentences, random_sentences, hash_sample, feature_whitelist, whitelist_intersect, break_pairs, ngrams_top)}

_ANY = "('the', 'for', 'that', 'nosuchterm')"
_MATCH = f"{TOKS}, own as (select * from tok where term in {_ANY}), kn as (select count(distinct term) n, string_agg(distinct term) t from own), miss as (select string_agg(x, ',' order by x) m from (values ('for'), ('nosuchterm'), ('that'), ('the')) v(x) where x not in (select term from own)), f as (select doc_id, count(distinct term) k from own group by doc_id)"
LINES = "ll as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents), ln as (select doc_id, unnest(range(len(l))) no, unnest(l) line from ll), lc as (select *, len(regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+')) n from ln), sp0 as (select doc_id, no, cast(coalesce(sum(n) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0) as bigint) b, n from lc), sp as (select doc_id, no, b, b + n e from sp0 where n > 0)"
_PLACED = f"{HITS}, {LINES}, pl as (select t.doc_id, no, pos, term, exists (select 1 from hits h where h.doc_id = t.doc_id and t.pos >= h.start and t.pos < h.start + 2) tagged from tok t join sp on sp.doc_id = t.doc_id and t.pos >= b and t.pos < e)"
ORACLE_SQL = {
    "label_filter": "select doc_id from documents where lang = 'de'",
    "number_pairs": "select doc_id, n_chars as \"value\" from documents where n_chars is not null",
    "pull_documents": "with a as (select cast(doc_id as varchar) asked from labels union select source from documents union select 'no such name'), n as (select source, min(doc_id) i from documents group by source) select asked, x.doc_id, x.lang from a left join n on n.source = asked left join documents x on cast(x.doc_id as varchar) = asked or (i = x.doc_id and asked not in (select cast(doc_id as varchar) from documents))",
    "match_documents": f"{_MATCH} select doc_id, coalesce(m, '') missing_terms from f, kn, miss where k >= n order by doc_id limit 200",
    "match_documents_any": f"{_MATCH} select doc_id, coalesce(m, '') missing_terms from f, miss",
    "match_page": f"{TOKS} select doc_id, count(distinct term) n_present from tok where term in ('the', 'for', 'that') group by doc_id order by doc_id limit 50 offset 50",
    "tag_spans": f"with {LINES} select doc_id, no, b \"begin\", e \"end\" from sp",
    "span_tokens": f"{_PLACED} select doc_id, no, count(*) n, count(*) filter (where tagged) n_tagged, cast(sum(pos) as bigint) sum_pos from pl group by doc_id, no",
    "near_far": f"{_PLACED}, near as (select distinct doc_id, no, true y from pl where tagged) select term, count(y) near, count(*) - count(y) far from pl left join near using (doc_id, no) group by term",
    "list_tags": f"{HITS}, {LINES} select 'line' tag, count(*) n from sp union all select 'phrase', count(*) from hits having count(*) > 0",
    "pull_sentences": f"with {LINES} select doc_id, no, md5(line) line_md5, n from lc where doc_id in (select doc_id from labels where toxic = 1)",
    "random_sentences": f"with {LINES} select doc_id, no from ln order by md5(doc_id || ':' || no), doc_id, no limit 50",
    "hash_sample": f"{HITS} select doc_id, start from hits order by md5(doc_id || ':' || start), doc_id, start limit 100",
    "feature_whitelist": f"{TOKS} select term, row_number() over (order by term) - 1 id from st where df > 5",
    "whitelist_intersect": "select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) term from benchmark intersect select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) from conversations",
    "break_pairs": f"with {LINES} select * from (select doc_id, b \"begin\", lead(b) over (partition by doc_id order by b) \"next\" from sp) where \"next\" is not null",
    "ngrams_top": f"{TOKS}, g as (select n, array_to_string(w[i:i + n - 1], ' ') gram from (select w, n, unnest(range(1, len(w) - n + 2)) i from d, (select unnest([1, 2, 3]) n))) select cast(n as integer) n, gram, count(*) freq from g group by all order by freq desc, n, gram limit 100",
}

"""Queries of stored corpora, markup spans and large dictionaries, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import blooms, entities, index, labeling, lookup, segments, spans, store
from ..sources import readers
from .catalog import HITS, TOKS, _docs, _hits, _t
from .lookups import LINES


def _place(s) -> str:
    return f"{index.shared(s)}/stored-{uuid.uuid4().hex}"


def markup_spans(s, d):
    return spans.markup_spans(_t(s, d, "pages")).withColumnRenamed("doc_id", "page_id")


def markup_tag_terms(s, d):
    """How many tokens and different terms stand in headings, paragraphs, links and bold print, and how many of these in links as well."""
    pages = index.cut(spans.marked_up(_t(s, d, "pages")))
    toks = pages.select("doc_id", F.posexplode("terms").alias("pos", "term"))
    own = pages.select("doc_id", F.inline("spans")).filter(F.col("tag").isin("h1", "p", "a", "b"))
    placed = spans.stabbed(toks, own.select("doc_id", "begin", "end", "tag")).select("tag", "doc_id", "pos", "term").distinct()
    return placed.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("n_terms"))


def _runs(rows, n):
    t = F.col("t")
    made = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.slice(t, i, n))
    return rows.select(fn.tokens(F.col("text")).alias("t")).filter(F.size("t") >= n).select(F.explode(made).alias("terms"))


def dictionary_large(s, d):
    """Every run of three words of the documents as a phrase: which of them stand in conversations, and how often. The Bloom filter lets few other runs through to the join."""
    said = _t(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    # phrases that no conversation may hold are left out before they are shuffled, by the bits of the conversations' runs
    asked = index.cut(_runs(said, 3).select(F.xxhash64("terms").alias("key")).distinct())
    held = blooms.bloom(asked, "key", n := asked.count())
    known = blooms.may_hold(_runs(_docs(s, d), 3).withColumn("key", F.xxhash64("terms")), "key", held, n)
    known = index.cut(known.select("terms").distinct().select(F.array_join("terms", " ").alias("phrase"), "terms"))
    return entities.mentions(said, known, most=1_000).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def dictionary_detected(s, d):
    """Runs of one to three words of items as a dictionary with repeated patterns, told in a tagger's order."""
    items = _t(s, d, "benchmark").select(F.col("item_id").alias("entity"), fn.tokens(F.col("text")).alias("t"))
    firsts = F.array(*[F.slice("t", 1, n) for n in (1, 2, 3)])
    known = items.filter(F.size("t") >= 3).select("entity", F.explode(firsts).alias("terms"))
    return entities.detected(_docs(s, d), known)


def _stored(s, d):
    hits = _hits(s, d).select(F.lit("of the").alias("phrase"), "doc_id", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"))
    return store.store(_docs(s, d), _place(s), hits)


def stored_slices(s, d):
    """Terms around every hit, pulled from the forward table."""
    kept = _stored(s, d)
    wanted = kept.table("hits").select("doc_id", F.greatest(F.col("start") - 3, F.lit(0)).alias("begin"), (F.col("start") + F.col("size") + 3).alias("end"))
    return kept.slices(wanted).select("doc_id", "begin", "end", F.array_join("terms", " ").alias("terms"))


def stored_around(s, d):
    """What stands near hits, from two tables in the same buckets."""
    return _stored(s, d).around_hits(5, 5).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def stored_sentences(s, d):
    """Tokens of lines with the document's language, from three tables in the same buckets."""
    rows = _stored(s, d).tokens_of_sentences()
    return rows.groupBy("doc_id", "sentence", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def stored_hits(s, d):
    """Hits of a phrase in toxic documents, by phrase and by document."""
    kept, wanted = _stored(s, d), _t(s, d, "labels").filter("toxic = 1").select("doc_id").distinct()
    by_phrase = kept.hits_of(["of the", "no such"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_phrase.join(kept.hits_in(wanted).groupBy("doc_id").agg(F.min("start").alias("first")), "doc_id")


def _cells(s, d):
    return store.CovariateStore(s, _place(s), "n_chars", "lang", 500).write(_docs(s, d))


def covariate_store_range(s, d):
    return _cells(s, d).between((1000, 3000), ["de", "en"]).select("doc_id", "n_chars", "lang")


def covariate_store_cells(s, d):
    """Documents that have the length and the language of a document labelled toxic."""
    docs = _docs(s, d)
    wanted = docs.join(_t(s, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select(F.col("n_chars").alias("x"), F.col("lang").alias("y"))
    return _cells(s, d).of_cells(wanted).select("doc_id", "n_chars", "lang")


def stored_appended(s, d):
    """Counts of terms of an index that grew by thirds of the documents, the second append bringing the first third's names with other texts again."""
    docs, part = _docs(s, d).withColumn("name", F.col("doc_id").cast("string")), F.col("doc_id") % 3
    again = docs.filter(part == 0).withColumn("text", F.lit("a later text of the name")).withColumn("doc_id", -1 - F.col("doc_id"))
    grown = segments.GrowingIndex(s, _place(s)).append(docs.filter(part == 0)).append(docs.filter(part == 1).union(again)).compact()
    return segments.GrowingIndex(s, grown.folder).append(docs.filter(part == 2)).terms()


def tag_class_rows(s, d):
    """Tokens of paragraphs as examples of the links and the bold print they stand in; bold is a property."""
    pages = index.cut(spans.marked_up(_t(s, d, "pages")))
    toks = pages.select("doc_id", F.posexplode("terms").alias("pos", "term"))
    own = pages.select("doc_id", F.inline("spans")).filter(F.col("tag").isin("p", "a", "b")).select("doc_id", "tag", "no", "begin", "end")
    # a token may stand in several paragraphs: the last that began counts
    placed = lookup.tokens_in_spans(toks, own, "p").groupBy("doc_id", "pos").agg(F.max("no").alias("no"), F.first("term").alias("term"), F.first("tags").alias("tags"))
    tags = F.transform("tags", lambda t: F.when(t == "b", "x/Text:Bold").otherwise(F.concat(F.lit("x/"), t)))
    tokens = placed.select(F.struct("doc_id", "pos").alias("item_id"), F.struct("doc_id", "no").alias("sentence"), tags.alias("tags"), F.array("term").alias("features"))
    ids = index.cut(lookup.feature_list(index.term_stats(toks), 2))
    rows = labeling.class_rows(tokens, ids, 5)
    return rows.groupBy("kind", "name", "class_id", "line").agg(F.count(F.lit(1)).alias("n"))


def reader_annotated_files(s, d):
    """Items as annotated documents in files of their own, lines as sentences; as many files as there are items."""
    made = F.transform(F.split("text", "\n"), lambda x: F.struct(fn.tokens(x).alias("tokens"), F.transform(fn.tokens(x), lambda y: F.translate(y, "abcdefghij", "ABCDEFGHIJ")).alias("lemmas"), fn.tokens(x).alias("pos")))
    rows = _t(s, d, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("name"), F.to_json(F.struct(made.alias("sentences"))).alias("value"))
    rows.write.partitionBy("name").text(path := _place(s))
    # each item's folder holds its file: the name is the folder's
    found = readers.annotated_files(s, f"{path}/*", lower=True, folder=True)
    return found.filter("end > begin").select("id", "no", "begin", "end", F.md5(F.array_join("lemmas", " ")).alias("lemmas_md5"))


QUERIES = {f.__name__: f for f in (markup_spans, markup_tag_terms, dictionary_large, dictionary_detected, stored_slices, stored_around, stored_sentences, stored_hits, covariate_store_range, covariate_store_cells, stored_appended, tag_class_rows, reader_annotated_files)}

# events in order; depth of a name's open tags, held at 0 where closing tags have none; an opening tag ends at the next event of its level
MARKED = f"""with h as (select page_id, regexp_extract_all(lower(coalesce(html, '')), '(?s){spans.MARKUP}') m from pages),
e0 as (select page_id, unnest(m) x, unnest(range(len(m))) i from h),
e as (select page_id, i, x, x[1] <> '<' tok, regexp_extract(x, '^</?([a-z][a-z0-9:-]*)', 1) tag, x[2] = '/' closing, regexp_matches(x, '^<(script|style)') and contains(x, '</') raw from e0),
p as (select *, coalesce(sum(tok::int) over (partition by page_id order by i rows between unbounded preceding and 1 preceding), 0) pos from e),
total as (select page_id, sum(tok::int) n from e group by page_id),
t as (select *, tag in ({", ".join(f"'{v}'" for v in spans.VOID)}) or raw as empty from p where not tok and tag <> ''),
c as (select *, sum(case when closing then -1 else 1 end) over w c from t where closing or not empty window w as (partition by page_id, tag order by i)),
m as (select *, least(0, min(c) over (partition by page_id, tag order by i)) low, least(0, coalesce(min(c) over (partition by page_id, tag order by i rows between unbounded preceding and 1 preceding), 0)) below from c),
v as (select *, case when closing then c - low + 1 else c - low end level from m where not closing or c >= below),
q as (select *, lead(pos) over (partition by page_id, tag, level order by i) upto from v),
d as (select page_id, i, sum(case when closing then -1 else 1 end) over (partition by page_id order by i) after from v),
o as (select page_id, i, tag, pos, upto from q where not closing union all select page_id, i, tag, pos, pos from t where empty and not closing),
sp as (select o.page_id, o.tag, row_number() over (partition by o.page_id order by o.i) - 1 no, o.pos::bigint "begin", coalesce(o.upto, n)::bigint "end",
  coalesce(last_value(d.after ignore nulls) over (partition by o.page_id order by o.i rows between unbounded preceding and current row), 0) depth_after, d.after is null as void, o.i
  from o join total using (page_id) left join d on d.page_id = o.page_id and d.i = o.i)"""
_GRAMS = "g as (select distinct array_to_string(w[i:i + 2], ' ') phrase from (select w, unnest(range(1, len(w) - 1)) i from d)), cw as (select regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from conversations), cg as (select array_to_string(w[i:i + 2], ' ') phrase from (select w, unnest(range(1, len(w) - 1)) i from cw))"
_FIRSTS = "b0 as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from benchmark), b as (select array_to_string(w[1:n], ' ') phrase, n, min(item_id) entity from b0, (select unnest([1, 2, 3]) n) where len(w) >= 3 group by all), f as (select doc_id, i - 1 start, n size, array_to_string(w[i:i + n - 1], ' ') phrase from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select unnest([1, 2, 3]) n)))"
ORACLE_SQL = {
    "markup_spans": f"{MARKED}, inner_ as (select page_id, i, sum(delta) over (partition by page_id order by i rows between unbounded preceding and 1 preceding) depth from (select page_id, i, case when closing then -1 else 1 end delta from v union all select page_id, i, 0 from t where empty and not closing)) select sp.page_id, tag, no, \"begin\", \"end\", coalesce(depth, 0)::bigint depth from sp join inner_ using (page_id, i)",
    "markup_tag_terms": f"{MARKED}, w as (select page_id, pos, x term from p where tok), pl as (select distinct tag, w.page_id, w.pos, term from w join sp on sp.page_id = w.page_id and w.pos >= \"begin\" and w.pos < \"end\" where tag in ('h1', 'p', 'a', 'b')) select tag, count(*) n, count(distinct term) n_terms from pl group by tag",
    "dictionary_large": f"{TOKS}, {_GRAMS} select phrase, count(*) n from cg join g using (phrase) group by phrase",
    "dictionary_detected": f"{TOKS}, {_FIRSTS} select doc_id, row_number() over (partition by doc_id order by start + size, size desc) - 1 no, start, size::bigint size, entity from f join b using (phrase)",
    "stored_slices": f"{HITS}, s as (select distinct doc_id, greatest(start - 3, 0) b, start + 5 e from hits) select s.doc_id, b \"begin\", e \"end\", string_agg(term, ' ' order by pos) terms from s join tok t on t.doc_id = s.doc_id and pos >= b and pos < e group by all",
    "stored_around": f"{HITS} select term, count(*) n from hits h join tok t on t.doc_id = h.doc_id and pos >= h.start - 5 and pos < h.start + 7 group by term",
    "stored_sentences": f"with {LINES} select sp.doc_id, no sentence, lang, e - b n, b \"first\" from sp join documents using (doc_id)",
    "stored_hits": f"{HITS} select doc_id, count(*) n, min(start) \"first\" from hits where doc_id in (select doc_id from labels where toxic = 1) group by doc_id",
    "reader_annotated_files": "with l as (select item_id, string_split(text, chr(10)) l from benchmark), n as (select item_id, unnest(range(len(l))) no, unnest(l) line from l), w as (select item_id, no, regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+') w from n), b as (select item_id id, no, coalesce(sum(len(w)) over (partition by item_id order by no rows between unbounded preceding and 1 preceding), 0)::bigint b, w from w) select id, no, b \"begin\", b + len(w) \"end\", md5(array_to_string(w, ' ')) lemmas_md5 from b where len(w) > 0",
    "tag_class_rows": f"{MARKED}, w as (select page_id, pos, x term from p where tok), pl as (select w.page_id, w.pos, term, max(no) no from w join sp on sp.page_id = w.page_id and w.pos >= \"begin\" and w.pos < \"end\" where tag = 'p' group by all), tg as (select distinct pl.page_id, pl.pos, tag from pl join sp on sp.page_id = pl.page_id and pl.pos >= \"begin\" and pl.pos < \"end\" where tag in ('a', 'b')), cl as (select page_id, pos, unnest(case when tag = 'b' then [('label', 'text:bold'), ('prop', 'bold')] else [('label', tag), ('obj', tag)] end) c from tg), fr as (select c, row_number() over (order by c[1], c[2]) class_id from cl group by c having count(*) >= 5), nm as (select page_id, pos, c[1] kind, c[2] \"name\", class_id from cl join fr using (c)), nr as (select distinct page_id, no from pl join tg using (page_id, pos)), nn as (select pl.page_id, pl.pos, 'null' kind, case when nr.no is null then 'far' else 'near' end \"name\", 0 class_id from pl left join nr on nr.page_id = pl.page_id and nr.no = pl.no where (pl.page_id, pl.pos) not in (select (page_id, pos) from nm)), ids as (select term, row_number() over (order by term) - 1 id from (select term from w group by term having count(distinct page_id) > 2)) select kind, \"name\", class_id::integer class_id, class_id || coalesce(' ' || id || ':1', '') line, count(*) n from (select * from nm union all select * from nn) x join pl using (page_id, pos) left join ids using (term) group by all",
    "stored_appended": f"{TOKS} select term, cf, df from st",
    "covariate_store_range": "select doc_id, n_chars, lang from documents where n_chars between 1000 and 3000 and lang in ('de', 'en')",
    "covariate_store_cells": "select doc_id, n_chars, lang from documents where (n_chars, lang) in (select n_chars, lang from documents join labels using (doc_id) where toxic = 1)",
}

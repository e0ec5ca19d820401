"""Queries of text functions, tokenizers and the ways to find hits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import labeling, search
from ..sources import readers
from .catalog import TOKS, _docs, _t, _toks
from .judging import _CW, _items, _judged


def tokenizer_counts(s, d):
    """Tokens and different ones by tokenizer; pages by what they show."""
    names = sorted(fn.TOKENIZERS)
    rows = _docs(s, d).select(F.inline(F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.size(fn.tokenizer(n)(F.col("text"))).cast("long").alias("n"), F.size(F.array_distinct(fn.tokenizer(n)(F.col("text")))).cast("long").alias("k")) for n in names])))
    return rows.groupBy("tokenizer").agg(F.sum("n").alias("n"), F.sum("k").alias("n_distinct"))


def page_text(s, d):
    return _t(s, d, "pages").select("page_id", fn.visible(F.col("html")).alias("text")).select("page_id", F.md5("text").alias("text_md5"), F.size(fn.tokens(F.col("text"))).cast("long").alias("n"))


def sentence_counts(s, d):
    cut = fn.sentences(F.coalesce("text", F.lit("")))
    return _docs(s, d).select("doc_id", cut.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def folded_texts(s, d):
    return _docs(s, d).select("doc_id", F.md5(fn.fold_accents(F.col("text"))).alias("folded_md5"))


def compacted_texts(s, d):
    """White space compacted, and what stands in the first parentheses."""
    return _docs(s, d).select("doc_id", F.md5(fn.compact_spaces(F.col("text"))).alias("compact_md5"), fn.between(F.col("text"), "(", ")").alias("inner"))


def hits_by_method(s, d):
    """Hits of one query by each method; stopwords don't count for the bag of words."""
    found = None
    for method in sorted(search.METHODS):
        own = search.find_hits(_toks(s, d), ["for", "that"] if method != "bag" else ["nicht", "the", "und"], method, 16, fn.STOPWORDS).select(F.lit(method).alias("method"), "doc_id", "start")
        found = own if found is None else found.unionByName(own)
    return found.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def named_corpus(s, d):
    """The first document of each source, its name with a prefix."""
    docs = _docs(s, d).select("doc_id", F.col("source").alias("name"))
    return readers.first_by_name(docs, "name", "doc_id", "given:")


def difference_classifier(s, d):
    """Scores of all documents by the classifier of counts, through the common interface."""
    own = labeling.CLASSIFIERS["difference"](50)
    model = own.train(_items(s, d).join(_judged(s, d), "item_id"))
    return own.score(_items(s, d), model)


QUERIES = {f.__name__: f for f in (tokenizer_counts, page_text, sentence_counts, folded_texts, compacted_texts, hits_by_method, named_corpus, difference_classifier)}

_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
_TOK = "'[\\p{L}\\p{N}]+'"
ORACLE_SQL = {
    "tokenizer_counts": f"with a as (select 'cased' tokenizer, regexp_extract_all(coalesce(text, ''), {_TOK}) w from documents union all select 'tokens', regexp_extract_all(lower(coalesce(text, '')), {_TOK}) from documents union all select 'words', list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') from documents) select tokenizer, cast(sum(len(w)) as bigint) n, cast(sum(len(list_distinct(w))) as bigint) n_distinct from a group by tokenizer",
    "page_text": f"with v as (select page_id, {_VISIBLE} t from pages) select page_id, md5(t) text_md5, len(regexp_extract_all(lower(t), {_TOK})) n from v",
    "sentence_counts": "with c as (select doc_id, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: x <> '') s from documents) select doc_id, len(s) n, md5(array_to_string(s, '|')) sentences_md5 from c",
    "folded_texts": "select doc_id, md5(strip_accents(text)) folded_md5 from documents",
    "compacted_texts": "select doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) compact_md5, nullif(regexp_extract(text, '(?s)\\((.*?)\\)', 1), '') \"inner\" from documents",
    "hits_by_method": f"{TOKS}, ft as (select * from tok where term in ('for', 'that')), fx as (select doc_id, pos, min(case when term = 'for' then pos end) over w a, min(case when term = 'that' then pos end) over w b from ft window w as (partition by doc_id order by pos rows between current row and unbounded following)), nt as (select * from tok where term in ('nicht', 'und')), nx as (select doc_id, pos, min(case when term = 'nicht' then pos end) over w a, min(case when term = 'und' then pos end) over w b, bool_or(term = 'nicht') over v ha, bool_or(term = 'und') over v hb from nt window w as (partition by doc_id order by pos rows between current row and unbounded following), v as (partition by doc_id)), f as (select doc_id, ha::int + hb::int k from nx where greatest(case when ha then coalesce(a, 1 << 30) else -1 end, case when hb then coalesce(b, 1 << 30) else -1 end) + 1 - pos <= 16), kk as (select case when count(*) filter (where k >= 2) >= 10 then 2 else 1 end least from f), h as (select 'phrase' method, x.doc_id from tok x join tok y on x.doc_id = y.doc_id and y.pos = x.pos + 1 where x.term = 'for' and y.term = 'that' union all select 'window', doc_id from fx where greatest(a, b) + 1 - pos <= 16 and a is not null and b is not null union all select 'bag', doc_id from f, kk where k >= least) select method, count(*) n, count(distinct doc_id) n_docs from h group by method",
    "named_corpus": "select min(doc_id) doc_id, 'given:' || source \"name\" from documents group by source",
    "difference_classifier": f"{_CW.replace('limit 100', 'limit 50')} select d.doc_id item_id, round(coalesce(s, 0.0), 6)::double score from d left join (select item_id, sum(weight) s from ws join cw using (feature) group by item_id) x on x.item_id = d.doc_id",
}

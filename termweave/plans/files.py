"""Queries of readers, writers and the stored index: the given tables go out in a format into the shared folder and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import index, search
from ..sources import readers
from .catalog import _IN, _QL, PHRASE, TERMS, TOKS, TWO, _docs, _t, _toks, ql_dirichlet


def _place(s) -> str:
    return f"{index.shared(s)}/files-{uuid.uuid4().hex}"


def _lines(rows, value, path) -> str:
    rows.select(value.alias("value")).write.text(path)
    return path


def reader_run(s, d):
    readers.write_run(ql_dirichlet(s, d).select("qid", F.col("doc_id").alias("doc"), "rank", "score", F.lit("base").alias("system")), path := _place(s))
    return readers.run_file(s, path)


def reader_qrels(s, d):
    readers.write_qrels(_t(s, d, "labels").select(F.lit("q1").alias("qid"), F.col("doc_id").alias("doc"), F.col("quality").alias("grade")), path := _place(s))
    return readers.qrels(s, path)


def reader_queries(s, d):
    """Items as queries in tab-separated lines."""
    readers.write_lines(_t(s, d, "benchmark").select("item_id", F.translate("text", "\n\t", "  ").alias("text")), ["item_id", "text"], path := _place(s))
    return readers.query_tsv(s, path).select("qid", F.md5("text").alias("text_md5"))


def reader_queries_json(s, d):
    """Objects of about a hundred queries each, dealt by hash, one a line."""
    one, n = F.struct(F.col("item_id").cast("string").alias("number"), "text"), _t(s, d, "benchmark").count() // 100 + 1
    _t(s, d, "benchmark").groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("part")).agg(F.collect_list(one).alias("queries")).drop("part").write.json(path := _place(s))
    return readers.queries_json(s, path, lines=True).select("qid", F.md5("text").alias("text_md5"))


def reader_features(s, d):
    docs = index.doc_stats(_docs(s, d)).join(_docs(s, d).select("doc_id", "lang", "n_chars"), "doc_id")
    pairs = F.array(F.struct(F.lit("1").alias("fid"), F.col("n_chars").cast("double").alias("value")), F.struct(F.lit("2").alias("fid"), F.col("len").cast("double").alias("value")))
    readers.write_features(docs.select(F.col("lang").alias("qid"), F.col("doc_id").cast("string").alias("doc"), F.lit(0).alias("grade"), F.inline(pairs)), path := _place(s))
    return readers.features_file(s, path)


def reader_json(s, d):
    _docs(s, d).select(F.col("doc_id").cast("string").alias("docid"), "text", "lang", "n_chars").write.json(path := _place(s))
    return readers.json_documents(s, path, "lang string, n_chars long, absent double").select("docid", F.md5("text").alias("text_md5"), "lang", "n_chars", "absent")


def reader_escaped_tsv(s, d):
    docs = _docs(s, d).select(F.col("doc_id").alias("name"), F.col("source").alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    readers.write_escaped_tsv(docs, path := _place(s))
    return readers.escaped_tsv(s, path).select("name", "title", F.md5("body").alias("body_md5"))


def reader_conll(s, d):
    """Conversations as documents, turns as sentences, words in four columns."""
    said = _t(s, d, "conversations").select("conv_id", "turn", fn.tokens(F.col("text")).alias("w"))
    block = F.array_join(F.transform("w", lambda x: F.concat(x, F.lit(" POS CH O"))), "\n")
    turns = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("b"))
    path = _lines(turns, F.concat(F.lit("-DOCSTART- -X- O O\n\n"), "b", F.lit("\n")), _place(s))
    return readers.conll(s, path).groupBy("word", "pos_tag", "ner").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") == 0).alias("n_first"))


def reader_triples(s, d):
    """Pages link to the host of their URL."""
    rows = _t(s, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).filter("host <> ''")
    line = F.concat(F.lit("<http://x/page/"), "page_id", F.lit("> <http://y/sameAs> <http://z/host/"), "host", F.lit("> ."))
    return readers.triples(s, _lines(rows, line, _place(s)), "sameAs").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def reader_categories(s, d):
    line = F.concat(F.lit("<http://x/doc/"), "doc_id", F.lit("> <http://y/subject> <http://z/Category:"), "source", F.lit("> ."))
    return readers.parts_of_triples(s, _lines(_docs(s, d), line, _place(s)), "subject").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def reader_edges(s, d):
    readers.write_lines(_docs(s, d), ["source", "lang"], path := _place(s))
    return readers.edges_tsv(s, path).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def reader_mentions(s, d):
    """Sources mention languages so many times each."""
    own = _docs(s, d).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "lang", "n"))).alias("x"))
    return readers.mention_counts(s, _lines(own, F.concat_ws("\t", F.col("source"), F.col("x")), _place(s)))


def reader_scans(s, d):
    """Conversations as scanned books, turns as pages."""
    word = lambda x: F.concat(F.lit('<WORD coords="1,2,3,4">'), x, F.lit("</WORD>"))
    page = F.concat(F.lit("<OBJECT>"), F.array_join(F.transform("w", word), ""), F.lit("</OBJECT>"))
    turns = _t(s, d, "conversations").select("conv_id", "turn", fn.tokens(F.col("text")).alias("w")).select("conv_id", F.struct("turn", page.alias("b")).alias("x"))
    books = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("b"))
    line = F.concat(F.lit('<DjVuXML archive="'), "conv_id", F.lit('"><BODY>'), "b", F.lit("</BODY></DjVuXML>"))
    scans = readers.page_scans(s, _lines(books, line, _place(s)), lines=True)
    return scans.select("archive", F.size("terms").cast("long").alias("n"), F.md5(F.array_join("terms", " ")).alias("terms_md5"), F.size(F.array_distinct("boxes")).cast("long").alias("n_boxes"))


def _books(s, d):
    """Conversations as scanned books of several lines, one file for each language of letters, turns as pages."""
    word = lambda x: F.concat(F.lit('<WORD coords="1,2,3,4">'), x, F.lit("</WORD>"))
    page = F.concat(F.lit("<OBJECT>"), F.array_join(F.transform(fn.tokens(F.col("text")), word), "\n"), F.lit("</OBJECT>"))
    rows = _t(s, d, "conversations").select((F.col("conv_id") % 3).cast("string").alias("book"), "conv_id", "turn", page.alias("value"))
    head = s.range(3).select(F.col("id").cast("string").alias("book"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.concat(F.lit('<DjVuXML archive="book'), "id", F.lit('"><BODY>')).alias("value"))
    tail = head.select("book", F.lit(1 << 62).alias("conv_id"), "turn", F.lit("</BODY></DjVuXML>").alias("value"))
    path = _place(s)
    head.union(rows).union(tail).repartition(3, "book").sortWithinPartitions("book", "conv_id", "turn").select("book", "value").write.partitionBy("book").text(path)
    return path


def reader_scans_files(s, d):
    """Books that are files of their own: each page is a row, numbered within its book."""
    return readers.page_scans(s, f"{_books(s, d)}/*").select("archive", "page", F.size("terms").cast("long").alias("n"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


def reader_csv(s, d):
    _t(s, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path := _place(s), header=True)
    return readers.codebook_csv(s, path, {"c_custkey": "number", "c_name": "categorical", "c_acctbal": "real"})


def reader_annotated(s, d):
    """Lines of documents as sentences; lemmas are the terms."""
    cut = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(fn.tokens(x).alias("tokens"), fn.tokens(x).alias("lemmas"), fn.tokens(x).alias("pos")))
    rows = _docs(s, d).select("doc_id", F.struct(cut.alias("sentences")).alias("x"))
    found = readers.annotated(s, _lines(rows, F.concat_ws("\t", F.col("doc_id").cast("string"), F.to_json("x")), _place(s)))
    return found.filter("end > begin").select(F.col("name").cast("long").alias("doc_id"), "no", "begin", "end")


def reader_annotations(s, d):
    c = [F.lit("-")] * 2 + [F.col("source")] + [F.lit("-")] * 4 + [F.col("lang")]
    readers.write_lines(_docs(s, d), c, path := _place(s))
    return readers.annotations_tsv(s, path).groupBy("mention", "entity").agg(F.count(F.lit(1)).alias("n"))


def reader_votes(s, d):
    """Pages of five events of a user, read back as votes."""
    items = _t(s, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("item"))
    readers.write_pages(items, path := _place(s))
    rows = s.read.csv(path, header=True)
    voted = rows.select(F.lit("w").alias("worker"), "qid", *[c for k in range(1, 6) for c in (f"item_{k}", F.lit(1).alias(f"vote_{k}"))])
    voted.write.csv(again := _place(s), header=True)
    return readers.voted_csv(s, again).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("n_items"))


def reader_difficulty(s, d):
    readers.write_lines(_docs(s, d), ["source", F.lit("hard"), F.lit("-"), "lang"], path := _place(s))
    return readers.difficulty_tsv(s, path).select("query", "difficulty", F.array_join("entities", ",").alias("entities"))


def reader_prior(s, d):
    readers.write_lines(_t(s, d, "embeddings"), ["vec_id", F.col("label").cast("double")], path := _place(s))
    return readers.prior_tsv(s, path)


def reader_topics(s, d):
    line = F.concat(F.lit('<topics><topic number="'), "item_id", F.lit('"><title>'), fn.tokens(F.col("text"))[0], F.lit("</title><description>"), F.array_join(fn.tokens(F.col("text")), " "), F.lit("</description></topic></topics>"))
    found = readers.topics_xml(s, _lines(_t(s, d, "benchmark"), line, _place(s)), lines=True)
    return found.select("qid", "title", F.md5("description").alias("description_md5"))


def reader_topics_html(s, d):
    line = F.concat(F.lit("<p><b>"), "item_id", F.lit("</b> <i>"), F.array_join(fn.tokens(F.col("text")), " "), F.lit("</i></p>"))
    return readers.topics_html(s, _lines(_t(s, d, "benchmark"), line, _place(s))).select("qid", F.md5("title").alias("title_md5"))


def reader_candidates(s, d):
    """Customers as candidates, and their forms."""
    line = F.concat(F.lit("candidate-"), "c_custkey", F.lit("  "), "c_mktsegment", F.lit(" "), "c_name", F.lit(" c"), "c_custkey", F.lit("@Example.org"))
    return readers.surface_forms(readers.candidates(s, _lines(_t(s, d, "customer"), line, _place(s))))


def reader_zips(s, d):
    """Nations as places with a code; the last has none."""
    rows = _t(s, d, "nation").select(F.when(F.col("n_nationkey") == 24, F.lit("99999")).otherwise(F.lpad(F.col("n_nationkey").cast("string"), 5, "0")).alias("zip"), F.col("n_name").alias("city"), F.lit("MA").alias("state"))
    rows.write.csv(path := _place(s))
    return readers.place_forms(readers.zip_codes(s, path), {"MA": "Massachusetts"})


def reader_titles(s, d):
    """Parts' names with underscores and a remark as titles."""
    titles = _t(s, d, "part").select(F.concat(F.translate(F.initcap("p_name"), " ", "_"), F.lit("_(kind)")).alias("title")).distinct()
    return readers.dictionary_of_titles(titles, 4).select("title", F.array_join("terms", " ").alias("terms"))


def positional_join(s, d):
    """Customers' names and numbers in two texts of several files, line by line."""
    rows = index.cut(_t(s, d, "customer").repartitionByRange("c_custkey").sortWithinPartitions("c_custkey"))
    a, b = (_lines(rows.sort("c_custkey"), v, _place(s)) for v in (F.col("c_name"), F.col("c_custkey").cast("string")))
    return readers.by_position(readers.numbered_lines(s, a), readers.numbered_lines(s, b)).select(F.col("left").alias("name"), F.col("right").alias("number"))


def named_archive(s, d):
    docs = _docs(s, d).select(F.col("source").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    readers.named_archive(docs, path := _place(s))
    return s.read.schema("name string, text string").json(path).select("name", F.md5("text").alias("text_md5"))


def dataset_config(s, d):
    """Documents read as a configuration file says."""
    row = F.struct(F.lit("given").alias("name"), F.lit(f"{d}/documents.parquet").alias("documents"), F.create_map(F.lit("lang"), F.lit("categorical"), F.lit("n_chars"), F.lit("number")).alias("variables"))
    path = _lines(s.range(1), F.to_json(row), _place(s))
    config = readers.dataset(s, path)
    return s.read.parquet(config["documents"]).groupBy(*sorted(k for k, v in config["variables"].items() if v == "categorical")).agg(F.count(F.lit(1)).alias("n"))


def _stored(s, d):
    return index.build(_docs(s, d), _place(s))


def stored_postings(s, d):
    return _stored(s, d).postings(TERMS).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def stored_terms(s, d):
    return _stored(s, d).terms()


def stored_phrase(s, d):
    return search.phrases(_stored(s, d).tokens(PHRASE), {1: PHRASE}).select("doc_id", F.col("start").cast("long").alias("start"))


def stored_ranking(s, d):
    """Query likelihood from postings and lengths alone: no text is read."""
    stored = _stored(s, d)
    return search.query_likelihood(stored.tokens([t for ts in TWO.values() for t in ts]), stored.lengths(), TWO, "dirichlet", 10)


def stored_names(s, d):
    """Sources of the labelled documents, and how many ids these sources have."""
    stored = _stored(s, d)
    names = stored.names_of(_t(s, d, "labels"), "source")
    return stored.ids_of(names, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def phrase_tables(s, d):
    """What is stored of phrases: for each term of a dictionary the phrases and places it has in them."""
    from .named import _dictionary

    known = _dictionary(s, d).select("phrase", "terms").distinct()
    return known.select("phrase", F.posexplode("terms").alias("offset", "term")).groupBy("term", "offset").agg(F.count(F.lit(1)).alias("n"))


def sentence_index(s, d):
    """Tokens of lines as stored sub-tables: tokens by term with how many lines and documents have it, from what comes back."""
    from ..operators import lookup

    cut = lookup.lines(_docs(s, d)).select("doc_id", "no", F.posexplode("terms").alias("pos", "term"))
    index.save({"tokens": cut}, path := _place(s))
    stored = s.read.parquet(f"{path}/tokens")
    # counted line by line, then document by document, a million tokens a task: a term's tokens are never one task's
    by_line = stored.repartition(stored.count() // 1_000_000 + 1, "term", "doc_id").groupBy("term", "doc_id", "no").agg(F.count(F.lit(1)).alias("n"))
    by_doc = by_line.groupBy("term", "doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_lines"))
    return by_doc.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("n_docs"))


QUERIES = {f.__name__: f for f in (reader_run, reader_qrels, reader_queries, reader_queries_json, reader_features, reader_json, reader_escaped_tsv, reader_conll, reader_triples, reader_categories, reader_edges, reader_mentions, reader_scans, reader_scans_files, reader_csv, reader_annotated, reader_annotations, reader_votes, reader_difficulty, reader_prior, reader_topics, reader_topics_html, reader_candidates, reader_zips, reader_titles, positional_join, named_archive, dataset_config, stored_postings, stored_terms, stored_phrase, stored_ranking, stored_names, phrase_tables, sentence_index)}

_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_A = f"{_QL}, a0 as (select qid, doc_id, round(avg(ln(tf + 1500.0 * cf / c) - ln(len + 1500.0)), 6) score from pr group by all), a as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) rank from a0) where rank <= 10)"
_ZIP = "z as (select lpad(n_nationkey::varchar, 5, '0') zip, n_name city from nation where n_nationkey <> 24)"
ORACLE_SQL = {
    "reader_run": f"{_A} select qid, doc_id::varchar doc, rank::integer rank, score, 'base' system from a",
    "reader_qrels": "select 'q1' qid, doc_id::varchar doc, quality grade from labels",
    "reader_queries": "select item_id::varchar qid, md5(translate(text, chr(10) || chr(9), '  ')) text_md5 from benchmark",
    "reader_queries_json": "select item_id::varchar qid, md5(text) text_md5 from benchmark",
    "reader_features": f"{TOKS} select lang qid, doc_id::varchar doc, 0 grade, '1' fid, n_chars::double \"value\" from documents union all select lang, doc_id::varchar, 0, '2', len::double from dl join documents using (doc_id)",
    "reader_json": "select doc_id::varchar docid, md5(text) text_md5, lang, n_chars, null::double absent from documents",
    "reader_escaped_tsv": "select doc_id::varchar \"name\", source title, md5(coalesce(text, '')) body_md5 from documents",
    "reader_conll": f"with w as (select conv_id, turn, {_W} w from conversations), u as (select unnest(w) word, unnest(range(len(w))) pos from w) select word, 'POS' pos_tag, 'O' ner, count(*) n, count(*) filter (where pos = 0) n_first from u group by word",
    "reader_triples": "select regexp_extract(url, '://([^/?#]*)', 1) dst, count(*) n from pages where regexp_extract(url, '://([^/?#]*)', 1) <> '' group by 1",
    "reader_categories": "select source category, count(*) n from documents group by source",
    "reader_edges": "select source src, lang dst, count(*) n from documents group by all",
    "reader_mentions": "select source mention, lang entity, count(*) n from documents group by all",
    "reader_scans": f"select conv_id::varchar archive, len(w) n, md5(array_to_string(w, ' ')) terms_md5, 1::bigint n_boxes from (select conv_id, {_W} w from conversations) where len(w) > 0",
    "reader_scans_files": f"select * from (select 'book' || (conv_id % 3) archive, row_number() over (partition by conv_id % 3 order by conv_id, turn) - 1 page, len(w) n, md5(array_to_string(w, ' ')) terms_md5 from (select *, {_W} w from conversations)) where n > 0",
    "reader_csv": "select c_custkey, c_name, c_acctbal from customer",
    "reader_annotated": "with ll as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents), ln as (select doc_id, unnest(range(len(l))) no, unnest(l) line from ll), lc as (select *, len(regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+')) n from ln) select doc_id, no, b \"begin\", b + n \"end\" from (select *, cast(coalesce(sum(n) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0) as bigint) b from lc) where n > 0",
    "reader_annotations": "select source mention, lang entity, count(*) n from documents group by all",
    "reader_votes": "select user_id::varchar qid, cast(case when count(*) < 5 then count(*) else 5 * ceil(count(*) / 5) end as bigint) n, count(*) n_items from events group by user_id",
    "reader_difficulty": "select source query, 'hard' difficulty, string_agg(distinct lang, ',' order by lang) entities from documents group by source",
    "reader_prior": "select vec_id::varchar id, label::double score from embeddings",
    "reader_topics": f"select item_id::varchar qid, w[1] title, md5(array_to_string(w, ' ')) description_md5 from (select item_id, {_W} w from benchmark)",
    "reader_topics_html": f"select item_id::varchar qid, md5(array_to_string(w, ' ')) title_md5 from (select item_id, {_W} w from benchmark)",
    "reader_candidates": "with p as (select 'candidate-' || c_custkey id, lower(c_mktsegment || ' ' || c_name) form, lower('c' || c_custkey || '@example.org') email from customer) select form, id, 'name' kind from p union all select email, id, 'email' from p",
    "reader_zips": f"with {_ZIP}, f as (select zip, unnest(list_distinct([zip, city || ' MA', city || ' Massachusetts', city || ' MA ' || zip, city || ' Massachusetts ' || zip, city || ' ' || zip, 'MA ' || zip, 'Massachusetts ' || zip, zip || ' ' || city, zip || ' ' || city || ' MA', zip || ' ' || city || ' Massachusetts', zip || ' MA', zip || ' Massachusetts'])) form from z) select lower(form) form, zip from f",
    "reader_titles": "with t as (select distinct p_name from part) select array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '_') || '_(kind)' title, p_name terms from t",
    "positional_join": "select c_name \"name\", c_custkey::varchar \"number\" from customer",
    "named_archive": "select source \"name\", md5(min(coalesce(text, ''))) text_md5 from documents group by source",
    "dataset_config": "select lang, count(*) n from documents group by lang",
    "stored_postings": f"{TOKS} select term, doc_id, count(*) tf, string_agg(pos, ',' order by pos) positions from tok where term in {_IN} group by all",
    "stored_terms": f"{TOKS} select term, cf, df from st",
    "stored_phrase": f"{TOKS} select a.doc_id, a.pos as start from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the'",
    "stored_ranking": f"{_A} select qid, doc_id, score, rank from a",
    "stored_names": "select source, count(*) n from documents where source in (select source from documents join labels using (doc_id)) group by source",
    "phrase_tables": f"with b as (select {_W} w from benchmark), p as (select distinct w[i] a, w[i + 1] b from (select w, unnest(range(1, len(w))) i from b)) select a term, 0 \"offset\", count(*) n from p group by a union all select b, 1, count(*) from p group by b",
    "sentence_index": "with ll as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents), ln as (select doc_id, unnest(range(len(l))) no, unnest(l) line from ll), t as (select doc_id, no, unnest(regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+')) term from ln) select term, count(*) n, count(distinct (doc_id, no)) n_lines, count(distinct doc_id) n_docs from t group by term",
}

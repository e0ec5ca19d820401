"""Queries of runs, judgments, features and classifiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import expansion, graph, index, labeling, lookup, runs, search
from ..sources import readers
from .catalog import _BOTH, _POST, _STOP, TOKS, _both, _docs, _ranks, _t, _toks, _word_sets, pooling, ql_dirichlet

CUTS = [1, 5, 10, 20, 50, 100]
#: Numbers of seeds.
SEEDS = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000]


def _long_run(s, d):
    return search.likelihood(_docs(s, d), {"q1": {"thing": 1.0, "with": 1.0}, "q3": {"para": 1.0}}, "dirichlet", 200)


def _good(s, d):
    return _t(s, d, "labels").filter("quality > 0").select("doc_id").distinct()


def run_semi_filter(s, d):
    return runs.keep_allowed(_long_run(s, d), _good(s, d), ["doc_id"])


def run_semi_first(s, d):
    return runs.keep_allowed(_long_run(s, d), _good(s, d), ["doc_id"], 5)


def run_subset(s, d):
    """Rows of the long run that the short one has for the same query."""
    return runs.keep_allowed(_long_run(s, d), ql_dirichlet(s, d).select("qid", "doc_id"), ["qid", "doc_id"])


def run_pool_fill(s, d):
    return runs.fill_pool(pooling(s, d).select("qid", "doc_id"), ql_dirichlet(s, d))


def baseline_run(s, d):
    """A run of other names: users are queries, events are documents; the ten best of each."""
    scored = _t(s, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("doc_id"), F.col("value").alias("score"))
    return search.ranked(scored, 10)


def qpp_overlap_docs(s, d):
    return runs.overlap_of_documents(*_both(s, d), 5)


def vote_details(s, d):
    return runs.vote_details(_t(s, d, "events"), ["user_id"], "event_type", "props", "value")


def judgments_per_label(s, d):
    return runs.per_label(_t(s, d, "labels"), ["quality", "toxic"])


def _features(s, d):
    """Long features of documents, queries are languages; quality is known of some."""
    docs = index.doc_stats(_docs(s, d)).join(_docs(s, d).select("doc_id", "lang", "n_chars"), "doc_id")
    own = docs.select(F.col("lang").alias("qid"), "doc_id", F.inline(F.array(F.struct(F.lit("chars").alias("fid"), F.col("n_chars").cast("double").alias("value")), F.struct(F.lit("words").alias("fid"), F.col("len").cast("double").alias("value")))))
    known = _t(s, d, "labels").join(_docs(s, d).select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("qid"), "doc_id", F.lit("quality").alias("fid"), F.col("quality").cast("double").alias("value"))
    return own.unionByName(known)


def letor_min_impute(s, d):
    return runs.impute_least(_features(s, d), _docs(s, d).select(F.col("lang").alias("qid"), "doc_id"))


def rerank_features(s, d):
    return runs.wide(letor_min_impute(s, d), ["chars", "quality", "words"])


def kcv_tuning(s, d):
    grades = _t(s, d, "labels").select("doc_id", F.col("quality").alias("grade")).crossJoin(F.broadcast(s.createDataFrame([("q1",), ("q2",), ("q3",)], "qid string")))
    a, b = _both(s, d)
    measured = runs.average_precision(a, grades).withColumn("system", F.lit("dirichlet")).unionByName(runs.average_precision(b, grades).withColumn("system", F.lit("jm")))
    return runs.tuned(measured, measured.select("qid", F.substring("qid", 2, 1).cast("long").alias("fold")).distinct())


def fold_split(s, d):
    return runs.folds(_docs(s, d), "doc_id", 5)


def join_skipped(s, d):
    return runs.joined_with_skipped(_docs(s, d), _t(s, d, "labels"), ["doc_id"])


def dedup_first(s, d):
    docs = _docs(s, d).withColumn("name", F.md5(F.coalesce("text", F.lit(""))))
    return readers.first_by_name(docs, "name", "doc_id").select("doc_id", "name")


def covariate_range(s, d):
    return index.covariate_range(index.covariate_cells(_docs(s, d), "lang", "source"), ("d", "en"), ("hot", "t"))


def _items(s, d):
    return _word_sets(s, d).withColumnRenamed("doc_id", "item_id")


def _judged(s, d):
    return _t(s, d, "labels").select(F.col("doc_id").alias("item_id"), (F.col("toxic") == 1).alias("positive"))


def judged_features(s, d):
    return labeling.judged_features(_items(s, d), _judged(s, d))


def classifier_weights(s, d):
    return labeling.strongest_by_size(labeling.difference_weights(_items(s, d), _judged(s, d)), 100)


def _scored(s, d):
    return labeling.score_all(_items(s, d), classifier_weights(s, d).select("feature", F.col("weight").cast("double").alias("weight")))


def rank_by_classifier(s, d):
    """Documents with any of the hundred strongest features, the best hundred."""
    rows = _items(s, d).select("item_id", F.explode("features").alias("feature"))
    return labeling.score(rows, classifier_weights(s, d), k=100)


def classify_documents(s, d):
    return _scored(s, d).select("item_id", "score", (F.col("score") > 0).alias("positive"))


def classifier_eval(s, d):
    return runs.evaluated(_scored(s, d).join(_judged(s, d), "item_id"), CUTS)


def seed_experiment(s, d):
    """Accuracy on all judged documents of classifiers that saw so many of them, those of the least hashes; all sizes in one job."""
    judged = index.cut(_judged(s, d))
    seeds = lookup.sample_by_hash(judged, ["item_id"], max(SEEDS)).select("item_id", F.md5(F.col("item_id").cast("string")).alias("h"))
    # at most the largest size of rows is numbered
    placed = seeds.select("item_id", F.row_number().over(Window.orderBy("h", "item_id")).alias("place"))
    scores = index.cut(labeling.seed_curve(_items(s, d), judged.join(placed, "item_id", "left"), list(SEEDS))).join(judged, "item_id")
    best = scores.withColumn("r", F.row_number().over(Window.partitionBy("seeds").orderBy(F.desc("score"), "item_id"))).filter("r <= 10")
    whole = scores.groupBy("seeds").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("score") > 0) & F.col("positive")).alias("tp"))
    return whole.join(best.groupBy("seeds").agg(F.round(F.count_if("positive") / 10, 6).alias("p_10")), "seeds").select("seeds", "n", "tp", "p_10")


def svm_rows(s, d):
    ids = lookup.feature_list(index.term_stats(_toks(s, d)))
    judged = _t(s, d, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("label"))
    return labeling.svm_rows(_items(s, d), ids, judged).select("item_id", F.md5("line").alias("line_md5"))


def oldest_query(s, d):
    """For each kind and payload of events the oldest, and who sent any; errors don't count."""
    e = _t(s, d, "events").filter("event_type <> 'error'")
    first = F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")
    users = F.array_join(F.transform(F.array_sort(F.collect_set("user_id")), lambda x: x.cast("string")), ",").alias("users")
    return e.groupBy("event_type", "props").agg(first, users)


def fact_sample(s, d):
    """A hundred events of a kind and range, by hash."""
    facts = _t(s, d, "events").filter("event_type <> 'error' and value between 10 and 100").select("event_id")
    return lookup.sample_by_hash(facts, ["event_id"], 100)


def page_links(s, d):
    return _t(s, d, "pages").select("page_id", F.inline(fn.links(F.col("html")))).groupBy("href", "text").agg(F.count(F.lit(1)).alias("n"))


def category_counts(s, d):
    return _docs(s, d).select(F.explode(fn.categories(F.col("text"))).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def lce_all(s, d):
    return expansion.local_contexts(ql_dirichlet(s, d), _toks(s, d), index.doc_stats(_docs(s, d)), index.term_stats(_toks(s, d)), drop=fn.STOPWORDS)


def text_functions(s, d):
    """Substrings, escapes and accents of every URL and text."""
    u = F.col("url")
    return _t(s, d, "pages").select("page_id", fn.take_before(u, "/").alias("before"), fn.take_after(u, "://").alias("after"), fn.take_after_last(u, "/").alias("after_last"), fn.take_before_last(u, "/").alias("before_last"), fn.remove_front(u, "http://").alias("no_front"), fn.remove_back(u, "/").alias("no_back"), fn.url_encoded(u).alias("encoded"), (fn.url_decoded(fn.url_encoded(u)) == u).alias("decoded"), F.md5(fn.strip_comments(F.col("html"))).alias("plain_md5"))


def term_maps(s, d):
    """How many different terms documents have and how often the most frequent one stands, from maps made inside the row."""
    m = F.map_values(fn.counts_of(fn.tokens(F.col("text"))))
    return _docs(s, d).select("doc_id", F.size(m).cast("long").alias("n_terms"), F.coalesce(F.array_max(m), F.lit(0)).cast("long").alias("most"))


def pagerank_top(s, d):
    """The hundred best terms of the graph of neighbours by the logarithm of their scores, iterated until they settle."""
    edges = index.bigrams(_docs(s, d)).select(F.col("t1").alias("src"), F.col("t2").alias("dst"))
    return graph.pagerank(edges, weighted=False).select("node", F.round(F.ln("score"), 6).alias("score")).orderBy(F.desc("score"), "node").limit(100)


QUERIES = {f.__name__: f for f in (run_semi_filter, run_semi_first, run_subset, run_pool_fill, baseline_run, qpp_overlap_docs, vote_details, judgments_per_label, letor_min_impute, rerank_features, kcv_tuning, fold_split, join_skipped, dedup_first, covariate_range, judged_features, classifier_weights, rank_by_classifier, classify_documents, classifier_eval, seed_experiment, svm_rows, oldest_query, fact_sample, page_links, category_counts, lce_all, text_functions, term_maps, pagerank_top)}

_LONG = f"{TOKS}, wq(qid, term) as (values ('q1', 'thing'), ('q1', 'with'), ('q3', 'para')), wt as (select doc_id, term, count(*) tf from tok where term in (select term from wq) group by all), wk as (select qid, term, cf from wq join st using (term)), wc as (select distinct qid, doc_id from wk join wt using (term)), ws as (select wc.qid, wc.doc_id, round(avg(ln(coalesce(wt.tf, 0) + 1500.0 * cf / c) - ln(len + 1500.0)), 6) score from wc join wk using (qid) left join wt on wt.doc_id = wc.doc_id and wt.term = wk.term join dl on dl.doc_id = wc.doc_id, coll group by wc.qid, wc.doc_id), lr as (select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from ws) where rank <= 200), good as (select doc_id from labels where quality > 0)"
_POOL = f"{_BOTH}, po as (select distinct qid, doc_id from (select qid, doc_id from a where rank <= 5 union all select qid, doc_id from b where rank <= 5))"
_FEAT = f"{TOKS}, ft as (select lang qid, doc_id, 'chars' fid, cast(n_chars as double) v from documents union all select lang, doc_id, 'words', cast(len as double) from dl join documents using (doc_id) union all select lang, doc_id, 'quality', cast(quality as double) from labels join documents using (doc_id)), lo as (select qid, fid, min(v) least from ft group by all), im as (select d2.lang qid, d2.doc_id, lo.fid, coalesce(v, least) v from documents d2 join lo on lo.qid = d2.lang left join ft on ft.qid = d2.lang and ft.doc_id = d2.doc_id and ft.fid = lo.fid)"
_AP = f"{_BOTH}, good as (select distinct doc_id from labels where quality > 0), runs as (select 'dirichlet' system, * from a union all select 'jm', * from b), h as (select system, qid, rank, row_number() over (partition by system, qid order by rank) seen from runs where doc_id in (select doc_id from good)), m as (select system, qid, sum(seen / rank) s, count(*) filter (where rank <= 5) k from h group by all), ap as (select system, qid, cast(substr(qid, 2, 1) as bigint) fold, round(coalesce(s, 0) / (select count(*) from good), 6) ap, round(coalesce(k, 0) / 5, 6) p_at from (select * from (select distinct qid from q) qq, (values ('dirichlet'), ('jm')) y(system)) z left join m using (system, qid)), fa as (select system, fold, avg(ap) ap, avg(p_at) p_at, sum(ap) s, count(*) n from ap group by system, fold), al as (select system, sum(ap) s, count(*) n from ap group by system), fs as (select fa.system, fold, fa.ap, fa.p_at, round((al.s - fa.s) / (al.n - fa.n), 9) train from fa join al using (system))"
_ITEMS = f"{TOKS}, ws as (select doc_id item_id, unnest(list_distinct(w)) feature from d), ju as (select doc_id item_id, toxic = 1 positive from labels)"


def _weights(judged: str, name: str = "dw") -> str:
    return f"{name} as (select feature, cast(sum(case when positive then 1 else -1 end) as bigint) weight from ws join {judged} using (item_id) group by feature having sum(case when positive then 1 else -1 end) <> 0)"


_CW = f"{_ITEMS}, {_weights('ju')}, cw as (select * from dw order by abs(weight) desc, feature limit 100)"
_SC = "sc as (select d.doc_id item_id, round(coalesce(s, 0.0), 6) score from d left join (select item_id, sum(weight) s from ws join cw using (feature) group by item_id) x on x.item_id = d.doc_id)"
_SEEDS = ", ".join(f"s{n} as (select * from ju order by md5(item_id::varchar), item_id limit {n}), {_weights(f's{n}', f'w{n}')}, c{n} as (select ju.item_id, positive, coalesce(s, 0) score from ju join documents on doc_id = ju.item_id left join (select item_id, sum(weight) s from ws join w{n} using (feature) group by item_id) x using (item_id))" for n in SEEDS)
ORACLE_SQL = {
    "run_semi_filter": f"{_LONG} select * from lr where doc_id in (select doc_id from good)",
    "run_semi_first": f"{_LONG} select qid, doc_id, score, rank from (select *, row_number() over (partition by qid order by rank) r from lr where doc_id in (select doc_id from good)) where r <= 5",
    "run_subset": f"{_LONG}, {_BOTH[len(TOKS) + 2:]} select lr.* from lr join a using (qid, doc_id)",
    "run_pool_fill": f"{_POOL} select qid, doc_id, round(coalesce(1.0 / a.rank, 0.0), 6) score from po left join a using (qid, doc_id)",
    "baseline_run": "select * from (select user_id qid, event_id doc_id, \"value\" score, row_number() over (partition by user_id order by \"value\" desc, event_id) rank from events) where rank <= 10",
    "qpp_overlap_docs": f"{_BOTH}, ov as (select qid, round(count(b.doc_id) / 5, 6) overlap from a left join (select * from b where rank <= 5) b using (qid, doc_id) where a.rank <= 5 group by qid) select qid, doc_id, overlap from (select qid, doc_id from a union select qid, doc_id from b) join ov using (qid)",
    "vote_details": "with h as (select user_id, event_type l, count(*) n from events group by all) select user_id, string_agg(l || ':' || n, ',' order by l) histogram, any_value(w) n_workers, any_value(t) total_time from h join (select user_id, count(distinct props) w, round(sum(value), 4) t from events group by user_id) using (user_id) group by user_id",
    "judgments_per_label": "select 'quality' \"label\", count(*) filter (where quality > 0) positive, count(*) filter (where quality <= 0) negative from labels union all select 'toxic', count(*) filter (where toxic > 0), count(*) filter (where toxic <= 0) from labels",
    "letor_min_impute": f"{_FEAT} select qid, doc_id, fid, v \"value\" from im",
    "rerank_features": f"{_FEAT}, wd as (select qid, doc_id, max(v) filter (where fid = 'chars') chars, max(v) filter (where fid = 'quality') quality, max(v) filter (where fid = 'words') words from im group by all) select *, greatest(chars, quality, words) \"max\", least(chars, quality, words) \"min\", round(chars + quality + words, 6) \"sum\", round((chars + quality + words) / 3, 6) \"avg\" from wd",
    "kcv_tuning": f"{_AP} select fold, system, round(ap, 6) ap, round(p_at, 6) p_at from fs qualify row_number() over (partition by fold order by train desc, system) = 1",
    "fold_split": "select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 5 fold from documents",
    "join_skipped": "select count(l.doc_id) matched, count(*) filter (where l.doc_id is null) skipped from documents d left join labels l using (doc_id)",
    "dedup_first": "select min(doc_id) doc_id, md5(coalesce(text, '')) \"name\" from documents group by 2",
    "covariate_range": "select lang x, source y, count(*) n from documents where lang between 'd' and 'en' and source between 'hot' and 't' group by all",
    "judged_features": f"{_ITEMS} select feature, count(*) filter (where positive) positive, count(*) filter (where not positive) negative from ws join ju using (item_id) group by feature",
    "classifier_weights": f"{_CW} select feature, weight from cw",
    "rank_by_classifier": f"{_CW} select item_id, cast(sum(weight) as bigint) score from ws join cw using (feature) group by item_id order by score desc, item_id limit 100",
    "classify_documents": f"{_CW}, {_SC} select item_id, score::double score, score > 0 positive from sc",
    "classifier_eval": f"{_CW}, {_SC}, ev as (select *, row_number() over (order by score desc, item_id) r from sc join ju using (item_id)) select count(*) n, count(*) filter (where score > 0 and positive) tp, round(tp / n, 6) accuracy, round(tp / count(*) filter (where positive), 6) \"precision\", {', '.join(f'round(count(*) filter (where positive and r <= {k}) / {k}, 6) p_{k}' for k in CUTS)} from ev",
    "seed_experiment": f"{_ITEMS}, {_SEEDS} " + " union all ".join(f"select {n}::bigint seeds, count(*) n, count(*) filter (where score > 0 and positive) tp, round(count(*) filter (where positive and r <= 10) / 10, 6) p_10 from (select *, row_number() over (order by score desc, item_id) r from c{n})" for n in SEEDS),
    "svm_rows": f"{TOKS}, ids as (select term, row_number() over (order by term) - 1 id from st where df > 5), ws as (select doc_id, unnest(list_distinct(w)) term from d) select doc_id item_id, md5(quality || ' ' || string_agg(id || ':1', ' ' order by id)) line_md5 from ws join ids using (term) join labels using (doc_id) group by doc_id, quality",
    "oldest_query": "select event_type, props, arg_min(event_id, (ts, event_id)) event_id, string_agg(distinct user_id, ',' order by user_id) users from events where event_type <> 'error' group by event_type, props",
    "fact_sample": "select event_id from events where event_type <> 'error' and value between 10 and 100 order by md5(event_id::varchar), event_id limit 100",
    "page_links": "with a as (select unnest(regexp_extract_all(html, '(?s)<a href=\"[^\"]*\"[^>]*>.*?</a>')) x from pages) select regexp_extract(x, '<a href=\"([^\"]*)\"', 1) href, regexp_extract(x, '(?s)<a [^>]*>(.*?)</a>', 1) \"text\", count(*) n from a group by all",
    "category_counts": "with c as (select trim(unnest(flatten(list_transform(regexp_extract_all(text, '\\(([^()]*)\\)', 1), lambda x: string_split(x, ','))))) category from documents) select category, count(*) n from c where category <> '' group by category",
    "lce_all": f"{_POST}, t2 as (select qid, doc_id, term, count(*) tf from pp join tok using (doc_id) where term not in {_STOP} group by all), tt as (select qid, term from t2 group by all having sum(tf) > 1), sc as (select tt.qid, term, round(sum(score + ln((coalesce(t2.tf, 0) + 1000.0 * cf / c) / (len + 1000.0)) - ln(cf / c)), 6) score from tt join st using (term) join pp using (qid) join dl on dl.doc_id = pp.doc_id left join t2 on t2.term = tt.term and t2.doc_id = pp.doc_id and t2.qid = tt.qid cross join coll group by tt.qid, term) select qid, term, score from sc qualify row_number() over (partition by qid order by score desc, term) <= 30",
    "text_functions": "select page_id, split_part(url, '/', 1) \"before\", case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else url end \"after\", split_part(url, '/', -1) after_last, case when strpos(url, '/') > 0 then substr(url, 1, length(url) - length(split_part(url, '/', -1)) - 1) else url end before_last, case when starts_with(url, 'http://') then substr(url, 8) else url end no_front, case when ends_with(url, '/') then substr(url, 1, length(url) - 1) else url end no_back, replace(replace(url_encode(url), '%20', '+'), '~', '%7E') encoded, case when url is not null then true end decoded, md5(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')) plain_md5 from pages",
    "pagerank_top": f"{_ranks()} select n node, round(ln(score), 6) score from r20 order by score desc, node limit 100",
    "term_maps": f"{TOKS} select d.doc_id, cast(len(list_distinct(w)) as bigint) n_terms, coalesce(m, 0) most from d left join (select doc_id, max(n) m from (select doc_id, term, count(*) n from tok group by all) group by doc_id) using (doc_id)",
}

"""Lookups over a corpus: labels, numbers, names, spans of lines, sentences, feature lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import marked, spaced_lines
from ..functions.text import tokens as token_array
from . import index, search
from .spans import stabbed


def labelled(docs: DataFrame, field: str, value: str, key: str = "doc_id") -> DataFrame:
    """key of the documents whose categorical variable has the value: none for an unknown variable or value, an error for a number."""
    if field not in docs.columns:
        return docs.select(key).filter(F.lit(False))
    if not isinstance(docs.schema[field].dataType, T.StringType):
        raise TypeError(f"{field} isn't categorical")
    return docs.filter(F.col(field) == value).select(key)


def numbers(docs: DataFrame, field: str, key: str = "doc_id") -> DataFrame:
    """key, value of a whole-number variable; documents without a value are left out. An error for other variables."""
    if not isinstance(docs.schema[field].dataType, T.IntegralType):
        raise TypeError(f"{field} isn't a whole number")
    return docs.filter(F.col(field).isNotNull()).select(key, F.col(field).cast("long").alias("value"))


def pull(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", name: str = "name", text: str = "text") -> DataFrame:
    """asked and all columns but the text for each row of wanted (asked: string): the document of that id, else the first of that name; without either the columns are null."""
    rest = [c for c in docs.columns if c != text]
    row = F.struct(*rest).alias("row")
    by_id = wanted.join(docs.select(F.col(key).cast("string").alias("asked"), row), "asked", "left")
    # names may repeat: the one of the least id counts
    names = docs.groupBy(F.col(name).alias("asked")).agg(F.min_by(F.struct(*rest), F.col(key)).alias("named"))
    return by_id.join(names, "asked", "left").select("asked", F.coalesce("row", "named").alias("row")).select("asked", "row.*")


def match_documents(toks: DataFrame, terms: list[str], operation: str = "AND", limit: int | None = 200, strict: bool = False) -> DataFrame:
    """doc_id, missing_terms: the first documents in order of ids that hold all (AND) or any (OR) of the terms that occur at all.

    Terms that occur nowhere are named in missing_terms (sorted, joined by commas) and don't count, unless strict.
    """
    terms = sorted(set(terms))
    own = toks.filter(F.col("term").isin(terms))
    found = own.groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    # one row: an array of as many terms as the query has
    known = own.agg(F.array_sort(F.collect_set("term")).alias("known"))
    asked = F.array(*map(F.lit, terms))
    joined = found.join(F.broadcast(known))
    enough = F.size("terms") >= (1 if operation == "OR" else F.size(asked if strict else F.col("known")))
    out = joined.filter(enough).select("doc_id", F.array_join(F.array_except(asked, F.col("known")), ",").alias("missing_terms"))
    return out if limit is None else out.orderBy("doc_id").limit(limit)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, no, line, terms for each line; no sentence splitter is needed for these."""
    cut = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("no", "line"))
    return cut.select("doc_id", F.col("no").cast("long").alias("no"), "line", token_array(F.col("line")).alias("terms"))


def line_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tag, no, begin, end (places of tokens, half-open) of each line with a token: a window over the lines of one document."""
    before = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("terms").cast("long")
    begin = F.coalesce(F.sum(n).over(before), F.lit(0))
    cut = lines(docs, key, text).select("doc_id", F.lit("line").alias("tag"), "no", begin.alias("begin"), (begin + n).alias("end"))
    return cut.filter("end > begin")


def hit_spans(hits: DataFrame, tag: str) -> DataFrame:
    """Hits (doc_id, start, size) as spans of a tag, numbered within their document."""
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "size")).cast("long")
    return hits.select("doc_id", F.lit(tag).alias("tag"), no.alias("no"), F.col("start").cast("long").alias("begin"), (F.col("start") + F.col("size")).cast("long").alias("end"))


def tokens_in_spans(toks: DataFrame, spans: DataFrame, tag: str = "line") -> DataFrame:
    """doc_id, no, pos, term, tags for each token of a span of the tag; tags: the other tags that contain the token, none as an empty array.

    Tokens meet the spans by document and bucket of places.
    """
    own = spans.filter(F.col("tag") == tag).select("doc_id", "no", "begin", "end")
    placed = stabbed(toks, own).select("doc_id", "no", "pos", "term")
    other = spans.filter(F.col("tag") != tag).select("doc_id", "tag", "begin", "end")
    over = stabbed(toks.select("doc_id", "pos"), other).groupBy("doc_id", "pos").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return placed.join(over, ["doc_id", "pos"], "left").select("doc_id", "no", "pos", "term", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def near_and_far(placed: DataFrame) -> DataFrame:
    """term, near, far: tokens of spans (from tokens_in_spans) with any tagged token, and of those without."""
    tagged = placed.filter(F.size("tags") > 0).select("doc_id", "no").distinct().withColumn("tagged", F.lit(True))
    both = placed.join(tagged, ["doc_id", "no"], "left")
    return both.groupBy("term").agg(F.count_if(F.col("tagged")).alias("near"), F.count_if(F.col("tagged").isNull()).alias("far"))


def lines_near_and_far(docs: DataFrame, phrase: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, near, far: tokens of lines with any token of the phrase, which may run over line ends, and of other lines. Texts without an id don't count.

    Lines and places of the phrase are told inside the row: only counts of terms are shuffled. Texts that share an id are one
    document whose lines of a number are one line and whose places lie over each other; tokens of such texts alone meet by intervals.
    """
    own = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    shared = index.cut(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if shared.isEmpty():
        return _near_and_far_inside(own, phrase)
    alone, several = own.join(shared, "doc_id", "left_anti"), own.join(shared, "doc_id", "left_semi")
    toks = index.tokens(several)
    # a place counts once, whichever texts hold its parts
    hits = search.phrases(toks.filter(F.col("term").isin(phrase)).distinct(), {1: phrase})
    placed = tokens_in_spans(toks, line_spans(several).unionByName(hit_spans(hits, "phrase")))
    both = _near_and_far_inside(alone, phrase).unionByName(near_and_far(placed))
    return both.groupBy("term").agg(F.sum("near").alias("near"), F.sum("far").alias("far"))


def _near_and_far_inside(docs: DataFrame, phrase: list[str]) -> DataFrame:
    lines = docs.select(F.explode(F.split(marked(spaced_lines(F.col("text")), phrase), "\n")).alias("line"))
    # told here for the line, not above for each of its tokens
    lines = lines.select(F.col("line").contains("*").alias("near"), F.replace("line", F.lit("*"), F.lit("")).alias("line"))
    toks = lines.select("near", F.explode(F.split("line", " ")).alias("term")).filter("term != ''")
    return toks.groupBy("term").agg(F.count_if("near").alias("near"), F.count_if(~F.col("near")).alias("far"))


def feature_list(stats: DataFrame, over: int = 5) -> DataFrame:
    """term, id: terms of more than so many documents, numbered from 0 in order.

    Numbers come from counts by first letters: a window within each of these, after the sum of those before.
    """
    kept = stats.filter(F.col("df") > over).select("term", F.substring("term", 1, 2).alias("first"))
    sizes = kept.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as the corpus has pairs of first letters
    offsets = sizes.select("first", (F.sum("n").over(Window.orderBy("first")) - F.col("n")).alias("offset"))
    own = F.row_number().over(Window.partitionBy("first").orderBy("term")) - 1
    return kept.join(offsets, "first").select("term", (F.col("offset") + own).alias("id"))


def sample_by_hash(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """k rows of the least hashes of their columns: a sample that is the same each time."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in columns])
    return rows.withColumn("__h", F.md5(text)).orderBy("__h", *columns).limit(k).drop("__h")


def break_pairs(spans: DataFrame) -> DataFrame:
    """doc_id, begin, next: each two breaks that follow each other in a document."""
    ahead = Window.partitionBy("doc_id").orderBy("begin")
    return spans.select("doc_id", "begin", F.lead("begin").over(ahead).alias("next")).filter("next is not null")


def ngrams(docs: DataFrame, most: int, text: str = "text") -> DataFrame:
    """n, gram for each run of 1 to most neighbours; made inside the row."""
    t = F.col("__t")

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(t, i, n), " ").alias("gram")))
        return F.when(F.size(t) >= n, found).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))

    made = [runs(n) for n in range(1, most + 1)]
    return docs.select(token_array(F.col(text)).alias("__t")).select(F.inline(F.concat(*made)))

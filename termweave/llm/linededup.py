"""Line dedup over overlapping windows of three lines.

Lines with a word are numbered; every three consecutive ones make a window, hashed by its text. A window
that occurs twice or more anywhere is repeated; its first occurrence, by (doc_id, line), stays and the
lines that later occurrences cover, merged over overlapping windows, are removed. A document with fewer
than three such lines is one window as a whole. A line is kept where any copy of it is a first occurrence's
and no later occurrence covers it.

Counting and the first place of a window are one pre-aggregated shuffle of hashes. Only windows that are
repeated come back, by a join that Spark can split at a hot window. Texts are shuffled once, by document,
to meet the numbers of the lines they lose: at every size alike.

Defined results: null and empty texts stay as they are; null doc_ids take no part and stay as they are;
lines are compared without white space at their ends; rows that share a doc_id are told apart by their
text, and rows equal in both are one document (all of them lose the same lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, materialise, table

WINDOW = 3


def _lines(text: Column) -> Column:
    """Trimmed lines that have a word, as structs of number (of all lines) and line."""
    edge = f"^[{SEPARATORS}]+|[{SEPARATORS}]+$"
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("no"), F.regexp_replace(x, edge, "").alias("line")))
    return F.filter(numbered, lambda x: x["line"] != "")


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc, version (hash of the text), at (number of the first line), covers (numbers of the lines), h: a row for each window."""
    cut = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("version"), _lines(F.col(text)).alias("lines")).filter(F.col("doc").isNotNull() & (F.size("lines") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("lines") - (window - 1), F.lit(1)))
    part = lambda i: F.slice("lines", i, window)
    made = F.transform(starts, lambda i: F.struct(F.get(part(i), F.lit(0))["no"].alias("at"), F.transform(part(i), lambda x: x["no"]).alias("covers"), F.md5(F.concat_ws("\n", F.transform(part(i), lambda x: x["line"]))).alias("h")))
    return cut.select("doc", "version", F.inline(made))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc, version, gone: the lines that go, for each document that loses any."""
    cut = windows(docs, key, text, window)
    place = F.struct("doc", "version", "at")
    firsts = cut.select("h", place.alias("place")).groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").select("h", "first")
    later = cut.join(firsts, "h").filter(place > F.col("first"))
    return later.select("doc", "version", F.explode("covers").alias("no")).groupBy("doc", "version").agg(F.sort_array(F.collect_set("no")).alias("gone"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, with later occurrences taken out of text, and __n_removed (lines)."""
    gone = materialise(repeated(docs, key, text, window))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    keyed = docs.select(row, F.col(key).alias("__key"), F.xxhash64(text).alias("__version"))
    named = gone.select(F.col("doc").alias("__doc"), F.col("version").alias("__of"), F.col("gone").alias("__gone")).hint("merge")
    joined = keyed.join(named, (F.col("__key") == F.col("__doc")) & (F.col("__version") == F.col("__of")), "left")
    old = F.col("__row")[text]
    # numbers less numbers by hashing, so a long text takes time in proportion to its lines
    lines = F.get(F.transform(F.array(F.split(old, "\n")), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone")), lambda i: F.get(x, i))), F.lit(0))
    rest = F.array_join(lines, "\n")
    new = F.when(F.col("__gone").isNull(), old).otherwise(rest)
    return joined.select(*(new.alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns), F.coalesce(F.size("__gone"), F.lit(0)).alias("__n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__n_removed").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"))


def _gone_sql(docs: str, text: str = "text") -> str:
    """CTEs that end in gone(doc_id, gone) over the relation docs, whose doc_id is unique."""
    return f"""
ln as (select doc_id, list_filter(list_transform(string_split({text}, chr(10)), lambda x, i: {{'no': i - 1, 'line': trim(x, e' \\t\\n\\x0b\\x0c\\r')}}), lambda x: x.line <> '') l from {docs} where doc_id is not null and {text} is not null),
st as (select doc_id, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) i from ln where len(l) > 0),
win as (select doc_id, l[i].no pos, list_transform(l[i:i + 2], lambda x: x.no) covers, md5(array_to_string(list_transform(l[i:i + 2], lambda x: x.line), chr(10))) h from st),
ranked as (select doc_id, covers, row_number() over (partition by h order by doc_id, pos) r from win),
gone as (select doc_id, list(distinct no) gone from (select doc_id, unnest(covers) no from ranked where r > 1) group by doc_id)"""


_REST = "case when gone is null then text else coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(gone, i - 1)), chr(10)), '') end"
ORACLE_SQL = f"""
with {_gone_sql("documents")}
select d.doc_id, cast(coalesce(len(gone), 0) as bigint) n_removed, md5({_REST}) text_md5 from documents d left join gone using (doc_id)"""

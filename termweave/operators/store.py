"""A corpus on disk to read slices, sentences, spans and hits back from: tables bucketed by document, so that joins of them don't shuffle.

tokens (doc_id, pos, sentence, term), sentences (doc_id, sentence, begin, end, text), documents (doc_id and all variables), spans
(doc_id, tag, begin, end) and hits (phrase, doc_id, start, size) have the same number of buckets by doc_id; hits stand there a second time, in
buckets by phrase. A document's rows lie in one bucket in order.
Cells of two variables are folders (see CovariateStore), so that a range of them reads its own files alone.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens as token_array
from .spans import stabbed

#: Characters of text for each bucket, about, and buckets of each table at least, but where the caller asks for another number. So a task holds as much of a large corpus as of a small one.
BUCKET_CHARS, BUCKETS = 8_000_000, 16
#: Tasks that write the hits of one bucket of phrases: a frequent phrase is dealt over them.
WRITERS = 16
#: Folders that a list of cells is turned into a filter for.
FOLDERS = 1_000


class CorpusStore:
    """Tables that store() wrote under a folder. They are registered anew with each session that opens them."""

    KEYS = {"tokens": ("doc_id", ["doc_id", "pos"]), "sentences": ("doc_id", ["doc_id", "sentence"]), "documents": ("doc_id", ["doc_id"]), "spans": ("doc_id", ["doc_id", "begin"]), "hits": ("doc_id", ["doc_id", "start"]), "phrases": ("phrase", ["phrase", "doc_id", "start"])}

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder
        # where it is opened without their number, the folder's note tells it
        self.buckets = buckets or spark.read.json(f"{folder}/note").first()["buckets"]
        self.names: dict[str, str] = {}
        # else a join by document and sentence shuffles tables that are in buckets by document alone
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def _name(self, table: str) -> str:
        return f"store_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.folder}/{table}').hex}"

    def write(self, table: str, rows: DataFrame) -> None:
        """Rows of one table, a file for each bucket (of phrases up to WRITERS files): they are shuffled once, here, and never where they are read."""
        key, order = self.KEYS[table]
        # a phrase's hits would be one task's
        by = [key] if key == "doc_id" else [F.pmod(F.hash(key), F.lit(self.buckets)), F.pmod(F.hash("doc_id"), F.lit(WRITERS))]
        writer = rows.repartition(self.buckets, *by).write.bucketBy(self.buckets, key).sortBy(*order)
        writer.mode("overwrite").option("path", f"{self.folder}/{table}").saveAsTable(self._name(table))
        self.names[table] = self._name(table)

    def table(self, table: str) -> DataFrame:
        if table not in self.names:
            key, order = self.KEYS[table]
            schema = self.spark.read.parquet(f"{self.folder}/{table}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"create table if not exists {self._name(table)} ({columns}) using parquet clustered by ({key}) sorted by ({', '.join(order)}) into {self.buckets} buckets location '{self.folder}/{table}'")
            self.names[table] = self._name(table)
        return self.spark.table(self.names[table])

    def close(self) -> None:
        """Takes the tables out of the session; their files stay."""
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")
        self.names = {}

    def slices(self, wanted: DataFrame) -> DataFrame:
        """doc_id, begin, end, terms of intervals of places (doc_id, begin, end), held within the document; an interval beyond its end or of an unknown document is left out."""
        own = stabbed(self.table("tokens"), wanted.select("doc_id", "begin", "end").distinct())
        found = F.array_sort(F.collect_list(F.struct("pos", "term")))
        return own.groupBy("doc_id", "begin", "end").agg(found.alias("x")).select("doc_id", "begin", "end", F.transform("x", lambda x: x["term"]).alias("terms"))

    def around_hits(self, left: int, right: int) -> DataFrame:
        """doc_id, start, size, phrase, pos, term: tokens within so many places of stored hits. Both tables are bucketed by document: nothing is shuffled."""
        hits = self.table("hits").withColumns({"begin": F.greatest(F.col("start") - left, F.lit(0)), "end": F.col("start") + F.col("size") + right})
        met = self.table("tokens").join(hits, "doc_id").filter("pos >= begin and pos < end")
        return met.select("doc_id", "start", "size", "phrase", "pos", "term")

    def sentences(self, documents: DataFrame | None = None) -> DataFrame:
        """All sentences, or those of the documents (doc_id)."""
        rows = self.table("sentences")
        return rows if documents is None else rows.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")

    def tokens_of_sentences(self) -> DataFrame:
        """doc_id, sentence, begin, pos, term and the document's variables: token, sentence and document tables side by side, without a shuffle."""
        t, s = self.table("tokens"), self.table("sentences").select("doc_id", "sentence", "begin")
        return t.join(s, ["doc_id", "sentence"]).join(self.table("documents"), "doc_id")

    def labelled(self, field: str, value: str) -> DataFrame:
        """doc_id of the documents whose variable has the value: the filter is pushed down to the table of documents."""
        return self.table("documents").filter(F.col(field) == value).select("doc_id")

    def spans(self, tags: list[str] | None = None) -> DataFrame:
        rows = self.table("spans")
        return rows if tags is None else rows.filter(F.col("tag").isin(tags))

    def hits_of(self, phrases: list[str]) -> DataFrame:
        """phrase, doc_id, start, size: the buckets of these phrases are read, and of their files the row groups that may hold them."""
        return self.table("phrases").filter(F.col("phrase").isin(phrases))

    def hits_in(self, documents: DataFrame) -> DataFrame:
        return self.table("hits").join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def store(docs: DataFrame, folder: str, hits: DataFrame | None = None, spans: DataFrame | None = None, cut: str = "\n", buckets: int | None = None, key: str = "doc_id", text: str = "text") -> CorpusStore:
    """Writes a corpus; sentences are what stands between cuts (a pattern), numbered from 0, empty ones too; hits: phrase, doc_id, start, size; spans: doc_id, tag, begin, end. buckets: None for as many as the texts' length asks for."""
    spark = docs.sparkSession
    buckets = buckets or max(BUCKETS, -(-(docs.agg(F.sum(F.char_length(text)).alias("n")).first()["n"] or 0) // BUCKET_CHARS))
    out = CorpusStore(spark, folder, buckets)
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").json(f"{folder}/note")
    sentences = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), cut), lambda s: F.struct(s.alias("text"), token_array(s).alias("terms")))
    parts = docs.select(F.col(key).alias("doc_id"), F.posexplode(sentences).alias("sentence", "x")).select("doc_id", F.col("sentence").cast("long").alias("sentence"), "x.text", "x.terms")
    n = F.size("terms").cast("long")
    before = Window.partitionBy("doc_id").orderBy("sentence").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(n).over(before), F.lit(0))
    placed = parts.repartition(buckets, "doc_id").withColumn("begin", begin)
    out.write("sentences", placed.select("doc_id", "sentence", "begin", (F.col("begin") + n).alias("end"), "text"))
    tokens = placed.select("doc_id", "sentence", "begin", F.posexplode("terms").alias("k", "term"))
    out.write("tokens", tokens.select("doc_id", (F.col("begin") + F.col("k")).alias("pos"), "sentence", "term"))
    out.write("documents", docs.select(F.col(key).alias("doc_id"), *[c for c in docs.columns if c not in (key, text)]))
    if spans is not None:
        out.write("spans", spans.select("doc_id", "tag", "begin", "end"))
    if hits is not None:
        own = hits.select("phrase", "doc_id", "start", "size")
        out.write("hits", own)
        out.write("phrases", own)
    return out


class CovariateStore:
    """Documents by two variables, in folders: the first in bins of a width, the second by value."""

    def __init__(self, spark: SparkSession, folder: str, x: str, y: str, width: int):
        self.spark, self.folder, self.x, self.y, self.width = spark, folder, x, y, width

    def write(self, docs: DataFrame) -> CovariateStore:
        """A cell's files: at most as many as tasks hold rows of it. Null values of a variable are a cell of their own."""
        placed = docs.withColumns({"x_bin": self._bin(F.col(self.x)), "y_cell": F.col(self.y).cast("string")})
        # a large cell is dealt over tasks by the hash of its rows
        placed.repartition("x_bin", "y_cell", F.pmod(F.hash(*docs.columns), F.lit(8))).write.mode("overwrite").partitionBy("x_bin", "y_cell").parquet(f"{self.folder}/cells")
        placed.limit(0).write.mode("overwrite").parquet(f"{self.folder}/schema")  # a corpus may be empty
        return self

    def _bin(self, value: Column) -> Column:
        return F.floor(value / self.width).cast("long")

    def documents(self) -> DataFrame:
        """As written: types of folders' names aren't guessed."""
        return self.spark.read.schema(self.spark.read.parquet(f"{self.folder}/schema").schema).parquet(f"{self.folder}/cells")

    def between(self, x: tuple[int, int], y: list[str] | None = None) -> DataFrame:
        """Documents with x[0] <= x <= x[1] and one of the values of y: only the folders of these cells are listed and read."""
        rows = self.documents().filter(F.col("x_bin").between(x[0] // self.width, x[1] // self.width) & F.col(self.x).between(*x))
        rows = rows if y is None else rows.filter(F.col("y_cell").isin(y))
        return rows.drop("x_bin", "y_cell")

    def of_cells(self, cells: DataFrame) -> DataFrame:
        """Documents of a list of cells (x, y). The folders of up to FOLDERS cells are named to the scan; of more, all are read."""
        wanted = cells.select(F.col("x").alias("__x"), F.col("y").cast("string").alias("__y")).distinct()
        named = wanted.select(self._bin(F.col("__x")).alias("bin"), F.col("__y").alias("y")).distinct().limit(FOLDERS + 1).collect()
        rows = self.documents()
        if len(named) <= FOLDERS:
            by: dict[str, list[int]] = {}
            for r in named:
                by.setdefault(r["y"], []).append(r["bin"])
            rows = rows.filter(reduce(lambda a, b: a | b, [(F.col("y_cell") == y) & F.col("x_bin").isin(bins) for y, bins in by.items() if y is not None], F.lit(False)))
        return rows.join(wanted, (F.col(self.x) == F.col("__x")) & (F.col("y_cell") == F.col("__y")), "left_semi").drop("x_bin", "y_cell")

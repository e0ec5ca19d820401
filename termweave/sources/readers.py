"""Readers and writers of the text formats of retrieval experiments. Each is a plan over spark.read, schemas given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import json_unescaped, normal_name
from ..functions.text import tokens as token_array
from ..operators.finder import running
from ..operators.index import cut


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("c"))


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc, rank, score, system from white-space columns."""
    c = F.col("c")
    return _lines(spark, path).select(c[0].alias("qid"), c[2].alias("doc"), c[3].cast("int").alias("rank"), c[4].cast("double").alias("score"), c[5].alias("system"))


def write_run(run: DataFrame, path: str) -> None:
    run.select(F.concat_ws(" ", "qid", F.lit("Q0"), "doc", "rank", "score", "system").alias("value")).write.text(path)


def qrels(spark: SparkSession, path: str, shift: int = 0) -> DataFrame:
    """qid, doc, grade; shift is taken off the grade."""
    c = F.col("c")
    return _lines(spark, path).select(c[0].alias("qid"), c[2].alias("doc"), (c[3].cast("int") - shift).alias("grade"))


def query_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="qid string, text string", quote="")


def features_file(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc, grade, fid, value: one row for each feature of a ranking line 'grade qid:Q f:v ... # doc'."""
    v = spark.read.text(path).filter(F.col("value").rlike(r"^\s*-?\d+\s+qid:"))
    body, doc = F.split(F.trim(F.substring_index("value", "#", 1)), r"\s+"), F.trim(F.substring_index("value", "#", -1))
    rows = v.select(F.split(body[1], ":")[1].alias("qid"), doc.alias("doc"), body[0].cast("int").alias("grade"), F.explode(F.slice(body, 3, F.greatest(F.size(body) - 2, F.lit(0)))).alias("f"))
    return rows.select("qid", "doc", "grade", F.split("f", ":")[0].alias("fid"), F.split("f", ":")[1].cast("double").alias("value"))


def write_features(features: DataFrame, path: str, lines: int = 20_000) -> None:
    """The reverse, a line for each (qid, doc), files of at most that many lines."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(F.col("fid").cast("int").alias("k"), "fid", "value"))), lambda x: F.concat_ws(":", x["fid"], x["value"]))
    rows = features.groupBy("qid", "doc", "grade").agg(F.concat_ws(" ", pairs).alias("f"))
    rows.select(F.concat("grade", F.lit(" qid:"), "qid", F.lit(" "), "f", F.lit(" # "), "doc").alias("value")).write.option("maxRecordsPerFile", lines).text(path)


def edges_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="src string, dst string", quote="")


def triples(spark: SparkSession, path: str, predicate: str) -> DataFrame:
    """src, dst: last parts of subject and object of N-Triples with the predicate."""
    v = spark.read.text(path).filter(F.col("value").contains(predicate))
    return v.select(*[F.regexp_extract("value", r"^<([^>]*)>\s+<([^>]*)>\s+<([^>]*)>", k).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))]).filter(F.col("p").endswith(predicate)).select(F.substring_index("s", "/", -1).alias("src"), F.substring_index("o", "/", -1).alias("dst"))


def json_documents(spark: SparkSession, path: str, variables: str = "") -> DataFrame:
    """docid, text and declared variables (a schema string) from JSON lines; absent variables are null."""
    return spark.read.schema("docid string, text string" + (f", {variables}" if variables else "")).json(path)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (its first byte), at (grows within a split), value: the lines of files of any size, which are cut into splits of
    spark.sql.files.maxPartitionBytes. Written once, so that every later pass sees the same splits."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    return cut(rows)


def numbered(lines: DataFrame, marks: dict[str, Column], through: bool = False) -> DataFrame:
    """Adds to split_lines() no, the line's number from 0 in its file, and for each of marks (conditions) how many lines have it up to here.

    Two passes: each split's lines and marks are counted, and their sums over the splits before (a row each) are added to what is counted inside
    a split. through: numbers go on from file to file, in order of their names.
    """
    flags = {m: c.cast("long").alias(f"__{m}") for m, c in marks.items()}
    rows = lines.select("*", *flags.values())
    sums = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("__lines"), *[F.coalesce(F.sum(f"__{m}"), F.lit(0)).alias(f"__all_{m}") for m in marks])
    before = Window.orderBy("file", "split") if through else Window.partitionBy("file").orderBy("split")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c, to: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(to)
    offsets = cut(sums.select("file", "split", offset("__lines", "__no"), *[offset(f"__all_{m}", f"__from_{m}") for m in marks]))
    inside = Window.partitionBy("file", "split").orderBy("at")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumns({"__own": F.row_number().over(inside) - 1, **{f"__upto_{m}": F.coalesce(F.sum(f"__{m}").over(upto), F.lit(0)) for m in marks}})
    both = counted.join(offsets, ["file", "split"])
    return both.select(*lines.columns, (F.col("__no") + F.col("__own")).alias("no"), *[(F.col(f"__from_{m}") + F.col(f"__upto_{m}")).alias(m) for m in marks])


def conll(spark: SparkSession, path: str) -> DataFrame:
    """file, doc, sentence, pos, word, pos_tag, chunk, ner from four-column blocks. Files are cut into splits, and documents, sentences and places numbered over these."""
    begins = F.col("value").startswith("-DOCSTART-")
    marked = numbered(split_lines(spark, path), {"doc": begins, "sentence": F.trim("value") == ""})
    c = F.split(F.trim("value"), r"\s+")
    words = marked.filter((F.trim("value") != "") & ~begins)
    pos = F.row_number().over(Window.partitionBy("file", "doc", "sentence").orderBy("no")) - 1
    return words.select("file", "doc", "sentence", pos.alias("pos"), c[0].alias("word"), c[1].alias("pos_tag"), c[2].alias("chunk"), c[3].alias("ner"))


def mention_counts(spark: SparkSession, path: str) -> DataFrame:
    """mention, entity, n from 'mention TAB entity count TAB entity count ...'."""
    parts = F.split("value", "\t")
    v = spark.read.text(path).select(parts[0].alias("mention"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("x"))
    return v.select("mention", F.substring_index("x", " ", 1).alias("entity"), F.substring_index("x", " ", -1).cast("long").alias("n"))


def first_by_name(docs: DataFrame, name: str, order: str, prefix: str = "") -> DataFrame:
    """One row for each name: the first in order; prefix goes before the names, so that corpora can be put together."""
    whole = F.struct(*docs.columns)
    out = docs.groupBy(F.col(name).alias("__n")).agg(F.min_by(whole, F.col(order)).alias("x")).select("x.*")
    return out.withColumn(name, F.concat(F.lit(prefix), F.col(name))) if prefix else out


def escaped_tsv(spark: SparkSession, path: str) -> DataFrame:
    """name, title, body of tab-separated lines whose title and body are escaped as in JSON strings."""
    parts = F.split("value", "\t", 3)
    return spark.read.text(path).select(parts[0].alias("name"), json_unescaped(parts[1]).alias("title"), json_unescaped(parts[2]).alias("body"))


def write_escaped_tsv(docs: DataFrame, path: str) -> None:
    """The reverse, from name, title, body."""
    inner = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("x"))), r'(?s)^\{"x":"(.*)"\}$', 1)
    docs.select(F.concat_ws("\t", F.col("name").cast("string"), inner("title"), inner("body")).alias("value")).write.text(path)


def _lines_of_xml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """x: the element that each line holds. Malformed ones are null."""
    return spark.read.text(path).select(F.from_xml("value", schema).alias("x"))


def _elements(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """file, no and the members of each element of that name (which holds none of its own name), numbered from 0 in order within their file.

    A file is cut where elements end, in splits of any size, so an element is a row and a large file is read by several tasks. Numbers are sums over
    the splits before. A malformed element is a row of nulls, so that those behind it keep their numbers.
    """
    rows = spark.read.option("lineSep", f"</{row}>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    # elements without content stand before the one that ends here
    found = F.regexp_extract_all("value", F.lit(rf"(?s)<{row}(?:\s[^<>]*)?/>|<{row}(?:\s[^<>]*)?>.*$"), F.lit(0))
    parts = cut(rows.select("file", "split", "at", found.alias("parts")).filter(F.size("parts") > 0))
    sums = parts.groupBy("file", "split").agg(F.sum(F.size("parts")).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("own", F.coalesce(F.sum(F.size("parts")).over(inside), F.lit(0))).join(offsets, ["file", "split"])
    told = placed.select("file", (F.col("offset") + F.col("own")).alias("first"), F.posexplode("parts").alias("k", "part"))
    whole = F.when(F.col("part").rlike(rf"^<{row}(?:\s[^<>]*)?/>$"), F.col("part")).otherwise(F.concat("part", F.lit(f"</{row}>")))
    return told.select("file", (F.col("first") + F.col("k")).alias("no"), F.from_xml(whole, schema).alias("x")).select("file", "no", "x.*")


def page_scans(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """archive, page, terms, boxes of scanned books in XML: an OBJECT is a page, a WORD a word with its coords. Pages without words are left out, the others keep their number.

    lines: each line is a whole book; else each file is one, of any length: a page is a row, and the archive is what the file's first line with one names.
    """
    kind = "WORD array<struct<_VALUE:string,_coords:string>>"
    if lines:
        books = _lines_of_xml(spark, path, f"_archive string, BODY struct<OBJECT:array<struct<{kind.replace(' ', ':', 1)}>>>")
        pages = books.select(F.col("x._archive").alias("archive"), F.posexplode("x.BODY.OBJECT").alias("page", "o")).select("archive", F.col("page").cast("long").alias("page"), "o.WORD")
    else:
        name = F.regexp_extract("value", r'<DjVuXML[^>]*\barchive="([^"]*)"', 1)
        named = spark.read.text(path).filter(F.col("value").contains("<DjVuXML")).select(F.col("_metadata.file_path").alias("file"), name.alias("archive"))
        named = named.groupBy("file").agg(F.min(F.nullif("archive", F.lit(""))).alias("archive"))
        pages = _elements(spark, path, "OBJECT", kind).join(named, "file", "left").select("archive", F.col("no").alias("page"), "WORD")
    kept = F.filter("WORD", lambda w: F.trim(w["_VALUE"]) != "")
    return pages.select("archive", "page", F.transform(kept, lambda w: F.trim(w["_VALUE"])).alias("terms"), F.transform(kept, lambda w: w["_coords"]).alias("boxes")).filter(F.size("terms") > 0)


#: Spark types of a codebook's kinds of variables.
KINDS = {"categorical": "string", "number": "bigint", "real": "double", "text": "string", "date": "date"}


def codebook_csv(spark: SparkSession, path: str, codebook: dict[str, str]) -> DataFrame:
    """A CSV with a header whose columns have the types that the codebook gives (column to kind, in order); unknown kinds are an error."""
    if unknown := sorted(set(codebook.values()) - set(KINDS)):
        raise ValueError(f"unknown kinds of variables: {', '.join(unknown)}")
    schema = ", ".join(f"`{c}` {KINDS[k]}" for c, k in codebook.items())
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=False)


_ANNOTATED = "sentences array<struct<tokens:array<string>,lemmas:array<string>,pos:array<string>>>"


def _sentences(rows: DataFrame, names: list[str], lower: bool) -> DataFrame:
    """names, no, terms, lemmas, begin, end of rows of names and s (the sentences of one document): offsets are sums inside the row."""
    n = lambda x: F.size(x["tokens"])
    begins = F.transform("s", lambda x, i: F.aggregate(F.slice("s", 1, i), F.lit(0).cast("long"), lambda a, y: a + n(y)))
    placed = rows.filter("s is not null").select(*names, F.posexplode(F.arrays_zip(F.col("s"), begins.alias("b"))).alias("no", "x"))
    lemmas = F.col("x.s.lemmas")
    return placed.select(*names, F.col("no").cast("long").alias("no"), F.col("x.s.tokens").alias("terms"), (F.transform(lemmas, lambda y: F.lower(y)) if lower else lemmas).alias("lemmas"), F.col("x.b").alias("begin"), (F.col("x.b") + F.size("x.s.tokens")).alias("end"))


def annotated(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """name, no, terms, lemmas, begin, end from lines of 'name TAB json', json holding sentences of pos, lemmas and tokens; places count over the document. lower: lemmas in lower case."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(parts[0].alias("name"), F.from_json(parts[1], _ANNOTATED)["sentences"].alias("s"))
    return _sentences(rows, ["name"], lower)


def annotated_files(spark: SparkSession, path: str, lower: bool = False, folder: bool = False) -> DataFrame:
    """name, id, no, terms, lemmas, begin, end from files of one such document each, which (or whose folder) are named after it; id is the number at the name's end, null without one."""
    name = F.regexp_extract("_metadata.file_path", "([^/]*)/[^/]*$", 1) if folder else F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")
    rows = spark.read.option("multiLine", True).schema(_ANNOTATED).json(path).select(name.alias("name"), F.col("sentences").alias("s"))
    return _sentences(rows.withColumn("id", F.nullif(F.regexp_extract("name", r"(\d+)$", 1), F.lit("")).cast("long")), ["name", "id"], lower)


def annotations_tsv(spark: SparkSession, path: str) -> DataFrame:
    """mention, entity: the third and the eighth of tab-separated columns."""
    c = F.split("value", "\t")
    return spark.read.text(path).select(F.get(c, F.lit(2)).alias("mention"), F.get(c, F.lit(7)).alias("entity")).filter("entity is not null")


def queries_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """qid, text of files of {"queries": [{"number": ..., "text": ...}]}; lines: each line is such an object, so that a file can be cut."""
    rows = spark.read.option("multiLine", not lines).schema("queries array<struct<number:string,text:string>>").json(path)
    return rows.select(F.inline("queries")).select(F.col("number").alias("qid"), "text")


def voted_csv(spark: SparkSession, path: str, slots: int = 5) -> DataFrame:
    """worker, qid, item, vote of a CSV with a header that has columns worker, qid and for each slot item_k and vote_k; empty slots are left out."""
    rows = spark.read.csv(path, header=True)
    cells = F.array(*[F.struct(F.col(f"item_{k}").alias("item"), F.col(f"vote_{k}").cast("int").alias("vote")) for k in range(1, slots + 1)])
    return rows.select("worker", "qid", F.inline(cells)).filter("item is not null")


def difficulty_tsv(spark: SparkSession, path: str) -> DataFrame:
    """query, difficulty, entities (sorted): lines of query, difficulty and an entity, which stands in the fourth column where there are more than three."""
    c = F.split("value", "\t")
    entity = F.when(F.size(c) > 3, F.get(c, F.lit(3))).otherwise(F.get(c, F.lit(2)))
    rows = spark.read.text(path).select(c[0].alias("query"), F.get(c, F.lit(1)).alias("difficulty"), entity.alias("entity"))
    return rows.groupBy("query").agg(F.min("difficulty").alias("difficulty"), F.array_sort(F.collect_set("entity")).alias("entities"))


def prior_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="id string, score double", quote="")


def topics_xml(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """qid, title, description of <topic number=""><title/><description/></topic> elements; lines: each line is a whole <topics> element. Malformed topics are left out."""
    kind = "_number string, title string, description string"
    if lines:
        rows = _lines_of_xml(spark, path, f"topic array<struct<{kind.replace(' ', ':')}>>".replace(",:", ",")).select(F.inline("x.topic"))
    else:
        rows = _elements(spark, path, "topic", kind).filter("_number is not null")
    return rows.select(F.col("_number").alias("qid"), F.trim("title").alias("title"), F.trim("description").alias("description"))


def topics_html(spark: SparkSession, path: str) -> DataFrame:
    """qid, title from pages with <b>number</b> title parts, one a line."""
    v = spark.read.text(path).filter(F.col("value").contains("<b>"))
    return v.select(F.regexp_extract("value", "<b>([^<]*)</b>", 1).alias("qid"), F.trim(F.regexp_replace(F.regexp_extract("value", "</b>(.*)$", 1), "<[^>]*>", "")).alias("title"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """id, name, email of lines 'candidate-N name ... email'."""
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.col("value").startswith("candidate-")).select(c[0].alias("id"), F.array_join(F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0))), " ").alias("name"), F.element_at(c, -1).alias("email"))


def zip_codes(spark: SparkSession, path: str) -> DataFrame:
    """zip, city, state of a CSV without a header; the code 99999 stands for none."""
    return spark.read.csv(path, schema="zip string, city string, state string").filter("zip <> '99999'")


def surface_forms(people: DataFrame) -> DataFrame:
    """form, id, kind: names, names without accents, and addresses as forms in lower case; people: id, name, email. Each form of an entity once."""
    forms = F.array(F.struct(F.lower("name").alias("form"), F.lit("name").alias("kind")), F.struct(normal_name(F.col("name")).alias("form"), F.lit("plain").alias("kind")), F.struct(F.lower("email").alias("form"), F.lit("email").alias("kind")))
    rows = people.select("id", F.inline(forms)).filter("form <> ''")
    return rows.groupBy("form", "id").agg(F.min("kind").alias("kind"))


def place_forms(zips: DataFrame, state_names: dict[str, str]) -> DataFrame:
    """form, zip: a code alone, with city and state in several orders, and cities with the state's name; in lower case, each once."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in state_names.items() for x in pair]), F.col("state")), F.col("state")) if state_names else F.col("state")
    c, st, z, sep = F.col("city"), F.col("state"), F.col("zip"), F.lit(" ")
    made = [z, F.concat(c, sep, st), F.concat(c, sep, name), F.concat(c, sep, st, sep, z), F.concat(c, sep, name, sep, z), F.concat(c, sep, z), F.concat(st, sep, z), F.concat(name, sep, z), F.concat(z, sep, c), F.concat(z, sep, c, sep, st), F.concat(z, sep, c, sep, name), F.concat(z, sep, st), F.concat(z, sep, name)]
    return zips.select("zip", F.explode(F.array_distinct(F.array(*[F.lower(x) for x in made]))).alias("form")).select("form", "zip")


def dictionary_of_titles(titles: DataFrame, longest: int, title: str = "title") -> DataFrame:
    """title, terms: titles in their dictionary form of one to longest terms; others are left out."""
    return titles.select(F.col(title).alias("title"), token_array(normal_name(F.col(title))).alias("terms")).filter(F.size("terms").between(1, longest))


def by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines of two texts side by side: the rows of one number."""
    return left.join(right, "no").select("no", left["value"].alias("left"), right["value"].alias("right"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """no, value: the lines of a text with their numbers, from file to file in order of names; a file's splits are numbered by several tasks."""
    return numbered(split_lines(spark, path), {}, through=True).select("no", "value")


def parts_of_triples(spark: SparkSession, path: str, predicate: str, mark: str = "Category:") -> DataFrame:
    """src, category of N-Triples with the predicate whose object's last part begins with mark."""
    rows = triples(spark, path, predicate)
    return rows.filter(F.col("dst").startswith(mark)).select("src", F.substr("dst", F.lit(len(mark) + 1)).alias("category"))


def write_lines(rows: DataFrame, columns: list[Column | str], path: str, sep: str = "\t", most: int = 0) -> None:
    """Columns joined by sep as lines, most lines in a file at most (0: any number)."""
    text = F.concat_ws(sep, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])
    writer = rows.select(text.alias("value")).write
    (writer.option("maxRecordsPerFile", most) if most else writer).text(path)


def write_qrels(grades: DataFrame, path: str) -> None:
    """Lines 'qid 0 doc grade'."""
    write_lines(grades, ["qid", F.lit("0"), "doc", "grade"], path, " ")


def write_pages(rows: DataFrame, path: str, slots: int = 5) -> None:
    """qid and slots items a line, with a header, from qid, item: items of a query in order, the last page filled up with a sample (the least hashes) of the query's items
    on the other pages; where these are too few its cells stay empty. A query of very many items is dealt over tasks (see finder.running)."""
    numbered_ = cut(running(rows.select("qid", "item"), ["qid"], ["item"], "r"))
    sizes = numbered_.groupBy("qid").agg((F.max("r") + 1).alias("n"))
    lack = F.pmod(-F.col("n"), F.lit(slots))
    # at most slots - 1 of each partial group go on: the sample is kept small before it is shuffled
    others = numbered_.join(sizes, "qid").filter(F.col("r") < F.col("n") - F.pmod("n", F.lit(slots))).withColumn("h", F.xxhash64("qid", "item"))
    again = others.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("h", "item")) - 1).filter((F.col("k") < slots - 1) & (F.col("k") < lack))
    placed = numbered_.select("qid", "item", "r").unionByName(again.select("qid", "item", (F.col("n") + F.col("k")).alias("r"))).withColumn("page", F.floor(F.col("r") / slots))
    wide = placed.groupBy("qid", "page").agg(*[F.max(F.when(F.pmod("r", F.lit(slots)) == k, F.col("item"))).alias(f"item_{k + 1}") for k in range(slots)])
    wide.select("qid", *[f"item_{k + 1}" for k in range(slots)]).write.csv(path, header=True)


def named_archive(docs: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One compressed JSON line for each name: the first text in order of the other columns that a name has."""
    first_by_name(docs.select(F.col(name).alias("name"), F.col(text).alias("text")), "name", "text").write.option("compression", "gzip").json(path)


def dataset(spark: SparkSession, path: str) -> dict:
    """What a dataset's configuration (one small JSON file) says: name, path of the documents, variables, tokenizer. Missing members are null."""
    row = spark.read.option("multiLine", True).schema("name string, documents string, variables map<string,string>, tokenizer string").json(path).first()
    return {} if row is None else row.asDict()

"""Readers of files that are cut into splits, and of XML by elements."""

import uuid

import pytest
from pyspark.sql import functions as F

from termweave.operators.index import shared
from termweave.sources import readers


@pytest.fixture
def place(spark, tmp_path):
    return tmp_path


@pytest.fixture
def splits(spark):
    """Splits of 2,000 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _conll(docs):
    return "".join("-DOCSTART- -X- O O\n\n" + "".join("".join(f"{w} N B O\n" for w in s) + "\n" for s in d) for d in docs)


def test_conll_is_numbered_over_splits(spark, place, splits):
    files = [[[[f"f{f}d{d}s{s}w{w}" for w in range(1 + (d + s) % 4)] for s in range(1 + d % 5)] for d in range(90)] for f in range(2)]
    for k, docs in enumerate(files):
        (place / f"part-{k}").write_text(_conll(docs))
    lines = readers.split_lines(spark, str(place))
    assert lines.select("file", "split").distinct().groupBy("file").count().agg(F.min("count")).first()[0] > 4
    got = {(r.file[-1], r.word): (r.doc, r.sentence, r.pos) for r in readers.conll(spark, str(place)).collect()}
    want, seen = {}, 0
    for k, docs in enumerate(files):
        sentence = 0
        for d, sentences in enumerate(docs, 1):
            sentence += 1  # the blank line behind the document's mark
            for s in sentences:
                want.update({(str(k), w): (d, sentence, i) for i, w in enumerate(s)})
                sentence += 1
                seen += len(s)
    assert got == want and len(got) == seen


def test_lines_are_numbered_over_files_and_splits(spark, place, splits):
    values = [f"line {k} " + "x" * (k % 50) for k in range(900)]
    (place / "part-0").write_text("\n".join(values[:500]) + "\n")
    (place / "part-1").write_text("\n".join(values[500:]))
    got = readers.numbered_lines(spark, str(place))
    assert {r.no: r.value for r in got.collect()} == dict(enumerate(values))
    both = readers.by_position(got, readers.numbered_lines(spark, str(place)))
    assert both.filter("left <> right").count() == 0 and both.count() == 900


def test_marks_are_counted_up_to_each_line(spark, place, splits):
    (place / "f").write_text("\n".join("a" if k % 7 == 0 else "b" * 30 for k in range(700)))
    rows = readers.numbered(readers.split_lines(spark, str(place)), {"n_a": F.col("value") == "a"}).collect()
    assert all(r.n_a == r.no // 7 + 1 for r in rows) and len(rows) == 700


def _book(name, pages):
    body = "\n".join("<OBJECT>" + "".join(f'<WORD coords="{k},1">{w}</WORD>\n' for k, w in enumerate(p)) + "</OBJECT>" for p in pages)
    return f'<?xml version="1.0"?>\n<DjVuXML archive="{name}">\n<BODY>{body}</BODY>\n</DjVuXML>\n'


def test_pages_of_books_are_rows(spark, place, splits):
    pages = [[f"p{k}", "w", " "] if k % 10 else [] for k in range(10_000)]
    (place / "a.xml").write_text(_book("one", pages))
    (place / "b.xml").write_text(_book("two", [["x"], ["y", "z"]]))
    got = {(r.archive, r.page): (r.terms, r.boxes) for r in readers.page_scans(spark, str(place)).collect()}
    assert got == {**{("one", k): ([f"p{k}", "w"], ["0,1", "1,1"]) for k in range(10_000) if k % 10}, ("two", 0): (["x"], ["0,1"]), ("two", 1): (["y", "z"], ["0,1", "1,1"])}


def test_malformed_elements_keep_the_numbers_of_those_behind(spark, place):
    (place / "a.xml").write_text('<DjVuXML archive="m"><BODY><OBJECT><WORD>a</WORD></OBJECT>\n<OBJECT><WORD>b</OBJECT>\n<OBJECT><WORD>c</WORD></OBJECT></BODY></DjVuXML>')
    got = {r.page: r.terms for r in readers.page_scans(spark, str(place)).collect()}
    assert got == {0: ["a"], 2: ["c"]}


def test_topics_are_rows(spark, place):
    (place / "t.xml").write_text('<topics>\n<topic number="1"><title> one </title><description>d\n1</description></topic>\n<topic number="2"><title>two</title></topic>\n<topic><title>no number</title></topic></topics>')
    assert sorted(map(tuple, readers.topics_xml(spark, str(place)).collect())) == [("1", "one", "d\n1"), ("2", "two", None)]


def test_pages_are_filled_up_with_a_sample(spark):
    rows = spark.createDataFrame([("a", k) for k in range(12)] + [("b", k) for k in range(3)] + [("c", k) for k in range(10)], "qid string, item long")
    readers.write_pages(rows, path := f"{shared(spark)}/{uuid.uuid4().hex}")
    lines = [(r.qid, [int(x) for x in (r.item_1, r.item_2, r.item_3, r.item_4, r.item_5) if x is not None]) for r in spark.read.csv(path, header=True).collect()]
    of = {q: sorted(x for k, x in lines if k == q) for q in "abc"}
    assert [x for x in of["a"] if x[:2] == [10, 11]] and len(of["a"]) == 3 and all(len(x) == 5 for x in of["a"])
    last = next(x for x in of["a"] if x[:2] == [10, 11])
    assert set(last[2:]) < set(range(10)) and len(set(last)) == 5
    assert of["b"] == [[0, 1, 2]] and of["c"] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]


def test_annotated_documents_of_lines_and_of_files(spark, place):
    one = '{"sentences": [{"tokens": ["A", "b"], "lemmas": ["A", "B"], "pos": ["X", "Y"]}, {"tokens": [], "lemmas": [], "pos": []}, {"tokens": ["c"], "lemmas": ["C"], "pos": ["Z"]}]}'
    (place / "lines").mkdir()
    (place / "lines" / "f").write_text(f"bill7\t{one}\nbad\t{{no json\nnone\t{{}}\n")
    want = [(0, ["A", "b"], ["a", "b"], 0, 2), (1, [], [], 2, 2), (2, ["c"], ["c"], 2, 3)]
    assert [tuple(r) for r in readers.annotated(spark, str(place / "lines"), lower=True).orderBy("no").collect()] == [("bill7", *w) for w in want]
    (place / "files").mkdir()
    (place / "files" / "bill12.anno").write_text(one.replace("}, {", "},\n {"))
    (place / "files" / "other.anno").write_text('{"sentences": [{"tokens": ["z"], "lemmas": ["Z"], "pos": ["N"]}]}')
    got = readers.annotated_files(spark, str(place / "files")).orderBy("name", "no").collect()
    assert [(r.name, r.id, r.no, r.begin, r.end) for r in got] == [("bill12", 12, 0, 0, 2), ("bill12", 12, 1, 2, 2), ("bill12", 12, 2, 2, 3), ("other", None, 0, 0, 1)] and got[0].lemmas == ["A", "B"]

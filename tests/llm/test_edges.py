"""Empty tables, very long texts, repeated rows, ties and clashing columns, for every operator and the pipeline."""

import base64
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import ann, bpe, chat, jaccard, licences, linededup, mixing, pii, quality, queries, urls
from termweave.llm.common import discard, materialise, settled, shared, table

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "labels", "conversations", "benchmark"]
#: Columns of the caller's whose names operators might use themselves.
CLASH = "id string, n int, class string, fp string, line string, gram string, hash string, score double, rate double, level long, host string, text2 string, __x int"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("none")
    for t in TABLES:
        table(spark, SF, t).limit(0).write.parquet(f"{place}/{t}.parquet")
    return str(place)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_empty_tables(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0


def _clashing(spark, rows, schema):
    extra = [c.split()[0] for c in CLASH.split(", ")]
    own = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(None).cast(k.split()[1]) for c, k in zip(extra, CLASH.split(", "), strict=True) if c not in own})


def test_nulls_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "one two three four five six", "s"), (1, "one two three four five six", "s"), (2, None, None), (None, "x y", "s"), (3, "", "t")]
    docs = _clashing(spark, rows, "doc_id long, text string, source string")
    labels = _clashing(spark, [(1, 1, 0), (2, None, None), (None, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    import public_tokenizers as P

    assert bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 5
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()) == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3)]
    assert jaccard.keep_one(docs).columns == docs.columns and jaccard.keep_one(docs).count() == 5
    assert linededup.dedup(docs).columns == [*docs.columns, "__n_removed"] and linededup.dedup(docs).count() == 5
    assert quality.judge(docs).count() == 5 and quality.keep_good(docs).columns == docs.columns
    assert mixing.mix(docs, labels).count() == 5 and mixing.apply_mix(docs, labels).columns == docs.columns
    assert pii.find(docs).count() == 5 and licences.scan(docs).count() == 0 and licences.scan_runs(docs).count() == 0
    pages = _clashing(spark, [(1, "http://a.com/"), (1, "http://a.com/"), (2, None)], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in urls.judge(pages, urls.RULES).collect()) == [(1, "allow"), (1, "allow"), (2, "block")]
    said = _clashing(spark, [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "Assistant", "c"), (None, 2, "user", "d"), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    assert [(r.call_id, r.status) for r in chat.link(*chat.from_turns(said), chat.SCHEMAS).collect()] == [("1:0", "ok")]
    vectors = _clashing(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [1.0, 0.5]), (40, None)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(vectors, F.col("vec_id") % 20 == 0, 20).collect()] == [(20, 1, 1, 1.0)]


def test_very_long_texts(spark):
    """Texts beyond a piece, a segment and a batch: each operator reads them whole."""
    import public_tokenizers as P
    import tiktoken

    rng = random.Random(1)
    words = [f"w{rng.randrange(30_000)}" for _ in range(150_000)]
    long, near = " ".join(words), " ".join(w if k % 100 else "changed" for k, w in enumerate(words))
    blank, solid = " " * (bpe.PIECE + 5) + "end", "ab" * bpe.PIECE
    assert len(long) > 3 * bpe.PIECE and len(long) > 3 * jaccard.SEGMENT
    docs = spark.createDataFrame([(1, long, "s"), (2, near, "s"), (3, long + " last", "s"), (4, "short text", "s")], "doc_id long, text string, source string")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(5, blank), (6, "x " + solid[: bpe.PIECE // 8])], "doc_id long, text string"))
    for r in bpe.encode(both, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).join(both, "doc_id").collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == enc.encode_ordinary(r.text) and bytes(r.decoded).decode() == r.text
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in (long, near, long + " last")]
    assert [len(s) for s in jaccard.shingle_sets([long, near, long + " last"])] == [len(s) for s in sets]
    links = {(a, b) for a in range(3) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert links == {(1, 0), (2, 0), (2, 1)} and got == {1: 1, 2: 1, 3: 1, 4: 4}
    measured = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert measured[1].n_words == len(words) and measured[1].n_repeat_words == 0
    assert {r.doc_id: r.n_tokens for r in mixing.posteriors(docs, mixing.Model(mixing._prior({"clean": 1, "low": 0, "toxic": 0}), {"low": 0.0, "toxic": 0.0}, []), [F.col("doc_id")]).collect()}[3] == len(words) + 1
    lines = "\n".join(f"line {k}" for k in range(60_000))
    twice = spark.createDataFrame([(1, lines), (2, "first\n" + lines)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup(twice).collect()} == {1: lines, 2: "first"}
    far = spark.createDataFrame([(1, long + " mail a@b.org")], "doc_id long, text string")
    assert pii.find(far).first().spans == f"email:{len(long) + 6}:{len(long) + 13}"


def test_line_dedup_ties_of_one_id(spark):
    """Rows of one id are told apart by their text, in the order of its hash; equal rows lose the same lines."""
    block = "a\nb\nc"
    rows = [(1, block + "\nx"), (1, block + "\ny"), (1, block + "\ny"), (2, block)]
    got = sorted(r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got in (["", "a\nb\nc\nx", "y", "y"], ["", "a\nb\nc\ny", "a\nb\nc\ny", "x"])


def test_tables_are_removed_once_settled(spark):
    from pathlib import Path

    place = Path(shared(spark).removeprefix("file:"))
    tables = lambda: len(list(place.glob("termweave-*")))
    docs, before = table(spark, SF, "documents"), tables()
    kept = settled(lambda: materialise(docs.select("doc_id")).filter("doc_id > 5"))
    assert tables() == before + 1 and kept.count() > 0
    jaccard.keep_one(docs).count()
    mixing.mix(docs, table(spark, SF, "labels")).count()
    assert tables() == before + 3
    discard(kept)
    assert tables() == before + 2


def test_pretokens_end_where_pieces_do():
    text = "".join(random.Random(4).choice(["a", " ", "\n", "  ", "é", "'s", "7", "　"]) for _ in range(5000))
    import public_tokenizers as P
    import regex

    old, bpe.PIECE = bpe.PIECE, 50
    try:
        cut = [x for a, b in bpe.pieces(text) for x in regex.compile(P.PATTERN).findall(text, a, b)]
    finally:
        bpe.PIECE = old
    assert cut == regex.findall(P.PATTERN, text) and re.sub(r"\s", "", "".join(cut)) == re.sub(r"\s", "", text)


def test_long_urls_and_rules_of_equal_length(spark):
    long = "http://a.com/" + "path/" * 800
    rows = [(k, f"http://{'good' if k % 2 else 'bad'}{k}.{'com' if k % 2 else 'net'}/{'en' if k % 2 else 'fr'}/{k}") for k in range(80)] + [(100, long), (101, "http://x.org/" + "e" * 4_000), (102, "http://WWW.EXAMPLE.com/en/x"), (103, "http://example.com/en/x")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES).collect()}
    assert got[100].path == long[len("http://a.com") :] and (got[100].rule, got[100].verdict) == ("com/", "allow") and got[101].verdict in ("allow", "block") and got[101].score is not None
    assert (got[102].rule, got[102].verdict, got[102].host) == ("www.example.com/en/", "allow", "www.example.com") and (got[103].rule, got[103].verdict) == ("example.com/en/", "block")
    # of rules of one length that fit, a block wins, whatever their order
    for rules in ([("allow", "com/"), ("block", "com/")], [("block", "com/"), ("allow", "com/")]):
        assert {r.verdict for r in urls.judge(spark.createDataFrame(rows[1:9:2], "page_id long, url string"), rules).collect()} == {"block"}


def test_very_long_turns(spark):
    said = spark.createDataFrame([(1, 0, "user", "ü" * 300_000), (1, 1, "assistant", '"' * 200_000), (2, 0, "system", "x"), (2, 1, "user", None), (2, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in chat.link(*chat.from_turns(said), chat.SCHEMAS).collect()}
    assert got["1:0"].status == "invalid" and len(got["1:0"].line) == 300_000 + 400_000 + len('{"arguments":{"prompt":"","role":"user"},"id":"1:0","name":"reply","result":""}')
    assert got["2:0"].status == "unresolved" and got["2:1"].status == "invalid"


def test_licences_at_the_end_of_long_texts(spark):
    notice = "Released under the MIT License."
    docs = spark.createDataFrame([(1, "word of prose that goes on\n" * 6_000 + notice)], "doc_id long, text string")
    assert [(r.unit, r.number, r.licence) for r in licences.scan(docs).collect()] == [("line", 6_000, "MIT")]

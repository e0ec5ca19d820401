"""Each operator on small tables: nulls, empty and repeated rows, clashing columns, brute force."""

import base64
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import ann, bpe, chat, jaccard, licences, linededup, mixing, pii, quality, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k}" for k in range(3000))
TEXTS = [None, "", " \n\t", "one", "A b c d e f", "a B c d e f", LONG, LONG + " tail", "x " * 400, "line one\nline two\nline three\nline four", "zero\nline one\nline two\nline three"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 2}", len(t or ""), "clash") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s0", 11, "clash"), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")


def test_bpe_equals_library(spark, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = spark.createDataFrame([(100, "don't  stop   \n\n naïve ÜBER 12345 🙂🙂 " * 50), (101, "<|endoftext|>zzzqqq" * 3)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    got = bpe.encode(both, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).join(both, "doc_id").collect()
    assert len(got) >= len(TEXTS)
    for r in got:
        ids = enc.encode_ordinary(r.text or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()


def test_jaccard_equals_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    base = [f"t{k}" for k in rng.integers(0, 50, 60)]
    near = []
    for k in range(60):  # a family of copies with up to eight words changed, so that its members link only in part
        w = list(base)
        for at in rng.integers(0, 60, k % 9):
            w[at] = f"n{rng.integers(0, 5)}"
        near.append((200 + k, " ".join(w)))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(both).collect()}
    sets = {}
    for r in both.filter("doc_id is not null").collect():
        w = WORD.findall((r.text or "").lower())
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    of = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
    assert got.pop(None) == (0, None)
    assert got == {k: (len(sets[k]), of[k]) for k in sets}


def test_quality_measures(docs):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for k, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        assert (got[k].n_words, got[k].n_repeat_words, got[k].word_chars) == (len(w), len(covered), sum(map(len, w)))
    assert got[6].base_failed is False and got[8].base_failed and not got[0].kept
    assert set(quality.keep_good(docs).columns) == set(docs.columns)


def test_line_dedup_takes_later_windows(docs):
    got = {r.doc_id: r.text for r in linededup.dedup(docs).collect()}
    assert got[9] == TEXTS[9] and got[10] == "zero" and got[0] is None and got[None] == "no id"


def test_pii(spark):
    cases = ["a.b@c.de and 10.0.0.1 or 999.1.1.1", "4111 1111 1111 1111", "+1 (234) 555-1234", "john [at] example (dot) com", "look at the dot com", "call plus one five five five one two three four five", "", None]
    got = [r.spans for r in pii.find(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["email:0:8,ip:13:21", "card:0:19", "phone:0:17", "email:0:27", "", "phone:5:52", "", ""]


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), v.tolist(), "x") for k, v in enumerate(rng.normal(size=(800, 16)))]
    rows += [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [None] * 16, "x"), (904, [1.0], "x"), (20, rows[20][1], "x"), (905, rows[20][1], "x")]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, hash string"), F.col("vec_id") % 20 == 0, 20).collect()
    e = np.array([r[1] for r in rows[:800]], np.float32).astype(float)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert len(found) == 40 and 905 in found[20].values()
    recall = []
    for q in found:
        s = e @ e[q]
        s[q] = -9e9
        recall.append(len(set(found[q].values()) & set(np.argsort(-s)[:20])) / 20)
    assert np.mean(recall) >= 0.9
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_urls(spark):
    pages = [(k, u) for k, u in enumerate([None, "", "no scheme", "http://A.example.com/en/x", "http://www.example.com/en/1", "https://b.net/es/1?q", "https://b.org", "https://x.com/de/#t"] + [f"http://n{k % 7}.net/fr/{k}" for k in range(40)] + [f"http://n{k % 7}.com/de/{k}" for k in range(40)])]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), urls.RULES).collect()}
    assert [got[k].verdict for k in (0, 1, 3, 4, 5, 7)] == ["block", "block", "block", "allow", "block", "allow"]
    assert (got[3].host, got[3].path, got[3].rule, got[4].rule) == ("a.example.com", "/en/x", "example.com/en/", "www.example.com/en/") and got[2].host == got[2].path == ""


def test_licences(spark):
    got = licences.scan(spark.createDataFrame([(1, "hello\nlicensed under the apache license version 2.0"), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.unit, r.number, r.licence, r.dice) for r in got) == [(1, "line", 1, "Apache-2.0", 1.0), (1, "text", 0, "Apache-2.0", 0.933333)]


def test_licence_paragraphs_and_repeated_rows(spark):
    """Whole licences, wrapped or not, as paragraphs of longer texts; ties go to the name that sorts first."""
    wrapped = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    texts = dict(licences.TEXTS)
    story = "\n".join(f"line {k} says thing {k * 7}" for k in range(80))
    rows = [(1, f"{story}\n \n{wrapped(texts['MIT'], 9)}\n\n{story}", "a", 5), (2, f"{story}\n\n{texts['ISC']}", "a", 5), (3, wrapped(texts["BSD-3-Clause"], 12), "a", 5), (3, wrapped(texts["BSD-3-Clause"], 12), "a", 5), (4, "", "a", 5), (5, story * 300, "a", 5), (None, None, "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit string, number int")
    got = sorted((r.doc_id, r.unit, r.number, r.licence) for r in licences.scan(docs).collect() if r.unit != "line")
    assert got == [(1, "paragraph", 1, "MIT"), (3, "text", 0, "BSD-3-Clause"), (3, "text", 0, "BSD-3-Clause")]
    lines = [(r.doc_id, r.number, r.licence) for r in licences.scan(docs).collect() if r.unit == "line"]
    assert (2, 81, "ISC") in lines
    assert licences.scan(docs.limit(0)).count() == 0
    twins = [("B", "one two three four"), ("A", "one two three four")]
    assert [r.licence for r in licences.scan(spark.createDataFrame([(1, "one two three four")], "doc_id long, text string"), twins).collect()] == ["A"]


def test_chat_order_and_cycles(spark):
    calls = spark.createDataFrame([("a", "reply", {"prompt": "p", "role": "user"}, None), ("b", "reply", {"prompt": "p"}, ["a", "zz"]), ("c", "reply", {}, ["d"]), ("d", "reply", {"prompt": "p"}, ["c"])], "call_id string, name string, arguments map<string,string>, waits_for array<string>")
    results = spark.createDataFrame([("a", "r"), ("b", "s"), ("q", "t")], "call_id string, content string")
    got = {r.call_id: r for r in chat.link(calls, results, chat.SCHEMAS).collect()}
    assert {k: (r.level, r.status) for k, r in got.items()} == {"a": (0, "ok"), "b": (1, "ok"), "c": (-1, "cyclic"), "d": (-1, "cyclic")}
    assert got["a"].line == '{"arguments":{"prompt":"p","role":"user"},"id":"a","name":"reply","result":"r"}'


def test_chat_schema_types(spark):
    schemas = {"t": {"required": ["n"], "max_chars": {}, "one_of": {"unit": ["c", "f"]}, "types": {"n": "integer", "x": "number", "b": "boolean", "l": "array", "o": {"a": "integer", "s": {"k": "string"}}}, "closed": True}}
    good = [{"n": "3"}, {"n": "-12", "x": "1.5e3", "b": "true"}, {"n": "0", "l": "[1,2]", "o": '{"a": 1, "s": {"k": "v"}}'}, {"n": "1", "unit": "c", "x": None}]
    bad = [{}, {"n": "3.0"}, {"n": "x"}, {"n": "1", "x": "1."}, {"n": "1", "b": "yes"}, {"n": "1", "l": "{}"}, {"n": "1", "o": "[]"}, {"n": "1", "o": '{"a": "z", "s": {"k": "v"}}'}, {"n": "1", "o": '{"a": 1}'}, {"n": "1", "more": "1"}, {"n": "1", "unit": "k"}, {"n": None}]
    rows = spark.createDataFrame([(k, "t", a, "clash") for k, a in enumerate(good + bad)] + [(99, "unknown", {"n": "1"}, "clash"), (98, None, None, None)], "k int, name string, arguments map<string,string>, content string")
    got = {r.k: r.v for r in rows.select("k", chat.valid(F.col("name"), F.col("arguments"), schemas).alias("v")).collect()}
    assert got == {k: k < len(good) for k in range(len(good + bad))} | {99: False, 98: False}


def test_chat_levels_equal_longest_paths(spark):
    rng = np.random.default_rng(5)
    waits = {f"c{k}": [f"c{k - 1}"] if k % 40 else [] for k in range(1, 120)} | {"c0": []}  # chains of forty
    waits |= {f"m{k}": [f"m{j}" for j in rng.integers(0, k, rng.integers(0, 4))] + ([f"c{k}"] if k % 5 == 0 else []) for k in range(1, 60)} | {"m0": ["c119"]}
    waits |= {"x": ["y", "m3"], "y": ["z"], "z": ["x"], "w": ["x"], "v": ["w", "c3"], "s": ["s"]}
    level: dict = {}
    for _ in waits:
        level |= {k: 1 + max((level[f] for f in w), default=-1) for k, w in waits.items() if all(f in level for f in w)}
    got = chat.levels(spark.createDataFrame(list(waits.items()), "call_id string, waits_for array<string>")).collect()
    assert {r.call_id: r.level for r in got} == {k: level.get(k, -1) for k in waits}


def test_mixing_tells_domains_apart(spark):
    rows = [(k, ("scum " if k % 4 == 0 else "") + " ".join(f"v{(k * 7 + j) % 90}" for j in range(30))) for k in range(400)] + [(900, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == 401
    assert all((r.p_toxic > 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id < 400)  # the held-in labels are told apart


def test_lines_of_calls_are_canonical_at_every_level(spark):
    schemas = {"f": {"required": [], "max_chars": {}, "one_of": {}, "types": {"o": {"a": "integer"}, "n": "integer", "l": "array", "b": "boolean", "x": "number", "s": "string"}}}
    calls = spark.createDataFrame(
        [("1", "f", {"o": '{"b":1,"a":2}', "n": "3", "s": "3"}, None), ("2", "f", {"s": "3", "n": "3", "o": '{"a": 2, "b":1}'}, None), ("3", "f", {"l": '[ {"z" : null, "y":[true, "é\\u0041"]} ]', "b": "true", "x": "1.5", "n": "no number", "q": '{"b":1}'}, None), ("4", "g", {"o": '{"b": 1}'}, None), ("5", "f", None, None), ("6", None, {'k"y': "a\nb"}, None)],
        "call_id string, name string, arguments map<string,string>, waits_for array<string>",
    )
    results = spark.createDataFrame([("1", "r")], "call_id string, content string")
    got = {r.call_id: r.line for r in chat.link(calls, results, schemas).collect()}
    assert got["1"] == '{"arguments":{"n":3,"o":{"a":2,"b":1},"s":"3"},"id":"1","name":"f","result":"r"}'
    assert got["2"] == '{"arguments":{"n":3,"o":{"a":2,"b":1},"s":"3"},"id":"2","name":"f"}'
    assert got["3"] == '{"arguments":{"b":true,"l":[{"y":[true,"éA"],"z":null}],"n":"no number","q":"{\\"b\\":1}","x":1.5},"id":"3","name":"f"}'
    assert got["4"] == '{"arguments":{"o":"{\\"b\\": 1}"},"id":"4","name":"g"}'
    assert got["5"] == '{"arguments":{},"id":"5","name":"f"}' and got["6"] == '{"arguments":{"k\\"y":"a\\nb"},"id":"6"}'

"""The pipeline's stages on the smallest tables, each on its predecessor's rows, against brute force."""

import base64
import hashlib
import re

from termweave.llm import mixing, quality
from termweave.llm.common import materialise, table

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _dedup(docs: dict) -> dict:
    """Texts without the lines that later occurrences of three-line windows cover."""
    found = {}
    for d in sorted(docs):
        lines = [(no, x.strip(WHITE)) for no, x in enumerate((docs[d] or "").split("\n")) if x.strip(WHITE)]
        for k in range(max(len(lines) - 2, 1) if lines else 0):
            part = lines[k : k + 3]
            found.setdefault(tuple(x for _, x in part), []).append((d, [no for no, _ in part]))
    gone: dict = {}
    for places in found.values():
        for d, covers in places[1:]:
            gone.setdefault(d, set()).update(covers)
    rest = {d: "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[d]) if d in gone else t for d, t in docs.items()}
    return {d: t for d, t in rest.items() if d not in gone or WORD.search(t)}


def _least(docs: dict) -> set:
    """The least ids of the components of documents that share four fifths of their five-word shingles."""
    sets = {}
    for d, t in docs.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    of = {d: d for d in docs}

    def top(d):
        while of[d] != d:
            d = of[d]
        return d

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                of[high] = low
    return {d for d in docs if of[d] == d}


def test_stages_equal_brute_force(spark):
    import corpus_pipeline as C
    import public_tokenizers as P
    import tiktoken

    docs = table(spark, SF, "documents")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    good = materialise(C.quality_rules(spark, docs, SF))
    assert good.columns == docs.columns
    verdicts = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    kept = texts(good)
    assert kept == {d: t for d, t in texts(docs).items() if verdicts[d]}
    lines = materialise(C.line_dedup(spark, good, SF))
    assert lines.columns == docs.columns and texts(lines) == _dedup(kept)
    one = materialise(C.near_duplicates(spark, lines, SF))
    before = texts(lines)
    assert one.columns == docs.columns and texts(one) == {d: before[d] for d in _least(before)}
    mixed = materialise(C.mixing_weights(spark, one, SF))
    after = texts(mixed)
    assert mixed.columns == docs.columns and after.items() <= texts(one).items() and len(after) == mixed.count()
    labels = table(spark, SF, "labels")
    assert after.keys() == {r.doc_id for r in mixing.mix(one, labels, max_rate=1.0).collect() if r.copies}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.byte_bpe(spark, mixed, SF).collect()}
    want = {}
    for d, t in after.items():
        ids = enc.encode_ordinary(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want[d] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == want


def test_stages_on_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Every stage takes what its predecessor kept: rows of one id stay together, a row without one stays."""
    import corpus_pipeline as C

    words = "the of and to in is it that for was with his they at be this from have or by one had not but what all were when we there".split()
    text = lambda k: "\n".join(" ".join(words[(k * 7 + i * j) % len(words)] + f"{k}x{i}x{j}" * (j % 3 == 0) for j in range(9)) for i in range(6))
    rows = [(k, text(k), "en", f"s{k % 3}", len(text(k))) for k in range(30)]
    rows += [rows[3], rows[3], (40, None, None, None, None), (41, "", "en", "s0", 0), (None, text(99), "en", "s0", 5), (42, text(5), "en", "s1", 7), (43, "short", "en", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'c' as id", "1 as n", "'c' as line", "0.5D as rate", "'c' as host", "2L as copies", "'c' as class", "'c' as __x")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 30, 2)] + [(1, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids, at = [], table(spark, str(tmp_path), "documents")
    for name, stage in C.STAGES[:-1]:
        before, at = at.columns, materialise(stage(spark, at, str(tmp_path)))
        assert at.columns == before, name
        ids.append(sorted((r.doc_id is not None, r.doc_id) for r in at.select("doc_id").collect()))
    of = [[d for known, d in x if known] for x in ids]
    assert not {40, 41, 43} & set(of[0]) and of[0].count(3) == 3 and 42 in of[0]
    assert 42 not in of[1] or 42 not in of[2]  # a copy loses its lines or its place
    assert len(ids[2]) > 20 and set(of[3]) <= set(of[2]) and all((False, None) in x for x in ids)
    last = C.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is not None, r.doc_id) for r in last) == ids[3] and all(r.n_tokens > 0 for r in last)

"""Ranked search against plain Python: ties, nulls, repeated rows, small segments and blocks; reads end early."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from termweave.llm import nra

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _plain(docs, items, k=20):
    docs = [(i, Counter(_terms(t))) for i, t in docs if i is not None and _terms(t)]
    n_docs, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    texts = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(texts.get(i, t), t)
    for i, t in texts.items():
        scored = []
        for d, c in docs:
            m = 100 - 25 + (25 * c.total() * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 12 * m)) for x, q in Counter(_terms(t)).items() if c[x])
            if s > 0:
                scored.append((-s, d, c.total()))
        out += [(i, r, d, -s) for r, (s, d, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def _got(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_search_equals_plain_scores(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "ABC", "naïve", "x-y", "10", "日本"]
    zipf = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, zipf, k=rng.randrange(0, 40)))) for k in range(700)]
    docs += [(1000 + k, "w1 w2 same") for k in range(90)] + [(1, "w1 again"), (2000, None), (2001, ""), (2002, "-- !"), (None, "w1 w2"), (1000, "w1 w2 same")]
    docs += [(3000, " ".join(rng.choices(words, k=50_000)))]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for k in range(25)] + [(100, "W1 w1, w1 w2"), (101, None), (102, ""), (103, "absent"), (104, "same"), (None, "w1"), (3, "zz first?"), (105, " ".join(rng.choices(words, k=9000)))]
    rng.shuffle(docs)
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("key", "term", "score", "rank", "item_id", "keys", "n_docs")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("term", "doc_id", "terms", "counts")})
    want = _plain(docs, items)
    for segment, block in ((nra.SEGMENT, nra.TERMS), (40, nra.TERMS), (900, 60)):
        assert _got(nra.rank(a, b, segment=segment, block=block)) == want
    assert _got(nra.rank(a, b, k=3, segment=300)) == _plain(docs, items, 3)
    assert nra.rank(a.limit(0), b).count() == 0 == nra.rank(a, b.limit(0)).count()
    assert nra.rank(a.filter("text is null"), b).count() == 0


def _lists(impacts):
    """impacts: for each list its {document: impact}."""
    rows = [sorted(((-x, d) for d, x in one.items())) for one in impacts]
    docs = np.array([d for one in rows for _, d in one], "<i4")
    values = np.array([-x for one in rows for x, _ in one], "<i8")
    n = 1 + max(docs.tolist(), default=0)
    return nra.Lists(np.arange(len(rows), dtype="<i4").tobytes(), np.array([len(r) for r in rows], "<i4").tobytes(), docs.tobytes(), values.tobytes(), n)


def test_reads_end_once_membership_ties_and_scores_are_settled():
    rng = random.Random(9)
    for _ in range(60):
        impacts = [{d: rng.randrange(0, 9) ** 4 for d in rng.sample(range(3000), rng.choice([1, 50, 2000]))} for _ in range(rng.randrange(1, 6))]
        whole, counts = _lists(impacts), np.array([rng.randrange(1, 4) for _ in impacts])
        total = Counter()
        for one, q in zip(impacts, counts.tolist(), strict=True):
            for d, x in one.items():
                total[d] += q * x
        kth = sorted(total.values(), reverse=True)[:20][-1]
        for threshold in (0, kth):
            docs, scores, n_read = whole.search(np.arange(len(impacts)), counts, 20, threshold)
            found = dict(zip(docs.tolist(), scores.tolist(), strict=True))
            assert all(total[d] == s for d, s in found.items())
            least = max(1, kth)
            assert {d for d, s in total.items() if s >= least} <= set(found) or len(total) < 20
            assert n_read <= sum(map(len, impacts))
    # a hundred high documents on each list, all others far below: the tails stay unread where all lists show the best
    top = {d: 1_000_000 - d for d in range(100)}
    impacts = [top | {d: 1 for d in range(100, 50_000)} for _ in range(3)]
    _, scores, n_read = _lists(impacts).search(np.arange(3), np.ones(3, np.int64), 20, 0)
    assert sorted(scores.tolist())[-1] == 3_000_000 and n_read < 2_000
    # a threshold that this segment can't reach ends it at the first step
    docs, _, n_read = _lists(impacts).search(np.arange(3), np.ones(3, np.int64), 20, 4_000_000)
    assert len(docs) == 0 and n_read == 3 * nra.HEAD


def test_lower_bounds_are_bounds():
    rng = random.Random(2)
    impacts = [{d: rng.randrange(1, 1000) for d in rng.sample(range(5000), 3000)} for _ in range(4)]
    total = Counter()
    for one in impacts:
        total.update(one)
    low = _lists(impacts).heads(np.arange(4), np.ones(4, np.int64), 20)
    assert len(low) == 20 and low.min() <= sorted(total.values(), reverse=True)[19]

"""HyperMinHash near-duplicates: sketches, estimates, components against brute force, hot lists."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from termweave.llm import minhash
from termweave.llm.common import materialise
from termweave.llm.jaccard import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _plain(texts):
    """{id: (n, component)} of {id: text}."""
    sets = {i: _set(t) for i, t in texts.items()}
    of = {i: i for i in sets}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)) and 100 * len(x & y) >= 85 * len(x | y):
                x, y = sorted((top(a), top(b)))
                of[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def _family(rng, base, n, most):
    """Copies of base with up to most changed words, so that some link and some don't."""
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randrange(most + 1)):
            w[at] = f"n{rng.randrange(4)}"
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for length, most in ((10, 1), (14, 2), (40, 3), (150, 8), (600, 25), (3000, 110)):
        base = [f"t{rng.randrange(9 * length)}" for _ in range(length)]
        texts += _family(rng, base, 60, most)
    texts += ["A b C d e f g", "a B c d E f g", "one", "one", "two three", "", " \n\t", *(" ".join(f"z{k}" for k in range(n)) for n in range(4, 40))]
    texts = {k: t for k, t in enumerate(texts)} | {9000: None}
    docs = spark.createDataFrame([*texts.items(), (None, "no id"), (3, texts[3])], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "n", "fp", "sketch", "band", "key", "a", "b", "kept")})
    want = _plain(texts)
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None] == [(0, None, True)]
    assert len({c for _, c in want.values()}) > 60 and max(sum(c == x for _, c in want.values()) for _, x in want.values()) > 20
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_keep_least_hashes_and_estimate_similarity():
    rng = np.random.default_rng(5)
    one = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2))
    sketch = minhash.registers([one, one[:0]])
    assert not sketch[1].any()
    for b in range(minhash.BUCKETS):
        own = [int(x) for x in one if int(x) >> 57 == b]
        if own:
            rest = (min(own) << 7) & (2**64 - 1)
            zeros = min(64 - rest.bit_length(), 46)
            assert sketch[0, b] == zeros << 10 | (rest << (zeros + 1) & (2**64 - 1)) >> 54
    errors = {0.85: [], 0.95: [], 0.3: [], 0.0: []}
    for j in errors:
        for n in (7, 20, 100, 400, 5000):
            sets = []
            for _ in range(60):
                every = rng.permutation(np.unique(rng.integers(0, 1 << 64, n + 5, dtype=np.uint64))[:n])
                shared = int(np.ceil(j * n))
                more = (n - shared) // 2
                sets += [np.sort(every[: shared + more]), np.sort(np.concatenate([every[:shared], every[shared + more :]]))]
                exact = len(np.intersect1d(sets[-1], sets[-2])) / n
                errors[j].append(-exact)
            rows = minhash.registers(sets)
            sizes = np.array([len(s) for s in sets])
            got = minhash.estimates(rows[::2], rows[1::2], sizes[::2], sizes[1::2])
            errors[j][-60:] = (got + np.array(errors[j][-60:])).tolist()
            if j >= 0.85:
                assert got.min() > minhash.ESTIMATE + 0.05
    assert all(abs(np.mean(e)) < 0.02 for e in errors.values()) and np.std(errors[0.85]) < 0.045


def test_chance_of_agreement_is_measured():
    rng = np.random.default_rng(6)
    n = 4000
    rows = minhash.registers([np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(600)])
    agree = float((rows[::2] == rows[1::2]).mean())
    assert abs(agree - minhash._chance(48, 48)) < 2e-4 and agree > 0


def test_bands_lose_no_pair_at_the_threshold():
    rng = np.random.default_rng(7)
    for n in (7, 40, 700):
        sets = []
        for _ in range(1500):
            every = rng.permutation(np.unique(rng.integers(0, 1 << 64, n + 5, dtype=np.uint64))[:n])
            drop = int(np.floor(0.15 * n))
            sets += [np.sort(every), np.sort(every[drop:])]
        rows = minhash.registers(sets).view(np.int64)
        assert (rows[::2] == rows[1::2]).any(axis=1).all()


def test_lists_that_stay_apart_meet_in_blocks(spark):
    """1,300 sets in one list, of which many link only in part: links join what brute force joins, in fewer rows than there are sets a meeting."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    texts = [t for k in range(13) for t in _family(rng, base[k:] + base[:k], 100, 9)]
    sets = list(shingle_sets(texts))
    sketch = minhash.registers(sets)
    band = sketch.view(np.int64)
    band[:, 0] = 77  # one list of all
    rows = [(k, len(s), r.tobytes(), k - k % 2 if k < 20 else k) for k, (s, r) in enumerate(zip(sets, sketch, strict=True))]
    known = materialise(spark.createDataFrame([r[:3] for r in rows], "id long, n long, sketch binary"))
    left = spark.createDataFrame([(0, 77, r[0], r[3]) for r in rows], "band int, key long, id long, component long")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [(r.a, r.b) for r in minhash._remaining(left, known, docs).collect()]

    def classes(links):
        of = {r[0]: r[3] for r in rows}
        while True:
            new = dict(of)
            for a, b in links:
                x = min(new[a], new[b])
                for v in (new[a], new[b]):
                    for k in (k for k, y in new.items() if y == v):
                        new[k] = x
            if new == of:
                return of
            of = new

    whole = [_set(t) for t in texts]
    want = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if 100 * len(whole[a] & whole[b]) >= 85 * len(whole[a] | whole[b])]
    assert set(got) <= set(want) and len(got) == len(set(got)) and len(got) < 6 * 1300 < len(want)
    sizes = [len(set(c.values())) for c in (classes(got), classes(want))]
    assert classes(got) == classes(want) and 20 < sizes[0] < 1250

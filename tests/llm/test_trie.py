"""The prefix trie against plain Python: ties, nulls, repeated rows, shards of a few turns, groups of copies."""

import random
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import numpy as np
from pyspark.sql import functions as F

from termweave.llm import trie


def _plain(convs):
    """The nodes of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, ids in members.items():
        under = [x for x in members if x[: len(node)] == node]
        kids = {x for x in under if len(x) == len(node) + 1}
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids), len(leaves), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def _got(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=repr)


def _table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("path", "said", "base", "h", "key", "depth", "size", "low")})


def test_trie_equals_plain_sets_of_prefixes(spark):
    rng = random.Random(3)
    convs, rows = {}, []
    for c in [*range(-7, 240), 10**12]:
        if c % 11 == 3:
            continue
        n = rng.choice([1, 2, 3, 5, 9, 12, 40 if c % 50 == 0 else 4])
        turns = [("user", "hot")] * rng.choice([0, 1, 2]) + [(rng.choice(["user", "bot"]), rng.choice(["", "é", "a", "long text"])) for _ in range(n)]
        if rng.random() < 0.3:
            turns = [("user", "hot"), ("bot", "copy"), ("user", "of many")]
        convs[c] = turns
        rows += [(c, None if d == 0 else d, None if (r, t) == ("", "") else r, t or None) for d, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    table = _table(spark, [*rows, (None, 0, "user", "nobody")])
    known = trie.paths(table)
    for shard in (1, 7, 60, trie.SHARD):
        assert _got(trie.nodes(known, shard)) == _plain(convs)
        assert _got(trie.nodes(trie.rebuilt(known), shard)) == _plain(_rebuilt(convs))
    assert _got(trie.trie(table)) == _plain(convs)
    assert trie.trie(table.limit(0)).count() == 0 and trie.nodes(trie.rebuilt(trie.paths(table.limit(0)))).count() == 0


def test_equal_turns_go_by_role_and_digest_and_repeated_rows_count(spark):
    order = sorted(["x", "y", "z"], key=lambda t: md5(f"1:a{t}".encode()).hexdigest())
    table = _table(spark, [(1, 0, "b", "q"), (1, 0, "a", "x"), (1, 0, "a", "y"), (1, 0, "a", "z"), (1, 0, "b", "q"), (1, None, "z", "first"), (2, None, None, None)])
    want = {1: [("z", "first"), *(("a", t) for t in order), ("b", "q"), ("b", "q")], 2: [("", "")]}
    assert _got(trie.trie(table)) == _plain(want)
    # no conversation begins with a turn that its role and text don't tell apart
    table = _table(spark, [(1, 0, "ab", "c"), (2, 0, "a", "bc")])
    assert _got(trie.trie(table)) == _plain({1: [("ab", "c")], 2: [("a", "bc")]})


def test_conversations_without_turns_and_bases_that_are_absent(spark):
    rows = [(c, d, "user", f"t{d}") for c in range(5, 40) if c % 5 for d in range(1 + c % 3)]
    convs = defaultdict(list)
    for c, _, r, t in rows:
        convs[c].append((r, t))
    got = _got(trie.nodes(trie.rebuilt(trie.paths(_table(spark, rows))), 3))
    assert got == _plain(_rebuilt(dict(convs))) and any(not t for t in _rebuilt(dict(convs)).values())


def test_one_very_long_conversation_and_very_many_copies(spark):
    long = [("user", f"{d}" * 3) for d in range(20_000)]
    rows = [(0, d, r, t) for d, (r, t) in enumerate(long)] + [(1, d, r, t) for d, (r, t) in enumerate(long[:15_000])] + [(c, d, "user", "same") for c in range(2, 12_000) for d in range(2)]
    got = {(r.conv_id, r.depth): r for r in trie.nodes(trie.paths(_table(spark, rows)), 500).collect()}
    assert len(got) == 1 + 20_000 + 2
    assert (got[0, 0].n_convs, got[0, 0].n_children, got[0, 0].n_leaves) == (12_000, 2, 2)
    assert got[2, 2].ends_sha256 == sha256(",".join(map(str, range(2, 12_000))).encode()).hexdigest() and got[2, 2].n_convs == 11_998
    assert got[0, 15_000].n_convs == 2 and got[0, 15_001].n_convs == 1 and got[0, 15_000].ends_sha256 == sha256(b"1").hexdigest()
    assert got[0, 1].saved_tokens == sum(len(t) for _, t in long[:15_000])


def test_findclose_crosses_blocks():
    rng = random.Random(1)
    for n in (1, 3, 40, 900):
        paths = sorted({tuple(rng.randrange(3) for _ in range(rng.randrange(0, 60))) for _ in range(n)})
        turns = np.array([x for p in paths for x in p], np.uint64).repeat(2).reshape(-1, 2)
        t = trie.Trie(turns, np.array([len(p) for p in paths], np.int64))
        stack, close = [], {}
        for at, e in enumerate(t.excess):
            if at == 0 or e > t.excess[at - 1]:
                stack.append(at)
            else:
                close[stack.pop()] = at
        assert not stack and [close[a] for a in t.opened] == t.close.tolist()
        prefixes = sorted({p[:d] for p in paths for d in range(len(p) + 1)})
        assert t.depth.tolist() == [len(p) for p in prefixes]
        assert t.parent.tolist() == [prefixes.index(p[:-1]) if p else -1 for p in prefixes]

"""The conversation trie against a trie of Python tuples, and the contraction on random trees."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomshift.llm import trie
from loomshift.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, at string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, "x") for r in rows], SCHEMA)


def in_order(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            groups[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(r, t) for _, _, r, _, t in sorted(items)] for c, items in groups.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def nodes_of(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[x] for x in children[p])
    return {(members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in members[p] if len(convs[c]) == len(p)).encode()).hexdigest()) for p in members}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    out = []
    for conv in [*range(95, 330), *range(-120, 40, 7), 4096, 8191, 8192, 2**61]:
        for k in range(rnd.randrange(0, 9)):
            out.append((conv, rnd.choice([k, k, k, None, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["", "Hi.", "Hi.", "é😀", None, "no"])))
    shared = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(75)]
    for n, conv in enumerate(range(500, 512)):
        out += [(conv, k, r, t) for k, (r, t) in enumerate(shared[: 75 - 5 * (n % 4)])]
        out += [(conv, 80 + k, "user", f"own {conv % 3} {k}") for k in range(n)]
    out += [(600 + k, 0, "user", "the same first turn") for k in range(90)] + [(700, k, "user", "x " * 50_000) for k in range(2)]
    out += [(None, 1, "user", "lost"), (3, 1, "user", "dup"), (3, 1, "user", "dup")]
    rnd.shuffle(out)
    return out


def test_trie_of_rebuilt_conversations(spark, rows):
    want = nodes_of(rebuilt(in_order(rows)))
    got = [tuple(r[n] for n in NAMES) for r in trie.of_rebuilt(table(spark, rows)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_trie_of_conversations_cut_into_slices(spark, rows, monkeypatch):
    from loomshift.operators import ordered

    real = ordered.OrderedGroups.__init__
    monkeypatch.setattr(ordered.OrderedGroups, "__init__", lambda self, df, keys, order, max_rows=20: real(self, df, keys, order, max_rows))
    want = nodes_of(in_order(rows))
    got = [tuple(r[n] for n in NAMES) for r in trie.of_conversations(table(spark, rows)).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("shape", ["chain", "star", "caterpillar", "random"])
def test_contraction(spark, shape):
    rnd = random.Random(4)
    n = 150
    up = {0: None}
    for k in range(1, n):
        up[k] = {"chain": k - 1, "star": 0, "caterpillar": k - 1 - (k - 1) % 2, "random": max(0, k - rnd.choice([1, 1, 1, 2, 9]))}[shape]
    depth, kids = {0: 0}, defaultdict(int)
    for k in range(1, n):
        depth[k] = depth[up[k]] + 1
        kids[up[k]] += 1
    value = {k: rnd.randrange(100) for k in up}
    total, leaves = dict(value), {k: int(not kids[k]) for k in up}
    for k in sorted(range(1, n), key=lambda k: -depth[k]):
        total[up[k]] += total[k]
        leaves[up[k]] += leaves[k]
    tree = spark.createDataFrame([(k, depth[k], up[k], depth.get(up[k]), kids[k], int(not kids[k]), value[k]) for k in up],
                                 "conv_id long, depth long, up_conv long, up_depth long, n_children long, n_leaves long, saved_tokens long")
    got = trie.contracted(tree, Scratch(spark, "test")).collect()
    assert len(got) == n and {(r.conv_id, r.n_leaves, r.saved_tokens) for r in got} == {(k, leaves[k], total[k]) for k in up}


def test_odd_tables(spark):
    assert trie.of_rebuilt(table(spark, [])).count() == 0 and trie.of_conversations(table(spark, [(None, 1, "user", "x")])).count() == 0
    # rebuilt conversations without turns still count at the root
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    got = trie.of_rebuilt(table(spark, [(alone, 1, "user", "x")])).collect()
    assert [tuple(r[n] for n in NAMES) for r in got] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]

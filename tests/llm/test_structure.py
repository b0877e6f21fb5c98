"""Structure repair against the cheapest series found by plain dynamic programming, and the pieces of the parallel form."""

import hashlib
import random
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from loomshift.llm import structure

SCHEMA = "conv_id long, turn long, role string, text string, audit int, pos string, chunk int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        signs = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and repaired lines: least (cost, audit) over all series, from the end."""
    bad = faults(rows)
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state):
        if i == len(rows):
            return {"": (0, "", ()), "a": (0, "", ()), "u": (2, "I", ("assistant:",)), "s": (4, "II", ("user:", "assistant:"))}[state]
        role, text = rows[i]
        cut = bad[i] == "truncated"
        found = [(3, "D", (), best(i + 1, state))]
        if bad[i] not in ("blank", "duplicate"):
            t = role[:1]
            if t == nxt[state] or (t == "s" and state == ""):
                found.append((cut, "K", (f"{role}:{text}",), best(i + 1, t)))
            t = nxt[state]
            found.append((2 + cut, "R", (("user:" if t == "u" else "assistant:") + text,), best(i + 1, t)))
            # turns put in front: one, two or three of them
            puts, s = (), state
            for n in range(1, 4):
                s = nxt[s]
                puts += ("user:" if s == "u" else "assistant:",)
                if t := role[:1]:
                    if t == nxt[s]:
                        found.append((2 * n + cut, "I" * n + "K", (*puts, f"{role}:{text}"), best(i + 1, t)))
                t = nxt[s]
                found.append((2 * n + 2 + cut, "I" * n + "R", (*puts, ("user:" if t == "u" else "assistant:") + text), best(i + 1, t)))
        return min((c + rest[0], e + rest[1], lines + rest[2]) for c, e, lines, rest in found)

    return best(0, "")


def by_hand(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, items in groups.items():
        items.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        pairs = [(r, t) for _, r, t in items]
        bad, turns = faults(pairs), [t for t, _, _ in items if t is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, lines = cheapest(tuple(pairs))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[bad.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out, groups


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "ann", "Über"]
    out = []
    for conv in range(60):
        for k in range(rnd.randrange(0, 14)):
            text = rnd.choice(["Fine.", "Open", "", " \n", "Why?", "Go!  ", "é.", None, f"line {k}.", f"line {k}"])
            turn = rnd.choice([k, k, k, k + 3, None, 2])
            out.append((conv, turn, rnd.choice(roles), text))
    out += [(None, k, "user" if k % 2 else "assistant", f"t{k}.") for k in range(7)]
    # long ones, over many chunks: alternating, all of one role that never fits, all repeats, mixed
    out += [(200, k, "user" if k % 2 == 0 else "assistant", f"t{k}.") for k in range(70)]
    out += [(201, k, "system", f"t{k}.") for k in range(61)]
    out += [(202, k, "user", "same.") for k in range(50)]
    out += [(203, k, rnd.choice(roles), rnd.choice([f"t{k}.", f"t{k}", ""])) for k in range(90)]
    out += [(204, None, "tool", f"t{k}") for k in range(40)]
    out += [(205, 0, "user", "x " * 100_000)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("chunk, passes", [(4096, 3), (3, 2), (5, 0), (1, 1)])
def test_audits(spark, rows, chunk, passes):
    want, _ = by_hand(rows)
    lost = table(spark, [(999, 1, "user", "gone.")] + rows[:5])
    got = {r.conv_id: tuple(r[n] for n in structure._Digest.names) for r in structure.audits(table(spark, rows), lost, chunk, passes).collect()}
    assert got.pop(999) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {k: v[:7] for k, v in got.items()} == {k: v[:7] for k, v in want.items()}
    assert got == want


def test_repaired_rows(spark, rows):
    want, groups = by_hand(rows)
    found = defaultdict(list)
    for r in structure.repaired(table(spark, rows), chunk=4).collect():
        found[r.conv_id].append(r)
    for conv, items in found.items():
        items.sort(key=lambda r: r.at)
        assert [r.at for r in items] == list(range(1, len(items) + 1)) and "".join(r.edit for r in items) == want[conv][6]
        kept = [r for r in items if r.edit != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in kept))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == want[conv][7]
    assert set(found) == {k for k, v in groups.items() if v}


def test_odd_tables(spark):
    assert structure.audits(table(spark, [])).count() == 0 and structure.repaired(table(spark, [])).count() == 0
    alone = structure.audits(table(spark, []), table(spark, [(None, None, None, None), (None, 1, "user", "x")])).collect()
    assert [(r.conv_id, r.audit, r.cost) for r in alone] == [(None, "", 0)]


def test_a_rerun_stops_where_vectors_differ_by_a_constant():
    rnd = random.Random(1)
    for _ in range(200):
        codes = np.array([rnd.choice([-1, 0, 1, 2, 3, 4, 5, 6, 7]) for _ in range(30)])
        old, new = np.array([0, 4, 2, 0]), np.array(rnd.choice([[0, 2, 0, 2], [1, 2, 0, 1], [0, 0, 1, 0], [5, 9, 7, 5]]))
        found, looked = structure.rerun(codes, old, structure.closed(new[None, :].copy())[0])
        truth = structure.front(codes, structure.closed(new[None, :].copy())[0])
        assert ((structure.front(codes, old) if found is None else found) == truth).all() and looked <= 30
    settled = np.array([2, 4] * 500)
    assert structure.rerun(settled, np.array([0, 4, 2, 0]), np.array([0, 2, 0, 2]))[1] < 10


def test_matrices_give_the_same_vectors():
    rnd = random.Random(2)
    for _ in range(100):
        codes = np.array([rnd.choice([-1, 0, 2, 3, 4, 5, 6]) for _ in range(rnd.randrange(1, 12))])
        m, end = structure.matrix(codes).reshape(4, 4), np.array(structure.END)
        assert (structure.normal((m + end).min(axis=1)) == structure.front(codes, end)).all()


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b! c?") for c in range(12) for t in [*range(9), None]] + [(None, 3, None, None)]
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, " " if role is None else "user" if fault == 4 else role, " " if text is None else {1: "", 2: "A b c"}.get(fault, text))
        want += [row] * {0: 0, 3: 2}.get(fault, 1)
    got = [tuple(r) for r in structure.damaged(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) != len(rows)

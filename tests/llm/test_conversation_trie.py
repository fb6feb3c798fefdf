"""The prefix trie against a plain one."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from prefscope.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string, key string, base long, head string"


def plain_trie(rows):
    """Every node by its path, from rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    seq = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        seq[c] = tuple(base[:h] + own[c][h:])
    members = {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        below = [out[k] for k in kids.get(path, [])]
        m = members[path]
        ends = ",".join(map(str, sorted(c for c in m if len(seq[c]) == len(path))))
        size = len(path[-1][1].encode()) if path else 0
        out[path] = [min(m), len(path), None, len(m), len(below), sum(b[5] for b in below) or 1,
                     sum(b[6] for b in below) + (len(m) - 1) * size, hashlib.sha256(ends.encode()).hexdigest()]
        for k in kids.get(path, []):
            out[k][2] = min(m)
    return sorted(map(tuple, out.values()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def trie(spark, rows, tasks=None):
    got = C.conversation_trie(table(spark, rows), tasks)
    assert got.columns == C.NODE
    return sorted(map(tuple, got.collect()), key=str)


def conversations(seed, n, hot):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        same = rng.random() < hot
        for t in range(4 if same else rng.randrange(1, 12)):
            rows.append((c, t, "user", f"common {t}" if same or rng.random() < .6 else f"é {rng.randrange(4)}"))
    return rows


@pytest.mark.parametrize("tasks,hot", [(1, .3), (5, .5), (40, .9)])
def test_equals_a_plain_trie_across_tasks(spark, tasks, hot):
    rows = conversations(tasks, 120, hot)
    assert trie(spark, rows, tasks) == plain_trie(rows)


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [(1, None, None, "a"), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "system", "b"), (None, 0, "user", "x"),
            (2, 5, None, None), (0, 0, "user", ""), (0, 1, "", ""), (-3, 0, "u", "x"), (-3, 1, "u", "y"), (13, 0, "u", "z"),
            (14, None, "u", "z"), (14, None, "u", "z")]
    want = plain_trie(rows)
    assert trie(spark, rows, 3) == want
    # Some conversation lost all its turns and ends at the root.
    root = next(r for r in want if r[1] == 0)
    assert root[7] != C.NO_ENDS and root[2] is None


def test_empty(spark):
    assert trie(spark, []) == []


def test_one_long_conversation(spark):
    rows = [(10, t, "u", f"text {t}") for t in range(3000)] + [(11, t, "u", f"text {t}") for t in range(2000)] + [(12, 0, "u", "q")]
    assert trie(spark, rows, 2) == plain_trie(rows)


def test_equal_conversations_over_many_tasks(spark):
    rows = [(c, t, "u", str(t)) for c in range(0, 3000, 5) for t in range(2)]
    got = trie(spark, rows, 9)
    assert len(got) == 3 and got == plain_trie(rows)


def test_extents_by_range_minima():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 5, 70)
    mins = C.RangeMin(values)
    for at in range(70):
        for bound in range(6):
            r = at
            while r + 1 < 70 and values[r + 1] >= bound:
                r += 1
            l = at
            while l > 0 and values[l] >= bound:
                l -= 1
            assert mins.right(np.array([at]), np.array([bound]))[0] == r
            assert mins.left(np.array([at]), np.array([bound]))[0] == l

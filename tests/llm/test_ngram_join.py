"""The n-gram Jaccard join against all pairs."""

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from prefscope.llm import ngram_join as J
from prefscope.llm.components import components
from test_basic_ops import corpus, empty, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def plain_components(rows, percent):
    sets = [plain_set(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
    lowest = defaultdict(lambda: 1 << 60)
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            lowest[find(i)] = min(lowest[find(i)], d)
    return Counter((d, len(s), None if d is None else lowest[find(i)])
                   for i, ((d, _, _), s) in enumerate(zip(rows, sets)))


def near_copies(seed, n=150):
    """Chains of edits, so that some pairs are just above and just below."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if i < 4 or r.random() < .2:
            words = [f"w{r.randint(0, 300)}" for _ in range(r.choice([2, 3, 4, 5, 8, 12, 40, 120, 400]))]
        else:
            words = WORD.findall(r.choice(rows)[1])
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                k = r.randint(0, len(words))
                words[k:k + r.randint(0, 2)] = ["n%d" % r.randint(0, 999)] * r.randint(0, 2)
        text = " ".join(words)
        rows.append((i, text.upper() if r.random() < .1 else text, "s"))
    return rows


@pytest.mark.parametrize("percent,block", [(85, 1_000_000), (85, 300), (60, 1_000_000)])
def test_components_equal_all_pairs(spark, percent, block):
    rows = near_copies(percent + block) + corpus(4, 60)
    rows = [(None if d is None else k, t, s) for k, (d, t, s) in enumerate(rows)]
    rows += [rows[3], (rows[5][0], "an id that comes again with another text " * 3, "s")]
    got = J.ngram_components(table(spark, rows), percent, block).collect()
    assert Counter(map(tuple, got)) == plain_components(rows, percent)


def test_empty_table(spark):
    assert J.ngram_components(empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_tree_links_what_all_pairs_link(seed):
    r = np.random.default_rng(seed)
    base = [np.unique(r.integers(0, 500, int(r.integers(1, 80))).astype(np.uint64)) for _ in range(8)]
    sets = []
    for _ in range(90):
        s = base[r.integers(0, 8)]
        s = np.unique(np.concatenate([s[r.random(len(s)) > .05], r.integers(0, 500, int(r.integers(0, 4))).astype(np.uint64)]))
        sets.append(s if len(s) else base[0])
    for left in (None, 40):
        up = list(range(len(sets)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x
        for i in range(len(sets)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if (left is None or j < left <= i) and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
        want = [find(i) for i in range(len(sets))]
        assert J.link_sets(sets, 85, left) == want
        J.HELD, held = 900, J.HELD  # a few sets at a time
        try:
            assert J.link_sets(sets, 85, left) == want
        finally:
            J.HELD = held


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_linked_sets_share_a_routing_key(percent):
    texts = [t for _, t, _ in near_copies(percent, 250)]
    hashes, begin = J.shingle_sets(pa.array(texts))
    keys, owner, _ = J.slice_keys(hashes, begin, percent)
    by_set = defaultdict(set)
    for k, o in zip(keys.tolist(), owner.tolist()):
        by_set[o].add(k)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:])]
    linked = 0
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                linked += 1
                assert by_set[i] & by_set[j], (len(sets[i]), len(sets[j]))
    assert linked > 20


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, r.randint(1000, 1400)) for _ in range(200)] + [(3, 3), (9, 8), (8, 9)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in up if x != 3)


def test_one_of_each_tells_rows_of_a_repeated_id_apart(spark):
    long = " ".join(f"a{i}" for i in range(60))
    near, other = long + " b0", " ".join(f"c{i}" for i in range(30))
    rows = [(1, long, "s"), (2, near, "s"), (2, other, "s"),  # other is no copy of 1
            (5, other + " z y x w v u", "s"), (6, other + " only in six", "s"), (6, "", "s"), (6, None, "s"),
            (7, " ".join(f"d{i}" for i in range(50)), "s"), (7, " ".join(f"d{i}" for i in range(51)), "s"),
            (7, " ".join(f"D{i}" for i in range(50)), "s"), (8, " ".join(f"d{i}" for i in range(52)), "s"),
            (9, "nine alone", "s"), (9, "nine alone", "s"), (None, long, "s")]
    got = J.one_of_each(table(spark, rows))
    assert got.columns == table(spark, rows).columns
    got = [(r.doc_id, r.text) for r in got.collect()]
    kept = Counter(i for i, _ in got)
    assert (2, other) in got and (2, near) not in got and (1, long) in got
    assert kept == Counter({1: 1, 2: 1, 5: 1, 6: 2, 7: 1, 9: 1, None: 1})
    assert sorted(got, key=str) == sorted(((r.doc_id, r.text) for r in J.one_of_each(
        table(spark, rows[::-1]).repartition(5)).collect()), key=str)


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_bitmaps_differ_in_no_more_bits_than_sets(percent):
    texts = [t for _, t, _ in near_copies(percent, 120)]
    hashes, begin = J.shingle_sets(pa.array(texts))
    sets = [frozenset(hashes[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:])]
    seen = 0
    for column in J.bitmaps(hashes, begin, percent):
        bits = column.to_pylist()
        for i in range(len(sets)):
            for j in range(i):
                if sets[i] and bits[i] is not None and bits[j] is not None and len(bits[i]) == len(bits[j]):
                    differ = (int.from_bytes(bits[i]) ^ int.from_bytes(bits[j])).bit_count()
                    assert differ <= len(sets[i] ^ sets[j])
                    linked = 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
                    may = J.plausible(percent, *map(np.array, (len(sets[i]), len(sets[j]), differ)))
                    assert may or not linked
                    seen += linked
    assert seen


def test_groups_are_connected_by_plausible_pairs(monkeypatch):
    monkeypatch.setattr(J, "PAIR_WORDS", 50)
    rng = np.random.default_rng(2)
    group = np.sort(rng.integers(0, 9, 80))
    size = rng.integers(30, 60, 80)
    bits = [rng.integers(0, 2, 128).astype(bool) for _ in range(80)]
    for i in range(1, 80):  # chains of small steps
        if rng.random() < .7:
            bits[i] = bits[i - 1].copy()
            bits[i][rng.integers(0, 128, 4)] ^= True
    packed = [np.packbits(b).tobytes() for b in bits]
    want = list(range(80))
    for _ in range(80):
        for i in range(80):
            for j in range(i):
                if group[i] == group[j] and J.plausible(80, size[i], size[j], np.int64((bits[i] ^ bits[j]).sum())):
                    want[i] = want[j] = min(want[i], want[j])
    got = J.connect(80, group, size, packed).tolist()
    assert got == want and len(set(want)) < 70


def test_roots():
    assert J.roots(7, np.array([5, 4, 3, 1]), np.array([4, 3, 2, 0])).tolist() == [0, 0, 2, 2, 2, 2, 6]


def test_large_groups_are_connected_unseen(spark, monkeypatch):
    from test_basic_ops import table
    rows = near_copies(4, 100)
    want = plain_components(rows, 80)
    monkeypatch.setattr(J, "GROUP", 2)
    got = J.ngram_components(table(spark, rows), 80).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((i, c) for i, _, c in want), key=str)


def test_many_copies_of_one_batch_go_as_one(spark):
    from test_basic_ops import table
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"z{i}"]), "s") for i in range(300)] + [(900, " ".join(words[:40]), "s")]
    got = {r.doc_id: r.component_id for r in J.ngram_components(table(spark, rows), 85).collect()}
    assert {v for k, v in got.items() if k < 900} == {0} and got[900] == 900


def test_thousands_of_near_copies_in_one_task():
    import time
    rng = np.random.default_rng(4)
    base = np.arange(20, dtype=np.int64)
    sets = [np.sort(np.concatenate([base, 1000 + rng.choice(10**6, 2, replace=False)])) for _ in range(8000)]
    at = time.time()
    assert set(J.link_sets(sets, 80)) == {0}
    assert time.time() - at < 20


def common_line(n, line=60):
    """Unrelated documents of one size that share a line."""
    r = random.Random(8)
    shared = [f"c{i}" for i in range(line)]
    return [(i, " ".join([*shared, *(f"w{r.randint(0, 10**9)}" for _ in range(240))]), "s") for i in range(n)]


def test_documents_that_share_a_line_are_no_cluster(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP", 12)
    rows = common_line(150)
    rows += [(200 + i, rows[i][1] + " end", "s") for i in range(0, 150, 30)]
    docs = table(spark, rows).repartition(4).select("doc_id", "text")
    sets = docs.mapInArrow(J._set_rows(80, 5), "doc_id long, n long, set_a long, set_b long, own_bits binary, lower_bits binary")
    clusters = Counter(r.cluster for r in J._clusters(docs, sets, 80, 5).collect())
    assert sorted(clusters.values()) == [2] * 5  # the near copies alone
    got = J.ngram_components(table(spark, rows), 80, k=5).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - 200 if i >= 200 else i for i, _, _ in rows}


@pytest.mark.parametrize("many,group", [(1, 1000), (1, 2), (3, 5)])
def test_shared_keys_that_are_left_out_lose_no_link(spark, monkeypatch, many, group):
    rows = near_copies(17, 130) + [(200 + i, t, s) for i, t, s in common_line(40)]
    r = random.Random(3)
    for i in range(40):
        words = rows[130 + i][1].split(" ")
        for _ in range(r.randint(1, 20)):
            words[r.randint(0, len(words) - 1)] = f"x{r.randint(0, 9999)}"
        rows.append((300 + i, " ".join(words), "s"))
    monkeypatch.setattr(J, "MANY", many)
    monkeypatch.setattr(J, "GROUP", group)
    got = J.ngram_components(table(spark, rows), 80).collect()
    assert Counter(map(tuple, got)) == plain_components(rows, 80)


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_linked_sets_keep_a_key_when_each_leaves_out_the_most_shared(percent):
    texts = [t for _, t, _ in near_copies(percent, 250)]
    hashes, begin = J.shingle_sets(pa.array(texts))
    keys, owner, lower, spare = map(np.ndarray.tolist, J.routes(hashes, begin, percent))
    often = Counter(keys)
    by_set, left_out = defaultdict(list), 0
    for k, o, low, x in zip(keys, owner, lower, spare):
        by_set[o, low, x].append(k)
    kept = defaultdict(set)
    for (o, _, x), own in by_set.items():
        own.sort(key=lambda k: (-often[k], k))
        kept[o] |= set(own[max(0, x - 1):])
        left_out += max(0, x - 1)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:])]
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                assert kept[i] & kept[j], (len(sets[i]), len(sets[j]))
    assert left_out > 100


def test_one_set_stands_only_for_sets_that_cannot_leave_the_key_out():
    key = np.concatenate([np.full(100, 7), np.full(100, 9), np.arange(100, 200)]).astype(np.uint64)
    number = np.tile(np.arange(100), 3)
    spare = np.where(number < 80, 2, 3)  # 80 sets have one key to leave out, 20 have two
    rows = J._sent(key, 1000 + number, 2 * number, spare).to_pylist()
    pairs = {(r["key"], r["a"]) for r in rows if r["how"] & J.PAIR}
    assert pairs == {(1000 + i, 1000) for i in range(1, 80)}
    plain = [r for r in rows if not r["how"] & J.PAIR]
    for k in (7, 9):
        assert {r["a"] for r in plain if r["key"] == k} == {1000, *range(1080, 1100)}
        assert [r["a"] for r in plain if r["key"] == k and r["how"] & J.STANDS] == [1000]
    assert all(bool(r["how"] & J.STAYS) == (r["a"] < 1080) and r["how"] >> J.SPARE_BITS == (2 if r["a"] < 1080 else 3)
               and not r["how"] & J.LOWER for r in plain)
    assert len(plain) == 2 * 21 + 100

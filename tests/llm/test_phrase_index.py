"""Collocations against plain counting, and the index against the text."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from prefscope.llm import phrase_index as P

SCHEMA = "doc_id long, text string, lang string, phrase string, k int, n long"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, longest, least, best):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        f = {p: a for p, a in f.items() if a >= least}
        rows = []
        for p, a in f.items():
            if len(p) == 1 or any(len(q) > len(p) and f[q] >= a and any(q[i:i + len(p)] == p for i in range(len(q)))
                                  for q in f):
                continue
            score, cut = min((1000 * a * total[lang] // (f[p[:c]] * f[p[c:]]), c) for c in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def found(spark, rows, *cuts):
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)
    got = P.collocations(docs, *cuts)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def texts(seed, n=150):
    rng, out = random.Random(seed), []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 60)):
            w.append(rng.choice(["new york city", "New York", "the", "of", "é a b c d", "a b", "b c,", "x. y", "\n", "z\tq"]))
        out.append((i, " ".join(w), rng.choice(["en", "en", "fr", None, "und", ""])))
    return out


@pytest.mark.parametrize("cuts", [(5, 8, 2000), (3, 3, 7), (2, 5, 4)])
def test_equals_plain_counting(spark, cuts):
    rows = texts(cuts[0])
    want = plain(rows, *cuts)
    assert found(spark, rows, *cuts) == want and len(want) > 3


def test_shards_of_a_few_texts(spark, monkeypatch):
    # Workers are forked from this process only when they start, so the shards are cut here.
    import pyarrow as pa
    monkeypatch.setattr(P, "SHARD_BYTES", 200)
    rows = texts(9)
    t = pa.table({"text": pa.array([r[1] for r in rows]), "lang": pa.array([r[2] or "und" for r in rows]),
                  "bucket": pa.array([0] * len(rows), pa.int32())})
    words = P._word_rows(t)
    keep = words.filter(pa.compute.greater_equal(words["n"], 8)).append_column("kind", pa.array([1] * sum(words["n"].to_numpy() >= 8)))
    assert len(list(P._shards(t))) > 20
    pairs = P._pair_rows(t, keep)
    assert sum(pairs["n"].to_pylist()) > 0 and len(set(pairs["h"].to_pylist())) == pairs.num_rows


def test_repeated_and_overlapping_words(spark):
    rows = [(1, "go " * 50, "en"), (1, "go " * 50, "en"), (2, "go go go. go", None)]
    assert found(spark, rows, 5, 3, 10) == plain(rows, 5, 3, 10)


def test_null_empty_and_very_long_texts(spark):
    long = "alpha beta gamma " * 60_000
    rows = [(1, None, "en"), (2, "", "en"), (3, long, "en"), (None, "x" * 300_000, None), (4, ".,;", "fr")]
    assert found(spark, rows, 5, 100, 20) == plain(rows, 5, 100, 20)
    assert found(spark, [], 5, 1, 20) == []
    assert found(spark, rows[:2], 5, 1, 20) == []


def test_scores_beyond_64_bits(spark):
    big = [("xx", 1, "a", 3 * 10**12), ("xx", 1, "b", 2 * 10**12), ("xx", 2, "a b", 10**12), ("xx", 0, "", 9 * 10**13)]
    counts = spark.createDataFrame([(a, b, c, d) for a, b, c, d in big], "lang string, k int, phrase string, n long")
    import unittest.mock as m
    with m.patch.object(P, "phrase_counts", lambda *a: counts):
        got = P.collocations(counts).collect()
    assert [(r.phrase, r.score) for r in got] == [("a b", 1000 * 10**12 * 9 * 10**13 // (6 * 10**24))]


def test_intervals_count_every_phrase():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 6, 400)
    ids[[0, -1]] = 0
    index = P.Phrases(ids, 5)
    grown = index.start()
    for k in range(2, 6):
        grown = index.extend(grown, k % 2 == 0, lambda a, b: np.ones(len(a), bool))
        want = Counter(tuple(ids[i:i + k].tolist()) for i in range(400 - k + 1) if (ids[i:i + k] > 0).all())
        assert {tuple(w): c for w, c in zip(grown[0].tolist(), grown[-1].tolist())} == want


def test_rare_phrases_of_frequent_pairs_are_not_sent():
    # All 400 pairs of 20 words are frequent; of the 8,000 triples and 160,000 phrases
    # of 4 words only those of the planted phrase are.
    import pyarrow as pa
    rng, least, buckets = random.Random(4), 100, 4
    known, tables = [], []
    for b in range(buckets):
        texts = [" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(30)) for _ in range(700)] + ["a q c p e"] * 60
        tables.append(pa.table({"text": pa.array(texts), "lang": pa.array(["en"] * len(texts)),
                                "bucket": pa.array([b] * len(texts), pa.int32())}))
    pairs = set()
    for t in tables:
        for s in P._shards(t):
            pairs |= set(P._pair(s.hash[:-1], s.hash[1:])[~s.first[1:]].tolist())
    pairs = P.T.signed(np.array(sorted(pairs), np.uint64))
    found = pa.table({"bucket": np.zeros(len(pairs), np.int32), "h": pairs, "kind": np.full(len(pairs), 2, np.int32),
                      "cells": pa.array([b""] * len(pairs), pa.binary())})
    sent = pa.concat_tables([P._cell_rows(5, 20, 3)(t, found) for t in tables])
    heavy = pa.concat_tables([P._heavy_rows(least)(sent.filter(pa.compute.equal(sent["block"], b))) for b in range(3)])
    got = Counter()
    for b, t in enumerate(tables):
        mine = heavy.filter(pa.compute.equal(heavy["bucket"], b))
        mine = pa.table({"bucket": mine["bucket"], "h": np.zeros(mine.num_rows, np.int64),
                         "kind": np.full(mine.num_rows, 3, np.int32), "cells": mine["cells"]})
        rows = P._longer_rows(5, 20)(t, pa.concat_tables([found, mine]))
        assert 6 <= rows.num_rows < 100
        got.update(dict(zip(rows["h"].to_pylist(), rows["n"].to_pylist())))
    want = Counter()
    for t in tables:
        for text in t["text"].to_pylist():
            w = text.split()
            want.update(" ".join(w[i:i + k]) for k in (3, 4, 5) for i in range(len(w) - k + 1))
    assert sorted(n for n in got.values() if n >= least) == sorted(n for n in want.values() if n >= least)
    assert sum(n >= least for n in got.values()) == 6


def test_a_language_is_in_few_buckets(spark):
    docs = spark.createDataFrame([(i, "x" * 50, "abcd"[i % 4]) for i in range(4000)], "doc_id long, text string, lang string")
    texts, size = P.by_language(docs, 8)
    held = defaultdict(Counter)
    for r in texts.groupBy("lang", "bucket").count().collect():
        held[r["bucket"]][r["lang"]] = r["count"]
    assert size == 4000 * 51 and sorted(held) == list(range(8))
    assert all(len(c) == 1 and 400 < sum(c.values()) < 600 for c in held.values())
    empty, size = P.by_language(docs.limit(0), 8)
    assert size == 0 and empty.collect() == []

"""The class-based language model against plain Python."""

import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from prefscope.llm import brown_lm as B
from prefscope.llm import textnum as T
from test_basic_ops import corpus, empty, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
END = None


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + [END]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def test_scores_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(B, "CLUSTERED", 60)
    monkeypatch.setattr(B, "SHARED", 300)
    monkeypatch.setattr(B, "BLOCK_WORDS", 8)
    rows = corpus(11, 200) + [(700 + i, f"Rare{i} WORDS, tail{i}" + " and rare99" * (i % 3), "s") for i in range(60)]
    docs = table(spark, rows)
    model, known, _ = B.fit(docs)
    words = known.value
    count = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    N, V, D = sum(count.values()), len(count), count[END]
    assert (model.tokens, model.distinct, model.texts) == (N, V, D)
    assert 5 < (words.rank >= 0).sum() < len(words.keys) < V

    seen = sorted({w for _, t, _ in rows for w in tokens(t)[:-1]})
    t = T.Texts(pa.array(seen))
    at, shape = words.find(t.hashes()), B.shapes(t)
    klass = {w: int(model.klass[words.rank[a]]) if a >= 0 and words.rank[a] >= 0 else B.CLASSES + int(s)
             for w, a, s in zip(seen, at, shape)} | {END: B.END}
    assert all((a >= 0) == (count[w] * 300 > N) for w, a in zip(seen, at))
    pairs, mass, kinds = Counter(), defaultdict(float), defaultdict(int)
    for i, text, _ in rows:
        if not held(i):
            ts = [klass[w] for w in tokens(text)]
            pairs.update(zip([B.END, *ts], ts))
    for w, n in count.items():
        if w is not END:
            mass[klass[w]] += n
            kinds[klass[w]] += 1
    out = Counter()
    for (a, _), n in pairs.items():
        out[a] += n

    def probability(w, before):
        c = klass[w]
        step = (pairs[before, c] + .5) / (out[before] + .5 * B.ALL)
        emit = 1.0 if w is END else (count[w] + .1) / (mass[c] + .1 * (kinds[c] + 1))
        return .8 * step * emit + .2 * (count[w] + .1) / (N + .1 * (V + 1))

    want = defaultdict(list)
    for i, text, _ in rows:
        ts = tokens(text)
        base = sum(math.log10((count[w] + .1) / (N + .1 * (V + 1))) for w in ts)
        score = sum(math.log10(probability(w, klass[b])) for b, w in zip([END, *ts], ts))
        want[i].append((held(i), len(ts), sum(count[w] > 0 for w in ts), N, base, score))
    got = defaultdict(list)
    for r in B.score_documents(docs).collect():
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert set(got) == set(want)
    for i in want:
        assert np.allclose(np.array(sorted(got[i]), float), np.array(sorted(want[i]), float), rtol=1e-9), i

    # After any class, all words and one unknown word of each class take no more than everything.
    for before in range(B.ALL):
        total = sum(probability(w, before) for w in count)
        assert total <= 1 + 1e-9


def test_exchange_raises_the_likelihood():
    """Words that alternate between two groups are told apart."""
    r = random.Random(4)
    groups = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    stream = [r.choice(groups[i % 2]) for i in range(20_000)]
    names = groups[0] + groups[1]
    r.shuffle(names)
    rank = {w: i for i, w in enumerate(names)}
    klass = np.arange(len(names)) % 2

    def counts(k):
        left, right = np.zeros((len(names), B.ALL), np.int64), np.zeros((len(names), B.ALL), np.int64)
        n = np.zeros((B.ALL, B.ALL), np.int64)
        for x, y in zip(stream, stream[1:]):
            right[rank[x], k[rank[y]]] += 1
            left[rank[y], k[rank[x]]] += 1
            n[k[rank[x]], k[rank[y]]] += 1
        return left, right, n

    def likelihood(n):
        return B.xlogx(n.astype(float)).sum() - B.xlogx(n.sum(1).astype(float)).sum() - B.xlogx(n.sum(0).astype(float)).sum()

    start = likelihood(counts(klass)[2])
    for _ in range(4):
        klass = B.exchange(*counts(klass)[:2], klass, counts(klass)[2])
    assert likelihood(counts(klass)[2]) > start
    assert not {klass[rank[w]] for w in groups[0]} & {klass[rank[w]] for w in groups[1]}


def test_the_model_beats_the_unigram_on_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(B, "CLUSTERED", 2000)
    r = random.Random(9)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "nva"]
    rows = [(i, " ".join(r.choice(kinds[(p + i) % 3]) for p in range(60)), "s") for i in range(300)]
    got = [x for x in B.score_documents(table(spark, rows)).collect() if x.held_out]
    assert len(got) > 10 and sum(x.score for x in got) > 0.85 * sum(x.base_score for x in got)
    parts = B.score_documents(table(spark, rows).repartition(7)).collect()
    assert sorted((x.doc_id, round(x.score, 9)) for x in parts if x.held_out) == sorted(
        (x.doc_id, round(x.score, 9)) for x in got)


def test_nothing_to_learn_from(spark):
    assert B.score_documents(empty(spark)).collect() == []
    ids = [i for i in range(200) if held(i)][:2]
    got = B.score_documents(table(spark, [(ids[0], "some words", "s"), (ids[1], None, "s")])).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(ids[0], 3, 0, 0), (ids[1], 1, 0, 0)}
    assert all(r.base_score == pytest.approx(0) and r.score <= 0 for r in got)

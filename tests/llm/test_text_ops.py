"""Language ID and substring dedup."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from prefscope.llm import langid, substring_dedup, textnum
from test_basic_ops import SCHEMA, corpus, empty, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_texts_finds_words_in_any_slice():
    texts = [t for _, t, _ in corpus()] + ["", None, " a", "b ", "ä\x0bö\x1cü"]
    for array in (pa.array(texts), pa.array(["pad", None, *texts])[2:]):
        t = textnum.Texts(array)
        raw = t.data.tobytes()
        got = [raw[a:b].decode() for a, b in zip(t.start, t.end)]
        want = [WORD.findall(x or "") for x in texts]
        assert got == sum(want, []) and t.n_words().tolist() == [len(w) for w in want]
        ids = {w: i for i, w in enumerate(dict.fromkeys(got))}
        hashes = t.hashes()
        assert len(set(hashes.tolist())) == len(ids)
        assert all(h == hashes[got.index(w)] for w, h in zip(got, hashes))


def test_cover_aligns_any_two_positions():
    on = set(substring_dedup.COVER)
    v = substring_dedup.PERIOD
    for i in range(v):
        for j in range(v):
            assert any((i + d) % v in on and (j + d) % v in on for d in range(v))


def plain_removal(rows, k):
    words = [WORD.findall(t or "") for _, t, _ in rows]
    often = Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1))
    out = Counter()
    for (i, _, _), w in zip(rows, words):
        hit = {p for a in range(len(w) - k + 1) if often[tuple(w[a:a + k])] > 1 for p in range(a, a + k)}
        out[i, len(w), len(hit), " ".join(x for p, x in enumerate(w) if p not in hit)] += 1
    return out


@pytest.mark.parametrize("window", [21, 35])
def test_substring_dedup(spark, window):
    r = random.Random(window)
    rows = corpus(8, 90)
    passage = [f"p{i}" for i in range(60)]
    for i in range(12, 80):  # passages of every length about the window's, at any offset
        n = window - 3 + i % 7
        a = r.randint(0, 60 - n)
        rows[i] = (i, " ".join([f"u{i}-{k}" for k in range(r.randint(0, 30))] + passage[a:a + n] +
                               [f"v{i}-{k}" for k in range(r.randint(0, 30))]), "s")
    rows.append((200, " ".join(["again"] * 50), "s"))
    rows.append((201, "\n ".join([f"q{k}" for k in range(40)] * 2), "s"))
    got = substring_dedup.remove_repeats(table(spark, rows), window).collect()
    assert Counter(map(tuple, got)) == plain_removal(rows, window)
    assert substring_dedup.remove_repeats(empty(spark)).collect() == []


def sentences(r, lang, n):
    letters = {"aa": "abcde", "bb": "vwxyz", "cc": "äöüßé"}[lang]
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(n))


def test_language_id(spark):
    r = random.Random(2)
    rows = [(i, sentences(r, lang, r.choice([3, 20, 200])), lang, "s", 0, 7, "k", "b")
            for i in range(400) for lang in [("aa", "bb", "cc")[i % 3]]]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "aa"), (903, sentences(r, "bb", 5000), None),
           (None, sentences(r, "cc", 30), "cc")]
    rows += [(i, t, lang, None, None, None, None, None) for i, t, lang in odd]
    docs = spark.createDataFrame(rows, SCHEMA)
    net = langid.fit(docs)
    assert net.languages == ["aa", "bb", "cc"]
    got = langid.identify(docs, net).collect()
    assert len(got) == len(rows)
    by_id = {x.doc_id: x for x in got}
    assert [by_id[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "bb", "cc"]
    held = [x for x in got if x.doc_id is not None and x.doc_id < 400 and x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert sum(by_id[x.doc_id].lang_pred == ("aa", "bb", "cc")[x.doc_id % 3] for x in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 for x in got)
    kept = langid.accepted(docs, 0.0, net)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in got if x.lang_pred != "und"}
    relabelled = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'other' AS source", "doc_id + 5 AS n_chars")
    assert Counter((x.doc_id, x.lang_pred, x.score) for x in langid.identify(relabelled, net).collect()) == Counter(
        (x.doc_id, x.lang_pred, x.score) for x in got)


def test_language_id_without_labels(spark):
    docs = table(spark, [(1, "some text", "s"), (2, None, "s")]).selectExpr("doc_id", "text", "CAST(NULL AS string) lang")
    assert [(x.lang_pred, x.score) for x in langid.identify(docs).collect()] == [("und", 0.0)] * 2
    assert langid.identify(empty(spark)).collect() == []


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 700 + 1), "aa" if i % 4 else "bb") for i in range(3000)],
                                 "doc_id long, text string, lang string")
    rows = langid.labelled_windows(docs, texts=50, windows=3).collect()
    count = Counter(x.lang for x in rows)
    assert 50 <= count["aa"] <= 150 and 50 <= count["bb"] <= 150
    assert max(len({x.doc_id for x in rows if x.lang == lang}) for lang in count) <= 50


def test_pair_tables_equal_the_convolution():
    net = langid.Network(["aa", "bb"])
    net.tables()
    x = np.random.default_rng(1).integers(0, 256, (5, langid.WINDOW_BYTES)).astype(np.uint8)
    want = []
    for c in net.conv:
        n = x.shape[1] - len(c) + 1
        want.append(sum(c[k][x[:, k:k + n]] for k in range(len(c))).max(axis=1))
    assert np.allclose(net.pooled(x), np.maximum(np.concatenate(want, axis=1), 0), atol=1e-5)

"""The pipeline, stage by stage, against plain Python on its own input."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from prefscope.llm import langid, ngram_join, piece_codec
from test_basic_ops import SCHEMA, WORD, empty, plain_mix
from test_ngram_join import near_copies, plain_components

pytestmark = pytest.mark.skipif(not os.path.exists(piece_codec.MODEL), reason="the vocabulary file isn't there")


def documents(spark):
    rows = [(i, t + " " + "und der die" * (i % 2), ("en", "de")[i % 2], f"s{i % 3}") for i, t, _ in near_copies(21, 140)]
    rows += [(500 + i, rows[i][1], rows[i][2], "s9") for i in range(0, 60, 2)]
    rows += [(700, None, "en", "s1"), (701, "", "en", "s1"), (702, "12 ! 34", "en", "s2"), (703, "kein label da", None, None)]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "k", "b") for i, t, lang, s in rows], SCHEMA).select(
        "doc_id", "text", "lang", "source", "n_chars")


def staying(rows):
    """The ids that stay among (id, text): the smallest of each group that
    links of 80 % of the shingles of five words connect."""
    rows = sorted(rows)
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
            for w in ((t or "").lower().split() for _, t in rows)]
    lowest = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = lowest[i], lowest[j]
                lowest = [min(a, b) if x in (a, b) else x for x in lowest]
    return {rows[i][0] for i in range(len(rows)) if lowest[i] == i}


def test_stages(spark):
    docs = documents(spark).cache()
    start = [tuple(r) for r in docs.collect()]
    known = corpus_pipeline.language_id(spark, docs, "")
    assert known.columns == docs.columns
    got = [tuple(r) for r in known.collect()]
    verdict = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert sorted(got, key=str) == sorted((r for r in start if verdict[r[0]].lang_pred != "und" and verdict[r[0]].score >= .4), key=str)
    assert {700, 701, 702} & {r[0] for r in got} == set()

    unique = corpus_pipeline.exact_duplicates(spark, known, "").cache()
    largest = {}
    for r in got:
        largest[r[1]] = max(largest.get(r[1], -1), r[0])
    got2 = [tuple(r) for r in unique.collect()]
    assert sorted(got2, key=str) == sorted((r for r in got if largest[r[1]] == r[0]), key=str) and len(got2) < len(got)

    far = corpus_pipeline.near_duplicates(spark, unique, "").cache()
    stay = staying([(r[0], r[1]) for r in got2])
    got3 = [tuple(r) for r in far.collect()]
    assert sorted(got3, key=str) == sorted((r for r in got2 if r[0] in stay), key=str) and len(got3) < len(got2)

    mixed = corpus_pipeline.mix_sources(spark, far, "").cache()
    _, taken = plain_mix([(r[0], r[1], r[3]) for r in got3])
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert +words == +taken and mixed.columns == docs.columns

    pieces = corpus_pipeline.encode_pieces(spark, mixed, "").collect()
    assert Counter(r.doc_id for r in pieces) == Counter(r.doc_id for r in mixed.collect())
    import sentencepiece as sp
    library = sp.SentencePieceProcessor(model_file=piece_codec.MODEL)
    text = {r[0]: r[1] for r in got3}
    assert all(r.piece_ids == library.encode(text[r.doc_id]) and r.round_trip for r in pieces)


def test_run_is_its_stages(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, whole)) == sorted(map(key, docs.collect())) and whole


def test_empty_documents(spark):
    docs = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []


def test_one_of_each_keeps_rows_without_words_or_id(spark):
    rows = [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "", "s"), (4, None, "s"), (None, "a b c d e f", "s")]
    from test_basic_ops import table
    got = ngram_join.one_of_each(table(spark, rows))
    assert sorted((str(r.doc_id) for r in got.collect())) == ["1", "3", "4", "None"]
    assert got.columns == table(spark, rows).columns


def test_near_duplicates_share_80_percent_of_five_words(spark):
    from test_basic_ops import table
    rows = near_copies(33, 140) + [(900, " ".join(f"v{i}" for i in range(96)), "s")]
    # 82 of 102 shingles of five words in common; of four words, 85 of 101.
    rows += [(901, " ".join(f"v{i}" if i not in (20, 60) else f"u{i}" for i in range(96)), "s")]
    stay = staying([(i, t) for i, t, _ in rows])
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()}
    assert got == stay and 900 in got and 901 not in got
    assert stay != {i for i, _, c in plain_components(rows, 85) if i == c}

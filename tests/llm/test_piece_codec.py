"""SentencePiece encoding against the library, decoding by round trips."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from prefscope.llm import piece_codec as C
from test_basic_ops import corpus, empty, table

pytestmark = pytest.mark.skipif(not os.path.exists(C.MODEL), reason="the vocabulary file isn't there")
ODD = ["", None, "a", "  two  spaces ", "\n\n x\ty", "日本語 텍스트 🙂🙂 end", "x" * 300, " ", "é" * 50, "a\u0000b",
       " " * 40 + "x", " " * 17, "a" + " " * 33 + "\n", "   \n", "the  é  cat", "<s> </s> <0x41>"]


def texts(seed, n=400):
    r = random.Random(seed)
    return ODD + ["".join(r.choice(" ethanoigsr.éß\n0") for _ in range(r.randint(0, 60))) for _ in range(n)]


def lists(ids, begin):
    return [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]


def test_ids_equal_the_library():
    import sentencepiece as sp
    library = sp.SentencePieceProcessor(model_file=C.MODEL)
    rows = texts(1) + [t for _, t, _ in corpus()]
    ids, begin = C.encode(pa.array(rows), C.vocabulary(C.read_model()))
    assert lists(ids, begin) == library.encode([t or "" for t in rows])
    assert C.decode(ids, begin, C.vocabulary(C.read_model())).to_pylist() == [t or "" for t in rows]


def unspaced(seed):
    r = random.Random(seed)
    words = "the of and ation tion ing er qu http www com".split()
    return ["".join(r.choice("ethanoigsr") for _ in range(30_000)),
            "".join(r.choice(words) for _ in range(8_000)),
            "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(20_000)),
            "".join(r.choice("日本語中文字的是不了人我在有他这") for _ in range(20_000)),
            "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(30_000)),
            "\U00013000\U00013001" * 10_000, "\ue000" * 20_000,
            *["".join(r.choice("abéß日🙂") for _ in range(n)) for n in range(100, 700, 7)],
            *["".join(r.choice(["=", "-", "==", "a"]) for _ in range(n)) for n in range(120, 400, 9)],
            *[c * n for c in "x-=0日" for n in (127, 128, 129, 300, 1001)], *["ab" * n for n in (64, 65, 500)]]


def test_long_units_without_spaces_equal_the_library(monkeypatch):
    import sentencepiece as sp
    library = sp.SentencePieceProcessor(model_file=C.MODEL)
    rows = unspaced(4)
    for chunk, step in ((C.CHUNK, C.STEP), (4, 3), (3, 1)):
        monkeypatch.setattr(C, "CHUNK", chunk)
        monkeypatch.setattr(C, "STEP", step)
        v = C.Vocabulary(C.read_model())
        ids, begin = C.encode(pa.array(rows), v)
        assert lists(ids, begin) == library.encode(rows)
        assert C.decode(ids, begin, v).to_pylist() == rows


def test_a_long_unit_takes_few_steps():
    """100,000 characters without a space are as many steps as a chunk has."""
    r = random.Random(6)
    v = C.Vocabulary(C.read_model())
    begun = time.monotonic()
    C.encode(pa.array(["".join(r.choice("ethanoigsrlduc") for _ in range(100_000))]), v)
    assert time.monotonic() - begun < 10


def test_unigram_model_equals_all_segmentations():
    """The same pieces as a unigram model, against plain dynamic programming."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    proto.ParseFromString(C.read_model())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    r, score = random.Random(5), {}
    for p in proto.pieces:
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = -r.uniform(1, 12)
            score[p.piece] = p.score
    v = C.vocabulary(proto.SerializeToString())
    assert not v.merges
    number = {p.piece: i for i, p in enumerate(proto.pieces)}
    for text in texts(2, 30):
        marked = "▁" + (text or "").replace(" ", "▁")
        best = [(0.0, [])] + [None] * len(marked)
        for end in range(1, len(marked) + 1):
            for begin in range(max(0, end - v.longest), end):
                part = marked[begin:end]
                if part in score:
                    step, ids = score[part], [number[part]]
                elif len(part) == 1:
                    step, ids = v.unknown, [int(v.byte_ids[b]) for b in part.encode()]
                else:
                    continue
                total = best[begin][0] + step
                if best[end] is None or total > best[end][0]:
                    best[end] = (total, best[begin][1] + ids)
        ids, begin = C.encode(pa.array([text], pa.string()), v)
        assert ids.tolist() == (best[-1][1] if text else [])


def test_remembering_does_not_change_ids(monkeypatch):
    rows = pa.array(texts(3))
    v = C.vocabulary(C.read_model())
    first = C.encode(rows, v)
    again = C.encode(rows, v)
    monkeypatch.setattr(C, "UNITS", 0)
    fresh = C.encode(rows, C.Vocabulary(C.read_model()))
    for a in (again, fresh):
        assert (a[0] == first[0]).all() and (a[1] == first[1]).all()


def test_documents_round_trip(spark):
    rows = corpus() + [(500 + i, t, "s") for i, t in enumerate(ODD)] + [(900, "its own ▁ mark", "s")]
    docs = table(spark, rows)
    encoded = C.encode_documents(docs)
    got = encoded.collect()
    assert len(got) == len(rows)
    assert all(r.n_pieces == len(r.piece_ids) for r in got)
    assert all(r.round_trip == (r.doc_id != 900) for r in got)
    back = C.decode_documents(encoded).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(map(tuple, back), key=key) == sorted(
        ((i, (t or "").replace("▁", " ")) for i, t, _ in rows), key=key)
    assert C.encode_documents(empty(spark)).collect() == []


def test_decoding_any_ids(spark):
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1, 2]), (4, [3 + 0xFF, 3 + 0x41])], "doc_id long, piece_ids array<int>")
    assert {r.doc_id: r.text for r in C.decode_documents(odd).collect()} == {1: None, 2: "", 3: "", 4: "�A"}


def test_code_points():
    text = "aé日🙂\u0000z"
    points, lead = C.code_points(np.frombuffer(text.encode(), np.uint8))
    assert points.tolist() == [ord(c) for c in text] and len(lead) == len(text)

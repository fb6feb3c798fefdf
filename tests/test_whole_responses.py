"""Queries over small tables of their own, against what the reference computes."""

import os

from prefscope.plans import queries as Q

from conftest import SF0001


def small_tables(spark, tmp_path, **own):
    """The tables of sf0.001, with ``own`` rows in place of some."""
    for f in os.listdir(SF0001):
        name = f.removesuffix(".parquet")
        if name in own:
            schema = spark.read.parquet(f"{SF0001}/{f}").schema
            rows = [tuple(r.get(c) for c in schema.names) for r in own[name]]
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{f}")
        else:
            os.symlink(f"{SF0001}/{f}", f"{tmp_path}/{f}")
    return str(tmp_path)


def test_instruction_overlap_compares_whole_responses(spark, tmp_path):
    answers = [("Same text", "Same text", "Same text"), ("Alpha one", "Alpha two", "Alpha one"), ("A", "B", "C"),
               ("", "", "x"), ("x" * 9000 + "a", "x" * 9000 + "b", "x" * 9000 + "b")]
    d = small_tables(spark, tmp_path, documents=[
        {"doc_id": 25 * m + p, "text": t} for p, three in enumerate(answers) for m, t in enumerate(three)])
    got = {(r.model_a, r.model_b): (r.n_a, r.n_b, r.n_equal, r.identical_pct)
           for r in Q.h5_identical_by_task(spark, d).collect() if r.task == "instructions"}
    assert got == {("Base", "SFT"): (5, 5, 2, 40.0), ("SFT", "DPO"): (5, 5, 2, 40.0), ("Base", "DPO"): (5, 5, 2, 40.0)}


def test_preference_validation_scores_100_pairs_or_the_pool(spark, tmp_path):
    for n, want in ((40, 40), (130, 100)):
        d = tmp_path / str(n)
        d.mkdir()
        turns = [{"conv_id": c, "turn": t, "role": ("user", "assistant")[t % 2], "text": f"turn {t} of {c}"}
                 for c in range(n) for t in range(4)]
        got = Q.h8_preference_validation(spark, small_tables(spark, d, conversations=turns)).collect()
        assert [r.n_pairs for r in got] == [want]

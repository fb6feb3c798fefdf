"""Tables that are written and read again: what the scans prune, bundles from
files, broken rows; and provider order, availability and top-n heaps."""

import pytest
from pyspark.sql import functions as F

from prefscope.functions.chat import render_chatml
from prefscope.operators import judge, prep, report, scoring
from prefscope.schemas import JUDGED, METRIC_BUNDLE
from prefscope.sources import readers, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# A1 -------------------------------------------------------------------------
def test_message_lists_are_read_by_content_only(spark, tmp_path):
    schema = "conv_id long, messages array<struct<role: string, content: string>>"
    data = [(1, [("u", "ab"), ("a", None)]), (2, []), (3, None), (4, [("u", "x" * 2001)]), (5, [("u", "é" * 2000)]),
            (6, [("u", "x")] * 7), (7, [None, ("u", "x")])]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "c"))
    stored = readers.read_conversations(spark, str(tmp_path / "c"))
    got = prep.passing_message_lists(stored)
    assert "messages:array<struct<content:string>>" in plan(got)
    assert rows(got) == [(1, 2, 2), (5, 1, 2000), (7, 2, 1)]
    assert {r[0] for r in rows(got)} == {r.conv_id for r in prep.filter_conversations(stored).collect()}


# A2 / C2 / C3 ---------------------------------------------------------------
PAIRS = "pair_id long, prompt string, chosen string, rejected string, score_chosen double, score_rejected double, split string"


def test_pairs_are_pruned_by_split_and_gap(spark, tmp_path):
    data = [(1, "p", "a", "b", 3.0, 2.0, "train"), (2, "p", "a", "b", 3.0, 2.5, "train"), (3, "p", "a", "b", None, 2.0, "train"),
            (4, "p", "a", "b", 9.0, 1.0, "test"), (5, "p", "a" * 1201, "b", 9.0, 1.0, "train"), (6, "p", None, "b", 9.0, 1.0, "train")]
    pairs = spark.createDataFrame(data, PAIRS)
    writers.write_pairs(pairs, str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    got = readers.read_pairs(spark, str(tmp_path / "p"), "train", min_gap=1.0, max_chars=1200)
    text = plan(got)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(split" in text
    assert "Or(IsNull(score_gap),GreaterThanOrEqual(score_gap,1.0))" in text and "LessThanOrEqual(longest_side,1200)" in text
    assert [r[0] for r in rows(got)] == [1, 3] and got.columns == PAIRS.replace(" long", "").replace(
        " string", "").replace(" double", "").split(", ")
    assert rows(got.select("pair_id")) == rows(prep.filter_pairs(pairs.where("split = 'train'")).select("pair_id"))
    every = readers.read_pairs(spark, str(tmp_path / "p"), min_gap=1.0)
    assert [r[0] for r in rows(every)] == [1, 3, 4, 5, 6] and "split" not in every.columns


def test_pairs_without_scores_have_a_gap_of_zero(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "p", "a", "b", "train")], "pair_id long, prompt string, chosen string, rejected string, split string")
    writers.write_pairs(pairs, str(tmp_path / "p"))
    read = lambda gap: readers.read_pairs(spark, str(tmp_path / "p"), "train", scores=False, min_gap=gap).count()
    assert read(1.0) == 0 and read(0.0) == 1


def test_row_groups_are_in_the_order_of_the_gap(spark, tmp_path):
    import pyarrow.parquet as pq
    pairs = spark.range(5000).select(
        F.col("id").alias("pair_id"), F.lit("p").alias("prompt"), F.lit("a").alias("chosen"), F.lit("b").alias("rejected"),
        (F.col("id") * 7919 % 5000).cast("double").alias("score_chosen"), F.lit(0.0).alias("score_rejected"), F.lit("s").alias("split"))
    writers.write_pairs(pairs.coalesce(1), str(tmp_path / "p"))
    file, = (tmp_path / "p" / "split=s").glob("*.parquet")
    gaps = pq.read_table(file, columns=["score_gap"])["score_gap"].to_pylist()
    assert gaps == sorted(gaps)


# H4 / B1 / A5 / A7 / H5 / H9 ------------------------------------------------
def bundles(spark, samples):
    data = [(m, 1.5, 20.0, 8.0, 16.0, None if a is None else [("p", x) for x in a], [("q", "1", "1", x) for x in b])
            for m, a, b in samples]
    return spark.createDataFrame(data, "model string, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in METRIC_BUNDLE.fields))


def overlaps(df):
    return {(r.task, r.model_a, r.model_b): (r.n_a, r.n_b, r.n_equal, r.comparable, r.identical_pct) for r in df.collect()}


def test_stored_samples_are_matched_by_position(spark, tmp_path):
    b = bundles(spark, [("Base", ["x", "y", "z"], ["a\nb", "c"]), ("SFT", ["x", "z", "y"], ["a\nb", "d"]),
                        ("DPO", ["x", "y"], [])])
    root = str(tmp_path / "b")
    writers.write_bundles(b, root)
    stored = readers.read_metrics(spark, {m: f"{root}/model={m}" for m in report.MODELS})
    assert rows(stored.select("model", "instr_samples", "gsm8k_samples")) == rows(b.select("model", "instr_samples", "gsm8k_samples"))
    got = overlaps(report.sample_overlap(stored, (("Base", "SFT"), ("SFT", "DPO"))))
    assert got == {("instructions", "Base", "SFT"): (3, 3, 1, True, 100 / 3), ("instructions", "SFT", "DPO"): (3, 2, 1, False, 0.0),
                   ("qa", "Base", "SFT"): (2, 2, 1, True, 50.0), ("qa", "SFT", "DPO"): (2, 0, 0, False, 0.0)}


def test_a_missing_bundle_is_a_row_of_nulls(spark, tmp_path):
    b = bundles(spark, [("Base", ["x"], ["a"]), ("DPO", None, [])])
    root = str(tmp_path / "b")
    writers.write_bundles(b, root)
    stored = readers.read_metrics(spark, {m: f"{root}/model={m}" for m in report.MODELS}, keep_missing=True)
    assert [r.model for r in stored.orderBy("model").collect()] == ["Base", "DPO", "SFT"]
    table = report.compare(report.to_long(stored, {"P": "perplexity"}))
    assert [tuple(r) for r in table.collect()] == [("P", 1.5, None, 1.5)]
    got = overlaps(report.sample_overlap(stored, (("Base", "SFT"), ("Base", "DPO"))))
    assert got["qa", "Base", "SFT"] == (1, 0, 0, False, 0.0) and got["instructions", "Base", "DPO"] == (1, 0, 0, False, 0.0)


def test_null_responses_equal_only_each_other(spark):
    b = bundles(spark, [("Base", [None, None, ""], ["a"]), ("SFT", [None, "", None], ["a"])])
    assert overlaps(report.sample_overlap(b, (("Base", "SFT"),)))["instructions", "Base", "SFT"] == (3, 3, 1, True, 100 / 3)


def test_bundles_hold_the_first_instruction_responses(spark):
    ppl = spark.createDataFrame([("Base", 2.0)], "model string, perplexity double")
    ins = spark.createDataFrame([("Base", i, "p", f"r{i}", True) for i in range(40)],
                                "model string, idx long, prompt string, response string, ok boolean")
    qa = spark.createDataFrame([("Base", 0, "q", "#### 1", "1", True, False)], "model string, idx long, question string, "
                               "answer string, response string, correct boolean, cot boolean")
    b = scoring.metric_bundle(ppl, ins, qa).first()
    assert [s.response for s in b.instr_samples] == [f"r{i}" for i in range(25)] and b.n_instr_samples == 40
    assert len(scoring.metric_bundle(ppl, ins, qa, n_instr=3).first().instr_samples) == 3


# B3 -------------------------------------------------------------------------
def test_broken_rows_come_back_apart(spark, tmp_path):
    good = [(1, "a\nb", '"quoted", x', "  spaced  ", "DPO", "r"), (2, None, "é", "", "Tie", None)]
    writers.write_table(spark.createDataFrame(good, JUDGED), str(tmp_path / "t"))
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "x.csv").write_text("prompt_id,Base,SFT,DPO,winner,reason\nseven,a,b,c,DPO,r\n3,cut\n4,a,b,c,SFT,\"m\nn\"\n")
    got = writers.read_table(spark, [str(tmp_path / "t"), str(odd)], JUDGED, corrupt="broken")
    fine = got.where("broken is null").drop("broken")
    good[1] = (2, None, "é", None, "Tie", None)  # CSV has one sign for empty and null
    assert rows(fine) == rows(spark.createDataFrame([*good, (4, "a", "b", "c", "SFT", "m\nn")], JUDGED))
    assert sorted(r.broken for r in got.where("broken is not null").select("broken", "Base").collect()) == ["3,cut", "seven,a,b,c,DPO,r"]
    with pytest.raises(ValueError):
        writers.read_table(spark, str(odd), corrupt="broken")


# L1 / L2 --------------------------------------------------------------------
ATTEMPTS = [(1, "b", 1, '{"winner":"SFT"}'), (1, "a", 7, '{"winner":"DPO"}'), (1, "a", 9, '{"winner":"Base"}'),
            (2, "a", 1, "bad"), (2, "b", 2, '{"winner":"Tie","reason":"x"}'), (3, "c", 0, '{"winner":"DPO"}'),
            (3, None, 0, '{"winner":"DPO"}'), (4, "a", 1, "bad")]


def verdicts(spark, *providers):
    a = spark.createDataFrame(ATTEMPTS, "prompt_id long, provider string, attempt long, raw string")
    p = spark.createDataFrame([(i,) for i in range(1, 6)], "prompt_id long")
    out = judge.resolve_verdicts(a, p, providers=providers)
    return {r.prompt_id: (r.winner, r["used_provider"] if "used_provider" in out.columns else None) for r in out.collect()}


def test_providers_are_asked_in_order(spark):
    none = ("Error", None)
    assert verdicts(spark, ("a", True), ("b", True)) == {1: ("DPO", "a"), 2: ("Tie", "b"), 3: none, 4: none, 5: none}
    assert verdicts(spark, ("b", True), ("a", True))[1] == ("SFT", "b")
    assert verdicts(spark, ("a", False), ("b", True)) == {1: ("SFT", "b"), 2: ("Tie", "b"), 3: none, 4: none, 5: none}
    assert verdicts(spark, ("a", True), ("b", False))[2] == none
    assert set(verdicts(spark, ("a", False), ("b", False)).values()) == {("Tie", None)}


# G6 -------------------------------------------------------------------------
def test_availability_may_differ_by_request(spark):
    there = spark.createDataFrame([(1, "Base"), (1, "DPO"), (1, "DPO"), (2, "SFT"), (3, "other")], "conv_id long, model string")
    asked = spark.createDataFrame([(c, m) for c in (1, 2, 3, 4, None) for m in ("Base", "SFT", "DPO", "x")], "conv_id long, model string")
    got = {(r.conv_id, r.model): r.served_model for r in report.resolve_available(asked, there, ["conv_id"]).collect()}
    assert len(got) == 20
    assert {k: v for k, v in got.items() if v != "Base"} == {(1, "DPO"): "DPO", (2, "SFT"): "SFT", (2, "DPO"): "SFT"}


# J2-J4 ----------------------------------------------------------------------
def test_small_samples_are_heaps_and_equal_the_others(spark, monkeypatch):
    df = spark.createDataFrame([(i % 40, "t" * (i % 7)) for i in range(300)], "id long, text string")
    heap = prep.seeded_sample(df, "id", 55)
    assert "TakeOrderedAndProject" in plan(heap) and "Exchange range" not in plan(heap)
    split = prep.train_eval_split(df, "id", 20, 13)
    first = prep.first_n(df, 9, "id")
    some = [rows(x) for x in (heap, split, first)]
    monkeypatch.setattr(prep, "HEAP_ROWS", 0)
    assert some == [rows(x) for x in (prep.seeded_sample(df, "id", 55), prep.train_eval_split(df, "id", 20, 13), prep.first_n(df, 9, "id"))]
    with pytest.raises(ValueError):
        prep.first_n(df, 301, "id")
    monkeypatch.undo()
    with pytest.raises(ValueError):
        prep.first_n(df, 301, "id")


# D4 -------------------------------------------------------------------------
def test_a_null_content_is_empty_and_the_message_stays(spark):
    df = spark.createDataFrame([([("user", "a"), ("assistant", None), (None, "b")],)], "m array<struct<role: string, content: string>>")
    assert df.select(render_chatml("m")).first()[0] == (
        "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>\nb<|im_end|>\n")


# K7 -------------------------------------------------------------------------
def test_bigram_models_of_one_fit_equal_single_ones(spark, monkeypatch):
    from prefscope.operators import logprob as K
    docs = spark.createDataFrame([(1, "a b a b c", 1), (2, "a a b", 1), (3, "c c a q", 0), (4, None, 1), (5, "", None)],
                                 "doc_id long, text string, quality int")
    pairs = spark.createDataFrame([(1, "a", "b c", "a a"), (2, "q q", "zz b", None)], "pair_id long, prompt string, chosen string, rejected string")
    texts = spark.createDataFrame([(1, "a b c q"), (2, "c"), (3, "zz a b")], "text_id long, text string")
    lms = K.fit_ngram_family(docs, {"ref": F.lit(True), "pol": F.col("quality") == 1}, vocab_from="ref", n=2)
    ref = K.fit_ngram(docs, n=2)
    pol = K.fit_ngram(docs.where("quality = 1"), n=2, vocab_size=ref.vocab_size)
    assert lms["pol"].vocab_size == ref.vocab_size == 4
    want = K._join_keys(K.pair_logps(pairs, pol, prefix="pol_"), K.pair_logps(pairs, ref, prefix="ref_"), ["pair_id"])
    alone = {m: K.perplexity(texts, x).first() for m, x in (("ref", ref), ("pol", pol))}
    near = lambda a, b: [tuple(pytest.approx(x) for x in r) for r in rows(a)] == rows(b)
    for size in (K.BROADCAST_BYTES, 0):
        monkeypatch.setattr(K, "BROADCAST_BYTES", size)
        got = K.pair_logps_multi(pairs, {"pol": lms["pol"], "ref": lms["ref"]})
        assert near(got.select(want.columns), want)
        for r in K.perplexity_multi(texts, lms).collect():
            assert (r.n_texts, pytest.approx(r.perplexity)) == tuple(alone[r.model])
    # A model of the fit alone is an ordinary model.
    assert near(K.pair_logps(pairs, lms["pol"]), K.pair_logps(pairs, pol))

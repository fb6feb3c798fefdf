"""K and H8: numbers from FIXTURES.md, stability and properties."""

import math

import pytest

from pyspark.sql import functions as F

from prefscope.operators import logprob as K
from prefscope.plans import fixtures as FX

from conftest import SF001


def test_k7_k2_unigram_perplexity(spark):
    lm = K.fit_ngram(FX.reference_corpus(spark, SF001))
    r = K.perplexity(FX.heldout_texts(spark, SF001), lm).first()
    assert round(r["perplexity"], 6) == 13978.326719


def _preference(spark, monkeypatch=None):
    ref = K.fit_ngram(FX.reference_corpus(spark, SF001))
    pol = K.fit_ngram(FX.policy_corpus(spark, SF001), vocab_size=ref.vocab_size)
    pairs = FX.fd2_pairs(spark, SF001)
    j = K.join_logps(K.pair_logps(pairs, pol, prefix="pol_"), K.pair_logps(pairs, ref, prefix="ref_"))
    return K.preference_summary(K.reward_margin(K.rewards(j, 0.05))).first()


def test_k7_preference_chain(spark):
    r = _preference(spark)
    assert r["n_pairs"] == 135
    assert round(r["preference_accuracy_pct"], 6) == 53.333333
    assert round(r["mean_margin"], 6) == -0.011386


def test_hot_cold_split_equals_broadcast(spark, monkeypatch):
    monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(K, "HOT_SPLIT", 50)
    r = _preference(spark)
    assert round(r["preference_accuracy_pct"], 6) == 53.333333
    assert round(r["mean_margin"], 6) == -0.011386


def test_k1_masks_prompt(spark):
    df = spark.createDataFrame([(1, 0, -5.0, True), (1, 1, -1.0, False), (1, 2, -2.0, False), (2, 0, -3.0, True)],
                               "seq_id long, pos long, logp double, is_prompt boolean")
    out = {r["seq_id"]: r["logp"] for r in K.sequence_logp(df).collect()}
    assert out == {1: -3.0, 2: 0.0}


def test_k5_stable(spark):
    df = spark.createDataFrame([(-1000.0,), (1000.0,), (0.0,)], "margin double")
    r = K.dpo_loss(df).first()["dpo_loss"]
    assert math.isfinite(r)
    assert abs(r - (1000.0 + 0.0 + math.log(2)) / 3) < 1e-9


def test_h8_strict_and_antisymmetric(spark):
    df = spark.createDataFrame([(1, -1.0, -2.0, -1.5, -1.5), (2, -1.0, -1.0, -1.0, -1.0)],
                               "pair_id long, pol_chosen double, pol_rejected double, ref_chosen double, ref_rejected double")
    m = K.reward_margin(K.rewards(df, 0.1))
    r = K.preference_summary(m).first()
    assert r["preference_accuracy_pct"] == 50.0  # the tie counts as wrong
    swapped = df.select("pair_id", F.col("pol_rejected").alias("pol_chosen"), F.col("pol_chosen").alias("pol_rejected"),
                        F.col("ref_rejected").alias("ref_chosen"), F.col("ref_chosen").alias("ref_rejected"))
    a = {x["pair_id"]: x["margin"] for x in m.collect()}
    b = {x["pair_id"]: x["margin"] for x in K.reward_margin(K.rewards(swapped, 0.1)).collect()}
    assert all(abs(a[k] + b[k]) < 1e-12 for k in a)


def test_k6_fill_failed(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "pair_id long")
    lp = spark.createDataFrame([(1, -1.0, -2.0, -1.0, -1.0), (2, None, -2.0, -1.0, -1.0)],
                               "pair_id long, pol_chosen double, pol_rejected double, ref_chosen double, ref_rejected double")
    out = {r["pair_id"]: r for r in K.fill_failed(ids, lp).collect()}
    assert not out[1]["failed"] and out[1]["pol_rejected"] == -2.0
    assert out[2]["failed"] and out[2]["pol_rejected"] == 0.0
    assert out[3]["failed"] and out[3]["ref_chosen"] == 0.0


def test_ngram_contexts(spark):
    df = spark.createDataFrame([("a b a b",)], "text string")
    lm = K.fit_ngram(df, n=2)
    grams = {(r["ctx"], r["token"]): r["c"] for r in lm.grams.collect()}
    assert grams == {("<s>", "a"): 1, ("a", "b"): 2, ("b", "a"): 1}
    ctx = {r["ctx"]: r["c_ctx"] for r in lm.contexts.collect()}
    assert ctx == {"<s>": 1, "a": 2, "b": 1}
    assert lm.vocab_size == 2
    held = spark.createDataFrame([(1, "a b c")], "text_id long, text string")
    p = K.perplexity(held, lm).first()["perplexity"]
    exp = math.exp(-(math.log(2 / 3) + math.log(3 / 4) + math.log(1 / 3)) / 3)
    assert abs(p - exp) < 1e-12


def test_ngram_pair_context_reaches_into_prompt(spark):
    pairs = spark.createDataFrame([(1, "x y", "z", "w")], "pair_id long, prompt string, chosen string, rejected string")
    rows = K.completion_tokens(pairs, "chosen", n=3).collect()
    got = [(r["token"], r["ctx"], r["is_prompt"]) for r in rows]
    # prompt rendered as "<|im_start|>user\nx y<|im_end|>\n<|im_start|>assistant\n"
    p1, p2 = "<|im_start|>user\nx", "y<|im_end|>\n<|im_start|>assistant\n"
    assert got == [(p1, "<s> <s>", True), (p2, "<s> " + p1, True), ("z", p1 + " " + p2, False),
                   ("<|im_end|>", p2 + " z", False)]
    lists = spark.createDataFrame([(1, [("user", "x y")], [("user", "q"), ("assistant", "z")], [("assistant", "w")])],
                                  "pair_id long, prompt array<struct<role:string,content:string>>, "
                                  "chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>")
    got2 = [(r["token"], r["ctx"], r["is_prompt"]) for r in K.completion_tokens(lists, "chosen", n=3).collect()]
    assert got2 == got


def test_ngram_split_join_equals_broadcast(spark, monkeypatch):
    lm = K.fit_ngram(FX.reference_corpus(spark, SF001), n=2)
    texts = FX.heldout_texts(spark, SF001)
    a = K.perplexity(texts, lm).first()["perplexity"]
    monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(K, "HOT_SPLIT", 20)
    b = K.perplexity(texts, lm).first()["perplexity"]
    assert abs(a - b) < 1e-9 * a


def test_perplexity_from_token_table_equals_k2(spark):
    lm = K.fit_ngram(FX.reference_corpus(spark, SF001))
    texts = FX.heldout_texts(spark, SF001)
    toks = FX.token_rows(texts, "text_id").where(F.col("pos") < 512)
    per_token = K.score_tokens(toks, lm, ["text_id"]).withColumnRenamed("text_id", "seq_id")
    a = K.perplexity_from_tokens(per_token).first()
    b = K.perplexity(texts, lm).first()
    assert a["n_texts"] == b["n_texts"] and abs(a["perplexity"] - b["perplexity"]) < 1e-6 * b["perplexity"]


def test_reliable_fit_cuts_lineage(spark):
    a = K.fit_ngram(FX.reference_corpus(spark, SF001))
    b = K.fit_ngram(FX.reference_corpus(spark, SF001), reliable=True)
    plan = b.counts._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan  # read back from the checkpoint, not recounted
    texts = FX.heldout_texts(spark, SF001)
    assert K.perplexity(texts, a).first()["perplexity"] == K.perplexity(texts, b).first()["perplexity"]
    a.unpersist()


def test_multi_model_passes_equal_single(spark, monkeypatch):
    lms = K.fit_ngram_family(FX.labelled_documents(spark, SF001),
                             {"ref": FX.all_rows(), "pol": FX.good_clean()}, vocab_from="ref")
    texts = FX.heldout_texts(spark, SF001)
    multi = {r["model"]: r["perplexity"] for r in K.perplexity_multi(texts, lms).collect()}
    for name, lm in lms.items():
        assert abs(multi[name] - K.perplexity(texts, lm).first()["perplexity"]) < 1e-9 * multi[name]
    pairs = FX.fd2_pairs(spark, SF001)
    a = {r["pair_id"]: r for r in K.pair_logps_multi(pairs, lms).collect()}
    b = {r["pair_id"]: r for r in K.pair_logps(pairs, lms["pol"], prefix="pol_").collect()}
    assert all(abs(a[k]["pol_chosen"] - b[k]["pol_chosen"]) < 1e-9 and
               abs(a[k]["pol_rejected"] - b[k]["pol_rejected"]) < 1e-9 for k in b)
    monkeypatch.setattr(K, "BROADCAST_BYTES", 0)  # per-model fallback path
    c = {r["model"]: r["perplexity"] for r in K.perplexity_multi(texts, lms).collect()}
    assert all(abs(c[k] - multi[k]) < 1e-9 * multi[k] for k in multi)


def test_shuffle_lookup_equals_broadcast_with_a_dominant_unseen_token(spark, monkeypatch):
    """The token that fills most rows is not in the corpus; one sequence has a
    null key. Both lookups give the same sums."""
    corpus = spark.createDataFrame([("a b a c",), ("b d",)], "text string")
    tokens = spark.createDataFrame(
        [(i % 50 if i % 50 else None, "unseen" if i % 4 else "ab"[i % 2]) for i in range(4000)],
        "seq_id long, token string")
    models = {"x": K.fit_ngram(corpus), "y": K.fit_ngram(corpus, vocab_size=9)}
    want = {r["seq_id"]: tuple(r)[1:] for r in K.sequence_sums_multi(tokens, models, ["seq_id"]).collect()}
    monkeypatch.setattr(K, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(K, "HOT_SPLIT", 1)
    got = {r["seq_id"]: tuple(r)[1:] for r in K.sequence_sums_multi(tokens, models, ["seq_id"]).collect()}
    assert set(got) == set(want) and None in got
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_k6_fails_per_model(spark):
    """The policy failed on pair 1 only on one side: its margin is the
    reference's alone, not zero."""
    lp = spark.createDataFrame([(1, None, -7.0, -5.0, -9.0), (2, -1.0, -2.0, -3.0, None)],
                               "pair_id long, pol_chosen double, pol_rejected double, ref_chosen double, ref_rejected double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "pair_id long")
    out = K.reward_margin(K.rewards(K.fill_failed(ids, lp), beta=0.05))
    got = {r["pair_id"]: r for r in out.collect()}
    assert got[1]["margin"] == pytest.approx(-0.2) and got[1]["pol_failed"] and not got[1]["ref_failed"]
    assert got[2]["margin"] == pytest.approx(0.05) and got[2]["ref_failed"] and not got[2]["pol_failed"]
    assert got[3]["margin"] == 0.0 and got[3]["failed"]


def test_k1_legacy_prompt(spark):
    pairs = spark.createDataFrame([(1, "sys", "", "q", "c1 c2", "r"), (2, None, "in", "q", None, "")],
                                  "pair_id long, system string, input string, question string, chosen string, rejected string")
    toks = K.completion_tokens(pairs, "chosen").collect()
    text = {i: " ".join(r["token"] for r in sorted(toks, key=lambda r: r["pos"]) if r["pair_id"] == i) for i in (1, 2)}
    assert "sys" in text[1] and text[1].endswith("c1 c2 <|im_end|>") and text[2].endswith("<|im_end|>") and "in" in text[2]


def test_token_rows_run_no_lambda_per_token(spark):
    """Split, shift and zip are generated code; contexts are right for any n."""
    df = spark.createDataFrame([(1, "a  b c"), (2, ""), (3, None), (4, "d")], "id long, text string")
    for n, want in ((1, [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (4, 0, "d")]),
                    (2, [(1, 0, "a", "<s>"), (1, 1, "b", "a"), (1, 2, "c", "b"), (4, 0, "d", "<s>")]),
                    (3, [(1, 0, "a", "<s> <s>"), (1, 1, "b", "<s> a"), (1, 2, "c", "a b"), (4, 0, "d", "<s> <s>")])):
        rows = K.token_rows(df, ["id"], K.whitespace_tokens("text"), n)
        assert sorted(map(tuple, rows.collect())) == want
        assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [1, 2])
def test_shuffle_lookup_reads_scored_texts_once(spark, monkeypatch, n):
    """Beyond the broadcast size the scored rows are written before the lookups,
    which make several passes over them."""
    lms = K.fit_ngram_family(FX.labelled_documents(spark, SF001),
                             {"ref": FX.all_rows(), "pol": FX.good_clean()}, vocab_from="ref", n=n)
    texts = FX.heldout_texts(spark, SF001)
    want = {r["model"]: r["perplexity"] for r in K.perplexity_multi(texts, lms).collect()}
    monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(K, "HOT_SPLIT", 20)
    out = K.perplexity_multi(texts, lms)
    assert "benchmark.parquet" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["model"]: r["perplexity"] for r in out.collect()} == pytest.approx(want)


def test_few_scored_keys_take_their_counts_without_a_shuffle(spark, monkeypatch):
    """The model is beyond the broadcast size, what is scored is not."""
    lm = K.fit_ngram(FX.reference_corpus(spark, SF001), n=2)
    texts = spark.createDataFrame([(1, "zz zz zz"), (2, "der die das")], "text_id long, text string")
    want = K.perplexity(texts, lm).first()
    monkeypatch.setattr(K, "BROADCAST_BYTES", 1000)
    out = K.perplexity(texts, lm)
    assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert out.first()["perplexity"] == pytest.approx(want["perplexity"])

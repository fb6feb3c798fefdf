"""
*part* are exercised inside another query). Each takes (spark, sf_dir) and
returns a DataFrame; every one reads whole given tables. Computed columns are
aliased to the names used by the DuckDB oracles in ``oracle.py``; integers
are LONG and doubles are rounded to 6 places so both engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscope.functions import chat as C
from prefscope.functions import text as T
from prefscope.functions.rules import with_rule_verdict
from prefscope.operators import judge as L
from prefscope.operators import logprob as K
from prefscope.operators import prep as P
from prefscope.operators import report as R
from prefscope.operators import scoring as H
from prefscope.plans import fixtures as FX
from prefscope.schemas import JUDGED
from prefscope.session import shared_path
from prefscope.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]


def r6(c) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---------------------------------------------------------------------------
# C: filters
# ---------------------------------------------------------------------------
def c1_filter_conversations(spark, d):
    """C1 over the long conversation rows: one partial aggregate per
    conversation (the array form is used where arrays are needed, d4)."""
    kept = P.passing_conversations(FX.table(spark, d, "conversations"), 6, 2000)
    return kept.select("conv_id", long("n_turns").alias("n_turns"), long("n_chars").alias("n_chars"))


def a1_stored_conversations(spark, d):
    """A1 and C1 from stored message lists: only their contents are read."""
    path = shared_path(spark, "conversations")
    FX.fd1_messages(spark, d).write.parquet(path)
    return P.passing_message_lists(readers.read_conversations(spark, path))


def a2_stored_pairs(spark, d):
    """A2, C2 and C3 from pairs stored by split with their gap: directories
    and row groups are pruned."""
    pairs = FX.fd2_pairs(spark, d).withColumn(
        "split", F.when(F.col("pair_id") % 10 == 0, "test_prefs").otherwise("train_prefs"))
    path = shared_path(spark, "pairs")
    writers.write_pairs(pairs, path)
    kept = readers.read_pairs(spark, path, "train_prefs", min_gap=1.0, max_chars=1200)
    return kept.select("pair_id", "split", "score_chosen", "score_rejected",
                       long(F.length("chosen")).alias("chosen_chars"),
                       long(F.length("rejected")).alias("rejected_chars"))


def b3_judged_csv(spark, d):
    """The judged table (cells of several lines) as CSV and back, beside a
    file whose rows don't fit its schema; these come back apart, as text."""
    path, odd = shared_path(spark, "judged"), shared_path(spark, "judged-odd")
    judged = l3_judged(spark, d)
    writers.write_table(judged, path)
    broken = FX.judged_prompts(spark, d).where("prompt_id % 50 = 0").select(
        F.concat(F.lit("x"), F.col("prompt_id").cast("string")).alias("prompt_id"), F.lit("cut off").alias("Base"))
    writers.write_table(broken, odd)
    rows = writers.read_table(spark, [path, odd], JUDGED, corrupt="broken")
    return rows.select("prompt_id", "winner", "reason", *[
        F.md5(m).alias(f"{m.lower()}_md5") for m in R.MODELS], "broken")


def b4_showcase_csv(spark, d):
    """The side-by-side responses without verdicts as CSV and back."""
    path = shared_path(spark, "showcase")
    writers.write_table(R.side_by_side(FX.fd3_responses(spark, d), keys=("q_id",)), path)
    rows = writers.read_table(spark, path, "q_id long, Base string, SFT string, DPO string")
    return rows.select("q_id", *R.MODELS)


def c3_filter_pairs(spark, d):
    kept = P.filter_pairs(FX.fd2_pairs(spark, d), max_chars=1200, min_gap=1.0)
    return kept.select("pair_id", "score_chosen", "score_rejected",
                       long(F.length("chosen")).alias("chosen_chars"),
                       long(F.length("rejected")).alias("rejected_chars"))


def c4_filter_texts(spark, d):
    kept = P.filter_texts(FX.fd8_texts(spark, d), min_chars=20)
    return kept.select("doc_id", long(F.length(T.py_strip("text"))).alias("stripped_chars"))


def c6_funnel(spark, d):
    stats = FX.fd1_stats(spark, d)
    return P.funnel(stats, [
        ("has_messages", F.col("n_turns") >= 1),
        ("max_turns", F.col("n_turns") <= 6),
        ("max_chars", F.col("n_chars") <= 2000),
    ])


def c6_pair_funnel(spark, d):
    pairs = FX.fd2_pairs(spark, d)
    return P.funnel(pairs, [
        ("score_gap", P.score_gap_ok(pairs, 1.0)),
        ("max_chars", P.pair_length_ok(pairs, 1200)),
    ])


# ---------------------------------------------------------------------------
# D: reshapes
# ---------------------------------------------------------------------------
def d1_last_content(spark, d):
    """The last message of each conversation's message list."""
    msgs = FX.fd1_messages(spark, d)
    last = C.last_content("messages")
    return msgs.select("conv_id",
                       F.try_element_at("messages", F.lit(-1)).getField("role").alias("last_role"),
                       last.alias("last_content"), long(F.length(last)).alias("last_chars"))


def _render(c) -> Column:
    return C.render_chatml(c, False)


def d2_to_pairs_text(spark, d):
    pairs = P.to_pairs(FX.fd2_pairs(spark, d), keep=("pair_id",))
    return pairs.select("pair_id",
                        long(F.size("prompt")).alias("n_prompt"),
                        long(F.size("chosen")).alias("n_chosen"),
                        long(F.size("rejected")).alias("n_rejected"),
                        _render("prompt").alias("prompt_chatml"),
                        _render("chosen").alias("chosen_chatml"),
                        _render("rejected").alias("rejected_chatml"))


def d2_to_pairs_lists(spark, d):
    """List-form pairs from all conversations: prompt = first message's text,
    chosen = the whole conversation, rejected = all but its last message."""
    msgs = FX.fd1_messages(spark, d)
    src = msgs.select(
        F.col("conv_id").alias("pair_id"),
        F.col("messages")[0].getField("content").alias("prompt"),
        F.col("messages").alias("chosen"),
        F.slice("messages", 1, F.size("messages") - 1).alias("rejected"))
    pairs = P.to_pairs(src, keep=("pair_id",))
    return pairs.select("pair_id",
                        long(F.size("chosen")).alias("n_chosen"),
                        long(F.size("rejected")).alias("n_rejected"),
                        _render("prompt").alias("prompt_chatml"),
                        _render("chosen").alias("chosen_chatml"),
                        _render("rejected").alias("rejected_chatml"))


def _legacy_rows(spark, d):
    conv = FX.table(spark, d, "conversations")
    is_sys, is_user = F.col("role") == "system", F.col("role") == "user"
    g = conv.groupBy("conv_id").agg(
        F.min_by(F.when(is_sys, F.col("text")), F.when(is_sys, F.col("turn"))).alias("system"),
        F.min_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("first_user"),
        F.max_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("question"))
    return g.select("conv_id", "system",
                    F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.col("first_user")).alias("input"),
                    "question")


def d3_legacy_prompt(spark, d):
    rows = P.legacy_prompt(_legacy_rows(spark, d))
    return rows.select("conv_id", long(F.size("prompt")).alias("n_messages"),
                       _render("prompt").alias("prompt_chatml"))


def d4_render_chatml(spark, d):
    msgs = FX.fd1_messages(spark, d)
    return msgs.select("conv_id", C.render_chatml("messages", False).alias("chatml"),
                       C.render_chatml("messages", True).alias("chatml_prompt"))


def d5_qa_prompt(spark, d):
    b = FX.table(spark, d, "benchmark")
    return b.select("item_id", T.qa_prompt("text").alias("prompt"))


def _user_turn_prompts(spark, d):
    conv = FX.table(spark, d, "conversations").where(F.col("role") == "user")
    return conv.select(
        "conv_id", "turn", F.col("text").alias("prompt"),
        ((F.col("conv_id") % 5).cast("double") / 10).alias("temperature"),
        F.lit(0.9).alias("top_p"),
        long(F.lit(200) + (F.col("turn") % 5) * 20).alias("max_tokens"))


def d6_model_prompt(spark, d):
    g = R.request_grid(_user_turn_prompts(spark, d))
    return g.select("conv_id", "turn", "model",
                    P.model_prompt("prompt", "is_chat").alias("model_prompt"))


def d7_judge_prompt(spark, d):
    sbs = R.side_by_side(FX.fd3_responses(spark, d), keys=("q_id",))
    return sbs.select("q_id", L.judge_prompt(F.col("q_id").cast("string"), "Base", "SFT", "DPO")
                      .alias("judge_prompt"))


def d9_close_sequence(spark, d):
    docs = FX.table(spark, d, "documents")
    closed = C.close_sequence(C.whitespace_tokens("text"))
    return docs.select("doc_id", long(F.size(closed)).alias("n_tokens"),
                       F.try_element_at(closed, F.lit(-1)).alias("last_token"))


def d10_truncate_tokens(spark, d):
    docs = FX.table(spark, d, "documents")
    toks = C.whitespace_tokens("text")
    kept = C.truncate_tokens(toks, 512)
    return docs.select("doc_id", long(F.size(toks)).alias("n_tokens"),
                       long(F.size(kept)).alias("n_kept"),
                       F.try_element_at(kept, F.lit(-1)).alias("last_kept"))


# ---------------------------------------------------------------------------
# E: text functions (documents are the volume input)
# ---------------------------------------------------------------------------
def _docs(spark, d):
    return FX.table(spark, d, "documents").select("doc_id", "text")


def _low(c="text"):
    return T.py_strip(F.lower(F.col(c)))


def e1_py_strip(spark, d):
    return _docs(spark, d).select(
        "doc_id", long(F.length(T.py_strip("text"))).alias("stripped_chars"),
        (T.py_strip("text") != F.col("text")).alias("changed"))


def e2_has_repetition(spark, d):
    return _docs(spark, d).select(
        "doc_id", long(F.size(T.repetition_lines("text"))).alias("n_long_lines"),
        T.has_repetition("text").alias("repetition"))


def e3_has_chat_collapse(spark, d):
    g = d6_model_prompt(spark, d)
    return g.select("conv_id", "turn", "model",
                    T.has_chat_collapse("model_prompt").alias("collapse"))


def _qa_scored(spark, d):
    return H.score_qa(FX.fd3_responses(spark, d))


def e4_final_number(spark, d):
    return FX.fd3_responses(spark, d).select("q_id", "model", T.final_number("response").alias("pred"))


def e5_gold_answer(spark, d):
    return FX.fd3_responses(spark, d).select("q_id", "model", T.gold_answer("answer").alias("gold"))


def e6_is_exact(spark, d):
    return _qa_scored(spark, d).select("q_id", "model", "pred", "gold", "correct")


def e7_has_cot(spark, d):
    return _docs(spark, d).select("doc_id", T.has_cot_marker("text").alias("cot_marker"),
                                  T.has_cot("text").alias("cot"))


def e7_has_cot_qa(spark, d):
    return _qa_scored(spark, d).select("q_id", "model", "repetition", "cot")


def e8_n_sentences(spark, d):
    return _docs(spark, d).select("doc_id", long(T.n_sentences("text")).alias("n_sentences"))


def e9_n_lines(spark, d):
    return _docs(spark, d).select("doc_id", long(T.n_lines("text")).alias("n_lines"))


def e10_n_words(spark, d):
    return _docs(spark, d).select("doc_id", long(T.n_words("text")).alias("n_words"))


# Fixed word lists for the keyword-test queries over the documents.
E11_ANY = ("the", "und", "les")
E11_ALL = ("le", "la")
E11_NONE = ("der", "die", "das")


def e11_contains(spark, d):
    low = _low()
    return _docs(spark, d).select(
        "doc_id", T.contains_any(low, E11_ANY).alias("has_any"),
        T.contains_all(low, E11_ALL).alias("has_all"),
        T.contains_none(low, E11_NONE).alias("has_none"))


def e12_contains_exact(spark, d):
    return _docs(spark, d).select(
        "doc_id", T.contains_exact("text", "MIT").alias("has_mit"),
        T.contains_exact("text", "#").alias("has_hash"),
        T.contains_exact("text", "The").alias("has_the"))


def e13_all_words_start(spark, d):
    """Three words that start with s: the roles of each turn, three times over
    (all, when the role is ``system``), and the part types."""
    roles = FX.table(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("item"),
        F.concat_ws(' "', "role", "role", F.concat("role", F.lit('!"'))).alias("words"))
    types = FX.table(spark, d, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item"), F.col("p_type").alias("words"))
    low = T.py_strip(F.lower(F.col("words")))
    return roles.unionByName(types).select(
        "item", T.all_words_start(low, "s", 3).alias("all_start_s"),
        T.all_words_start(low, "s", 4).alias("four_start_s"))


def e14_min_len(spark, d):
    return FX.table(spark, d, "conversations").select(
        "conv_id", "turn", T.min_len(_low(), 20).alias("longer_than_20"))


def e15_parse_verdict(spark, d):
    a = FX.fd4_attempts(spark, d)
    return a.select("prompt_id", "attempt", T.parse_verdict("raw").alias("v")).select(
        "prompt_id", "attempt", F.col("v.ok").alias("ok"), F.col("v.winner").alias("winner"),
        F.col("v.reason").alias("reason"))


# ---------------------------------------------------------------------------
# F / H1: rules
# ---------------------------------------------------------------------------
def _instr_scored(spark, d):
    return H.score_instructions(FX.fd6_responses(spark, d))


def f1_rule_verdict(spark, d):
    r = with_rule_verdict(FX.fd6_responses(spark, d))
    return r.select("item_id", "model", "prompt_id", "correct")


def f2_instruction_ok(spark, d):
    return _instr_scored(spark, d).select("item_id", "model", "ok")


def h1_instruction_accuracy(spark, d):
    a = H.instruction_accuracy(_instr_scored(spark, d))
    return a.select("model", "n", r6("instruction_following_acc_pct").alias("instruction_following_acc_pct"))


# ---------------------------------------------------------------------------
# G: joins
# ---------------------------------------------------------------------------
def g1_side_by_side(spark, d):
    return R.side_by_side(FX.fd3_responses(spark, d), keys=("q_id",))


def g3_join_logps(spark, d):
    lp = FX.fd5_logps(spark, d)
    pol = lp.select("pair_id", "pol_chosen", "pol_rejected")
    ref = lp.select("pair_id", "ref_chosen", "ref_rejected")
    j = K.join_logps(pol, ref)
    return j.select("pair_id", *[r6(c).alias(c) for c in
                                 ("pol_chosen", "pol_rejected", "ref_chosen", "ref_rejected")])


def g4_request_grid(spark, d):
    g = R.request_grid(_user_turn_prompts(spark, d))
    return g.select("conv_id", "turn", "model", "is_chat", "do_sample",
                    r6("eff_temperature").alias("eff_temperature"),
                    r6("eff_top_p").alias("eff_top_p"), "max_tokens")


def g6_resolve_model(spark, d):
    g = R.request_grid(_user_turn_prompts(spark, d))
    return R.resolve_model(g, available=("Base", "SFT")).select(
        "conv_id", "turn", "model", "served_model")


def g6_availability(spark, d):
    """G6 where it differs by conversation which checkpoints are there: DPO for
    every third, SFT for every second; every seventh has none listed."""
    g = R.request_grid(_user_turn_prompts(spark, d))
    ids = FX.table(spark, d, "conversations").select("conv_id").distinct().where("conv_id % 7 <> 0")
    there = ids.select("conv_id", F.explode(F.expr(
        "filter(array('Base', if(conv_id % 2 = 0, 'SFT', null), if(conv_id % 3 = 0, 'DPO', null)), x -> x is not null)"
    )).alias("model"))
    return R.resolve_available(g, there, ["conv_id"]).select("conv_id", "turn", "model", "served_model")


# ---------------------------------------------------------------------------
# H: aggregates
# ---------------------------------------------------------------------------
def h2_qa_accuracy(spark, d):
    a = H.qa_accuracy(_qa_scored(spark, d))
    return a.select("model", "n", r6("gsm8k_acc_pct").alias("gsm8k_acc_pct"))


def h3_cot_rate(spark, d):
    a = H.cot_rate(_qa_scored(spark, d))
    return a.select("model", r6("cot_presence_pct").alias("cot_presence_pct"))


def qa_report(spark, d):
    """The minimum slice: per model, QA accuracy and CoT presence (E2, E4-E7,
    H2, H3)."""
    a = H.qa_accuracy(_qa_scored(spark, d))
    return a.select("model", "n", r6("gsm8k_acc_pct").alias("gsm8k_acc_pct"),
                    r6("cot_presence_pct").alias("cot_presence_pct"))


def _three_models(spark, d):
    """Unigram models for the three checkpoints, sharing the reference
    (all-documents) vocabulary: Base = all documents, SFT = documents of good
    quality, DPO = good and not toxic."""
    return K.fit_ngram_family(
        FX.labelled_documents(spark, d),
        {"Base": FX.all_rows(), "SFT": FX.good(), "DPO": FX.good_clean()}, vocab_from="Base")


def _bundle(spark, d, with_samples: bool = True):
    texts = FX.heldout_texts(spark, d)
    ppl = K.perplexity_multi(texts, _three_models(spark, d)).select("model", "perplexity")
    instr = _instr_scored(spark, d).withColumnRenamed("item_id", "idx")
    qa = _qa_scored(spark, d).withColumn("idx", F.col("q_id")).withColumn(
        "question", F.col("q_id").cast("string"))
    return H.metric_bundle(ppl, instr, qa, n_qa_samples=10, with_samples=with_samples)


def h4_metric_bundle(spark, d):
    b = _bundle(spark, d)
    return b.select(
        "model", r6("perplexity").alias("perplexity"),
        r6("instruction_following_acc_pct").alias("instruction_following_acc_pct"),
        r6("gsm8k_acc_pct").alias("gsm8k_acc_pct"), r6("cot_presence_pct").alias("cot_presence_pct"),
        long("n_instr_samples").alias("n_instr_samples"),
        long(F.size("gsm8k_samples")).alias("n_gsm8k_samples"),
        F.array_join(F.transform("gsm8k_samples", lambda s: F.concat_ws(
            "=", s.getField("question"), F.coalesce(s.getField("pred"), F.lit("-")))), ",")
        .alias("gsm8k_sample_preds"))


def h4_instruction_samples(spark, d):
    """All instruction samples of the three models, as a long table."""
    s = H.instruction_samples(_instr_scored(spark, d), order="item_id")
    return s.select("model", "item_id", "prompt", F.md5("response").alias("response_md5"))


def _stored_bundles(spark, bundle, models, keep_missing=False):
    """The bundles of ``models`` written as files (B1) and all three read (A5)."""
    root = shared_path(spark, "bundles")
    writers.write_bundles(bundle.where(F.col("model").isin(*models)), root)
    return readers.read_metrics(spark, {m: f"{root}/model={m}" for m in R.MODELS}, keep_missing)


def h5_stored_bundles(spark, d):
    """H5 from files: metric bundles with their samples are written (B1), read
    (A5) and their sample arrays compared by position (G2)."""
    stored = _stored_bundles(spark, _bundle(spark, d), R.MODELS)
    out = R.sample_overlap(stored, (("Base", "SFT"), ("SFT", "DPO"), ("Base", "DPO")))
    return out.select("task", "model_a", "model_b", "n_a", "n_b", "n_equal", "comparable",
                      r6("identical_pct").alias("identical_pct"))


def h9_missing_bundle(spark, d):
    """H9 from files when one checkpoint's is not there (A7): null cells."""
    stored = _stored_bundles(spark, _bundle(spark, d, with_samples=False), ("Base", "DPO"), keep_missing=True)
    t = R.compare(R.to_long(stored, METRIC_LABELS))
    return t.select("metric", *[r6(m).alias(m) for m in R.MODELS])


def h5_identical_by_task(spark, d):
    """Overlap of the QA answers and of the instruction responses,
    positions being (task, idx). The model of an instruction response is one
    of three in turn, so documents 75 k + 25 m + p are the three models'
    answers to prompt p in round k."""
    qa = FX.fd3_responses(spark, d).select(F.lit("qa").alias("task"), F.col("q_id").alias("idx"), "model", "response")
    ins = FX.fd6_responses(spark, d).select(
        F.lit("instructions").alias("task"),
        (F.floor(F.col("item_id") / 75) * 25 + F.col("prompt_id")).cast("long").alias("idx"), "model", "response")
    wide = R.side_by_side(qa.unionByName(ins), keys=("task", "idx"))
    out = R.identical_pcts(wide, (("Base", "SFT"), ("SFT", "DPO"), ("Base", "DPO")), by=("task",))
    return out.select("task", "model_a", "model_b", "n_a", "n_b", "n_equal", "comparable",
                      r6("identical_pct").alias("identical_pct"))


def h5_identical_pct(spark, d):
    """H5 for three model pairs from one side-by-side pivot (one shuffle)."""
    wide = R.side_by_side(FX.fd3_responses(spark, d), keys=("q_id",))
    out = R.identical_pcts(wide, (("Base", "SFT"), ("SFT", "DPO"), ("Base", "DPO")))
    return out.select("model_a", "model_b", "n_a", "n_b", "n_equal", "comparable",
                      r6("identical_pct").alias("identical_pct"))


def _verdicts(spark, d):
    return L.resolve_verdicts(FX.fd4_attempts(spark, d), FX.judged_prompts(spark, d))


def h6_verdict_counts(spark, d):
    return L.verdict_counts(_verdicts(spark, d))


def h7_win_rates(spark, d):
    w = L.win_rates(L.verdict_counts(_verdicts(spark, d)))
    return w.select("winner", "wins", r6("win_rate_pct").alias("win_rate_pct"))


def _margins(spark, d):
    return K.reward_margin(K.rewards(FX.fd5_logps(spark, d), beta=0.05))


def h8_preference_summary(spark, d):
    s = K.preference_summary(_margins(spark, d))
    return s.select("n_pairs", r6("preference_accuracy_pct").alias("preference_accuracy_pct"),
                    r6("mean_margin").alias("mean_margin"))


# Report labels of the four metrics, in table order.
METRIC_LABELS = {
    "Perplexity": "perplexity",
    "Instruction-Follow Acc (%)": "instruction_following_acc_pct",
    "GSM8K Acc (%)": "gsm8k_acc_pct",
    "CoT Presence (%)": "cot_presence_pct",
}


def _compare(spark, d):
    return R.compare(R.to_long(_bundle(spark, d, with_samples=False), METRIC_LABELS))


def h9_compare(spark, d):
    t = _compare(spark, d)
    return t.select("metric", *[r6(m).alias(m) for m in R.MODELS])


def h10_relative_gain(spark, d):
    g = R.relative_gain(_compare(spark, d), base="SFT", new="DPO")
    return g.select("metric", *[r6(c).alias(c) for c in ("base_value", "new_value", "diff", "ratio")])


# ---------------------------------------------------------------------------
# I / J: windows, order, samples
# ---------------------------------------------------------------------------
def i1_running_accuracy(spark, d):
    s = _qa_scored(spark, d).withColumnRenamed("q_id", "idx")
    return H.running_accuracy(s, every=10, dense=True)


def i1_running_accuracy_sparse(spark, d):
    """I1 over items whose ids have gaps, answers and all columns along."""
    s = _qa_scored(spark, d).withColumn("idx", F.col("q_id") * 7 + F.col("q_id") % 3).where("q_id % 5 <> 2")
    return H.running_accuracy(s, every=10)


def j0_position(spark, d):
    """The position of every document, all columns along, by length and id."""
    p = P.with_position(FX.table(spark, d, "documents"), ["n_chars", "doc_id"], "position")
    return p.select("position", "doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def _passing_conversations(spark, d):
    return P.passing_conversations(FX.table(spark, d, "conversations")).select("conv_id")


def j1_seeded_order(spark, d):
    """The seeded permutation with each row's place in it."""
    keyed = _passing_conversations(spark, d).withColumn("shuffle_key", P.shuffle_key("conv_id", 42))
    return P.with_position(keyed, ["shuffle_key", "conv_id"], "position")


def j2_seeded_sample(spark, d):
    pairs = P.filter_pairs(FX.fd2_pairs(spark, d))
    s = P.seeded_sample(pairs, "pair_id", n=20, seed=42)
    return s.select("pair_id", "sample_rank", "shuffle_key")


def j3_train_eval_split(spark, d):
    s = P.train_eval_split(_passing_conversations(spark, d), "conv_id", n_train=20, n_eval=5)
    return s.select("conv_id", "sample_rank", "split")


def j4_first_n(spark, d):
    texts = P.filter_texts(FX.fd8_texts(spark, d))
    f = P.first_n(texts, 200, "doc_id")
    return f.select("doc_id", long(F.length("text")).alias("n_chars"))


def j5_preview(spark, d):
    """First 10 graded answers per model. Scoring is row-local, so the top-n
    is taken first and only its rows are scored."""
    p = P.preview(FX.fd3_responses(spark, d), 10, "model", "q_id")
    return H.score_qa(p).select("model", "q_id", "pred", "gold", "correct")


# ---------------------------------------------------------------------------
# K: log-probs
# ---------------------------------------------------------------------------
def _completion_logp(toks, lm):
    """K1: only completion tokens are priced, the others are counted."""
    masked = toks.groupBy("pair_id", "side").agg(F.count_if("is_prompt").alias("n_prompt_tokens"))
    scored = K.score_tokens(toks.where(~F.col("is_prompt")), lm, ["pair_id", "side"])
    s = K.sequence_logp(scored, keys=("pair_id", "side"))
    return s.join(masked, ["pair_id", "side"]).select(
        "pair_id", "side", "n_prompt_tokens", "n_completion_tokens", r6("logp").alias("logp"))


def k1_sequence_logp(spark, d):
    lm = K.fit_ngram(FX.reference_corpus(spark, d))
    pairs = FX.fd2_pairs(spark, d)
    toks = K.completion_tokens(pairs, "chosen").unionByName(K.completion_tokens(pairs, "rejected"))
    return _completion_logp(toks, lm)


def k1_legacy(spark, d):
    """K1 on legacy pairs: system, input and question in place of a prompt."""
    lm = K.fit_ngram(FX.reference_corpus(spark, d))
    conv = FX.table(spark, d, "conversations")
    answer = F.when(F.col("role") == "assistant", F.col("text"))
    turn = F.when(F.col("role") == "assistant", F.col("turn"))
    answers = conv.groupBy("conv_id").agg(F.min_by(answer, turn).alias("chosen"),
                                          F.max_by(answer, turn).alias("rejected"))
    pairs = _legacy_rows(spark, d).join(answers, "conv_id").withColumnRenamed("conv_id", "pair_id")
    toks = K.completion_tokens(pairs, "chosen").unionByName(K.completion_tokens(pairs, "rejected"))
    return _completion_logp(toks, lm)


def k2_perplexity(spark, d):
    lm = K.fit_ngram(FX.reference_corpus(spark, d))
    p = K.perplexity(FX.heldout_texts(spark, d), lm)
    return p.select("n_texts", r6("perplexity").alias("perplexity"))


def k2_perplexity_documents(spark, d):
    """K2 over texts on both sides of its cuts: all documents, and
    the first word of each (some of one word, many beyond 512 tokens)."""
    lm = K.fit_ngram(FX.reference_corpus(spark, d))
    docs = FX.table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    first = FX.table(spark, d, "documents").select(
        (-F.col("doc_id") - 1).alias("text_id"), F.substring_index("text", " ", 1).alias("text"))
    p = K.perplexity(docs.unionByName(first), lm)
    return p.select("n_texts", r6("perplexity").alias("perplexity"))


def k7_bigram_perplexity(spark, d):
    """K7 with n = 2 -> K2: add-one bigram model over all documents, macro
    perplexity of the held-out texts (first 512 tokens each)."""
    lm = K.fit_ngram(FX.reference_corpus(spark, d), n=2)
    p = K.perplexity(FX.heldout_texts(spark, d), lm)
    return p.select("n_texts", r6("perplexity").alias("perplexity"))


def k3_rewards(spark, d):
    r = K.rewards(FX.fd5_logps(spark, d), beta=0.05)
    return r.select("pair_id", r6("chosen_reward").alias("chosen_reward"),
                    r6("rejected_reward").alias("rejected_reward"))


def k4_reward_margin(spark, d):
    return _margins(spark, d).select("pair_id", r6("margin").alias("margin"))


def k5_dpo_loss(spark, d):
    return K.dpo_loss(_margins(spark, d)).select("n", r6("dpo_loss").alias("dpo_loss"))


def k6_fill_failed(spark, d):
    """Every fifth pair lacks the policy's chosen side, every seventh the
    reference's rejected side, and pairs of error events have no row."""
    ev = FX.table(spark, d, "events")
    lp = FX.fd5_logps(spark, d)
    lp = lp.withColumn("pol_chosen", F.when(F.col("pair_id") % 5 != 0, F.col("pol_chosen"))).withColumn(
        "ref_rejected", F.when(F.col("pair_id") % 7 != 0, F.col("ref_rejected")))
    scored = lp.join(
        ev.where(F.col("event_type") != "error").select(F.col("event_id").alias("pair_id")),
        "pair_id", "left_semi")
    f = K.fill_failed(ev.select(F.col("event_id").alias("pair_id")), scored)
    return f.select("pair_id", *[r6(c).alias(c) for c in
                                 ("pol_chosen", "pol_rejected", "ref_chosen", "ref_rejected")],
                    "pol_failed", "ref_failed", "failed")


def k7_fit_ngram(spark, d):
    lm = K.fit_ngram(FX.reference_corpus(spark, d))
    return lm.counts.select("token", "c", r6(lm.logp(F.col("c"))).alias("logp"))


def k7_ngram_preference(spark, d):
    """K7 -> K1 -> G3 -> K3 -> K4 -> H8 on the FD2 pairs: reference = all
    documents, policy = good, non-toxic documents, shared vocabulary."""
    lms = K.fit_ngram_family(FX.labelled_documents(spark, d),
                             {"ref": FX.all_rows(), "pol": FX.good_clean()}, vocab_from="ref")
    j = K.pair_logps_multi(FX.fd2_pairs(spark, d), {"pol": lms["pol"], "ref": lms["ref"]})
    s = K.preference_summary(K.reward_margin(K.rewards(j, beta=0.05)))
    return s.select("n_pairs", r6("preference_accuracy_pct").alias("preference_accuracy_pct"),
                    r6("mean_margin").alias("mean_margin"))


def k7_bigram_preference(spark, d):
    """K7 with n = 2 -> K1 -> G3 -> K3 -> K4 -> H8: reference and policy are
    bigram models of one fit, and both price a completion in one pass."""
    lms = K.fit_ngram_family(FX.labelled_documents(spark, d),
                             {"ref": FX.all_rows(), "pol": FX.good_clean()}, vocab_from="ref", n=2)
    j = K.pair_logps_multi(FX.fd2_pairs(spark, d), {"pol": lms["pol"], "ref": lms["ref"]})
    s = K.preference_summary(K.reward_margin(K.rewards(j, beta=0.05)))
    return s.select("n_pairs", r6("preference_accuracy_pct").alias("preference_accuracy_pct"),
                    r6("mean_margin").alias("mean_margin"))


def k7_bigram_family_perplexity(spark, d):
    """K7 with n = 2 for the three checkpoints' corpora in one fit -> K2."""
    lms = K.fit_ngram_family(
        FX.labelled_documents(spark, d),
        {"Base": FX.all_rows(), "SFT": FX.good(), "DPO": FX.good_clean()}, vocab_from="Base", n=2)
    p = K.perplexity_multi(FX.heldout_texts(spark, d), lms)
    return p.select("model", "n_texts", r6("perplexity").alias("perplexity"))


def h8_preference_validation(spark, d):
    """The preference validation end to end: pairs that pass the length and
    score filters, a seeded sample of at most 100 of them, log-probs of both sides under
    policy and reference, rewards, margins, accuracy."""
    lms = K.fit_ngram_family(FX.labelled_documents(spark, d),
                             {"ref": FX.all_rows(), "pol": FX.good_clean()}, vocab_from="ref")
    pairs = P.seeded_sample(P.filter_pairs(FX.fd2_pairs(spark, d)), "pair_id", n=100, seed=42)
    j = K.fill_failed(pairs, K.pair_logps_multi(pairs, {"pol": lms["pol"], "ref": lms["ref"]}))
    s = K.preference_summary(K.reward_margin(K.rewards(j, beta=0.05)))
    return s.select("n_pairs", r6("preference_accuracy_pct").alias("preference_accuracy_pct"),
                    r6("mean_margin").alias("mean_margin"))


# ---------------------------------------------------------------------------
# L: judge
# ---------------------------------------------------------------------------
def l1_resolve_verdicts(spark, d):
    return _verdicts(spark, d)


def _provider_attempts(spark, d):
    """FD4's attempts by two providers in turn, and some by one that is not
    listed."""
    a = FX.fd4_attempts(spark, d)
    return a.withColumn("provider", F.when(F.col("attempt") % 5 == 4, "other").when(
        F.col("attempt") % 2 == 0, "second").otherwise("first"))


def _by_provider(spark, d, first: bool, second: bool):
    return L.resolve_verdicts(_provider_attempts(spark, d), FX.judged_prompts(spark, d),
                              providers=(("first", first), ("second", second)))


def l1_providers(spark, d):
    """L1 in provider order: the second is asked where the first fails."""
    return _by_provider(spark, d, True, True)


def l1_first_provider_off(spark, d):
    return _by_provider(spark, d, False, True)


def l2_no_provider(spark, d):
    """L2: without a configured provider every prompt is a tie."""
    return _by_provider(spark, d, False, False)


def l3_judged(spark, d):
    sbs = R.side_by_side(FX.fd3_responses(spark, d), keys=("q_id",)).withColumnRenamed(
        "q_id", "prompt_id")
    return L.judged(sbs, _verdicts(spark, d))


# ---------------------------------------------------------------------------
# M
# ---------------------------------------------------------------------------
def m2_stack_models(spark, d):
    r = FX.fd3_responses(spark, d)
    frames = {m: r.where(F.col("model") == m).select("q_id", "response") for m in R.MODELS}
    return R.stack_models(frames)


QUERIES: dict[str, Query] = {
    "qa_report": qa_report,
    "a1_stored_conversations": a1_stored_conversations,
    "a2_stored_pairs": a2_stored_pairs,
    "b3_judged_csv": b3_judged_csv,
    "b4_showcase_csv": b4_showcase_csv,
    "c1_filter_conversations": c1_filter_conversations,
    "c3_filter_pairs": c3_filter_pairs,
    "c4_filter_texts": c4_filter_texts,
    "c6_funnel": c6_funnel,
    "c6_pair_funnel": c6_pair_funnel,
    "d1_last_content": d1_last_content,
    "d2_to_pairs_text": d2_to_pairs_text,
    "d2_to_pairs_lists": d2_to_pairs_lists,
    "d3_legacy_prompt": d3_legacy_prompt,
    "d4_render_chatml": d4_render_chatml,
    "d5_qa_prompt": d5_qa_prompt,
    "d6_model_prompt": d6_model_prompt,
    "d7_judge_prompt": d7_judge_prompt,
    "d9_close_sequence": d9_close_sequence,
    "d10_truncate_tokens": d10_truncate_tokens,
    "e1_py_strip": e1_py_strip,
    "e2_has_repetition": e2_has_repetition,
    "e3_has_chat_collapse": e3_has_chat_collapse,
    "e4_final_number": e4_final_number,
    "e5_gold_answer": e5_gold_answer,
    "e6_is_exact": e6_is_exact,
    "e7_has_cot": e7_has_cot,
    "e7_has_cot_qa": e7_has_cot_qa,
    "e8_n_sentences": e8_n_sentences,
    "e9_n_lines": e9_n_lines,
    "e10_n_words": e10_n_words,
    "e11_contains": e11_contains,
    "e12_contains_exact": e12_contains_exact,
    "e13_all_words_start": e13_all_words_start,
    "e14_min_len": e14_min_len,
    "e15_parse_verdict": e15_parse_verdict,
    "f1_rule_verdict": f1_rule_verdict,
    "f2_instruction_ok": f2_instruction_ok,
    "g1_side_by_side": g1_side_by_side,
    "g3_join_logps": g3_join_logps,
    "g4_request_grid": g4_request_grid,
    "g6_resolve_model": g6_resolve_model,
    "g6_availability": g6_availability,
    "h1_instruction_accuracy": h1_instruction_accuracy,
    "h2_qa_accuracy": h2_qa_accuracy,
    "h3_cot_rate": h3_cot_rate,
    "h4_metric_bundle": h4_metric_bundle,
    "h4_instruction_samples": h4_instruction_samples,
    "h5_stored_bundles": h5_stored_bundles,
    "h5_identical_pct": h5_identical_pct,
    "h5_identical_by_task": h5_identical_by_task,
    "h6_verdict_counts": h6_verdict_counts,
    "h7_win_rates": h7_win_rates,
    "h8_preference_summary": h8_preference_summary,
    "h8_preference_validation": h8_preference_validation,
    "h9_compare": h9_compare,
    "h9_missing_bundle": h9_missing_bundle,
    "h10_relative_gain": h10_relative_gain,
    "i1_running_accuracy": i1_running_accuracy,
    "i1_running_accuracy_sparse": i1_running_accuracy_sparse,
    "j0_position": j0_position,
    "j1_seeded_order": j1_seeded_order,
    "j2_seeded_sample": j2_seeded_sample,
    "j3_train_eval_split": j3_train_eval_split,
    "j4_first_n": j4_first_n,
    "j5_preview": j5_preview,
    "k1_sequence_logp": k1_sequence_logp,
    "k1_legacy": k1_legacy,
    "k2_perplexity": k2_perplexity,
    "k2_perplexity_documents": k2_perplexity_documents,
    "k3_rewards": k3_rewards,
    "k4_reward_margin": k4_reward_margin,
    "k5_dpo_loss": k5_dpo_loss,
    "k6_fill_failed": k6_fill_failed,
    "k7_fit_ngram": k7_fit_ngram,
    "k7_ngram_preference": k7_ngram_preference,
    "k7_bigram_perplexity": k7_bigram_perplexity,
    "k7_bigram_preference": k7_bigram_preference,
    "k7_bigram_family_perplexity": k7_bigram_family_perplexity,
    "l1_resolve_verdicts": l1_resolve_verdicts,
    "l1_providers": l1_providers,
    "l1_first_provider_off": l1_first_provider_off,
    "l2_no_provider": l2_no_provider,
    "l3_judged": l3_judged,
    "m2_stack_models": m2_stack_models,
}

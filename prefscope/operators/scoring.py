"""Evaluation scoring and per-model aggregates.

Scoring is a single narrow projection (all text functions in one stage);
every aggregate is grouped by model, which Spark pre-aggregates inside each
map task, so a model holding most rows still ships one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefscope.functions import text as T
from prefscope.functions.rules import INSTRUCTION_RULES, rule_number, with_rule_verdict


def pct(cond: Column) -> Column:
    """100 * share of rows where ``cond`` holds (null counts as false)."""
    return F.lit(100.0) * F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


# ---------------------------------------------------------------------------
# QA scoring
# ---------------------------------------------------------------------------
def score_qa(df: DataFrame, answer: str = "answer", response: str = "response") -> DataFrame:
    """Adds gold, pred, correct, repetition, cot."""
    return df.select(
        "*",
        T.gold_answer(answer).alias("gold"),
        T.final_number(response).alias("pred"),
    ).select(
        "*",
        T.is_exact("pred", "gold").alias("correct"),
        T.has_repetition(response).alias("repetition"),
        T.has_cot_marker(response).alias("_cot_marker"),
    ).withColumn("cot", F.col("_cot_marker") & ~F.col("repetition")).drop("_cot_marker")


# H2 / H3 -------------------------------------------------------------------
def qa_accuracy(scored: DataFrame, by: str = "model") -> DataFrame:
    """H2 and H3 in one aggregate: (model, n, gsm8k_acc_pct, cot_presence_pct)."""
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        pct(F.col("correct")).alias("gsm8k_acc_pct"),
        pct(F.col("cot")).alias("cot_presence_pct"))


def cot_rate(scored: DataFrame, by: str = "model") -> DataFrame:
    return scored.groupBy(by).agg(pct(F.col("cot")).alias("cot_presence_pct"))


# F1 / F2 / H1 --------------------------------------------------------------
def score_instructions(df: DataFrame, prompt: str = "prompt", response: str = "response",
                       rules=INSTRUCTION_RULES) -> DataFrame:
    """Adds correct (F1), collapse (E3), repetition (E2) and ok (F2). Rows that
    carry ``rule_number`` (worked out on the suite) are dispatched by it."""
    known = "rule_number" in df.columns
    numbered = df if known else df.withColumn("rule_number", rule_number(prompt, rules))
    scored = with_rule_verdict(numbered, "rule_number", response, "correct", rules)
    resp = F.coalesce(F.col(response), F.lit(""))
    scored = scored.select("*", T.has_chat_collapse(resp).alias("collapse"),
                           T.has_repetition(resp).alias("repetition"))
    scored = scored.withColumn("ok", F.col("correct") & ~F.col("collapse") & ~F.col("repetition"))
    return scored if known else scored.drop("rule_number")


def instruction_accuracy(scored: DataFrame, by: str = "model") -> DataFrame:
    """H1: (model, n, instruction_following_acc_pct)."""
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        pct(F.col("ok")).alias("instruction_following_acc_pct"))


# I1 ------------------------------------------------------------------------
def running_accuracy(scored: DataFrame, every: int = 10, by: str = "model",
                     idx: str = "idx", flag: str = "correct",
                     fanout: int = 4096, dense: bool = False) -> DataFrame:
    """Accuracy so far, reported before items idx = every, 2*every, ...
    (prior items only, divided by idx as the harness does). ``idx`` is any
    unique item order key: each model's items are first numbered 0, 1, 2, ...
    in that order (``with_position``), and the output ``idx`` is that number.
    With ``dense=True`` the caller states that ``idx`` is this number already,
    and numbering is left out.

    A window ordered over every item of a model would put the whole model in
    one task. Instead: per-bucket sums (bucket = idx div every, a partial
    aggregate), then an exact two-level prefix sum: buckets are grouped in
    blocks of ``fanout``; block totals (n / (every * fanout) rows per model)
    get a running sum, and buckets get a running sum inside their block,
    whose windows are partitioned by (model, block)."""
    if not dense:
        from prefscope.operators.prep import with_position
        # Positions are written to disk: only what the sums need goes along.
        scored = with_position(scored.select(by, F.col(idx).alias("_key"), flag), [by, "_key"], "_gpos")
        first = scored.groupBy(by).agg(F.min("_gpos").alias("_first"))
        scored = scored.join(first, by).withColumn(
            idx, F.col("_gpos") - F.col("_first")).drop("_gpos", "_first", "_key")
    b = scored.groupBy(by, F.floor(F.col(idx) / every).alias("bucket")).agg(
        F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("hits"))
    b = b.withColumn("block", F.floor(F.col("bucket") / fanout))
    blocks = b.groupBy(by, "block").agg(F.sum("hits").alias("block_hits"))
    before_block = F.coalesce(F.sum("block_hits").over(
        Window.partitionBy(by).orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(by, "block", before_block.alias("hits_before_block"))
    in_block = F.coalesce(F.sum("hits").over(
        Window.partitionBy(by, "block").orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = b.select(by, "bucket", "block", in_block.alias("hits_before_in_block"))
    j = b.join(blocks, [by, "block"])
    report_idx = F.col("bucket") * every
    hits_before = F.col("hits_before_block") + F.col("hits_before_in_block")
    return j.where(F.col("bucket") >= 1).select(
        by, report_idx.cast("long").alias(idx),
        hits_before.cast("long").alias("hits_so_far"),
        F.round(F.lit(100.0) * hits_before / report_idx, 6).alias("running_acc_pct"))


# H4 ------------------------------------------------------------------------
def metric_bundle(perplexity: DataFrame, instr_scored: DataFrame, qa_scored: DataFrame,
                  n_qa_samples: int = 10, by: str = "model", qa_order: str = "idx",
                  with_samples: bool = True, n_instr: int = 25, instr_order: str = "idx") -> DataFrame:
    """H4: one row per model with the four metrics, the number of instruction
    responses, the first ``n_instr`` of them (25, the harness's whole suite) and
    the first ``n_qa_samples`` QA samples (``qa_scored`` is ``score_qa`` output,
    which keeps ``answer``; the cut is the harness's own). An array per model
    must be bounded; all instruction samples are the long table of
    ``instruction_samples``.
    ``with_samples=False`` leaves the samples out (a comparison table needs only
    the metrics, and unused full-outer-join branches are not pruned by Spark)."""
    from prefscope.operators.prep import preview
    instr = instruction_accuracy(instr_scored, by).withColumnRenamed("n", "n_instr_samples")
    qa = qa_accuracy(qa_scored, by).drop("n")
    metrics = perplexity.join(instr, by, "full").join(qa, by, "full")
    names = [by, "perplexity", "instruction_following_acc_pct", "gsm8k_acc_pct", "cot_presence_pct"]
    if not with_samples:
        return metrics.select(*names)
    # Gold and prediction are re-derived after the per-model top-n, so the
    # regex work of this branch covers n rows per model, not every response.
    top = preview(qa_scored.select(by, qa_order, "question", "answer", "response"),
                  n_qa_samples, by, qa_order).select(
        by, qa_order, "question", T.gold_answer("answer").alias("gold"),
        T.final_number("response").alias("pred"), "response")
    samples = top.groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(
            F.col(qa_order).alias("o"), F.col("question"), F.col("gold"), F.col("pred"),
            F.col("response")))),
            lambda s: F.struct(s.getField("question").alias("question"),
                               s.getField("gold").alias("gold"),
                               s.getField("pred").alias("pred"),
                               s.getField("response").alias("response"))).alias("gsm8k_samples"))
    first = preview(instr_scored.select(by, instr_order, "prompt", "response"), n_instr, by, instr_order)
    answers = first.groupBy(by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(instr_order).alias("o"), "prompt", "response"))),
        lambda s: F.struct(s.getField("prompt").alias("prompt"),
                           s.getField("response").alias("response"))).alias("instr_samples"))
    return metrics.join(samples, by, "full").join(answers, by, "full").select(
        *names, "n_instr_samples", "instr_samples", "gsm8k_samples")


def instruction_samples(instr_scored: DataFrame, by: str = "model", order: str = "idx") -> DataFrame:
    """The instruction samples of H4, all of them: (model, idx, prompt, response)."""
    return instr_scored.select(by, order, "prompt", "response")

"""Judge resolution.

The hosted judge calls are outside Spark; every attempt (prompt, attempt
number in provider/model order, raw text) comes in as a row. Resolution is
one partial aggregate per prompt (``min_by`` over the attempts that parse),
so a prompt with a huge number of attempts is combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefscope.functions.text import parse_verdict
from prefscope.schemas import VALID_VERDICTS, VERDICT_LABELS

# ---------------------------------------------------------------------------
# Verdicts used when no attempt parses, or no judge is set up.
# ---------------------------------------------------------------------------
ERROR_WINNER = "Error"
ERROR_REASON = "All API judge model calls failed or timed out."
UNCONFIGURED_WINNER = "Tie"
UNCONFIGURED_REASON = "No Gemini or Groq API key configured."

# Fixed value: the judge prompt template, as the harness formats it; the
# four placeholders are filled with the prompt and the three responses.
JUDGE_TEMPLATE = """
    You are an expert AI evaluator. Compare three responses generated by different models (Base, SFT, DPO) to the user's prompt.
    Evaluate their quality based on helpfulness, accuracy, structure, instruction following, and step-by-step reasoning quality.
    
    [USER PROMPT]:
    {prompt}
    
    [BASE RESPONSE]:
    {base}
    
    [SFT RESPONSE]:
    {sft}
    
    [DPO RESPONSE]:
    {dpo}
    
    Respond ONLY with a JSON object in this format:
    {{
      "winner": "Base" | "SFT" | "DPO" | "Tie",
      "reason": "<one sentence explanation of why the winner was chosen>"
    }}
    """
JUDGE_FIELDS = ("prompt", "base", "sft", "dpo")


def _template_parts(template: str, fields) -> tuple[str, ...]:
    """The literal pieces around the placeholders, braces unescaped."""
    import re
    pieces = re.split(r"\{(" + "|".join(fields) + r")\}", template)[::2]
    return tuple(p.replace("{{", "{").replace("}}", "}") for p in pieces)


JUDGE_TEMPLATE_PARTS = _template_parts(JUDGE_TEMPLATE, JUDGE_FIELDS)


def _py_str(c: Column) -> Column:
    """How a Python f-string renders a possibly-missing value."""
    return F.coalesce(c.cast("string"), F.lit("None"))


# D7 ------------------------------------------------------------------------
def judge_prompt(prompt="prompt", base="Base", sft="SFT", dpo="DPO") -> Column:
    cols = [F.col(x) if isinstance(x, str) else x for x in (prompt, base, sft, dpo)]
    parts = JUDGE_TEMPLATE_PARTS
    pieces = [F.lit(parts[0])]
    for value, lit in zip(cols, parts[1:]):
        pieces += [_py_str(value), F.lit(lit)]
    return F.concat(*pieces)


# L1 / L2 -------------------------------------------------------------------
def resolve_verdicts(attempts: DataFrame, prompts: DataFrame | None = None,
                     configured: bool = True, key: str = "prompt_id",
                     providers: Sequence[tuple[str, bool]] | None = None) -> DataFrame:
    """L1: per prompt, the verdict of the first attempt (lowest ``attempt``)
    whose text is a JSON object; none -> Error. ``prompts`` (a table with
    ``key``) adds prompts that have no attempt at all. L2: with
    ``configured=False`` every prompt is a Tie with a fixed reason.

    With ``providers`` (name, configured), attempts carry a ``provider``: those
    of the first configured provider come first, whatever their numbers, then
    those of the next; attempts of providers that are off, unknown or null were
    never made. With no provider on, L2 holds. The result then also names the
    ``used_provider``."""
    if providers is not None:
        on = [name for name, is_on in providers if is_on]
        configured = bool(on)
    if not configured:
        ids = prompts if prompts is not None else attempts
        return ids.select(key).distinct().select(
            key, F.lit(UNCONFIGURED_WINNER).alias("winner"),
            F.lit(UNCONFIGURED_REASON).alias("reason"))
    if providers is not None:
        ranks = attempts.sparkSession.createDataFrame(list(enumerate(on)), "rank int, provider string")
        made = attempts.join(F.broadcast(ranks), "provider").select(
            key, F.struct("rank", "attempt", "provider").alias("attempt"), "raw")
        out = resolve_verdicts(made, prompts, key=key)
        return out.withColumn("used_provider", F.col("used_attempt.provider")).withColumn(
            "used_attempt", F.col("used_attempt.attempt"))
    parsed = attempts.select(key, "attempt", parse_verdict("raw").alias("v"))
    ok = F.col("v.ok")
    best = parsed.groupBy(key).agg(
        F.min_by(F.when(ok, F.struct(F.col("v.winner").alias("winner"),
                                     F.col("v.reason").alias("reason"))),
                 F.when(ok, F.col("attempt"))).alias("best"),
        F.count(F.lit(1)).alias("n_attempts"),
        F.min(F.when(ok, F.col("attempt"))).alias("used_attempt"))
    if prompts is not None:
        best = prompts.select(key).join(best, key, "left")
    return best.select(
        key,
        F.coalesce(F.col("best.winner"), F.lit(ERROR_WINNER)).alias("winner"),
        F.coalesce(F.col("best.reason"), F.lit(ERROR_REASON)).alias("reason"),
        F.coalesce(F.col("n_attempts"), F.lit(0).cast("long")).alias("n_attempts"),
        F.col("used_attempt"))


# H6 ------------------------------------------------------------------------
def verdict_counts(verdicts: DataFrame, labels=VERDICT_LABELS) -> DataFrame:
    """H6: (winner, n) with every known label present (zero-filled); unknown
    labels are counted too. The label list is unioned in with weight 0, so
    zero-filling needs no join."""
    spark: SparkSession = verdicts.sparkSession
    zero = spark.createDataFrame([(x,) for x in labels], "winner string").select(
        "winner", F.lit(0).cast("long").alias("_w"))
    one = verdicts.select("winner", F.lit(1).cast("long").alias("_w"))
    return one.unionByName(zero).groupBy("winner").agg(F.sum("_w").alias("n"))


# H7 ------------------------------------------------------------------------
def win_rates(counts: DataFrame, valid=VALID_VERDICTS) -> DataFrame:
    """H7: share of Base, SFT, DPO and Tie among those four labels (Error and
    unknown labels left out); no valid verdict -> no rows. The total is a
    window over at most four rows."""
    v = counts.where(F.col("winner").isin(*valid))
    total = F.sum("n").over(Window.partitionBy())
    return (v.withColumn("_total", total).where(F.col("_total") > 0)
            .select("winner", F.col("n").alias("wins"),
                    (F.lit(100.0) * F.col("n") / F.col("_total")).alias("win_rate_pct")))


# L3 ------------------------------------------------------------------------
def judged(side_by_side: DataFrame, verdicts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """L3: every prompt's side-by-side responses with winner and reason; a
    prompt without a verdict has ``Error`` and the fixed reason."""
    joined = side_by_side.join(verdicts.select(key, "winner", "reason"), key, "left")
    return joined.withColumn("winner", F.coalesce("winner", F.lit(ERROR_WINNER))).withColumn(
        "reason", F.coalesce("reason", F.lit(ERROR_REASON)))

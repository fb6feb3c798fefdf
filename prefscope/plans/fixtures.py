"""Derived fixtures FD1-FD8: Spark plans over the given test tables that give
the same rows as the SQL in FIXTURES.md, so each can be the first step of a
query and the first CTE of its oracle.

Every fixture reads whole tables; none samples or caps rows.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscope.functions.chat import whitespace_tokens
from prefscope.functions.rules import INSTRUCTION_PROMPTS, rule_number
from prefscope.operators import prep
from prefscope.parallel import spread
from prefscope.sources.readers import prompt_suite

# The three checkpoints, in report order, and FD3's offsets.
MODELS = ("Base", "SFT", "DPO")
MODEL_OFFSETS = (("Base", 0), ("SFT", 1), ("DPO", 2))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, rebalanced when Spark cannot split it."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


# FD1 ------------------------------------------------------------------------
def fd1_stats(spark, sf_dir) -> DataFrame:
    """(conv_id, n_turns, n_chars) per conversation."""
    return prep.conversation_stats(table(spark, sf_dir, "conversations"))


def fd1_messages(spark, sf_dir, max_turns: int | None = None) -> DataFrame:
    """(conv_id, messages); with ``max_turns`` only conversations of at most
    that many turns."""
    return prep.conversations_to_messages(table(spark, sf_dir, "conversations"), max_turns)


# FD2 ------------------------------------------------------------------------
def fd2_pairs(spark, sf_dir) -> DataFrame:
    """Preference pairs from conversations: a user turn, the assistant turn
    after it (chosen) and the assistant turn two later (rejected)."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("chosen"))
    b = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("rejected"))
    j = u.join(a, ["conv_id", "turn"]).join(b, ["conv_id", "turn"])
    return j.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"),
        "prompt", "chosen", "rejected",
        F.when(F.col("conv_id") % 11 == 0, F.lit(None).cast("double"))
        .otherwise((F.col("conv_id") % 10).cast("double") / 2 + 1).alias("score_chosen"),
        (F.col("turn") % 4).cast("double").alias("score_rejected"))


# FD3 ------------------------------------------------------------------------
def _num(c, m):
    return (c % m).cast("string")


def fd3_responses(spark, sf_dir) -> DataFrame:
    """Graded QA responses: every order is a question answered by each of the
    three models. The model dimension is a literal array exploded per row (a
    narrow Generate, not a join)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q_id"))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k"))
                       for m, k in MODEL_OFFSETS])
    x = o.select("q_id", F.inline(models))
    q, k = F.col("q_id"), F.col("k")
    v = _num(q, 97)
    case = (q + k) % 6
    response = (
        F.when(case == 0, F.concat(F.lit("Step 1: take it\nThen, #### "), v))
        .when(case == 1, F.concat(F.lit("The total is "), v))
        .when(case == 2, F.concat(F.lit("The total is "), v, F.lit(".")))
        .when(case == 3, F.lit("no number here"))
        .when(case == 4, F.concat(F.lit("same line\nsame line\nnext, "), _num(q, 89)))
        .otherwise(F.concat(F.lit("First, 1,200 then #### 7 and #### "), v)))
    return x.select("q_id", "model",
                    F.concat(F.lit("work shown #### "), v).alias("answer"),
                    response.alias("response"))


# FD4 ------------------------------------------------------------------------
def fd4_attempts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t, i = F.col("event_type"), F.col("event_id")
    raw = (F.when(i % 13 == 0, F.lit('{"winner":"DPO"} {"winner":"SFT"}'))
           .when(i % 17 == 0, F.lit('{"winner":"SFT","reason":"c","winner":"DPO"}'))
           .when(t == "error", F.lit("not json"))
           .when(t == "click", F.lit('{"winner":"DPO","reason":"a"}'))
           .when(t == "view", F.lit('{"winner":"SFT","reason":"b"}'))
           .when(t == "signup", F.lit('{"winner":"Tie"}'))
           .otherwise(F.lit('{"reason":"no winner"}')))
    return e.select(F.col("user_id").alias("prompt_id"),
                    F.col("event_id").alias("attempt"), raw.alias("raw"))


def judged_prompts(spark, sf_dir) -> DataFrame:
    """The prompts that were given to the judge: every question of FD3."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prompt_id"))


# FD5 ------------------------------------------------------------------------
def fd5_logps(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    return e.select(
        F.col("event_id").alias("pair_id"),
        (-v).alias("ref_chosen"), (-(v * 1.1)).alias("ref_rejected"),
        (-(v * 0.9)).alias("pol_chosen"),
        (-(v * (F.lit(1.0) + (F.col("event_id") % 7).cast("double") / 10))).alias("pol_rejected"))


# FD6 ------------------------------------------------------------------------
def fd6_responses(spark, sf_dir) -> DataFrame:
    """Documents as responses to the 25 instruction prompts (doc_id % 25 picks
    the prompt, (doc_id / 25) % 3 the model). The suite is a broadcast side of
    25 rows (G5)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    suite = prompt_suite(spark, INSTRUCTION_PROMPTS).withColumn("rule_number", rule_number("prompt"))
    models = F.array(*[F.lit(m) for m in MODELS])
    d = d.select(
        F.col("doc_id").alias("item_id"),
        (F.col("doc_id") % 25).alias("prompt_id"),
        F.element_at(models, (F.floor(F.col("doc_id") / 25) % 3 + 1).cast("int")).alias("model"),
        F.col("text").alias("response"))
    return d.join(F.broadcast(suite), "prompt_id")


# FD7 ------------------------------------------------------------------------
def reference_corpus(spark, sf_dir) -> DataFrame:
    """All documents (the reference model's corpus)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def policy_corpus(spark, sf_dir) -> DataFrame:
    """Documents labelled good and not toxic (the policy model's corpus)."""
    lab = table(spark, sf_dir, "labels").where(
        (F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    return reference_corpus(spark, sf_dir).join(lab, "doc_id", "left_semi")


def labelled_documents(spark, sf_dir) -> DataFrame:
    """Documents with their labels (null when unlabelled), for fitting all
    corpora in one pass. The join moves the labels if they are few (AQE decides
    by their size); beyond that documents and labels are best bucketed by id."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return reference_corpus(spark, sf_dir).join(lab, "doc_id", "left")


# Corpus predicates over ``labelled_documents``: the reference model reads all
# documents, the policy model the good and non-toxic ones, the middle
# checkpoint the good ones.
def all_rows():
    return F.lit(True)


def good():
    return F.col("quality") == 1


def good_clean():
    return (F.col("quality") == 1) & (F.col("toxic") == 0)


def heldout_texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("text_id"), "text")


def token_rows(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, pos, token): whitespace tokens with their 0-based position."""
    return texts.select(id_col, F.posexplode(whitespace_tokens(text_col))).select(
        id_col, F.col("pos").cast("long").alias("pos"), F.col("col").alias("token"))


# FD8 ------------------------------------------------------------------------
def fd8_texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")

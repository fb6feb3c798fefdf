"""Hot keys: one prompt, model or conversation holding a third or more of
all rows. Results stay exact and whole; plans pre-aggregate before the
shuffle and never collect the hot group."""

from pyspark.sql import functions as F

from prefscope.operators import judge as L
from prefscope.operators import prep as P
from prefscope.operators import scoring as H


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_prompt_attempts(spark):
    n = 30000
    a = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("long").alias("prompt_id"),
        F.col("id").alias("attempt"),
        F.when(F.col("id") < 6, F.lit("bad")).otherwise(F.lit('{"winner":"SFT"}')).alias("raw"))
    v = L.resolve_verdicts(a)
    assert "partial_min_by" in _plan(v)
    hot = v.where("prompt_id = 0").first()
    assert hot["n_attempts"] == n // 3 and hot["used_attempt"] == 6 and hot["winner"] == "SFT"
    assert v.count() == 1 + (n - n // 3)


def test_hot_model_accuracy(spark):
    r = spark.range(20000).select(
        F.when(F.col("id") % 10 == 0, F.lit("SFT")).otherwise(F.lit("DPO")).alias("model"),
        F.lit("#### 3").alias("answer"),
        F.when(F.col("id") % 4 == 0, F.lit("so 3")).otherwise(F.lit("4")).alias("response"))
    acc = H.qa_accuracy(H.score_qa(r))
    assert "partial_count" in _plan(acc) or "partial_avg" in _plan(acc)
    got = {x["model"]: (x["n"], x["gsm8k_acc_pct"]) for x in acc.collect()}
    assert got["DPO"][0] == 18000 and got["SFT"] == (2000, 50.0)


def test_hot_conversation_is_not_collected(spark):
    hot = spark.range(3000).select(F.lit(0).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.lit("user").alias("role"), F.lit("x").alias("text"))
    cold = spark.range(1, 3001).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"),
                                      F.lit("user").alias("role"), F.lit("hello").alias("text"))
    long = hot.unionByName(cold)
    msgs = P.conversations_to_messages(long, max_turns=6)
    kept = P.filter_conversations(msgs)
    ids = {r["conv_id"] for r in kept.select("conv_id").collect()}
    assert 0 not in ids and len(ids) == 3000
    plan = _plan(kept)
    assert plan.index("collect_list") < plan.index("LeftSemi")  # the semi-join feeds the collect
    last = long.groupBy("conv_id").agg(F.max_by("turn", "turn").alias("t"))
    assert last.where("conv_id = 0").first()["t"] == 2999

"""C, D and J operators: edge cases and properties."""

import pytest
from pyspark.sql import functions as F

from prefscope.functions.chat import render_chatml
from prefscope.operators import prep as P
from prefscope.plans import fixtures as FX

from conftest import SF001

MSG = "array<struct<role:string,content:string>>"


def test_c1_array_and_long_forms_agree(spark):
    long = FX.table(spark, SF001, "conversations")
    a = {r[0] for r in P.filter_conversations(FX.fd1_messages(spark, SF001)).select("conv_id").collect()}
    b = {r[0] for r in P.filter_conversations(long).select("conv_id").distinct().collect()}
    assert a == b and len(a) == 28


def test_c1_edges(spark):
    df = spark.createDataFrame([
        (1, []), (2, [("user", "x" * 2000)]), (3, [("user", "x" * 2001)]),
        (4, [("user", "a")] * 6), (5, [("user", "a")] * 7)], f"conv_id long, messages {MSG}")
    kept = sorted(r[0] for r in P.filter_conversations(df).collect())
    assert kept == [2, 4]


def test_c3_null_and_absent_scores(spark):
    df = spark.createDataFrame([(1, "a", "b", None, 1.0), (2, "a", "b", 2.0, 1.0), (3, "a", "b", 1.5, 1.0)],
                               "pair_id long, chosen string, rejected string, score_chosen double, score_rejected double")
    assert sorted(r[0] for r in P.filter_pairs(df).select("pair_id").collect()) == [1, 2]
    both_absent = df.drop("score_chosen", "score_rejected")
    assert P.filter_pairs(both_absent).count() == 0
    one_absent = df.drop("score_chosen").withColumn("score_rejected", F.lit(-1.0))
    assert P.filter_pairs(one_absent).count() == 3


def test_c2_uses_last_message_of_lists(spark):
    df = spark.createDataFrame([(1, [("user", "q"), ("assistant", "x" * 1201)], [("assistant", "ok")], None),
                                (2, [("user", "q" * 5000), ("assistant", "fine")], [("assistant", "ok")], None)],
                               f"pair_id long, chosen {MSG}, rejected {MSG}, score_chosen double")
    assert [r[0] for r in P.filter_pairs(df).select("pair_id").collect()] == [2]


def test_c6_funnel_counts(spark):
    stats = FX.fd1_stats(spark, SF001)
    rows = P.funnel(stats, [("a", F.col("n_turns") >= 1), ("b", F.col("n_turns") <= 6),
                            ("c", F.col("n_chars") <= 2000)]).orderBy("stage_no").collect()
    assert rows[0]["n_in"] == 100 and rows[-1]["n_kept"] == 28
    assert all(rows[i]["n_kept"] == rows[i + 1]["n_in"] for i in range(len(rows) - 1))


def test_d2_shapes(spark):
    df = spark.createDataFrame(
        [(1, "hi", [("user", "q"), ("assistant", "A")], [("assistant", "B")])],
        f"pair_id long, prompt string, chosen {MSG}, rejected {MSG}")
    r = P.to_pairs(df, keep=("pair_id",)).first()
    assert [tuple(m) for m in r["prompt"]] == [("user", "hi")]
    assert [tuple(m) for m in r["chosen"]] == [("assistant", "A")]
    assert [tuple(m) for m in r["rejected"]] == [("assistant", "B")]
    assert P.to_pairs(df).columns == ["prompt", "chosen", "rejected"]
    t = spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string")
    r = P.to_pairs(t).first()
    assert [tuple(m) for m in r["chosen"]] == [("assistant", "c")]


def test_d3_legacy_prompt(spark):
    df = spark.createDataFrame([("sys", "", "q"), (None, "in", "q"), ("", None, None)],
                               "system string, input string, question string")
    out = [[tuple(m) for m in r["prompt"]] for r in P.legacy_prompt(df).collect()]
    assert out == [[("system", "sys"), ("user", "q")], [("user", "in")], [("user", "")]]


def test_d4_chatml(spark):
    df = spark.createDataFrame([([("user", "hi"), ("assistant", "yo")],)], f"m {MSG}")
    r = df.select(render_chatml("m", True)).first()[0]
    assert r == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>assistant\n"


def test_j1_order_independent_of_partitioning(spark):
    base = FX.fd1_stats(spark, SF001).select("conv_id")
    a = [r[0] for r in P.seeded_order(base.repartition(1), "conv_id").collect()]
    b = [r[0] for r in P.seeded_order(base.repartition(7), "conv_id").collect()]
    assert a == b and len(a) == 100


def test_j2_sample_is_the_head_of_the_order(spark):
    base = FX.fd1_stats(spark, SF001)
    s = P.seeded_sample(base, "conv_id", 10).collect()
    order = [r["conv_id"] for r in P.seeded_order(base, "conv_id").collect()]
    assert [r["conv_id"] for r in sorted(s, key=lambda r: r["sample_rank"])] == order[:10]
    assert sorted(r["sample_rank"] for r in s) == list(range(1, 11))
    assert P.seeded_sample(base, "conv_id", 1000).count() == 100


def test_j2_repeated_and_null_ids_count_one_by_one(spark):
    rows = [(1, f"row{i}") for i in range(8)] + [(i, "x") for i in range(2, 20)] + [(None, "n1"), (None, "n2")]
    df = spark.createDataFrame(rows, "id long, text string")
    for n in (1, 5, 8, 12, 27, 28, 50):
        got = P.seeded_sample(df, "id", n).collect()
        assert len(got) == min(n, 28) and len({(r["id"], r["text"]) for r in got}) == len(got)
        assert sorted(r["sample_rank"] for r in got) == list(range(1, min(n, 28) + 1))
        again = P.seeded_sample(df.repartition(5), "id", n).collect()
        assert {tuple(r) for r in again} == {tuple(r) for r in got}


def test_j3_disjoint_and_short_pool(spark):
    base = FX.fd1_stats(spark, SF001)
    s = P.train_eval_split(base, "conv_id", 30, 10).collect()
    train = {r["conv_id"] for r in s if r["split"] == "train"}
    ev = {r["conv_id"] for r in s if r["split"] == "eval"}
    assert len(train) == 30 and len(ev) == 10 and not (train & ev)
    with pytest.raises(ValueError):
        P.train_eval_split(base, "conv_id", 95, 10)


def test_j4_first_n(spark):
    base = FX.fd1_stats(spark, SF001)
    assert [r[0] for r in P.first_n(base, 3, "conv_id").select("conv_id").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        P.first_n(base, 101, "conv_id")


def test_j5_preview_uses_group_limit(spark):
    from prefscope.operators.scoring import score_qa
    s = score_qa(FX.fd3_responses(spark, SF001))
    p = P.preview(s, 10, "model", "q_id")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    rows = p.collect()
    assert len(rows) == 30 and max(r["q_id"] for r in rows) == 9


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_with_position_numbers_wide_rows(spark, adaptive):
    """Every row once, in order, whatever AQE does with the partitions."""
    df = spark.range(0, 60_000).select(
        ((F.col("id") * 7919) % 60_000 * 3).alias("key"), F.md5(F.col("id").cast("string")).alias("text"),
        F.repeat(F.md5(F.col("id").cast("string")), 6).alias("wide"))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        got = P.with_position(df, ["key"], "pos")
        assert got.columns == ["key", "text", "wide", "pos"]
        assert got.where("pos * 3 <> key").count() == 0 and got.count() == 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_with_position_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (2, "c"), (None, "d"), (1, "e")], "k long, t string")
    got = {r["t"]: r["pos"] for r in P.with_position(df, ["k"], "pos").collect()}
    assert sorted(got.values()) == [0, 1, 2, 3, 4]
    assert {got["a"], got["d"]} == {0, 1} and got["e"] == 2 and {got["b"], got["c"]} == {3, 4}
    assert P.with_position(df.limit(0), ["k"]).count() == 0


def test_running_accuracy_on_sparse_ids(spark):
    from prefscope.operators import scoring as H
    rows = [(m, 3 * i, i % 4 == 0) for m in ("Base", "DPO") for i in range(2000)]
    df = spark.createDataFrame(rows, "model string, idx long, correct boolean").withColumn(
        "wide", F.repeat(F.lit("x"), 300))
    got = H.running_accuracy(df, every=10).collect()
    assert len(got) == 2 * 199
    assert all(r["hits_so_far"] == -(-r["idx"] // 4) for r in got)


@pytest.mark.parametrize("most", [2, 100_000])
def test_preview_shuffles_no_more_than_its_rows(spark, monkeypatch, most):
    """The wide rows meet the last key of each value where they are read, even
    when Spark takes neither side to be small; many values are ranked at once."""
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("model"), F.col("id").alias("idx"),
                                  F.repeat(F.lit("x"), 50).alias("response"))
    monkeypatch.setattr(P, "PREVIEW_VALUES", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.preview(df, 4)
        assert sorted(r["idx"] for r in out.collect()) == list(range(12))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert "WindowGroupLimit" in plan

"""Sources and sinks round trips; I1 against a window over all rows."""

import json
import random
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from prefscope.operators import report as R
from prefscope.operators import scoring as H
from prefscope.plans.queries import METRIC_LABELS
from prefscope.sources import readers, writers


METRICS = {  # one bundle per model, as the harness stores them, with made-up samples
    "Base": (42.5, 20.0, 8.0, 16.0, [("p1", "r1"), ("p2", "r\n2")], [("q1", "4", "5", "it is 5")]),
    "SFT": (47.08, 64.0, 37.0, 12.0, [("p1", "other")], [("q1", "4", None, "none")]),
    "DPO": (48.83, 72.0, 36.0, 44.0, [], []),
}


def metric_files(models=("Base", "SFT", "DPO")):
    out = tempfile.mkdtemp(prefix="prefscope-test-")
    for m in models:
        ppl, instr, qa, cot, samples, graded = METRICS[m]
        with open(f"{out}/{m}_metrics.json", "w") as f:
            json.dump({"perplexity": ppl, "instruction_following_acc_pct": instr, "gsm8k_acc_pct": qa,
                       "cot_presence_pct": cot,
                       "instr_samples": [{"prompt": p, "response": r} for p, r in samples],
                       "gsm8k_samples": [dict(zip(("question", "gold", "pred", "response"), g)) for g in graded]},
                      f, indent=2)
    return {m: f"{out}/{m}_metrics.json" for m in ("Base", "SFT", "DPO")}


def test_a5_metrics(spark):
    got = {r["model"]: r for r in readers.read_metrics(spark, metric_files()).collect()}
    for m, (ppl, instr, qa, cot, samples, graded) in METRICS.items():
        r = got[m]
        assert (r["perplexity"], r["instruction_following_acc_pct"], r["gsm8k_acc_pct"], r["cot_presence_pct"]) == (
            ppl, instr, qa, cot)
        assert [tuple(x) for x in r["instr_samples"]] == samples and [tuple(x) for x in r["gsm8k_samples"]] == graded


def test_a7_a_missing_file_gives_nulls(spark):
    bundle = readers.read_metrics(spark, metric_files(("SFT", "DPO")))
    table = {r["metric"]: r for r in R.compare(R.to_long(bundle, METRIC_LABELS)).collect()}
    assert len(table) == 4 and all(r["Base"] is None for r in table.values())
    assert (table["Perplexity"]["SFT"], table["CoT Presence (%)"]["DPO"]) == (47.08, 44.0)
    none = readers.read_metrics(spark, {"Base": "/tmp/prefscope-no-such-file.json"})
    assert none.count() == 0 and "gsm8k_samples" in none.columns


def test_comparison_and_gain(spark):
    table = R.compare(R.to_long(readers.read_metrics(spark, metric_files()), METRIC_LABELS))
    gain = {r["metric"]: r for r in R.relative_gain(table).collect()}
    assert gain["Instruction-Follow Acc (%)"]["diff"] == 8.0 and gain["GSM8K Acc (%)"]["diff"] == -1.0


def test_b1_write_metrics_round_trip(spark):
    bundle = readers.read_metrics(spark, metric_files())
    out = tempfile.mkdtemp(prefix="prefscope-test-")
    for m in METRICS:
        writers.write_metrics(bundle.where(F.col("model") == m).drop("model").coalesce(1), f"{out}/{m}")
    back = readers.read_metrics(spark, {m: f"{out}/{m}" for m in METRICS})
    assert sorted(map(str, back.collect())) == sorted(map(str, bundle.collect()))


def test_b1_write_bundles_round_trip(spark):
    bundle = readers.read_metrics(spark, metric_files())
    out = tempfile.mkdtemp(prefix="prefscope-test-") + "/bundles"
    writers.write_bundles(bundle, out)
    back = readers.read_metrics(spark, {m: f"{out}/model={m}" for m in METRICS})
    assert sorted(map(str, back.collect())) == sorted(map(str, bundle.collect()))


def test_b5_sweep_to_csv_and_json(spark):
    rows = [("c", "p\n1", "Base", 'say "hi", then'), ("c", "p2", "DPO", "")]
    df = spark.createDataFrame(rows, "category string, prompt string, model string, response string")
    out = tempfile.mkdtemp(prefix="prefscope-test-")
    writers.write_table(df, f"{out}/json", "json")
    assert sorted(map(tuple, writers.read_table(spark, f"{out}/json", df.schema, "json").collect())) == sorted(rows)
    writers.write_table(df, f"{out}/csv", "csv")
    back = sorted((r["prompt"], r["response"] or "") for r in writers.read_table(spark, f"{out}/csv", df.schema).collect())
    assert back == sorted((p, r) for _, p, _, r in rows)


def test_b6_validation_summary(spark):
    df = spark.createDataFrame([(100, 70.0, 0.527181)], "n_pairs long, preference_accuracy_pct double, mean_margin double")
    out = tempfile.mkdtemp(prefix="prefscope-test-") + "/summary"
    writers.write_metrics(df, out)
    assert [tuple(r) for r in spark.read.schema(df.schema).json(out).collect()] == [(100, 70.0, 0.527181)]


def test_reading_json_runs_no_inference_job(spark):
    d = tempfile.mkdtemp(prefix="prefscope-test-")
    with open(f"{d}/pairs.json", "w") as f:
        f.write(json.dumps({"pair_id": 1, "prompt": "p", "chosen": [{"role": "assistant", "content": "c"}],
                            "rejected": [], "score_chosen": 2, "extra": [1]}) + "\n")
    sc = spark.sparkContext
    sc.setJobGroup("inference", "reading")
    try:
        df = readers.read_pairs(spark, f"{d}/pairs.json", lists=("chosen", "rejected"))
        assert sc.statusTracker().getJobIdsForGroup("inference") == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    r = df.first()
    assert (r["prompt"], r["chosen"][0]["content"], r["rejected"], r["score_chosen"], r["score_rejected"]) == (
        "p", "c", [], 2.0, None)
    assert "score_chosen" not in readers.read_pairs(spark, f"{d}/pairs.json", scores=False).columns


def test_csv_multiline_round_trip(spark):
    out = tempfile.mkdtemp(prefix="prefscope-test-") + "/t"
    df = spark.createDataFrame([(1, 'line1\nline2 "q", x'), (2, "plain")], "id long, text string")
    writers.write_table(df, out, "csv")
    back = writers.read_table(spark, out, schema="id long, text string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_pairs_split_prunes_partitions(spark):
    out = tempfile.mkdtemp(prefix="prefscope-test-") + "/pairs"
    df = spark.createDataFrame([(1, "a", "train_prefs"), (2, "b", "test_prefs")], "pair_id long, prompt string, split string")
    writers.write_table(df, out, "parquet", partition_by=["split"])
    r = readers.read_pairs(spark, out, "test_prefs")
    assert [x["pair_id"] for x in r.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in r._jdf.queryExecution().executedPlan().toString() or \
        "PartitionFilters" in r._jdf.queryExecution().executedPlan().toString()


def test_prompt_suite_dicts(spark):
    s = readers.prompt_suite(spark, [{"category": "c", "prompt": "p", "max_tokens": 10,
                                      "temperature": 0.2, "top_p": 0.9}])
    r = s.first()
    assert (r["prompt_id"], r["prompt"], r["max_tokens"]) == (0, "p", 10)


def test_i1_two_level_prefix_equals_window(spark):
    rnd = random.Random(3)
    rows = [(m, i, rnd.random() < 0.4) for m in ("Base", "SFT") for i in range(537)]
    df = spark.createDataFrame(rows, "model string, idx long, correct boolean")
    got = {(r["model"], r["idx"]): r["running_acc_pct"]
           for r in H.running_accuracy(df, every=10, fanout=3, dense=True).collect()}
    w = Window.partitionBy("model").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("h", F.coalesce(F.sum(F.col("correct").cast("int")).over(w), F.lit(0))) \
        .where((F.col("idx") > 0) & (F.col("idx") % 10 == 0))
    exp = {(r["model"], r["idx"]): round(100.0 * r["h"] / r["idx"], 6) for r in ref.collect()}
    assert got == exp and len(got) == 2 * 53


def test_a1_array_form_json(spark):
    import os
    from prefscope.functions.chat import render_chatml, last_content
    from prefscope.operators import prep
    d = tempfile.mkdtemp(prefix="prefscope-test-")
    rows = [{"conv_id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
            {"conv_id": 2, "messages": [{"role": "user", "content": "x" * 2001}]}]
    with open(os.path.join(d, "c.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    conv = readers.read_conversations(spark, os.path.join(d, "c.json"))
    kept = prep.filter_conversations(conv).select(
        "conv_id", last_content("messages").alias("last"), render_chatml("messages").alias("chatml")).collect()
    assert [(r["conv_id"], r["last"]) for r in kept] == [(1, "yo")]
    assert kept[0]["chatml"].startswith("<|im_start|>user\nhi<|im_end|>\n")


def test_a3_a4_readers(spark):
    import os
    texts = readers.read_texts(spark, "/root/testdata/sf0.01/benchmark.parquet")
    assert texts.count() == 40 and "text" in texts.columns
    d = tempfile.mkdtemp(prefix="prefscope-test-")
    with open(os.path.join(d, "qa.json"), "w") as f:
        f.write(json.dumps({"question": "2+2?", "answer": "so\\n#### 4"}) + "\n")
    with open(os.path.join(d, "lines.txt"), "w") as f:
        f.write("one line\nanother line\n")
    qa = H.score_qa(readers.read_qa(spark, os.path.join(d, "qa.json")).withColumn("response", F.lit("it is 4")))
    assert qa.select("gold", "pred", "correct").first() == ("4", "4", True)
    assert readers.read_texts(spark, os.path.join(d, "lines.txt"), fmt="text").count() == 2


def test_i1_sparse_ids(spark):
    rnd = random.Random(5)
    rows = [(m, i * 7 + 3, rnd.random() < 0.5) for m in ("Base", "SFT") for i in range(123)]
    df = spark.createDataFrame(rows, "model string, key long, correct boolean")
    got = {(r["model"], r["key"]): r["running_acc_pct"]
           for r in H.running_accuracy(df, every=10, idx="key").collect()}
    dense = spark.createDataFrame([(m, (k - 3) // 7, c) for m, k, c in rows], "model string, idx long, correct boolean")
    exp = {(r["model"], r["idx"]): r["running_acc_pct"] for r in H.running_accuracy(dense, every=10, dense=True).collect()}
    assert got == exp and len(got) == 24


def test_spread_leaves_split_inputs_alone(spark):
    from prefscope.parallel import spread
    many = spark.range(0, 1000, numPartitions=9)
    assert spread(many) is many
    one = spark.range(0, 1000, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, 8)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from prefscope.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())

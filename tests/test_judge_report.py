"""L, H5-H7, H9, H10, G and M operators."""

import pytest

from prefscope.operators import judge as L
from prefscope.operators import report as R


def test_l1_first_parsable_attempt(spark):
    a = spark.createDataFrame([
        (1, 3, '{"winner":"SFT"}'), (1, 1, "oops"), (1, 2, '{"winner":"DPO","reason":"r"}'),
        (2, 1, "bad"), (2, 2, '{"a":1} trailing'), (3, 5, ' {"reason":"x"} ')],
        "prompt_id long, attempt long, raw string")
    out = {r["prompt_id"]: (r["winner"], r["reason"]) for r in L.resolve_verdicts(a).collect()}
    assert out[1] == ("DPO", "r")
    assert out[2] == (L.ERROR_WINNER, L.ERROR_REASON)
    assert out[3] == ("Tie", "x")
    prompts = spark.createDataFrame([(1,), (4,)], "prompt_id long")
    out = {r["prompt_id"]: r["winner"] for r in L.resolve_verdicts(a, prompts).collect()}
    assert out == {1: "DPO", 4: "Error"}
    off = L.resolve_verdicts(a, configured=False).collect()
    assert {r["winner"] for r in off} == {"Tie"} and len(off) == 3


def test_h6_h7(spark):
    v = spark.createDataFrame([("DPO",), ("DPO",), ("Error",), ("Judge",)], "winner string")
    c = {r["winner"]: r["n"] for r in L.verdict_counts(v).collect()}
    assert c == {"Base": 0, "SFT": 0, "DPO": 2, "Tie": 0, "Error": 1, "Judge": 1}
    w = {r["winner"]: r["win_rate_pct"] for r in L.win_rates(L.verdict_counts(v)).collect()}
    assert w == {"Base": 0.0, "SFT": 0.0, "DPO": 100.0, "Tie": 0.0}
    only_err = spark.createDataFrame([("Error",)], "winner string")
    assert L.win_rates(L.verdict_counts(only_err)).count() == 0


def test_h5_unequal_lengths(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "idx long, response string")
    b = spark.createDataFrame([(0, "x")], "idx long, response string")
    r = R.identical_pct(a, b).first()
    assert not r["comparable"] and r["identical_pct"] == 0.0
    r = R.identical_pct(a, a).first()
    assert r["comparable"] and r["identical_pct"] == 100.0
    empty = a.where("false")
    assert R.identical_pct(empty, empty).first()["identical_pct"] == 0.0


def test_g1_and_l3(spark):
    r = spark.createDataFrame([(1, "Base", "a"), (1, "SFT", "b"), (1, "DPO", "c"), (2, "Base", "d")],
                              "prompt_id long, model string, response string")
    s = R.side_by_side(r, keys=("prompt_id",))
    assert s.columns == ["prompt_id", "Base", "SFT", "DPO"]
    v = spark.createDataFrame([(1, "DPO", "why")], "prompt_id long, winner string, reason string")
    j = L.judged(s, v).collect()
    by = {x["prompt_id"]: x for x in j}
    assert len(j) == 2 and by[1]["SFT"] == "b" and by[1]["winner"] == "DPO"
    assert (by[2]["Base"], by[2]["winner"], by[2]["reason"]) == ("d", L.ERROR_WINNER, L.ERROR_REASON)


def test_g1_repeated_response(spark):
    r = spark.createDataFrame([(1, "Base", "a", 2), (1, "Base", "z", 1)], "item_id long, model string, response string, o int")
    assert R.side_by_side(r, order="o").first()["Base"] == "a"
    with pytest.raises(Exception, match="twice"):
        R.side_by_side(r).collect()


def test_d7_template(spark):
    df = spark.createDataFrame([("P", "b", None, "d")], "prompt string, Base string, SFT string, DPO string")
    t = df.select(L.judge_prompt()).first()[0]
    assert "[USER PROMPT]:\n    P\n" in t and "[SFT RESPONSE]:\n    None\n" in t
    assert t.startswith("\n    You are an expert AI evaluator.") and t.endswith("}\n    ")


def test_g4_grid_is_not_a_join(spark):
    p = spark.createDataFrame([(1, "q", 0.0, 1.0), (2, "r", 0.3, 0.9)],
                              "prompt_id long, prompt string, temperature double, top_p double")
    g = R.request_grid(p)
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    rows = {(r["prompt_id"], r["model"]): r for r in g.collect()}
    assert len(rows) == 6
    assert rows[(1, "SFT")]["eff_temperature"] == 1.0 and not rows[(1, "SFT")]["do_sample"]
    assert rows[(2, "DPO")]["eff_top_p"] == 0.9 and rows[(2, "Base")]["is_chat"] is False


def test_g6_fallback(spark):
    req = spark.createDataFrame([("Base",), ("SFT",), ("DPO",)], "model string")
    got = {r["model"]: r["served_model"] for r in R.resolve_model(req, ["Base"]).collect()}
    assert got == {"Base": "Base", "SFT": "Base", "DPO": "Base"}
    got = {r["model"]: r["served_model"] for r in R.resolve_model(req, ["Base", "SFT", "DPO"]).collect()}
    assert got == {"Base": "Base", "SFT": "SFT", "DPO": "DPO"}


def test_h9_h10_m2(spark):
    a = spark.createDataFrame([("acc", 10.0)], "metric string, value double")
    b = spark.createDataFrame([("acc", 20.0), ("ppl", 0.0)], "metric string, value double")
    long = R.stack_models({"SFT": b, "DPO": a})
    t = R.compare(long)
    rows = {r["metric"]: r for r in t.collect()}
    assert rows["acc"]["Base"] is None and rows["acc"]["SFT"] == 20.0
    g = {r["metric"]: r for r in R.relative_gain(t).collect()}
    assert g["acc"]["diff"] == -10.0 and g["acc"]["ratio"] == 0.5
    assert g["ppl"]["ratio"] is None and g["ppl"]["new_value"] is None


def test_identical_pcts_matches_pairwise(spark):
    r = spark.createDataFrame([(0, "Base", "x"), (0, "SFT", "x"), (1, "Base", "y"), (1, "SFT", "z"),
                               (2, "Base", "w")], "idx long, model string, response string")
    wide = R.side_by_side(r, keys=("idx",))
    got = R.identical_pcts(wide, (("Base", "SFT"),)).first()
    exp = R.identical_pct(r.where("model = 'Base'"), r.where("model = 'SFT'")).first()
    assert (got["n_a"], got["n_b"], got["n_equal"], got["comparable"], got["identical_pct"]) == \
        (exp["n_a"], exp["n_b"], exp["n_equal"], exp["comparable"], exp["identical_pct"])


def test_win_rates_sum_to_100(spark):
    from conftest import SF001
    from prefscope.plans import fixtures as FX
    rates = L.win_rates(L.verdict_counts(L.resolve_verdicts(FX.fd4_attempts(spark, SF001)))).collect()
    assert len(rates) == 4 and abs(sum(r["win_rate_pct"] for r in rates) - 100.0) < 1e-9


def test_g4_without_generation_settings(spark):
    p = spark.createDataFrame([(1, "q")], "prompt_id long, prompt string")
    g = R.request_grid(p)
    assert g.columns == ["prompt_id", "prompt", "model", "is_chat"] and g.count() == 3

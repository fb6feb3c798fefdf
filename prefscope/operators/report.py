"""Reports across models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The checkpoints in report order and whether each one is
# prompted with the chat template.
MODELS = ("Base", "SFT", "DPO")
MODEL_IS_CHAT = (("Base", False), ("SFT", True), ("DPO", True))
# Fallback chain when a checkpoint is missing: DPO -> SFT -> Base.
FALLBACK = {"Base": ("Base",), "SFT": ("SFT", "Base"), "DPO": ("DPO", "SFT", "Base")}


# G1 ------------------------------------------------------------------------
def side_by_side(responses: DataFrame, keys: Sequence[str] = ("item_id",),
                 models: Sequence[str] = MODELS, model: str = "model",
                 value: str = "response", order: str | None = None) -> DataFrame:
    """G1: one row per item, one column per model. A pivot with a fixed value
    list is one aggregation shuffle (and no extra distinct job). Of a repeated
    (item, model) the last in ``order`` stays, as in a dict that is written
    again; without an order column a repetition is an error at run time."""
    if order is not None:
        return responses.groupBy(*keys).pivot(model, list(models)).agg(F.max_by(value, order))
    one = responses.groupBy(*keys).pivot(model, list(models)).agg(
        F.max(value).alias("v"), F.count(F.lit(1)).alias("n"))
    repeated = F.raise_error(F.lit("side_by_side: an item has a model's response twice; pass order="))
    return one.select(*keys, *[
        F.when(F.col(f"{m}_n") > 1, repeated.cast(responses.schema[value].dataType))
        .otherwise(F.col(f"{m}_v")).alias(m) for m in models])


# G4 / D8 -------------------------------------------------------------------
def request_grid(prompts: DataFrame, models=MODEL_IS_CHAT) -> DataFrame:
    """Every prompt for every model, with D8's generation settings:
    sample iff temperature > 0; the effective temperature is at least 0.01
    when sampling, 1.0 otherwise; top_p is 1.0 when greedy.

    The model list is a literal array exploded per prompt (a narrow Generate),
    not a join, so no cartesian product appears in the plan."""
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("is_chat"))
                    for m, c in models])
    g = prompts.select("*", F.inline(arr))
    if "temperature" in prompts.columns:
        t = F.col("temperature")
        sample = t > 0.0
        g = g.withColumn("do_sample", sample) \
             .withColumn("eff_temperature", F.when(sample, F.greatest(t, F.lit(0.01))).otherwise(F.lit(1.0))) \
             .withColumn("eff_top_p", F.when(sample, F.col("top_p")).otherwise(F.lit(1.0)))
    return g


# G6 ------------------------------------------------------------------------
def resolve_model(requests: DataFrame, available: Sequence[str],
                  model: str = "model") -> DataFrame:
    """The checkpoint that serves each request: the requested one if
    present, else down the chain DPO -> SFT -> Base. ``available`` is the
    (small, fixed) list of loaded checkpoints, compiled into a CASE."""
    avail = set(available)
    served: Column | None = None
    for m, chain in FALLBACK.items():
        pick = next((c for c in chain if c in avail), "Base")
        cond = F.col(model) == m
        served = F.when(cond, F.lit(pick)) if served is None else served.when(cond, F.lit(pick))
    return requests.withColumn("served_model", served.otherwise(F.lit("Base")))


def resolve_available(requests: DataFrame, availability: DataFrame, keys: Sequence[str],
                      model: str = "model") -> DataFrame:
    """G6 where what is loaded differs from request to request: ``availability``
    has a row (keys, model) for every checkpoint that is there. One aggregate
    gives a flag per checkpoint and key; requests join it on their keys and take
    the first of their chain that is there. Base serves what nothing else does,
    also where a key has no row; unknown models are served by Base. Rows that
    repeat in ``availability`` count once."""
    flags = availability.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[
        F.max(F.col(model).eqNullSafe(m)).alias(f"_has_{m}") for m in FALLBACK])
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    joined = requests.join(flags, on, "left")
    served = F.lit("Base")
    for m, chain in FALLBACK.items():
        first = F.coalesce(*[F.when(F.col(f"_has_{c}"), F.lit(c)) for c in chain], F.lit("Base"))
        served = F.when(F.col(model) == m, first).otherwise(served)
    return joined.select(*requests.columns, served.alias("served_model"))


# H5 ------------------------------------------------------------------------
def identical_pct(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("idx",),
                  value: str = "response") -> DataFrame:
    """H5: share of positions where both sides' responses are equal. 0.0 when
    either side is empty or the sides differ in length (the harness hides
    that case; ``comparable`` exposes it). One full outer join on the
    position keys, one aggregate. Positions are unique per side (as in the
    harness's zip), so the join never pairs more than one row per key."""
    j = a.select(*keys, F.col(value).alias("_a")).join(
        b.select(*keys, F.col(value).alias("_b")), list(keys), "full")
    agg = j.agg(
        F.count("_a").alias("n_a"), F.count("_b").alias("n_b"),
        F.count_if(F.col("_a") == F.col("_b")).alias("n_equal"))
    ok = (F.col("n_a") == F.col("n_b")) & (F.col("n_a") > 0)
    return agg.select(
        "n_a", "n_b", "n_equal", ok.alias("comparable"),
        F.when(ok, F.lit(100.0) * F.col("n_equal") / F.col("n_a")).otherwise(F.lit(0.0))
        .alias("identical_pct"))


def identical_pcts(wide: DataFrame, pairs: Sequence[tuple[str, str]],
                   by: Sequence[str] = ()) -> DataFrame:
    """H5 for several model pairs at once, from a side-by-side table (G1:
    one row per position, one column per model): one aggregate over the
    already-pivoted rows instead of a join per pair, for each value of ``by``
    (G2: the task, when positions are (task, idx)). Returns (by, model_a,
    model_b, n_a, n_b, n_equal, comparable, identical_pct)."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += [F.count(a).alias(f"a{i}"), F.count(b).alias(f"b{i}"),
                 F.count_if(F.col(a) == F.col(b)).alias(f"e{i}")]
    counts = wide.groupBy(*by).agg(*aggs)
    rows = []
    for i, (a, b) in enumerate(pairs):
        na, nb, ne = F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"e{i}")
        ok = (na == nb) & (na > 0)
        rows.append(F.struct(
            F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), na.alias("n_a"), nb.alias("n_b"),
            ne.alias("n_equal"), ok.alias("comparable"),
            F.when(ok, F.lit(100.0) * ne / na).otherwise(F.lit(0.0)).alias("identical_pct")))
    return counts.select(*by, F.inline(F.array(*rows)))


def sample_overlap(bundles: DataFrame, pairs: Sequence[tuple[str, str]], model: str = "model",
                   samples=(("qa", "gsm8k_samples"), ("instructions", "instr_samples"))) -> DataFrame:
    """G2 and H5 from metric bundles, as they are stored: the sample arrays of
    two models are matched by position, one row per task and pair. Arrays of
    different length, empty, null or missing (a model without a bundle) give
    0.0 and are not comparable. A null response equals only another one."""
    rows = None
    for task, column in samples:
        one = bundles.select(F.lit(task).alias("task"), model, F.posexplode_outer(F.col(column)["response"]).alias("idx", "r"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.select("task", "idx", model, F.when(F.col("idx").isNotNull(), F.concat(
        F.col("r").isNull().cast("string"), F.coalesce("r", F.lit("")))).alias("response"))
    return identical_pcts(side_by_side(rows, keys=("task", "idx")), pairs, by=("task",))


# H9 ------------------------------------------------------------------------
def to_long(bundle: DataFrame, metrics: Mapping[str, str], model: str = "model") -> DataFrame:
    """Unpivot metric columns into (model, metric, value)."""
    return bundle.select(model, F.inline(F.array(*[
        F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"))
        for label, c in metrics.items()])))


def compare(metrics_long: DataFrame, models: Sequence[str] = MODELS,
            model: str = "model") -> DataFrame:
    """H9: metric x model table. Missing models or metrics are null cells
    (A7: report only what exists)."""
    return metrics_long.groupBy("metric").pivot(model, list(models)).agg(F.max("value"))


# H10 -----------------------------------------------------------------------
def relative_gain(table: DataFrame, base: str = "SFT", new: str = "DPO") -> DataFrame:
    """Difference and ratio of ``new`` against ``base`` per metric."""
    return table.select(
        "metric", F.col(base).alias("base_value"), F.col(new).alias("new_value"),
        (F.col(new) - F.col(base)).alias("diff"),
        F.try_divide(F.col(new), F.col(base)).alias("ratio"))


# M2 ------------------------------------------------------------------------
def stack_models(frames: Mapping[str, DataFrame], model: str = "model") -> DataFrame:
    """M2: stack per-model tables into one, tagged by model."""
    out = None
    for name, df in frames.items():
        tagged = df.select(F.lit(name).alias(model), "*")
        out = tagged if out is None else out.unionByName(tagged)
    return out

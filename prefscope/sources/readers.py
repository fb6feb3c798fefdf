"""Sources A1-A7: explicit schemas, shape decisions made once at ingestion."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefscope import schemas as S


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None) -> DataFrame:
    fmt = fmt or ("json" if path.endswith((".json", ".jsonl")) else "parquet")
    return spark.read.schema(schema).format(fmt).load(path)


def read_conversations(spark: SparkSession, path: str, fmt: str | None = None,
                       long: bool = False) -> DataFrame:
    """A1: conversations as (conv_id, messages), or with ``long`` as one row
    per message (conv_id, turn, role, text), which ``prep`` aggregates."""
    return _read(spark, path, S.CONVERSATION_ROW if long else S.CONVERSATION, fmt)


def read_pairs(spark: SparkSession, path: str, split: str | None = None,
               fmt: str | None = None, lists: Sequence[str] = (), scores: bool = True,
               min_gap: float | None = None, max_chars: int | None = None) -> DataFrame:
    """A2: preference pairs. The caller says which of prompt, chosen and
    rejected are message lists (the others are text) and whether the source
    has score columns. Stored partitioned by ``split``, so the ``split = ..``
    filter prunes whole directories. On pairs of ``write_pairs``, ``min_gap``
    and ``max_chars`` are C3 and C2 on the stored gap and length, which prune
    row groups; a null gap passes."""
    schema = S.pair_schema(lists, scores)
    if min_gap is not None or max_chars is not None:
        names = [*schema.names, *(["split"] if split is not None else [])]
        schema = schema.add("score_gap", "double").add("longest_side", "integer")
        rows = _read(spark, path, schema.add("split", "string"), fmt)
        if split is not None:
            rows = rows.where(F.col("split") == split)
        if min_gap is not None:
            rows = rows.where(F.col("score_gap").isNull() | (F.col("score_gap") >= float(min_gap)))
        if max_chars is not None:
            rows = rows.where(F.col("longest_side") <= max_chars)
        return rows.select(*names)
    if split is None:
        return _read(spark, path, schema, fmt)
    return _read(spark, path, schema.add("split", "string"), fmt).where(F.col("split") == split)


def read_texts(spark: SparkSession, path: str, fmt: str | None = None,
               id_col: str | None = None) -> DataFrame:
    """A3: held-out texts (``text``, with ``id_col`` a long id in front; plain
    text files give one row per line)."""
    if fmt == "text":
        return spark.read.text(path).withColumnRenamed("value", "text")
    schema = T.StructType() if id_col is None else T.StructType().add(id_col, "long")
    return _read(spark, path, schema.add("text", "string"), fmt)


def read_qa(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A4: maths QA items (question, answer)."""
    return _read(spark, path, S.QA, fmt)


def read_attempts(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Recorded judge attempts (prompt_id, attempt, raw), the input of L1."""
    return _read(spark, path, S.ATTEMPT, fmt)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_metrics(spark: SparkSession, paths: Mapping[str, str], keep_missing: bool = False) -> DataFrame:
    """A5: one metric-bundle JSON document per model, tagged by model. The
    file name is matched through ``_metadata.file_path`` in one scan. A7: a
    model whose file is not there is left out, so a comparison shows nulls;
    with ``keep_missing`` the expected models are outer-joined and it is a row
    of nulls."""
    if keep_missing:
        expected = spark.createDataFrame([(m,) for m in paths], "model string")
        return expected.join(read_metrics(spark, paths), "model", "left")
    names = [f.name for f in S.METRIC_BUNDLE.fields]
    by_path = {p: m for m, p in paths.items() if _exists(spark, p)}
    if not by_path:
        return spark.createDataFrame([], T.StructType([T.StructField("model", T.StringType()),
                                                       *S.METRIC_BUNDLE.fields]))
    df = (spark.read.schema(S.METRIC_BUNDLE).option("multiLine", True)
          .json(list(by_path))
          .select("*", F.col("_metadata.file_path").alias("_path")))
    model = None
    # Longest path first, so that ``/m/SFT`` is not taken for ``/m/SFT2``.
    for p, m in sorted(by_path.items(), key=lambda kv: -len(kv[0])):
        p = p.rstrip("/")
        cond = F.col("_path").endswith(p) | F.col("_path").contains(p + "/")
        model = F.when(cond, F.lit(m)) if model is None else model.when(cond, F.lit(m))
    return df.select(model.alias("model"), *names)


def prompt_suite(spark: SparkSession, rows: Iterable, schema=None) -> DataFrame:
    """An inline prompt suite. Plain strings become (prompt_id, prompt);
    dicts keep their fields (category, prompt, max_tokens, temperature,
    top_p) and get a prompt_id in list order."""
    rows = list(rows)
    if rows and isinstance(rows[0], str):
        return spark.createDataFrame(
            [(i, p) for i, p in enumerate(rows)], "prompt_id long, prompt string")
    schema = schema or S.PROMPT_SUITE
    names = [f.name for f in schema.fields if f.name != "prompt_id"]
    data = [(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)

"""Sinks B1-B6. Spark writes a directory of part files from the executors;
nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quote and escape with a double quote so multi-line text survives a CSV
# round trip (read back with multiLine=true and the same options).
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric bundles / summaries as JSON lines."""
    df.write.mode(mode).json(path)


def write_bundles(bundle: DataFrame, root: str, model: str = "model",
                  mode: str = "overwrite") -> None:
    """B1 for a per-model metric bundle: one JSON document per model under
    ``root/model=<name>`` (read back with ``read_metrics``), written by one
    job partitioned on the model column."""
    bundle.write.mode(mode).partitionBy(model).json(root)


def write_pairs(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The layout that A2, C2 and C3 read: one directory per ``split``, the
    score gap and the longer side's length stored as columns, and the rows of a
    file in the order of the gap, so that a bound on it skips row groups."""
    from prefscope.operators.prep import longest_side, score_gap
    (pairs.withColumns({"score_gap": score_gap(pairs).cast("double"), "longest_side": longest_side(pairs)})
     .sortWithinPartitions("split", "score_gap").write.mode(mode).partitionBy("split").parquet(path))


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Comparison tables, judged rows, showcases and sweeps. CSV
    output quotes multi-line text; JSON and parquet keep types."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.format(fmt).save(path)


def read_table(spark: SparkSession, path: str | list[str], schema=None, fmt: str = "csv",
               corrupt: str | None = None) -> DataFrame:
    """Read back what ``write_table`` wrote (also CSV files whose cells span
    lines; an empty text reads back as null). With ``corrupt`` and a schema, rows that don't fit the schema are
    kept: that column holds their text, and is null for the others."""
    r = spark.read
    if corrupt is not None:
        if schema is None:
            raise ValueError("rows can only be told broken by a schema")
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        r = r.options(mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt)
    if schema is not None:
        r = r.schema(schema)
    df = r.options(**CSV_OPTIONS).csv(path) if fmt == "csv" else r.format(fmt).load(path)
    if corrupt is None:
        return df
    # Only columns that a query asks for are parsed, and only these can be found
    # broken; so the text is tied to all of them, by a 0 made of their hash.
    fields = [F.col(f.name) for f in schema.fields if f.name != corrupt]
    nothing = F.least(F.pmod(F.xxhash64(*fields), F.lit(2)), F.lit(0)).cast("int")
    return df.withColumn(corrupt, F.substr(F.col(corrupt), nothing + 1))

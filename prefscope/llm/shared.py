"""What several operators share: tables written to the shared folder, joins
that stand a hot key, and row numbers without one task per group."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefscope.session import ensure_checkpoint_dir

#: Keys that hold more than 1 / HOT_KEYS of all rows are joined by broadcast;
#: by counting there are fewer than HOT_KEYS of them, whatever the input size.
HOT_KEYS = 1000
#: Cold rows keep salt 0; rows already matched are dealt over this many salts.
SPREAD = 4096
#: Rows per bucket that ``number_within`` aims at.
ROWS_PER_BUCKET = 500_000
#: Bytes of a row group of written tables: a writing task holds one in memory.
ROW_GROUP_BYTES = 32 << 20


def written(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed
    once, and not recomputed when an executor is lost. The files go when the
    application ends. ``parts``: at most so many files (``parts_for``)."""
    spark = df.sparkSession
    df = df if parts is None else df.coalesce(parts)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/prefscope-{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, n_rows: int) -> int:
    """Files for a table of up to ``n_rows`` short rows: one for each core, more
    for many rows. A shuffle may have far more partitions than such a table
    needs, and for each file Hadoop's local file system starts processes."""
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_BUCKET))


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str,
           spread_by: list[str], how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per key, its ``weight``
    being how many rows have the key). Heavy keys, of which there are fewer
    than ``HOT_KEYS`` by counting, are joined by broadcast; their rows then go
    through the shuffle join of the others on salts that match nothing, so no
    partition gets a hot key. ``rows`` is read once. Keys must not be null;
    ``table`` should be a written table, as it is read three times."""
    payload = [c for c in table.columns if c not in keys]
    total = table.agg(F.sum(weight)).first()[0] or 0
    bound = F.col(weight) * HOT_KEYS > F.lit(total)
    hot = table.where(bound).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        *[F.col(c).alias(f"_hot_v_{c}") for c in payload], F.lit(True).alias("_hot"))
    # The cold salt is 0, but as an expression of the keys: a literal would be
    # taken out of the join's keys, and hot rows would meet in one partition.
    none = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    cold = table.where(~bound).select(
        *[F.col(k).alias(f"_cold_{k}") for k in keys],
        *[F.col(c).alias(f"_cold_v_{c}") for c in payload],
        none.alias("_cold_salt"), F.lit(True).alias("_cold"))
    marked = rows.join(F.broadcast(hot), _all(F.col(k) == F.col(f"_hot_{k}") for k in keys),
                       "left")
    marked = marked.withColumn("_salt", F.when(
        F.col("_hot"), F.pmod(F.hash(*spread_by), F.lit(SPREAD)) + 1).otherwise(0).cast("int"))
    joined = marked.join(
        cold, _all([*(F.col(k) == F.col(f"_cold_{k}") for k in keys),
                    F.col("_salt") == F.col("_cold_salt")]), "left")
    if how == "inner":
        joined = joined.where(F.col("_hot") | F.col("_cold"))
    return joined.select(
        *rows.columns,
        *[F.when(F.col("_hot"), F.col(f"_hot_v_{c}")).otherwise(F.col(f"_cold_v_{c}")).alias(c)
          for c in payload])


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def number_within(df: DataFrame, group: str, spread_by: list[str], order: list[str],
                  n_rows: int, name: str) -> DataFrame:
    """``df`` with column ``name``: the rows of each group numbered from 0
    without gaps. Groups are cut into buckets by a hash of ``spread_by``, so a
    group that holds most rows is still numbered by many tasks: row numbers
    within a bucket plus the sizes of the buckets before it."""
    n = max(1, -(-n_rows // ROWS_PER_BUCKET))
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread_by), F.lit(n)).cast("int"))
    sizes = rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (rows.withColumn("_rank", F.row_number().over(within) - 1)
            .join(starts, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
            .select(*df.columns, (F.col("_rank") + F.col("_start")).cast("long").alias(name)))

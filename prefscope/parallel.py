"""Input parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Only a scan of up to this many splits is spread, and over at most this many
# times its splits.
SPREAD_SPLITS = 8
SPREAD_FACTOR = 8


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan of a few files that Spark cannot split (one row group
    each) over the cluster's task slots: the text scoring behind it would
    otherwise run in one task. Any larger scan is returned unchanged, on
    whatever cluster; its split size is set by row groups and
    ``spark.sql.files.maxPartitionBytes``.

    The round-robin repartition sorts rows before distributing them, so a
    recomputed partition after an executor loss gets the same rows."""
    n = df.rdd.getNumPartitions()
    target = min(df.sparkSession.sparkContext.defaultParallelism, SPREAD_FACTOR * max(n, 1))
    if n <= SPREAD_SPLITS and n < target:
        return df.repartition(target)
    return df

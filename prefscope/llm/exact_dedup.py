"""Exact dedup through an extendible-hash index on shared files.

Texts are keyed by a 64-bit hash. The directory of the index maps the leading
bits of a key to a bucket; it doubles as long as some bucket holds more keys
than a bucket may, and only overfull buckets are split, so buckets differ in
their depth. Owner tasks then take ranges of the key space: each writes the
entries of its buckets, sorted, to the shared folder. Entries of one key are
chained, and what makes an entry is the text itself: rows are grouped by key
and text, so keys may collide but texts are told apart byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefscope.llm.shared import lookup, partitions, written

#: Keys a bucket may hold before it is split.
BUCKET_KEYS = 100_000
#: Bits by which one look at the counts can deepen the directory.
STEP_BITS = 8


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def leading_bits(key: Column, depth) -> Column:
    """The first ``depth`` bits of a key as a number; 0 for depth 0."""
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftrightunsigned", key, (F.lit(64) - depth).cast("int")))


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> list[tuple[int, int]]:
    """Buckets (depth, leading bits) of an extendible-hash directory over the
    distinct ``key``s, in key order. A round counts the keys of the overfull
    buckets ``STEP_BITS`` deeper and splits them by doubling. The counts that
    reach the driver are at most 2**STEP_BITS for each overfull bucket, so the
    directory has in the order of keys / bucket_keys entries, not one per key."""
    done: list[tuple[int, int]] = []
    full = [(0, 0)] if keys.limit(1).count() else []
    if not full:
        return [(0, 0)]
    spark = keys.sparkSession
    while full:
        depth = full[0][0]
        if depth >= 64:
            return sorted(done + full, key=lambda b: b[1] << (64 - b[0]) if b[0] else 0)
        step = min(STEP_BITS, 64 - depth)
        held = keys
        if depth:
            parents = spark.createDataFrame([(b,) for _, b in full], "parent long")
            held = keys.join(F.broadcast(parents), leading_bits(F.col("key"), depth) == F.col("parent"),
                             "left_semi")
        cells = {r["b"]: r["n"] for r in held.groupBy(
            leading_bits(F.col("key"), depth + step).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        deeper = []
        for _, bits in full:
            split = [(depth, bits)]
            while split:
                d, b = split.pop()
                rest = depth + step - d
                n = sum(cells.get((b << rest) + i, 0) for i in range(1 << rest))
                if n <= bucket_keys:
                    done.append((d, b))
                elif rest:
                    split += [(d + 1, 2 * b), (d + 1, 2 * b + 1)]
                else:
                    deeper.append((d, b))
        full = deeper
    return sorted(done, key=lambda b: b[1] << (64 - b[0]) if b[0] else 0)


def bucket_of(entries: DataFrame, buckets: list[tuple[int, int]]) -> DataFrame:
    """``entries`` with the number of their bucket: the directory, one row per
    leading bits of each depth that occurs, is probed once per depth."""
    spark = entries.sparkSession
    out = entries.withColumn("bucket", F.lit(None).cast("int"))
    for depth in sorted({d for d, _ in buckets}):
        rows = [(b, i) for i, (d, b) in enumerate(buckets) if d == depth]
        found = spark.createDataFrame(rows, "_bits long, _b int")
        out = out.join(F.broadcast(found), leading_bits(F.col("key"), depth) == F.col("_bits"), "left"
                       ).withColumn("bucket", F.coalesce("bucket", "_b")).drop("_bits", "_b")
    return out


def index(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The index: one entry per distinct text with its key, bucket, place in
    the key's chain, sha256, keep_id and group_size. Copies are combined in
    the map tasks, so a group of any size sends one row per task; the text is
    shuffled once and not kept."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    entries = written(
        texts.groupBy(text_key(F.col("text")).alias("key"), "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "dedup-entries")
    buckets = directory(entries.select("key").distinct(), bucket_keys)
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    owned = bucket_of(entries, buckets).repartitionByRange(partitions(docs.sparkSession), "bucket", "key")
    return written(owned.withColumn("chain", F.row_number().over(chain) - 1)
                   .sortWithinPartitions("bucket", "key", "chain"), "dedup-index")


def exact_groups(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256. Texts are equal when they are the same bytes; null counts as
    empty, so null and empty texts are one group. The largest doc_id stays.

    Rows without a doc_id count in their group and are never kept, unless the
    whole group has none: keep_id is null then and all its rows are kept. Rows
    that repeat the id that stays are all marked kept; ``unique_documents``
    returns one of them. An empty table gives an empty result; columns besides
    doc_id and text are not read."""
    table = index(docs, bucket_keys)
    probe = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).select(
        "doc_id", text_key(F.col("_t")).alias("key"), F.sha2("_t", 256).alias("text_sha256"))
    found = lookup(probe, table.select("key", "text_sha256", "keep_id", "group_size"),
                   ["key", "text_sha256"], "group_size", ["doc_id"])
    return found.select("doc_id", "keep_id", "group_size",
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def unique_documents(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat
    both id and text, one. Few of them share an id, so they are told apart
    after the kept rows have been found."""
    table = index(docs, bucket_keys).select("key", "text_sha256", "keep_id", "group_size")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id",
                       F.coalesce("text", F.lit("")).alias("_t")).select(
        "_row", "doc_id", text_key(F.col("_t")).alias("key"), F.sha2("_t", 256).alias("text_sha256"))
    kept = lookup(rows, table, ["key", "text_sha256"], "group_size", ["doc_id"]).where(
        F.col("doc_id").eqNullSafe(F.col("keep_id")))
    one = Window.partitionBy("key", "text_sha256").orderBy("doc_id")
    return kept.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("_row.*")

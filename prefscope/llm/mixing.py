"""Mixing sources to target weights: weighted sampling without replacement by
exponential keys (Efraimidis and Spirakis), cut at a word budget per source.

Every source has a target share of the words. A source whose target is e times
its size or more contributes e complete epochs; what is left of the target is
taken from a sample in key order up to the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefscope.llm.shared import lookup, written

#: Weights of the sources in code point order, null last; they repeat.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is used more often than this.
MAX_EPOCHS = 3
#: Keys are cut into this many ordered cells per source; rows are sorted in
#: the one cell in which the budget ends.
CELLS = 4096
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def quality(words: Column) -> Column:
    """Sampling weight of a text: the share of its words that are distinct;
    1 for a text without words."""
    n = F.size(words)
    return F.when(n > 0, F.size(F.array_distinct(words)) / n).otherwise(F.lit(1.0))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on seed and id alone: the first 52 bits
    of their md5. It doesn't change with partitions, retries or reruns."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, cell, key) of each document; ``cell`` rises with
    ``key``, and holds about the same number of documents for any source."""
    rows = docs.select("doc_id", "source", words_of(F.col("text")).alias("w")).select(
        "doc_id", "source", F.size("w").cast("long").alias("size"), quality(F.col("w")).alias("q"))
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.col("q")
    cell = F.least(F.floor((1 - F.exp(-F.col("key"))) * CELLS), F.lit(CELLS - 1)).cast("int")
    return rows.withColumn("key", key).select("doc_id", "source", "size", cell.alias("cell"), "key")


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> also ``target``. Weights go round the sources
    in code point order, null last. All words are shared by weight; a target
    stops at ``max_epochs`` times its source's size and the excess is shared by
    weight among the others, until none is above. The sources of a mix are a
    short list (one row each), so they are numbered in one task."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    rows = sources.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    rows = rows.withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    # In the order of cap / weight, level(k) = (all words - caps before k) /
    # weights from k on. It rises as long as source k is above its cap at that
    # level and falls from the first that isn't, which gives the final level.
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
             ) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    final = F.max("level").over(everything)
    return rows.withColumn("final", final).select(
        "source", "source_size",
        F.least("cap", F.col("final") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
         seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sized documents, one row per source): what each source gives.

    ``epochs`` times every document, and once more those whose (key, doc_id)
    is up to (``last_key``, ``last_id``): key order up to the rest of the
    target, with the document at the budget's end if half of it still fits.

    Only sums per (source, cell) are shuffled; rows are ordered just within
    the cell in which a source's budget ends, so no task sees a whole source.
    """
    rows = written(sized(docs, seed), "mix-sizes")
    cells = rows.groupBy("source", "cell").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    sources = targets(cells.groupBy("source").agg(
        F.sum("words").alias("source_size"), F.sum("n").alias("n_docs")).select(
        "source", "source_size"), weights, max_epochs)
    counts = cells.groupBy("source").agg(F.sum("n").alias("n_docs")).withColumnRenamed("source", "s2")
    epochs = F.when(F.col("source_size") > 0, F.least(
        F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn(
        "budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    sources = written(sources.join(counts, F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "mix-sources")

    until = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    s = sources.select(F.col("source").alias("s2"), "budget")
    edges = written(
        cells.withColumn("through", F.sum("words").over(until))
        .join(s, F.col("source").eqNullSafe(F.col("s2")))
        .where((F.col("through") - F.col("words") < F.col("budget")) & (F.col("through") >= F.col("budget")))
        .groupBy("source", "budget").agg(F.min_by(F.struct(
            "cell", (F.col("through") - F.col("words")).alias("before")), "cell").alias("e"))
        .select(F.col("source").alias("s2"), "budget", F.col("e.cell").alias("c2"), "e.before"), "mix-edges")
    order = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(
        Window.unboundedPreceding, -1)
    last = (
        rows.join(F.broadcast(edges), F.col("source").eqNullSafe(F.col("s2")) & (F.col("cell") == F.col("c2")))
        .withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
        .where(F.col("budget") - F.col("start") >= F.col("size") / 2)
        .groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("last")))
    # Where no document of that cell fits, the cells before it are taken.
    chosen = edges.select("s2", "c2").join(
        last, F.col("s2").eqNullSafe(F.col("source")), "left").select(
        F.col("s2").alias("s3"), "c2", "last.key", "last.doc_id")
    return rows, sources.join(chosen, F.col("source").eqNullSafe(F.col("s3")), "left").select(
        "source", "source_size", "target", "epochs", "n_docs", F.col("c2").alias("last_cell"),
        F.col("key").alias("last_key"), F.col("doc_id").alias("last_id"))


def times(sample: DataFrame) -> Column:
    """How often the mix takes a document, given its source's plan."""
    first = F.col("cell") < F.col("last_cell")
    inside = (F.col("cell") == F.col("last_cell")) & (
        (F.col("key") < F.col("last_key")) | (F.col("key").eqNullSafe(F.col("last_key")) & (
            F.coalesce(F.col("doc_id") <= F.col("last_id"), F.col("doc_id").isNull()))))
    return (F.col("epochs") + F.coalesce((first | inside).cast("long"), F.lit(0))).cast("long")


def _with_plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    keyed = rows.withColumn("_none", F.col("source").isNull()).withColumn(
        "_source", F.coalesce("source", F.lit("")))
    table = written(sources.withColumn("_none", F.col("source").isNull()).withColumn(
        "_source", F.coalesce("source", F.lit(""))).drop("source"), "mix-plan")
    return lookup(keyed, table, ["_none", "_source"], "n_docs", ["doc_id"]).drop("_none", "_source", "n_docs")


def mix_report(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
               seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Null text has size 0; a null source is a source of its own, last in order;
    a null doc_id is drawn as the text "null" and sorts first. Rows that repeat
    an id share its key, and ties go by doc_id, so they are taken together.
    Documents without words are taken in their key's place, with 0 words. An
    empty table gives an empty result; other columns are not read."""
    rows, sources = plan(docs, weights, max_epochs, seed)
    return _with_plan(rows, sources).select(
        "doc_id", "size", "source_size", "target",
        (times(rows) * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """The mixed documents with all their columns, as many rows of each as
    the mix takes it."""
    _, sources = plan(docs, weights, max_epochs, seed)
    own = docs.columns
    helper = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
                         "doc_id", "source", "text")
    rows = helper.withColumn("_w", words_of(F.col("text"))).withColumn("_q", quality(F.col("_w"))).withColumn(
        "key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("_q")).withColumn(
        "cell", F.least(F.floor((1 - F.exp(-F.col("key"))) * CELLS), F.lit(CELLS - 1)).cast("int"))
    rows = rows.select("_row", "doc_id", "source", "cell", "key")
    taken = _with_plan(rows, sources).withColumn("_times", times(rows))
    return taken.where("_times > 0").select(
        "_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_copy")).select("_row.*")

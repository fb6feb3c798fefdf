"""Training-data preparation: filters (C1-C6), pair reshapes
and seeded ordering / sampling (J1-J5).

Design notes for scale:
* Conversation statistics (turn count, characters) are partial aggregates,
  so a conversation with a huge share of all rows costs nothing special.
* The seeded order is ``md5(seed:id)``: independent of partitioning, equal in
  DuckDB, and stable under recomputation after an executor loss.
* Samples and "first n" of up to ``HEAP_ROWS`` rows are top-n heaps. Larger
  ones find the n-th key among narrow ``(key, id)`` rows, then filter the wide
  rows by that one key: no join back (a repeated id does not multiply rows), no
  sort of wide rows, no task that holds n rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefscope.functions.chat import last_content, message, render_chatml
from prefscope.session import ensure_checkpoint_dir

#: Samples and first rows of at most so many rows are kept in heaps.
HEAP_ROWS = 10_000
#: Up to so many partition values of a preview, the last row of each is broadcast.
PREVIEW_VALUES = 100_000


# ---------------------------------------------------------------------------
# A1 helpers: long conversation rows -> statistics / message arrays
# ---------------------------------------------------------------------------
def conversation_stats(long_df: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_chars) from long rows (conv_id, turn, role, text)."""
    return long_df.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0).cast("long"))
        .alias("n_chars"))


def conversations_to_messages(long_df: DataFrame, max_turns: int | None = None) -> DataFrame:
    """(conv_id, messages) with messages in turn order: a message list is one
    value, so a conversation's messages meet in one task. With ``max_turns``
    (C1's filter, where that is wanted) only conversations of at most that many
    turns are collected; their turn counts are a partial aggregate joined back
    first."""
    if max_turns is not None:
        ok = conversation_stats(long_df).where(F.col("n_turns") <= max_turns)
        long_df = long_df.join(ok.select("conv_id"), "conv_id", "left_semi")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return long_df.groupBy("conv_id").agg(turns.alias("_t")).select(
        "conv_id",
        F.transform("_t", lambda t: message(t.getField("role"), t.getField("text")))
        .alias("messages"))


# ---------------------------------------------------------------------------
# C1
# ---------------------------------------------------------------------------
def message_chars(messages) -> Column:
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.aggregate(m, F.lit(0).cast("long"),
                       lambda acc, x: acc + F.coalesce(
                           F.length(x.getField("content")).cast("long"), F.lit(0).cast("long")))


def conversation_ok(n_turns: Column, n_chars: Column, max_turns: int = 6,
                    max_chars: int = 2000) -> Column:
    return n_turns.between(1, max_turns) & (n_chars <= max_chars)


def filter_conversations(df: DataFrame, max_turns: int = 6,
                         max_chars: int = 2000) -> DataFrame:
    """Keep conversations with 1..max_turns messages and at most
    max_chars characters in total. Array form (``messages`` column) is a
    narrow filter; long form (conv_id, turn, role, text) is a partial
    aggregate per conversation joined back with a left-semi join."""
    if "messages" in df.columns:
        return df.where(conversation_ok(F.size("messages"), message_chars("messages"),
                                        max_turns, max_chars))
    ok = passing_conversations(df, max_turns, max_chars)
    return df.join(ok.select("conv_id"), "conv_id", "left_semi")


def passing_conversations(long_df: DataFrame, max_turns: int = 6,
                          max_chars: int = 2000) -> DataFrame:
    """C1 on long rows, as statistics: (conv_id, n_turns, n_chars) of the
    conversations that pass. One partial aggregate, no message arrays."""
    return conversation_stats(long_df).where(
        conversation_ok(F.col("n_turns"), F.col("n_chars"), max_turns, max_chars))


def passing_message_lists(df: DataFrame, max_turns: int = 6, max_chars: int = 2000) -> DataFrame:
    """C1 on stored message lists, as statistics: (conv_id, n_turns, n_chars)
    of the conversations that pass. Only the contents are named, so a columnar
    scan reads that one field of the messages. A null list is not there; a null
    content has no characters."""
    lists = df.select("conv_id", F.col("messages.content").alias("_c"))
    chars = F.aggregate("_c", F.lit(0).cast("long"),
                        lambda acc, x: acc + F.coalesce(F.length(x).cast("long"), F.lit(0).cast("long")))
    stats = lists.select("conv_id", F.size("_c").cast("long").alias("n_turns"), chars.alias("n_chars"))
    return stats.where(conversation_ok(F.col("n_turns"), F.col("n_chars"), max_turns, max_chars))


# ---------------------------------------------------------------------------
# C2 / C3
# ---------------------------------------------------------------------------
def side_text(c: str, dtype: T.DataType) -> Column:
    """D1 on a pair side: last message content of a list, else the text."""
    if isinstance(dtype, T.ArrayType):
        return last_content(c)
    return F.col(c).cast("string")


def pair_length_ok(df: DataFrame, max_chars: int = 1200) -> Column:
    """The last message of each side has at most max_chars characters."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return ((F.length(side_text("chosen", types["chosen"])) <= max_chars)
            & (F.length(side_text("rejected", types["rejected"])) <= max_chars))


def score_gap(df: DataFrame) -> Column:
    """chosen - rejected; null if a score is null. An absent score column reads
    as 0.0."""
    sc = F.col("score_chosen") if "score_chosen" in df.columns else F.lit(0.0)
    sr = F.col("score_rejected") if "score_rejected" in df.columns else F.lit(0.0)
    return sc - sr


def score_gap_ok(df: DataFrame, min_gap: float = 1.0) -> Column:
    """Chosen - rejected >= min_gap. A null score passes; both columns
    absent give a gap of 0, which fails."""
    return F.coalesce(score_gap(df) >= F.lit(float(min_gap)), F.lit(True))


def longest_side(df: DataFrame) -> Column:
    """Characters of the longer side's last message; null if a side has none."""
    types = {f.name: f.dataType for f in df.schema.fields}
    a, b = (F.length(side_text(c, types[c])) for c in ("chosen", "rejected"))
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def filter_pairs(df: DataFrame, max_chars: int = 1200, min_gap: float = 1.0) -> DataFrame:
    """C2 + C3. The numeric test is written first: it is cheaper than text
    length and, when scores are parquet columns, can be evaluated early."""
    return df.where(score_gap_ok(df, min_gap) & pair_length_ok(df, max_chars))


# ---------------------------------------------------------------------------
# C4
# ---------------------------------------------------------------------------
def filter_texts(df: DataFrame, min_chars: int = 20, col: str = "text") -> DataFrame:
    from prefscope.functions.text import py_strip
    return df.where(F.length(py_strip(col)) > min_chars)


# ---------------------------------------------------------------------------
# C6
# ---------------------------------------------------------------------------
def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """One pass over ``df``: for each named predicate, rows that reach the
    stage (``n_in``) and rows that pass it and all before it (``n_kept``).
    Returns (stage_no, stage, n_in, n_kept)."""
    aggs = [F.count(F.lit(1)).alias("_n0")]
    cum = None
    for i, (_, p) in enumerate(stages, start=1):
        cum = p if cum is None else (cum & p)
        aggs.append(F.count_if(F.coalesce(cum, F.lit(False))).alias(f"_n{i}"))
    counts = df.agg(*aggs)
    rows = [F.struct(F.lit(i).cast("long").alias("stage_no"), F.lit(name).alias("stage"),
                     F.col(f"_n{i - 1}").alias("n_in"), F.col(f"_n{i}").alias("n_kept"))
            for i, (name, _) in enumerate(stages, start=1)]
    return counts.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------------------
# D2
# ---------------------------------------------------------------------------
def _as_prompt_messages(c: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        return F.col(c)
    return F.array(message("user", F.col(c).cast("string")))


def _as_completion_messages(c: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        x = F.col(c)
        last = F.try_element_at(x, F.lit(-1))
        only_last = F.array(message("assistant", last.getField("content")))
        return F.when((F.size(x) > 1) & (last.getField("role") == "assistant"),
                      only_last).otherwise(x)
    return F.array(message("assistant", F.col(c).cast("string")))


def to_pairs(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Normalise prompt, chosen, rejected into message lists. Text or
    list is decided from the schema once, not per row. Only ``keep``
    columns (e.g. an id) survive besides the three lists."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *keep,
        _as_prompt_messages("prompt", types["prompt"]).alias("prompt"),
        _as_completion_messages("chosen", types["chosen"]).alias("chosen"),
        _as_completion_messages("rejected", types["rejected"]).alias("rejected"))


# ---------------------------------------------------------------------------
# D3
# ---------------------------------------------------------------------------
def legacy_prompt(df: DataFrame, out: str = "prompt") -> DataFrame:
    """D3 on a table: adds ``out``, the prompt message list of each legacy
    row (see ``legacy_prompt_messages``)."""
    return df.withColumn(out, legacy_prompt_messages(df))


def legacy_prompt_messages(df: DataFrame) -> Column:
    """D3: optional system message, then a user message from ``input`` or,
    when that is empty, ``question``."""
    def opt(c):
        return F.col(c) if c in df.columns else F.lit(None).cast("string")
    system, inp, question = opt("system"), opt("input"), opt("question")
    user = F.coalesce(F.nullif(inp, F.lit("")), question, F.lit(""))
    sys_msgs = F.when(F.coalesce(system, F.lit("")) != "",
                      F.array(message("system", system))).otherwise(
        F.array().cast(T.ArrayType(T.StructType([
            T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))))
    return F.concat(sys_msgs, F.array(message("user", user)))


# ---------------------------------------------------------------------------
# D6
# ---------------------------------------------------------------------------
def model_prompt(prompt, is_chat) -> Column:
    """Raw prompt for a base model, ChatML with the generation tail for a
    chat model."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    chat = F.col(is_chat) if isinstance(is_chat, str) else is_chat
    return F.when(chat, render_chatml(F.array(message("user", p)), True)).otherwise(p)


def with_model_prompt(df: DataFrame, prompt: str = "prompt", is_chat: str = "is_chat",
                      out: str = "model_prompt") -> DataFrame:
    """D6 on a table (e.g. a request grid): adds the prompt text each model
    is given."""
    return df.withColumn(out, model_prompt(prompt, is_chat))


# ---------------------------------------------------------------------------
# J1-J5
# ---------------------------------------------------------------------------
def shuffle_key(id_col: str, seed: int = 42) -> Column:
    """md5 of ``seed:id``; a null id counts as the text ``null``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def seeded_order(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """A seeded permutation (range-partitioned global sort)."""
    return df.withColumn("shuffle_key", shuffle_key(id_col, seed)).orderBy(
        "shuffle_key", id_col)


def _first_rows(df: DataFrame, order: list[str], n: int, name: str,
                need: bool = False, what: str = "") -> DataFrame:
    """The first n rows in ``order``, with their 0-based position ``name``.

    Up to ``HEAP_ROWS`` rows, every task keeps its own first n in a heap and
    one task merges these (TakeOrderedAndProject): no shuffle of the others,
    nothing written. For a larger n the n-th key comes from the narrow rows of ``order`` alone and is one row
    on the driver; the wide rows up to that key are then numbered. Rows of
    equal keys are told apart by a hash of the whole row, so which of them are
    among the n does not depend on partitions. With ``need`` fewer than n rows
    are an error."""
    if n <= 0:
        return df.limit(0).withColumn(name, F.lit(None).cast("long"))
    if n <= HEAP_ROWS:
        if need and (found := df.select(*order).limit(n).count()) < n:
            raise ValueError(f"{what}: need {n} rows, the pool has {found}")
        top = [*order, "_tie"]
        first = df.withColumn("_tie", F.xxhash64(*df.columns)).orderBy(*top).limit(n)
        # A window over at most n rows, which are in one task already.
        return first.withColumn(name, (F.row_number().over(Window.orderBy(*top)) - 1).cast("long")).drop("_tie")
    at = with_position(df.select(*order), order, "_pos").where(F.col("_pos") == n - 1).select(*order).first()
    if at is None and need:
        raise ValueError(f"{what}: need {n} rows, the pool has {df.count()}")
    upto = df if at is None else df.where(_not_after(order, at))
    tie = upto.withColumn("_tie", F.xxhash64(*upto.columns))
    return with_position(tie, [*order, "_tie"], name).where(F.col(name) < n).drop("_tie")


def _not_after(order: list[str], at) -> Column:
    """(order columns) <= (the values ``at``), nulls first as ``orderBy`` has them."""
    out = F.lit(True)
    for c in reversed(order):
        v = at[c]
        if v is None:
            out = F.col(c).isNull() & out
        else:
            out = F.col(c).isNull() | (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
    return F.coalesce(out, F.lit(False))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of the seeded order, with their 1-based rank. Rows
    that repeat an id follow one another in the order and count one by one."""
    keyed = df.withColumn("shuffle_key", shuffle_key(id_col, seed))
    return _first_rows(keyed, ["shuffle_key", id_col], n, "_pos").withColumn(
        "sample_rank", F.col("_pos") + 1).drop("_pos")


def train_eval_split(df: DataFrame, id_col: str, n_train: int, n_eval: int,
                     seed: int = 42) -> DataFrame:
    """Disjoint slices [0, n_train) and [n_train, n_train + n_eval) of the
    seeded order; a pool smaller than n_train + n_eval is an error."""
    keyed = df.withColumn("shuffle_key", shuffle_key(id_col, seed))
    first = _first_rows(keyed, ["shuffle_key", id_col], n_train + n_eval, "_pos", True, "train_eval_split")
    return first.withColumn("sample_rank", F.col("_pos") + 1).withColumn(
        "split", F.when(F.col("_pos") < n_train, "train").otherwise("eval")).drop("_pos")


def first_n(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """The first n rows in ``order_col`` order; fewer rows is an error."""
    return _first_rows(df, [order_col], n, "_pos", True, "first_n").drop("_pos")


def preview(df: DataFrame, n: int = 10, partition_col: str = "model",
            order_col: str = "idx") -> DataFrame:
    """First n rows per partition value. The n-th key of each partition
    value comes from narrow rows (a WindowGroupLimit, applied before the
    shuffle as well as after it); wide rows beyond it are dropped by a broadcast
    join where they are read, so no task gets all rows of a value. Of more than
    ``PREVIEW_VALUES`` values the wide rows are ranked at once: the same limit
    then cuts them before they are shuffled."""
    narrow = df.select(F.col(partition_col).alias("_p"), F.col(order_col).alias("_o"))
    w = Window.partitionBy("_p").orderBy("_o")
    last = (narrow.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
            .groupBy("_p").agg(F.max("_o").alias("_last")))
    ensure_checkpoint_dir(df.sparkSession)
    last = last.checkpoint()
    near = df if last.count() > PREVIEW_VALUES else df.join(F.broadcast(last), F.col(partition_col).eqNullSafe(F.col("_p")) & (
        F.col(order_col).isNull() | (F.col(order_col) <= F.col("_last")))).drop("_p", "_last")
    w = Window.partitionBy(partition_col).orderBy(order_col)
    return (near.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= n).drop("_rn"))


def with_position(df: DataFrame, order_cols: list[str], name: str = "idx") -> DataFrame:
    """Dense 0-based position in ``order_cols`` order (the item index the
    harness gets from ``enumerate``), without a window over all rows.

    Rows are range-partitioned on the key and checkpointed with the number of
    their partition, so the ranges are drawn once: counts and positions read
    the same partitions, whatever AQE makes of either plan, and a lost
    executor costs nothing. Counts per partition (one row each) give every
    partition's first position; rows are numbered within their partition.
    Rows of equal keys follow one another in any order."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(*order_cols)
              .withColumn("_part", F.spark_partition_id()).checkpoint())
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_first"))
    within = Window.partitionBy("_part").orderBy(*order_cols)
    return (ranged.withColumn("_row", F.row_number().over(within) - 1)
            .join(F.broadcast(first), F.col("_part") == F.col("_p"))
            .withColumn(name, (F.col("_first") + F.col("_row")).cast("long"))
            .drop("_part", "_row", "_p", "_first"))

"""Host-level quality rules: how often documents of a host fail rules, shrunk
towards what is usual, decides about the host's other documents too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscope.llm import textnum as T
from prefscope.llm.shared import lookup, written

#: A text with fewer words, or a larger percentage of repeated words, fails.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))


def repeats(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``keys``: how often its group has it, and whether it is the
    first there."""
    both = T.mix(keys ^ T.mix(groups.astype(T.U) + T.U(1)))
    order = np.argsort(both, kind="stable")
    ordered = both[order]
    new = np.ones(len(both), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    run = np.cumsum(new) - 1
    count, first = np.empty(len(both), np.int64), np.empty(len(both), bool)
    count[order] = np.bincount(run, minlength=0)[run] if len(run) else 0
    first[order] = new
    return count, first


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text: words, code points in words, symbols, lines
    that repeat an earlier one, words in windows that occur again."""
    t = T.Texts(texts)
    words = t.hashes()
    first, owner = t.windows(WINDOW)
    often, _ = repeats(T.window_hashes(words, first, WINDOW), owner)
    repeated = T.covered(len(words), first[often > 1], WINDOW)

    cut = np.zeros(len(t.data) + 1, bool)
    cut[1:] = t.data == 10
    cut[t.offset] = True
    begin = np.flatnonzero(cut[:-1])
    line_text = np.searchsorted(t.offset, begin, "right") - 1
    newline = np.append(np.flatnonzero(t.data == 10), len(t.data))
    end = np.minimum(newline[np.searchsorted(newline, begin)], t.offset[line_text + 1])
    worded = np.searchsorted(t.start, end) > np.searchsorted(t.start, begin)
    begin, end, line_text = begin[worded], end[worded], line_text[worded]
    _, new = repeats(T.span(t.sums(), begin, end), line_text)
    return {
        "n_words": t.n_words(),
        "word_chars": t.per_text(t.inside & ((t.data & 0xC0) != 0x80)),
        "n_symbols": t.per_text(_IS_SYMBOL[t.data]),
        "n_dup_lines": np.bincount(line_text[~new], minlength=t.n),
        "n_repeat_words": t.per_word_text(repeated),
    }


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in T.slices(batch["text"]):
            part = batch.slice(lo, hi - lo)
            counts = measure(part["text"])
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["host"], *[pa.array(np.asarray(v, np.int64)) for v in counts.values()]],
                ["doc_id", "host", *counts])


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One narrow row of counts per document, and ``base_failed``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col(host).cast("string").alias("host"), "text")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(_measure_batches, MEASURES).withColumn("base_failed", failed)


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n, failures, rate): ``rate`` is the mean of the host's beta
    posterior. The prior's mean m is the failure rate of all documents; its
    weight follows from the variance t between hosts, estimated by moments
    from S = sum of n (p - m)^2 over the k hosts, of N documents in all:

        t = (S - (k - 1) m (1 - m)) / (N - sum(n^2) / N - (k - 1))
        a + b = m (1 - m) / t - 1

    Hosts that differ no more than chance would have them (t <= 0), or a
    single host, are shrunk fully: every rate is m. The failures of a host are
    summed in the map tasks first, so a host with most rows is no burden."""
    hosts = rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failures"))
    sums = hosts.agg(F.sum("n").alias("N"), F.sum("failures").alias("f"), F.count(F.lit(1)).alias("k"),
                     F.sum((F.col("n") * F.col("n")).cast("double")).alias("n2"),
                     F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("fp")).select(
        "N", "k", "n2", (F.col("f") / F.col("N")).alias("m"), "fp")
    # S = sum(f^2 / n) - N m^2, as sum(f) = N m
    noise = (F.col("k") - 1) * F.col("m") * (1 - F.col("m"))
    spread = F.col("fp") - F.col("N") * F.col("m") * F.col("m") - noise
    room = F.col("N") - F.col("n2") / F.col("N") - (F.col("k") - 1)
    prior = sums.select("m", F.when((room > 0) & (spread > 0), F.greatest(
        F.col("m") * (1 - F.col("m")) * room / spread - 1, F.lit(0.0))).alias("strength")).first()
    if prior["m"] is None:
        return hosts.withColumn("rate", F.lit(0.0))
    if prior["strength"] is None:
        return hosts.withColumn("rate", F.lit(prior["m"]))
    return hosts.withColumn("rate", (F.col("failures") + prior["strength"] * prior["m"])
                            / (F.col("n") + prior["strength"]))


def judge(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, host_rate. A document is
    kept when it passes the rules itself and its host's rate isn't above
    ``max_host_rate``.

    Null text has no words and fails; documents without a host share one. Very
    long texts are measured whole; repeated rows count each time. An empty
    table gives an empty result. Only doc_id, text and the host column are
    read. Word windows and lines are compared by 64-bit hashes within a text.
    """
    rows = written(measures(docs, host), "quality-measures")
    rates = written(host_rates(rows).select(
        F.col("host").isNull().alias("_none"), F.coalesce("host", F.lit("")).alias("_host"), "n", "rate"),
        "quality-hosts")
    keyed = rows.withColumn("_none", F.col("host").isNull()).withColumn(
        "_host", F.coalesce("host", F.lit("")))
    found = lookup(keyed, rates, ["_none", "_host"], "n", ["doc_id"])
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rate") <= max_host_rate)).alias("kept"),
        F.col("rate").alias("host_rate"))

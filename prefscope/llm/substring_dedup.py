"""Substring dedup through difference-cover anchors.

A difference cover of period v is a set of residues such that for any two
positions i and j some shift d < v puts both i + d and j + d on the cover. Two
occurrences of a passage of ``window`` words therefore share an aligned anchor:
``window - v + 1`` words that begin at cover positions of both texts. So only
the anchors at cover positions are hashed and counted over the corpus. Windows
around anchors that occur again are the candidates; their own hashes are
counted in turn, and words in windows that occur again are removed.

Texts are shuffled once, by a hash, into buckets. Anchors and windows travel as
one row per bucket, batch and hash, so that a passage that a third of all
documents share sends a few rows per task, and comes back as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefscope.llm import textnum as T
from prefscope.llm.shared import partitions

WINDOW = 35
#: A perfect difference set modulo 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Buckets per shuffle partition; a bucket's texts are in memory at a time.
BUCKETS_PER_PARTITION = 8


def anchors(t: T.Texts, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the anchors at cover positions."""
    first, owner = t.windows(window - PERIOD + 1)
    on = np.isin(np.arange(PERIOD), COVER)
    first = first[on[(first - t.words[owner]) % PERIOD]]
    return first, T.window_hashes(words, first, window - PERIOD + 1)


def candidates(t: T.Texts, anchor: np.ndarray, window: int) -> np.ndarray:
    """First words of the windows that contain one of the anchors (given by
    their first words) at a shift below the period."""
    owner = np.searchsorted(t.words, anchor, "right") - 1
    low = np.maximum(anchor - PERIOD + 1, t.words[owner])
    high = np.minimum(anchor, t.words[owner + 1] - window)
    low, high = low[high >= low], high[high >= low]
    steps = np.zeros(len(t.start) + 1, np.int64)
    np.add.at(steps, low, 1)
    np.add.at(steps, high + 1, -1)
    return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _anchor_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, buckets = [], []
            for lo, hi in T.slices(batch["text"]):
                t = T.Texts(batch["text"].slice(lo, hi - lo))
                first, h = anchors(t, t.hashes(), window)
                bucket = batch["bucket"].slice(lo, hi - lo).to_numpy()
                hashes.append(h)
                buckets.append(bucket[np.searchsorted(t.words, first, "right") - 1])
            if hashes:
                yield _counted([np.concatenate(hashes)], np.concatenate(buckets))
    return rows


def _counted(hashes: list[np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    """One row per distinct hash and bucket, with how often it occurs."""
    order = np.lexsort((bucket, *hashes))
    hashes, bucket = [h[order] for h in hashes], bucket[order]
    new = np.ones(len(bucket), bool)
    new[1:] = bucket[1:] != bucket[:-1]
    for h in hashes:
        new[1:] |= h[1:] != h[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(bucket)))
    return pa.RecordBatch.from_arrays(
        [*[pa.array(T.signed(h[at]) if h.dtype == np.uint64 else h[at]) for h in hashes], pa.array(bucket[at].astype(np.int32)),
         pa.array(count.astype(np.int32))],
        [*[f"h{i}" for i in range(len(hashes))], "bucket", "n"])


def _column(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks() if table.num_rows else pa.array([], table.schema.field(name).type)


def _second(t: T.Texts, first: np.ndarray, window: int) -> np.ndarray:
    """The other 32 bits by which windows are told apart, as signed longs."""
    return T.signed(T.window_hashes(t.hashes(1), first, window, 1)) >> 32


def _as_hashes(table: pa.Table, name: str) -> np.ndarray:
    return _column(table, name).to_numpy().view(np.uint64)


def _candidate_rows(window: int):
    def rows(texts: pa.Table, found: pa.Table) -> pa.Table:
        known, parts = np.unique(_as_hashes(found, "h0")), []
        column = _column(texts, "text")
        for lo, hi in T.slices(column) if len(known) else ():
            t = T.Texts(column.slice(lo, hi - lo))
            words = t.hashes()
            first, h = anchors(t, words, window)
            starts = candidates(t, first[is_in(h, known)], window)
            parts.append([T.window_hashes(words, starts, window),
                          _second(t, starts, window).astype(np.int32)])
        hashes = [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0, np.uint64), np.zeros(0, np.int32)]
        bucket = np.full(len(hashes[0]), texts["bucket"][0].as_py() if texts.num_rows else 0, np.int32)
        return pa.Table.from_batches([_counted(hashes, bucket)])
    return rows


def _kept_rows(window: int):
    def rows(texts: pa.Table, found: pa.Table) -> pa.Table:
        known = np.unique(_as_hashes(found, "h"))
        column, ids, out = _column(texts, "text"), _column(texts, "doc_id"), []
        for lo, hi in T.slices(column):
            t = T.Texts(column.slice(lo, hi - lo))
            gone = np.zeros(len(t.start), bool)
            if len(known):
                first, _ = t.windows(window)
                both = T.window_hashes(t.hashes(), first, window) ^ _second(t, first, window).view(np.uint64)
                gone = T.covered(len(t.start), first[is_in(both, known)], window)
            out.append(pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(t.n_words().astype(np.int64)),
                 pa.array(t.per_word_text(gone).astype(np.int64)), kept_text(t, ~gone)],
                ["doc_id", "n_words", "n_removed", "kept_text"]))
        return pa.Table.from_batches(out)
    return rows


def kept_text(t: T.Texts, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    size = np.zeros(len(t.data) + 1, np.int64)
    np.add.at(size, t.start[keep], 1)
    np.add.at(size, t.end[keep], -1)
    take = np.cumsum(size[:-1]) > 0
    data = np.where(t.inside, t.data, np.uint8(32))
    # The byte behind a kept word is its space, unless no word follows in the text.
    kept = np.flatnonzero(keep)
    owner = np.searchsorted(t.words, kept, "right") - 1
    follows = np.zeros(len(kept), bool)
    follows[:-1] = owner[1:] == owner[:-1]
    take[t.end[kept[follows]]] = True
    offset = np.concatenate([[0], np.cumsum(take)])[t.offset]
    return pa.LargeStringArray.from_buffers(
        t.n, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(data[take])).cast(pa.string())


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the words
    that stay, joined by one space). A word goes when it is in a window of
    ``window`` consecutive words that also starts anywhere else, in the same
    document or another, the first occurrence included; words compare
    unchanged. All windows are judged on the input.

    Null and empty texts have no words, texts shorter than a window lose none,
    and rows that repeat another in full lose all windows. Texts are read
    whole; a bucket of about 1 / (8 * spark.sql.shuffle.partitions) of them is
    in memory at a time. An empty table gives an empty result; columns besides
    doc_id and text are not read. Windows are told apart by 96 bits
    over the corpus, and by 64 within a bucket.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    n = partitions(docs.sparkSession)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(BUCKETS_PER_PARTITION * n)).cast("int").alias("bucket")
    ).repartition(n, "bucket")

    def again(rows: DataFrame, *keys: str) -> DataFrame:
        """The (bucket, keys) of what occurs more than once in all."""
        total = F.sum("n").over(Window.partitionBy(*keys))
        return rows.withColumn("total", total).where("total > 1").select("bucket", *keys)

    seen = texts.mapInArrow(_anchor_rows(window), "h0 long, bucket int, n int")
    near = texts.groupBy("bucket").cogroup(again(seen, "h0").groupBy("bucket")).applyInArrow(
        _candidate_rows(window), "h0 long, h1 int, bucket int, n int")
    # Back in their bucket, 64 of the 96 bits tell windows apart.
    repeated = again(near, "h0", "h1").select(
        "bucket", F.col("h0").bitwiseXOR(F.col("h1").cast("long")).alias("h"))
    return texts.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(
        _kept_rows(window), "doc_id long, n_words long, n_removed long, kept_text string")

"""Brown class-based bigram model: words in classes by exchange clustering,
text scored by class transitions and word emissions.

A token's probability is

    L * T[class of the token before, its class] * E(token | its class)
        + (1 - L) * unigram(token)

with T and E counted on the training documents and smoothed by addition. All
training tokens are counted. Words with more than a fixed share of all tokens
are clustered by exchange: each moves to the class with which the likelihood
of the class bigrams rises most, block of words by block, on counts of the
classes around each word. Rarer words, for which such counts say little, and
words never seen are in classes by their shape, which a task can tell from the
word alone. Counts of words down to a smaller share are known to every task
(by that share they are few enough); a text's other words are looked up by a
join, one row for each text, word and class before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscope.llm import textnum as T
from prefscope.llm.langid import fold
from prefscope.llm.shared import written

#: One of so many documents, by crc32 of its id, is held out.
FOLDS = 10
CLASSES, SHAPES = 32, 8
#: Words with more than 1 / CLUSTERED of the tokens are clustered, those with
#: more than 1 / SHARED are known to all tasks: fewer than so many, by counting.
CLUSTERED, SHARED = 100_000, 1_000_000
PASSES = 2
#: Words whose exchange one task decides.
BLOCK_WORDS = 256
ADD, ADD_TRANSITION, MIXTURE = 0.1, 0.5, 0.8
END = CLASSES + SHAPES
ALL = END + 1


@dataclass
class Words:
    """Words that all tasks know: sorted hashes, their counts, their rank
    among the clustered (-1: not clustered)."""

    keys: np.ndarray
    count: np.ndarray
    rank: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, at, -1)


def shapes(t: T.Texts) -> np.ndarray:
    """Shape of each word: whether it is long, has a byte beyond ASCII, ends in
    a character that is no letter or digit."""
    last = t.data[t.end - 1]
    wide = np.concatenate([[0], np.cumsum(t.data >= 128)])
    alnum = (last >= 128) | ((last >= 48) & (last < 58)) | ((last >= 97) & (last < 123))
    return ((t.end - t.start > 7) + 2 * (wide[t.end] > wide[t.start]) + 4 * ~alnum).astype(np.int64)


# ---- counts ----------------------------------------------------------------
def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for lo, hi in T.slices(batch["text"]):
            t = T.Texts(batch["text"].slice(lo, hi - lo), lower=True)
            key, first, n = np.unique(t.hashes(), return_index=True, return_counts=True)
            parts.append((key, shapes(t)[first].astype(np.int32), n))
        if parts:
            key, shape, n = (np.concatenate(x) for x in zip(*parts))
            key, first, at = np.unique(key, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(T.signed(key)), pa.array(shape[first]),
                 pa.array(np.bincount(at, n, len(key)).astype(np.int64))], ["word", "shape", "n"])


def count_words(train: DataFrame) -> DataFrame:
    """(word, shape, n) over all texts; words are known by 64-bit hashes."""
    return train.select("text").mapInArrow(_count_rows, "word long, shape int, n long").groupBy("word").agg(
        F.first("shape").alias("shape"), F.sum("n").alias("n"))


# ---- classes ---------------------------------------------------------------
def classes_of(t: T.Texts, known: Words, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: hash, place among the known words, class, and the class
    of the token before it (the end of a text at a text's beginning)."""
    h = t.hashes()
    at = known.find(h)
    rank = np.where(at >= 0, known.rank[at], -1) if len(known.keys) else at
    c = np.where(rank >= 0, klass[rank] if len(klass) else 0, CLASSES + shapes(t))
    before = np.empty_like(c)
    before[1:] = c[:-1]
    starts = t.words[:-1][t.n_words() > 0]
    before[starts] = END
    return h, at, c, before


def _context_rows(known, klass: np.ndarray, n_blocks: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        words, size = known.value, len(klass)
        around = np.zeros((2, size * ALL), np.int64)
        for batch in batches:
            for lo, hi in T.slices(batch["text"]):
                t = T.Texts(batch["text"].slice(lo, hi - lo), lower=True)
                _, at, c, before = classes_of(t, words, klass)
                after = np.empty_like(c)
                after[:-1] = c[1:]
                after[t.words[1:][t.n_words() > 0] - 1] = END
                rank = np.where(at >= 0, words.rank[at], -1) if len(words.keys) else at
                mine = np.flatnonzero(rank >= 0)
                for k, other in enumerate((before, after)):
                    cell, n = np.unique(rank[mine] * ALL + other[mine], return_counts=True)
                    around[k, cell] += n
        around = around.reshape(2, size, ALL)
        part = TaskContext.get().partitionId()
        for b in range(n_blocks):
            block = around[:, b::n_blocks]
            if block.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([b], pa.int32()),
                     pa.array([np.ascontiguousarray(block).tobytes()], pa.binary())], ["part", "block", "counts"])
    return rows


def _sum_rows(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["counts"])
    return pa.table({"part": pa.array([0], pa.int32()), "block": table["block"].slice(0, 1).cast(pa.int32()),
                     "counts": pa.array([total.tobytes()], pa.binary())})


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(left: np.ndarray, right: np.ndarray, klass: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """New classes of some words, one after the other. ``left`` and ``right``
    count the classes before and after each word, ``bigrams`` the class pairs
    of the whole corpus. A word goes where the log likelihood of the class
    bigrams, sum n(c,d) log n(c,d) - sum n(c,.) log n(c,.) - sum n(.,d) log
    n(.,d), becomes largest; of equal gains, to the first class."""
    n, out, every = bigrams.astype(float).copy(), klass.copy(), np.arange(CLASSES)
    for w in range(len(klass)):
        a, r, lft = out[w], right[w].astype(float), left[w].astype(float)
        n[a] -= r
        n[:, a] -= lft
        rows, cols, own = n[:CLASSES], n[:, :CLASSES].T, n[every, every]
        gain = (xlogx(rows + r) - xlogx(rows)).sum(1) + (xlogx(cols + lft) - xlogx(cols)).sum(1)
        gain += xlogx(own + r[:CLASSES] + lft[:CLASSES]) - xlogx(own + r[:CLASSES]) - xlogx(
            own + lft[:CLASSES]) + xlogx(own)
        out_of, into = rows.sum(1), cols.sum(1)
        gain -= xlogx(out_of + r.sum()) - xlogx(out_of) + xlogx(into + lft.sum()) - xlogx(into)
        b = int(np.argmax(gain))
        out[w] = b
        n[b] += r
        n[:, b] += lft
    return out


def _exchange_rows(klass: np.ndarray, bigrams: np.ndarray, n_blocks: int):
    def rows(table: pa.Table) -> pa.Table:
        b = table["block"][0].as_py()
        mine = klass[b::n_blocks]
        left, right = sum(np.frombuffer(x.as_py(), np.int64) for x in table["counts"]).reshape(2, len(mine), ALL)
        new = exchange(left, right, mine, bigrams)
        return pa.table({"rank": pa.array(np.arange(b, len(klass), n_blocks)), "class": pa.array(new.astype(np.int32))})
    return rows


def _bigram_rows(known, klass: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL * ALL, np.int64)
        for batch in batches:
            for lo, hi in T.slices(batch["text"]):
                t = T.Texts(batch["text"].slice(lo, hi - lo), lower=True)
                _, _, c, before = classes_of(t, known.value, klass)
                total += np.bincount(before * ALL + c, minlength=ALL * ALL)
                filled = t.n_words() > 0
                final = np.full(t.n, END)
                final[filled] = c[t.words[1:][filled] - 1]
                total += np.bincount(final * ALL + END, minlength=ALL * ALL)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])
    return rows


def class_bigrams(train: DataFrame, known, klass: np.ndarray) -> np.ndarray:
    """n(class, next class) over all training texts: one small table."""
    rows = train.select("text").mapInArrow(_bigram_rows(known, klass), "cell int, n long").groupBy("cell").agg(
        F.sum("n").alias("n")).collect()
    out = np.zeros(ALL * ALL, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(ALL, ALL)


def cluster(train: DataFrame, known, size: int, passes: int = PASSES) -> np.ndarray:
    """Classes of the ``size`` clustered words, by rank. They begin dealt round
    in the order of their counts. A pass counts the classes around each word
    (summed in the scan's tasks, then over groups of tasks, then in all) and
    lets blocks of words exchange at the same time."""
    klass = np.arange(size, dtype=np.int64) % CLASSES
    n_blocks = max(1, -(-size // BLOCK_WORDS))
    for _ in range(passes if size else 0):
        bigrams = class_bigrams(train, known, klass)
        counts = train.select("text").mapInArrow(
            _context_rows(known, klass, n_blocks), "part int, block int, counts binary")
        groups = max(1, int(np.sqrt(train.rdd.getNumPartitions())))
        some = counts.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("block", "part").applyInArrow(
            _sum_rows, "part int, block int, counts binary")
        moved = some.groupBy("block").applyInArrow(
            _exchange_rows(klass, bigrams, n_blocks), "rank long, class int").collect()
        klass = klass.copy()
        for r in moved:
            klass[r["rank"]] = r["class"]
    return klass


# ---- model and scores ------------------------------------------------------
@dataclass
class Model:
    tokens: int  # all training tokens, ends included
    distinct: int
    texts: int
    klass: np.ndarray
    transition: np.ndarray  # (class before, class), smoothed
    mass: np.ndarray  # of each class, what emissions are divided by

    def unigram(self, n):
        return (n + ADD) / (self.tokens + ADD * (self.distinct + 1))


def fit(docs: DataFrame, passes: int = PASSES) -> tuple[Model, object, DataFrame]:
    """The model, the broadcast known words, and the table of all words. It
    learns from documents that aren't held out."""
    spark = docs.sparkSession
    train = docs.where(fold(F.col("doc_id"), FOLDS) != 0).select("text")
    words = written(count_words(train), "lm-words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    texts = train.count()
    tokens, distinct = sums["n"] + texts, sums["v"] + (texts > 0)
    shared = words.where(F.col("n") * SHARED > tokens).toArrow()
    key, count = shared["word"].to_numpy().view(np.uint64), shared["n"].to_numpy()
    order = np.argsort(key)
    key, count = key[order], count[order]
    rank = np.full(len(key), -1)
    often = np.flatnonzero(count * CLUSTERED > tokens)
    often = often[np.lexsort((key[often], -count[often]))]
    rank[often] = np.arange(len(often))
    known = spark.sparkContext.broadcast(Words(key, count, rank))
    klass = cluster(train, known, len(often), passes)
    bigrams = class_bigrams(train, known, klass)
    total, kinds = np.zeros(ALL), np.zeros(ALL)
    np.add.at(total, klass, count[often])
    np.add.at(kinds, klass, 1)
    for r in words.where(F.col("n") * CLUSTERED <= tokens).groupBy("shape").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        total[CLASSES + r["shape"]], kinds[CLASSES + r["shape"]] = r["n"], r["v"]
    transition = (bigrams + ADD_TRANSITION) / (bigrams.sum(1, keepdims=True) + ADD_TRANSITION * ALL)
    return Model(int(tokens), int(distinct), int(texts), klass, transition, total + ADD * (kinds + 1)), known, words


def _score_rows(model: Model, known):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            for lo, hi in T.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                t = T.Texts(part["text"], lower=True)
                h, at, c, before = classes_of(t, words, model.klass)
                found = at >= 0
                n = np.where(found, words.count[at], 0) if len(words.keys) else np.zeros(len(h))
                step = MIXTURE * model.transition[before, c] / model.mass[c]
                base = np.where(found, np.log10(model.unigram(n)), 0.0)
                score = np.where(found, np.log10(step * (n + ADD) + (1 - MIXTURE) * model.unigram(n)), 0.0)
                owner = t.text_of_word()
                filled = t.n_words() > 0
                final = np.full(t.n, END)
                final[filled] = c[t.words[1:][filled] - 1]
                end = model.unigram(model.texts)
                base_sum = np.bincount(owner, base, t.n) + np.log10(end)
                score_sum = np.bincount(owner, score, t.n) + np.log10(
                    MIXTURE * model.transition[final, END] + (1 - MIXTURE) * end)
                n_known = np.bincount(owner, found, t.n).astype(np.int64) + (model.texts > 0)
                # Words to look up: one row for each text, word and class before.
                rare = np.flatnonzero(~found)
                order = rare[np.lexsort((before[rare], h[rare], owner[rare]))]
                o, key, b = owner[order], h[order], before[order]
                new = np.ones(len(order), bool)
                new[1:] = (o[1:] != o[:-1]) | (key[1:] != key[:-1]) | (b[1:] != b[:-1])
                first = np.flatnonzero(new)
                often = np.diff(np.append(first, len(order)))
                row = part["row"].to_numpy()
                k, z = t.n, len(first)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([row, row[o[first]]])),
                    pa.array(np.concatenate([T.signed(T.mix(row.view(np.uint64))), T.signed(key[first])])),
                    pa.array(np.concatenate([np.zeros(k, np.int32), often.astype(np.int32)])),
                    pa.array(np.concatenate([np.zeros(k), step[order[first]]])),
                    pa.concat_arrays([part["doc_id"], pa.nulls(z, pa.int64())]),
                    pa.array(np.concatenate([t.n_words() + 1, np.zeros(z, np.int64)])),
                    pa.array(np.concatenate([n_known, np.zeros(z, np.int64)])),
                    pa.array(np.concatenate([base_sum, np.zeros(z)])),
                    pa.array(np.concatenate([score_sum, np.zeros(z)]))],
                    ["row", "word", "times", "step", "doc_id", "n_tokens", "n_known", "base", "score"])
    return rows


def score_documents(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (unigram) and score (the class model's log10
    probability of the text, its end included).

    Words are lower-cased in A-Z. Null and empty texts have one token, the
    end. A null doc_id counts as held out; repeated rows each count and each
    get a row. Without training documents no token is known, and all
    probabilities come from smoothing. Very long texts are read whole. An
    empty table gives an empty result; columns besides doc_id and text are
    not read. Words are told apart by 64-bit hashes."""
    model, known, words = fit(docs, passes)
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.mapInArrow(_score_rows(model, known), (
        "row long, word long, times int, step double, doc_id long, n_tokens long, n_known long, base double, score double"))
    # A document's own row goes along with its words to look up, under a key that is no word's.
    looked = parts.join(words.select(F.col("word").alias("_word"), "n"), F.col("word") == F.col("_word"), "left")
    n = F.coalesce("n", F.lit(0))
    unigram = (n + ADD) / F.lit(model.tokens + ADD * (model.distinct + 1))
    scored = looked.select(
        "row", "doc_id", "n_tokens", (F.col("n_known") + F.when(n > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.when(F.col("times") > 0, F.col("times") * F.log10(unigram)).otherwise(F.col("base")).alias("base"),
        F.when(F.col("times") > 0, F.col("times") * F.log10(F.col("step") * (n + ADD) + (1 - MIXTURE) * unigram))
        .otherwise(F.col("score")).alias("score"))
    return scored.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score")).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")

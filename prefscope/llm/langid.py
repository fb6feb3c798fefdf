"""Language identification by a convolutional network over bytes.

A text is cut into windows of a fixed number of bytes. Filters of several
widths slide over a window's one-hot bytes, the largest response of each
filter in the window is kept, and a softmax layer gives the language. The
network is trained in numpy on a bounded sample of labelled windows; a text's
prediction is the mean over all its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefscope.llm import textnum as T

WINDOW_BYTES = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The bounded training sample: so many texts per language, and so many
#: windows of each, evenly spaced over the whole text.
SAMPLE_TEXTS = 600
SAMPLE_WINDOWS = 3
EPOCHS = 8
BATCH = 64
RATE = 0.01
SEED = 7
#: One of so many documents, by crc32 of its id, is never learned from.
FOLDS = 5
UNDETERMINED = "und"
#: Windows that go through the network at a time.
BLOCK = 128

PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double"


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % folds


class Network:
    """``conv``: per width an array (width, 256, filters); ``bias`` of the
    filters; ``out`` and ``out_bias``: the softmax layer."""

    def __init__(self, languages: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.conv = [r.normal(0, 0.2, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.bias = np.zeros(n, np.float32)
        self.out = r.normal(0, 0.2, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def tables(self) -> None:
        """Responses to each pair of bytes, so that a filter of width 4 takes
        two table rows a position instead of four."""
        first, second = np.arange(65536) >> 8, np.arange(65536) & 255
        self.pairs = []
        for c in self.conv:
            steps = [c[k][first] + c[k + 1][second] for k in range(0, len(c) - 1, 2)]
            self.pairs.append((steps, c[-1] if len(c) % 2 else None))

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(windows, bytes) -> the largest response of each filter."""
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        found = []
        for (steps, single), c in zip(self.pairs, self.conv):
            n = x.shape[1] - len(c) + 1
            response = steps[0][pair[:, :n]]
            for k, step in enumerate(steps[1:], 1):
                response += step[pair[:, 2 * k:2 * k + n]]
            if single is not None:
                response += single[x[:, len(c) - 1:]]
            found.append(response.max(axis=1))
        return np.maximum(np.concatenate(found, axis=1) + self.bias, 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = [softmax(self.pooled(x[k:k + BLOCK]) @ self.out + self.out_bias)
                 for k in range(0, len(x), BLOCK)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on cross entropy. The gradient of a max-pooled filter goes to the
    bytes at the position of its largest response alone."""
    net, r = Network(languages, seed), np.random.default_rng(seed)
    params = [*net.conv, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, f = 0, np.arange(FILTERS)
    for _ in range(epochs):
        order = r.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            rows = order[lo:lo + BATCH]
            xb, where, found = x[rows], [], []
            for c in net.conv:
                n = xb.shape[1] - len(c) + 1
                response = sum(c[k][xb[:, k:k + n]] for k in range(len(c)))
                at = response.argmax(axis=1)
                where.append(at)
                found.append(np.take_along_axis(response, at[:, None], 1)[:, 0])
            z = np.concatenate(found, axis=1) + net.bias
            h = np.maximum(z, 0)
            d = softmax(h @ net.out + net.out_bias)
            d[np.arange(len(rows)), y[rows]] -= 1
            d /= len(rows)
            dz = (d @ net.out.T) * (z > 0)
            grads = []
            for i, c in enumerate(net.conv):
                g = np.zeros_like(c)
                part = dz[:, i * FILTERS:(i + 1) * FILTERS]
                for k in range(len(c)):
                    seen = np.take_along_axis(xb, where[i] + k, 1)
                    np.add.at(g[k], (seen, np.broadcast_to(f, seen.shape)), part)
                grads.append(g)
            grads += [dz.sum(axis=0), h.T @ d, d.sum(axis=0)]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.tables()
    return net


def labelled_windows(docs: DataFrame, texts: int = SAMPLE_TEXTS, windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """The training sample: (lang, doc_id, window). Of each language at most
    ``texts`` documents outside the held-out fold, lowest in a hash of their
    id; only the windows leave the executors, never whole texts. Rows are thinned by
    hash to about 1.5 times what is wanted before they are ranked, so no task
    ranks a whole language."""
    known = docs.where(F.col("text").isNotNull() & (F.length("text") > 0) & F.col("lang").isNotNull()
                       & (fold(F.col("doc_id"), FOLDS) != 0)).select(
        "doc_id", "lang", "text", F.xxhash64(F.lit(SEED), "doc_id").alias("h"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return known.limit(0).select("lang", "doc_id", F.lit(b"").alias("window"))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items())
                           for x in (lang, min(1.0, (1.5 * texts + 20) / n))])
    thin = known.where((F.pmod("h", F.lit(1 << 20)) / (1 << 20)) < share[F.col("lang")])
    data = F.encode("text", "utf-8")
    starts = [F.floor(F.lit(k) * F.greatest(F.octet_length("text") - WINDOW_BYTES, F.lit(0)) / max(1, windows - 1))
              for k in range(windows)]
    few = thin.select("lang", "doc_id", "h", F.explode(F.array_distinct(F.array(
        *[s.cast("int") for s in starts]))).alias("at"), data.alias("data")).select(
        "lang", "doc_id", "h", "at", F.substring(F.col("data"), F.col("at") + 1, F.lit(WINDOW_BYTES)).alias("window"))
    rank = Window.partitionBy("lang").orderBy("h", "doc_id", "at")
    return few.withColumn("_n", F.dense_rank().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).withColumn(
        "_r", F.row_number().over(rank)).where((F.col("_n") <= texts) & (F.col("_r") <= texts * windows)).select(
        "lang", "doc_id", "window")


def fit(docs: DataFrame) -> Network | None:
    """The trained network; None if no document has a label and a text."""
    rows = sorted((r["lang"], r["doc_id"], bytes(r["window"])) for r in labelled_windows(docs).collect())
    if not rows:
        return None
    languages = sorted({lang for lang, _, _ in rows})
    x = np.frombuffer(b"".join(w.ljust(WINDOW_BYTES, b"\0") for _, _, w in rows), np.uint8).reshape(-1, WINDOW_BYTES)
    y = np.array([languages.index(lang) for lang, _, _ in rows])
    return train(x, y, languages)


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, zero bytes behind their ends; each window's
    text and its bytes. An empty text has one window."""
    t = T.Texts(texts)
    sizes = np.diff(t.offset)
    n = np.maximum(1, -(-sizes // WINDOW_BYTES))
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(begin[-1] * WINDOW_BYTES, np.uint8)
    out[np.arange(len(t.data)) + np.repeat(begin[:-1] * WINDOW_BYTES - t.offset[:-1], sizes)] = t.data
    owner = np.repeat(np.arange(t.n), n)
    held = np.minimum(sizes[owner] - (np.arange(begin[-1]) - begin[owner]) * WINDOW_BYTES, WINDOW_BYTES)
    return out.reshape(-1, WINDOW_BYTES), owner, np.maximum(held, 1)


def _predict(net: Network | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if net is not None:
            net.tables()
        for batch in batches:
            for lo, hi in T.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                n = hi - lo
                lang, score = [UNDETERMINED] * n, np.zeros(n)
                if net is not None:
                    x, owner, held = windows_of(part["text"])
                    total = np.zeros((n, len(net.languages)))
                    np.add.at(total, owner, net.predict(x) * held[:, None])
                    total /= total.sum(axis=1, keepdims=True)
                    best = total.argmax(axis=1)
                    letter = part["has_letter"].to_numpy(zero_copy_only=False).astype(bool)
                    lang = [net.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letter)]
                    score = np.where(letter, total[np.arange(n), best], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(lang, pa.string()),
                     pa.array(np.minimum(score, 1.0), pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"])
    return predict


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the mean
    probability of the language over the text's windows).

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text when nothing is labelled. Rows without a label or text aren't learned
    from; a null doc_id counts as held out. Very long texts are read whole, a
    block of windows at a time. Repeated rows get the same answer, an empty
    table an empty result. Only doc_id, text and (for learning) lang are read.
    """
    net = net if net is not None else fit(docs)
    if net is not None:
        net.pairs = []  # rebuilt in the tasks
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return rows.mapInArrow(_predict(net), PREDICTION)


def accepted(docs: DataFrame, min_score: float = 0.5, net: Network | None = None) -> DataFrame:
    """The documents, with all their columns, whose language is one that was
    learned, with at least ``min_score``."""
    net = net if net is not None else fit(docs)
    if net is not None:
        net.pairs = []
    own = docs.schema
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                       F.col("text").rlike(r"\p{L}").alias("has_letter"), F.lit(False).alias("held_out"))
    at, predict = names.index("text"), _predict(net)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = batch["has_letter"].fill_null(False)
            view = pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(batch))), batch["held_out"], batch[f"c{at}"], letter],
                ["doc_id", "held_out", "text", "has_letter"])
            good = np.zeros(len(batch), bool)
            for out in predict(iter([view])):
                ids = out["doc_id"].to_numpy()
                good[ids] = [x != UNDETERMINED for x in out["lang_pred"].to_pylist()]
                good[ids] &= out["score"].to_numpy() >= min_score
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept[f"c{i}"] for i in range(len(names))], names)

    return rows.mapInArrow(keep, own)

"""Collocations: phrases of two to five words that are frequent and bind.

Texts are dealt into shards. A shard's words are numbered and held in an
FM-index over word ids: the suffixes sorted to the depth of the longest phrase,
the word before each of them (the Burrows-Wheeler transform), and the same for
the reversed text. A phrase is an interval of either order; adding a word on one
side is a backward step in one index and a shift in the other, so phrases grow
to the right and left in turn, all of one length at once, with their counts.

Counts are summed across the shards. A phrase can be frequent only if its words
and pairs are, so a shard first learns which of its words, then which of its pairs
are frequent in all texts. Of the longer phrases made of these, most are rare:
a bucket first counts them in the cells of a sketch (a cell has the phrases whose
hashes begin alike, so no phrase occurs more often than its cell), learns which of
its cells are frequent in all texts, and enumerates phrases within these only.
Counts are kept by 64-bit hashes; of the buckets that have a frequent phrase, one
sends its text, once. Buckets hold few languages each, as phrases are counted by
language: a phrase is then in few buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefscope.llm import textnum as T
from prefscope.llm.shared import lookup, partitions, written

LONGEST, LEAST, BEST = 5, 100, 2000
#: UTF-8 bytes of text in a bucket, about; a task holds one bucket at a time.
BUCKET_BYTES = 32_000_000
#: Shards after which a bucket's counts are put together.
TOGETHER = 8
#: Bytes of text in a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 1_000_000
#: Bytes of text for each cell of the sketch of longer phrases, at most.
CELL_BYTES = 256
#: Languages are dealt into buckets by so many hashes, and texts of one hash by so many steps.
LANG_SLOTS, STEPS = 1000, 1 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\f\r"]] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[[9, 32]] = True


class Index:
    """An FM-index of one direction over word ids (0 stands between pieces),
    right for patterns of at most ``depth`` words."""

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        order = np.argsort(_ranks(ids, depth), kind="stable")
        self.bwt = ids[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(ids))])
        self.width = n + 1

    @cached_property
    def places(self) -> np.ndarray:
        """(word, place) of the transform in order: ranks are found by bisection."""
        return np.sort(self.bwt * self.width + np.arange(len(self.bwt)))

    def rank(self, word: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each word stands before ``end`` in the transform."""
        return np.searchsorted(self.places, word * self.width + end) - self.less[word]

    def before(self, low: np.ndarray, count: np.ndarray):
        """The distinct words before the suffixes of each interval: (interval,
        word, count, words in the interval that are smaller)."""
        n = int(count.sum())
        owner = np.repeat(np.arange(len(low)), count)
        place = np.arange(n) - np.repeat(np.cumsum(count) - count, count) + low[owner]
        top = int(self.bwt.max(initial=0)) + 1
        key = np.sort(owner * top + self.bwt[place])
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.zeros(0, np.int64)
        owner, word = key[at] // top, key[at] % top
        start = (np.cumsum(count) - count)[owner]
        return owner, word, np.diff(np.append(at, n)), at - start


def _ranks(ids: np.ndarray, depth: int) -> np.ndarray:
    """An order of the suffixes by their first ``depth`` words. As many words
    as fit are packed into 64 bits at a time."""
    n, out, done = len(ids), ids, 1
    while done < depth:
        bits, top = int(ids.max(initial=0)).bit_length(), int(out.max(initial=0)).bit_length()
        take = min(depth - done, max(1, (62 - top) // max(bits, 1)))
        key = out.copy()
        for i in range(done, done + take):
            key <<= bits
            key[:max(n - i, 0)] |= ids[i:]
        done += take
        out = np.unique(key, return_inverse=True)[1] if done < depth else key
    return out


class Phrases:
    """Both directions of a shard, and phrases as synchronised intervals."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids, self.depth = ids, depth
        self.less = np.concatenate([[0], np.cumsum(np.bincount(ids))])

    @cached_property
    def forward(self) -> Index:
        return Index(self.ids, self.depth)

    @cached_property
    def backward(self) -> Index:
        return Index(self.ids[::-1].copy(), self.depth)

    def start(self) -> tuple[np.ndarray, ...]:
        """All words as phrases: (words, place in forward order, in backward
        order, count)."""
        word = np.arange(1, len(self.less) - 1)
        low, count = self.less[word], self.less[word + 1] - self.less[word]
        return word[:, None], low, low.copy(), count

    def extend(self, phrases: tuple[np.ndarray, ...], right: bool, allowed, last: bool = False) -> tuple[np.ndarray, ...]:
        """Every phrase with each word that stands to its right (or left) in
        the text; ``allowed`` (left word, right word) says which pairs may.
        Phrases that are the ``last`` to grow get no intervals."""
        words, low, mirror, count = phrases
        one = self.backward if right else self.forward
        here, other = (mirror, low) if right else (low, mirror)
        owner, word, times, smaller = one.before(here, count)
        keep = word > 0
        edge = words[owner, -1 if right else 0]
        keep &= allowed(edge, word) if right else allowed(word, edge)
        owner, word, times, smaller = owner[keep], word[keep], times[keep], smaller[keep]
        pair = [words[owner], word[:, None]]
        pair = np.hstack(pair if right else pair[::-1])
        if last:
            return pair, times
        here = one.less[word] + one.rank(word, here[owner])
        other = other[owner] + smaller
        return pair, *((other, here) if right else (here, other)), times


class Shard:
    """The words of some texts, their language in their hash, and where pieces
    begin."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.t = T.Texts(texts, lower=True, separator=_SEPARATOR)
        self.lang = langs.dictionary_encode()
        names = T.Texts(self.lang.dictionary, separator=np.zeros(256, bool))
        self.names = self.lang.dictionary
        key = np.zeros(len(self.names), np.uint64)
        filled = np.flatnonzero(np.diff(names.offset))
        key[filled] = T.span(names.sums(1), names.offset[filled], names.offset[filled + 1], 1)
        self.of = np.repeat(np.asarray(self.lang.indices), self.t.n_words())
        self.hash = T.mix(self.t.hashes() ^ key[self.of])
        n = len(self.t.start)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[self.t.data])])
        self.first = np.ones(n, bool)
        self.first[1:] = breaks[self.t.start[1:]] > breaks[self.t.end[:-1]]
        self.first[self.t.words[:-1][self.t.n_words() > 0]] = True

    def number(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The kept words as ids from 1, with 0 wherever words were left out or
        a piece ends; the hash of each id; a word of each id."""
        at = np.flatnonzero(keep)
        hashes, one, ids = np.unique(self.hash[at], return_index=True, return_inverse=True)
        gap = np.ones(len(at), bool)
        gap[1:] = (np.diff(at) > 1) | self.first[at[1:]]
        place = np.arange(len(at)) + np.cumsum(gap)
        out = np.zeros(int(place[-1]) + 2 if len(at) else 1, np.int64)
        out[place] = ids + 1
        return out, hashes, at[one]

    def text(self, words: np.ndarray) -> pa.Array:
        """The text of some words, by their numbers."""
        size = self.t.end[words] - self.t.start[words]
        offset = np.concatenate([[0], np.cumsum(size)])
        byte = np.arange(offset[-1]) - np.repeat(offset[:-1] - self.t.start[words], size)
        return pa.LargeStringArray.from_buffers(
            len(words), pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(self.t.data[byte]))


def _shards(table: pa.Table) -> Iterator[Shard]:
    texts, langs = (table[c].combine_chunks() if table.num_rows else pa.array([], pa.string()) for c in ("text", "lang"))
    for lo, hi in T.slices(texts, SHARD_BYTES):
        yield Shard(texts.slice(lo, hi - lo), langs.slice(lo, hi - lo))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return T.mix(left * T.U(T.BASES[0]) + T.mix(right ^ T.U(T.BASES[1])))


def _known(found: pa.Table, kind: int) -> np.ndarray:
    """The hashes of words (kind 1) or pairs (2) that are frequent."""
    if not found.num_rows:
        return np.zeros(0, np.uint64)
    kinds, h = (found[c].combine_chunks().to_numpy() for c in ("kind", "h"))
    return np.sort(h[kinds == kind].view(np.uint64))


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts with the counts of equal hashes summed."""
    h = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)])
    c = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
    order = np.argsort(h)
    h, c = h[order], c[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(c, at) if len(at) else c


def _summed(texts: pa.Table, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """The counts of a bucket's shards as rows, a few shards at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if len(held) > TOGETHER:
            held = [_together(held)]
    h, c = _together(held)
    bucket = texts["bucket"][0].as_py() if texts.num_rows else 0
    return pa.table({"h": T.signed(h), "bucket": np.full(len(h), bucket, np.int32), "n": c})


def _word_rows(texts: pa.Table) -> pa.Table:
    """How often each word of a bucket occurs."""
    return _summed(texts, (np.unique(s.hash, return_counts=True) for s in _shards(texts)))


def _pair_rows(texts: pa.Table, found: pa.Table) -> pa.Table:
    """How often each pair of frequent words stands together in a bucket."""
    known = _known(found, 1)

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in _shards(texts) if len(known) else ():
            ids, h, _ = s.number(_is_in(s.hash, known))
            index = Phrases(ids, 2)
            words, times = index.extend(index.start(), True, lambda a, b: np.ones(len(a), bool), last=True)
            yield _folded(h, words), times
    return _summed(texts, parts())


def _folded(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes of phrases from those of their words; of two words, ``_pair``."""
    out = hashes[words[:, 0] - 1]
    for i in range(1, words.shape[1]):
        out = _pair(out, hashes[words[:, i] - 1])
    return out


def _chains(s: Shard, pairs: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 3: where phrases made of frequent pairs begin, and
    their hashes (as ``_folded``)."""
    pair = _pair(s.hash[:-1], s.hash[1:])
    joined = ~s.first[1:] & _is_in(pair, pairs)
    at = np.flatnonzero(joined)
    value = pair[at]
    for k in range(3, longest + 1):
        going = at + k - 2 < len(joined)
        going[going] = joined[at[going] + k - 2]
        at = at[going]
        value = _pair(value[going], s.hash[at + k - 1])
        yield at, value


def _cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> T.U(64 - bits)


def _cell_rows(longest: int, bits: int, blocks: int):
    """How often phrases of 3 words and more that are made of frequent pairs occur
    in a bucket, by cell; cells next to each other make up a block, a row."""
    def rows(texts: pa.Table, found: pa.Table) -> pa.Table:
        pairs, held = _known(found, 2), []
        for s in _shards(texts) if len(pairs) else ():
            held += [np.unique(_cell(h, bits), return_counts=True) for _, h in _chains(s, pairs, longest)]
            if len(held) > TOGETHER:
                held = [_together(held)]
        cells, n = _together(held)
        block = (cells * T.U(blocks) >> T.U(bits)).astype(np.int32)
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(cells) else np.zeros(0, np.int64)
        bucket = texts["bucket"][0].as_py() if texts.num_rows else 0
        return pa.table({
            "bucket": np.full(len(cut), bucket, np.int32), "block": block[cut],
            "cells": pa.array([x.astype(np.uint32).tobytes() for x in np.split(cells, cut[1:])][:len(cut)], pa.binary()),
            "counts": pa.array([x.tobytes() for x in np.split(n, cut[1:])][:len(cut)], pa.binary())})
    return rows


def _heavy_rows(least: int):
    """For each bucket the cells that it has of a block and that occur ``least``
    times in all buckets."""
    def rows(sent: pa.Table) -> pa.Table:
        cells = [np.frombuffer(x, np.uint32).astype(np.uint64) for x in sent["cells"].to_pylist()]
        all_cells, n = _together([(c, np.frombuffer(x, np.int64)) for c, x in zip(cells, sent["counts"].to_pylist())])
        heavy = all_cells[n >= least]
        return pa.table({
            "bucket": sent["bucket"].combine_chunks(),
            "cells": pa.array([c[_is_in(c, heavy)].astype(np.uint32).tobytes() for c in cells], pa.binary())})
    return rows


def _longer_rows(longest: int, bits: int):
    """Counts phrases of 3 words and more. They are made of frequent pairs (kind 2)
    and are in a cell that is frequent (3), as all phrases within them are."""
    def parts(texts: pa.Table, pairs: np.ndarray, heavy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in _shards(texts) if len(heavy) else ():
            at, value = next(_chains(s, pairs, 3))
            at = at[_is_in(_cell(value, bits), heavy)]
            if not len(at):
                continue
            keep = np.zeros(len(s.hash), bool)
            for i in range(3):
                keep[at + i] = True
            ids, h, _ = s.number(keep)

            def allowed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
                return _is_in(_pair(h[left - 1], h[right - 1]), pairs)

            index = Phrases(ids, longest)
            grown = index.start()
            for k in range(2, longest + 1):
                grown = index.extend(grown, k % 2 == 0, allowed, last=k == longest)
                if k > 2:
                    value = _folded(h, grown[0])
                    some = _is_in(_cell(value, bits), heavy)
                    grown = tuple(g[some] for g in grown)
                    yield value[some], grown[-1]

    def rows(texts: pa.Table, found: pa.Table) -> pa.Table:
        heavy = np.frombuffer(b"".join(found["cells"].to_pylist() if found.num_rows else []), np.uint32)
        return _summed(texts, parts(texts, _known(found, 2), np.sort(heavy).astype(np.uint64)))
    return rows


PHRASES = "lang string, k int, phrase string, n long"


def _text_rows(longest: int):
    def rows(texts: pa.Table, found: pa.Table) -> pa.Table:
        """The frequent phrases whose text this bucket gives, with their count
        in all buckets, and (k = 0) how many words each language has here."""
        h, n = (found[c].combine_chunks().to_numpy() for c in ("h", "total"))
        order = np.argsort(h.view(np.uint64))
        known, n, out = h.view(np.uint64)[order], n[order], []
        missing = np.ones(len(known), bool)
        for s in _shards(texts):
            total = np.bincount(s.of, minlength=len(s.names))
            out.append(_phrases(s.names, 0, pa.array([""] * len(total), pa.large_string()), total))
            at, value = np.arange(len(s.hash)), s.hash
            for k in range(1, longest + 1):
                if k > 1:
                    going = at + k - 1 < len(s.hash)
                    going[going] = ~s.first[at[going] + k - 1]
                    at, value = at[going], value[going]
                    value = _pair(value, s.hash[at + k - 1])
                if not len(at) or not missing.any():
                    break
                place = np.searchsorted(known, value)
                place[place == len(known)] = 0
                hit = np.flatnonzero((known[place] == value) & missing[place])
                place, first = np.unique(place[hit], return_index=True)
                missing[place] = False
                word = at[hit[first]]
                columns = [s.text(word + i) for i in range(k)]
                phrase = columns[0] if k == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))
                out.append(_phrases(s.names.take(pa.array(s.of[word])), k, phrase, n[place]))
        schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
        return pa.concat_tables(out).cast(schema).combine_chunks() if out else schema.empty_table()
    return rows


def _phrases(lang: pa.Array, k: int, phrase: pa.Array, n: np.ndarray) -> pa.Table:
    return pa.table({"lang": lang, "k": np.full(len(n), k, np.int32), "phrase": phrase, "n": n.astype(np.int64)})


def by_language(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``docs`` with the ``bucket`` of each text, and the bytes of all texts.
    Texts lie along a line, those of a language next to each other in the order
    of a hash; the line is cut into buckets of equal bytes, ``least`` at least."""
    slot = F.pmod(F.xxhash64("lang"), F.lit(LANG_SLOTS)).cast("int")
    width = dict(docs.groupBy(slot.alias("slot")).agg(F.sum(F.octet_length("text") + F.lit(1).cast("long"))).collect())
    size = sum(width.values())
    buckets = max(least, -(-size // BUCKET_BYTES))
    widths = [float(width.get(i, 0)) for i in range(LANG_SLOTS)]
    starts = np.concatenate([[0.0], np.cumsum(widths)[:-1]]).tolist()
    step = F.pmod(F.xxhash64("doc_id", "text"), F.lit(STEPS)) / F.lit(float(STEPS))
    place = (F.get(F.lit(starts), slot) + F.get(F.lit(widths), slot) * step) * F.lit(buckets / max(size, 1))
    return docs.withColumn("bucket", F.least(F.floor(place), F.lit(buckets - 1)).cast("int")), size


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, k, phrase, n): the phrases of up to ``longest`` words that occur
    at least ``least`` times in the texts of a language, their words joined by
    spaces; and with k = 0 the number of all words of each language."""
    n = partitions(docs.sparkSession)
    texts, size = by_language(docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")), max(1, n // 4))
    texts = texts.select("text", "lang", "bucket").repartition(n, "bucket")

    def frequent(rows: DataFrame, kind: int) -> DataFrame:
        """The (bucket, h) of what occurs ``least`` times in all, how often, and
        whether the bucket is the one that gives its text."""
        same, turn = Window.partitionBy("h"), F.struct(F.xxhash64("h", "bucket"), "bucket")
        return rows.withColumn("total", F.sum("n").over(same)).withColumn("own", turn == F.min(turn).over(same)).where(
            F.col("total") >= least).select("bucket", "h", F.lit(kind).alias("kind"), "total", "own")

    def with_texts(found: DataFrame, rows, schema: str = "h long, bucket int, n long") -> DataFrame:
        return texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(rows, schema)

    single = frequent(texts.groupBy("bucket").applyInArrow(_word_rows, "h long, bucket int, n long"), 1)
    pairs = frequent(with_texts(single.select("bucket", "h", "kind"), _pair_rows), 2)
    found = single.unionByName(pairs)
    if longest > 2:
        bits = min(32, max(10, (size // CELL_BYTES).bit_length()))
        known = pairs.select("bucket", "h", "kind")
        cells = with_texts(known, _cell_rows(longest, bits, n), "bucket int, block int, cells binary, counts binary")
        heavy = cells.groupBy("block").applyInArrow(_heavy_rows(least), "bucket int, cells binary")
        known = known.withColumn("cells", F.lit(b"")).unionByName(
            heavy.select("bucket", F.lit(0).cast("long").alias("h"), F.lit(3).alias("kind"), "cells"))
        found = found.unionByName(frequent(with_texts(known, _longer_rows(longest, bits)), 3))
    rows = with_texts(found.where("own").select("bucket", "h", "total"), _text_rows(longest), PHRASES)
    rows = written(rows, "phrase-texts")
    return rows.where("k > 0").unionByName(
        rows.where("k = 0").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r,
    n, score.

    ASCII letters are lower-cased; texts are cut into pieces at ``. , ; : ! ?``
    and the line breaks \\n \\x0b \\f \\r, pieces into words at spaces and tabs. A
    candidate has 2 to ``longest`` words and occurs a >= ``least`` times within
    pieces, overlaps included. Cut after k words into parts that occur l and r
    times, it scores floor(1000 a n / (l r)), n being all words of the language;
    the lowest-scoring cut counts, of equal scores the one with the smallest k.
    Candidates inside a longer phrase that occurs as often are dropped. Each
    language's first ``best`` stay, by score, a (both descending) and phrase
    (by UTF-8 bytes).

    A null text is empty, a null lang is ``und`` (together with documents that
    have that lang). Repeated rows count as often as they are there; an empty
    table gives an empty result; columns besides doc_id, text and lang are not
    read. Texts are read whole; one text is in one task's memory. Products are
    exact (decimals of 38 digits).
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    counts = written(phrase_counts(docs, longest, least), "phrases")
    phrases = counts.where("k > 0")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    parts = (phrases.where("k > 1").withColumn("a", F.col("n")).select("lang", "phrase", "k", "a", cut.alias("cut"))
             .withColumn("left", F.expr("substring_index(phrase, ' ', cut)"))
             .withColumn("right", F.expr("substring_index(phrase, ' ', cut - k)")))
    for side, name in (("left", "l"), ("right", "r")):
        part = phrases.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("n").alias(name))
        parts = parts.join(part, (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part"))).drop("of", "part")
    size = written(counts.where("k = 0").select("lang", "n"), "phrase-langs")
    parts = lookup(parts, size, ["lang"], "n", ["phrase"], "inner")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    parts = parts.withColumn("top", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")).cast("decimal(34,0)")).withColumn(
        "bottom", wide("l") * wide("r")).withColumn("score", F.expr("cast(top div bottom as bigint)"))
    scored = parts.groupBy("lang", "phrase", "k", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("lowest"))
    longer = phrases.where("k > 2")
    inside = longer.select("lang", "n", F.explode(F.expr(
        "array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k))")).alias("part"))
    inside = inside.groupBy(F.col("lang").alias("of"), "part").agg(F.max("n").alias("within"))
    kept = scored.join(inside, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left").where(
        "within is null or within < a")
    score = F.col("lowest.score")
    order = Window.partitionBy("lang").orderBy(score.desc(), F.col("a").desc(), F.col("phrase"))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("lowest.l").alias("l"),
        F.col("lowest.r").alias("r"), "n", score.alias("score"))

"""The prefix trie of conversations, from sorted sequences.

A conversation is a sequence of turns, each a digest of its role and text. In
sorted order the conversations that share a prefix are neighbours, and the
longest common prefixes (LCP) of neighbours say where they part. A row brings a
new node for every depth beyond its LCP with the row before. Over a sparse table
of range minima each of these prefixes searches its own extent: to the right, as
far as no LCP is below its depth, which gives its members, and to the left at
one depth less, which gives the row where its parent begins. No stack is kept,
and all prefixes are searched at once as numpy arrays.

The rows are range partitioned by sequence and conv_id, so even equal sequences
spread over tasks. A task finishes the nodes that lie inside its range; those
that reach its first or last row are open: their sums are put together from all
tasks over the first and last rows alone, by the same search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscope.llm.shared import partitions, written

#: Bytes of a turn in a sequence (an MD5 digest).
TOKEN = 16
#: Conversations c - c % 5 .. share the first turns of c - c % 5, at most 8.
FAMILY, HEADS = 5, 9
#: Turns that a task of the sorted order holds, about.
TURNS_PER_TASK = 2_000_000
#: Decimal ids that travel in one row when their hash spans tasks.
IDS_PER_PIECE = 1000
NO_ENDS = hashlib.sha256(b"").hexdigest()

PARTS = ("kind int, part int, ref long, depth long, conv_id long, parent_ref long, parent_conv_id long, "
         "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
         "token binary, size long, side int")
OPEN = ("part int, ref long, node long, first boolean, depth long, conv_id long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): every conversation as the first h turns of
    conversation c - c % 5, then its own after its first h; h is the unsigned
    crc32 of the decimal conv_id modulo 9. ``key`` holds 16 bytes a turn,
    ``sizes`` the UTF-8 bytes of each text.

    Turns are ordered by turn, null first, and rows of one turn number by the
    MD5 of their role and text. A null role or text is empty; rows without a
    conv_id belong to no conversation. One shuffle, on c - c % 5.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
                                      .cast("binary")).alias("token"),
                 F.octet_length(text).cast("long").alias("size")).alias("t"))
    turns = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).repartition("base")
    own = turns.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    heads = own.where("conv_id = base").select(
        F.col("base").alias("head_of"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.slice("own", 1, 0)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h),
                     F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0))))
    return (own.join(heads, F.col("base") == F.col("head_of"), "left").select("conv_id", turns.alias("turns"))
            .select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["token"]), "")).alias("key"),
                    F.transform("turns", lambda t: t["size"]).alias("sizes")))


class RangeMin:
    """Minima of any range of some values, from a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minima of [low, high]."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] + 1 - 2 ** k])
        return out

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each the largest r with no value below its bound in [at + 1, r]."""
        out = at.copy()
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            fits = np.flatnonzero(out + 1 < len(level))
            out[fits[level[out[fits] + 1] >= bound[fits]]] += 2 ** k
        return out

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each the smallest l with no value below its bound in [l + 1, at]."""
        out = at.copy()
        for k in reversed(range(len(self.levels))):
            fits = np.flatnonzero(out >= 2 ** k)
            out[fits[self.levels[k][out[fits] + 1 - 2 ** k] >= bound[fits]]] -= 2 ** k
        return out


def common(tokens: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Turns that each row has in common with the one before (0 for the first).
    ``tokens``: the turns of all rows; ``start``: where each row's begin, and
    the end."""
    depth = np.diff(start)
    row = np.repeat(np.arange(len(depth)), depth)
    at = np.arange(len(tokens)) - start[row]
    here = np.flatnonzero((row > 0) & (at < depth[row - 1]))
    differs = np.ones(len(tokens), bool)
    differs[here] = (tokens[here] != tokens[start[row[here] - 1] + at[here]]).any(1)
    first = depth.copy()
    full = np.flatnonzero(depth)
    if len(full):
        part = np.minimum.reduceat(np.where(differs, at, len(tokens)), start[full])
        first[full] = np.minimum(part, depth[full])
    first[:1] = 0
    return first


class Trie:
    """The nodes of sorted sequences: for each the row where it begins, its
    depth, the last row of its extent and its parent's number. The nodes of a
    subtree are numbered one after the other."""

    def __init__(self, tokens: np.ndarray, start: np.ndarray):
        depth, lcp = np.diff(start), common(tokens, start)
        self.mins = RangeMin(lcp)
        self.new = lcp + 1
        self.new[0] = 0  # the first row brings the root
        count = depth - self.new + 1
        self.base = np.concatenate([[0], np.cumsum(count)])
        self.row = np.repeat(np.arange(len(depth)), count)
        self.depth = np.arange(len(self.row)) - self.base[self.row] + self.new[self.row]
        self.last = self.mins.right(self.row, self.depth)
        self.parent = np.full(len(self.row), -1)
        below = np.flatnonzero(self.depth)
        self.parent[below] = self.at(self.row[below], self.depth[below] - 1)
        self.end = self.base[self.last + 1]  # behind the last node of the subtree

    def at(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The number of the node that holds the first ``depth`` turns of a row."""
        first = self.mins.left(row, depth)
        return self.base[first] + depth - self.new[first]

    def children(self, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        parent = self.parent[of]
        return np.bincount(parent[parent >= 0], minlength=len(self.row))

    def below(self, values: np.ndarray) -> np.ndarray:
        """Each node's sum over its subtree."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.end] - total[:-1]


def _digests(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, ids[a:b])).encode()).hexdigest()
            for a, b in zip(low.tolist(), high.tolist())]


def _rows(**columns) -> pa.RecordBatch:
    """A batch of the schema PARTS; columns that aren't given are null."""
    types = {"kind": pa.int32(), "part": pa.int32(), "side": pa.int32(), "ends_sha256": pa.string(), "token": pa.binary()}
    names = [c.split()[0] for c in PARTS.split(", ")]
    n = len(columns["depth"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], types.get(c, pa.int64())) if c in columns else pa.nulls(n, types.get(c, pa.int64()))
         for c in names], names)


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the sorted order: its closed nodes (kind 0), what it knows
    of its open ones (kind 1), and the ids that end at these (kind 2)."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table).combine_chunks()
    part, n = TaskContext.get().partitionId(), table.num_rows
    conv = table["conv_id"].to_numpy()
    keys = table["key"].combine_chunks().cast(pa.large_binary())
    keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
    sizes = np.asarray(table["sizes"].combine_chunks().flatten(), np.int64)
    raw = b"".join(keys.to_pylist())
    tokens = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    start = np.concatenate([[0], np.cumsum([len(k) // TOKEN for k in keys.to_pylist()], dtype=np.int64)])
    t = Trie(tokens, start)
    depth = np.diff(start)
    opened = (t.row == 0) | (t.last == n - 1)
    closed = ~opened
    size = np.zeros(len(t.row), np.int64)
    turn = t.depth > 0
    size[turn] = sizes[start[t.row[turn]] + t.depth[turn] - 1]
    members = t.last - t.row + 1
    kids = t.children(np.flatnonzero(closed))
    low = RangeMin(conv).within(t.row, t.last)
    leaves = t.below(closed & (kids == 0))
    saved = t.below(np.where(closed, (members - 1) * size, 0))
    # Equal sequences are neighbours; their node begins at the first of them.
    same = np.zeros(n, bool)
    same[1:] = (t.new[1:] > depth[1:]) & (depth[1:] == depth[:-1])
    first = np.flatnonzero(~same)
    behind = np.append(first[1:], n)
    ending = t.base[first + 1] - 1
    out = np.flatnonzero(closed)
    if len(out):
        digest = np.full(len(t.row), NO_ENDS, object)
        inner = closed[ending]
        digest[ending[inner]] = _digests(conv, first[inner], behind[inner])
        parent = t.parent[out]
        known = closed[parent]
        # Open nodes are known by number: those of the first row by their depth,
        # those of the last row alone behind them.
        yield _rows(kind=np.zeros(len(out)), part=np.full(len(out), part), depth=t.depth[out], conv_id=low[out],
                    parent_ref=pa.array(_refs(t, parent, depth[0]), mask=known),
                    parent_conv_id=pa.array(low[parent], mask=~known), n_convs=members[out], n_children=kids[out],
                    n_leaves=leaves[out], saved_tokens=saved[out], ends_sha256=pa.array(digest[out], pa.string()))
    at = np.flatnonzero(opened)
    last = t.row[at] > 0
    token = [raw[TOKEN * i:TOKEN * (i + 1)] for i in (start[t.row[at]] + t.depth[at] - 1)]
    yield _rows(kind=np.ones(len(at)), part=np.full(len(at), part), ref=_refs(t, at, depth[0]), depth=t.depth[at],
                conv_id=low[at], n_convs=members[at], n_children=kids[at], n_leaves=leaves[at], saved_tokens=saved[at],
                token=[x if d else b"" for x, d in zip(token, t.depth[at])], size=size[at], side=last.astype(np.int32))
    for node, a, b in zip(*(x[opened[ending]].tolist() for x in (ending, first, behind))):
        pieces = range(a, b, IDS_PER_PIECE)
        ref = _refs(t, np.array([node]), depth[0])[0]
        yield _rows(kind=np.full(len(pieces), 2), part=np.full(len(pieces), part), ref=np.full(len(pieces), ref),
                    depth=np.arange(len(pieces)),
                    ends_sha256=[",".join(map(str, conv[i:min(i + IDS_PER_PIECE, b)])) for i in pieces])


def _refs(t: Trie, nodes: np.ndarray, first_depth: int) -> np.ndarray:
    """Numbers of open nodes within their task: the depth for prefixes of the
    first row, then those of the last row that the first doesn't have."""
    return np.where(t.row[nodes] == 0, t.depth[nodes], first_depth + t.depth[nodes])


def _open_nodes(table: pa.Table) -> pa.Table:
    """The open nodes of all tasks put together, over the first and last rows
    of the tasks in sorted order."""
    names = [c.split()[0] for c in OPEN.split(", ")]
    rows = table.sort_by([("part", "ascending"), ("side", "ascending"), ("depth", "ascending")])
    part, side, depth, ref, size, n_convs, conv, kids, leaves, saved = (
        np.asarray(rows[c]) for c in ("part", "side", "depth", "ref", "size", "n_convs", "conv_id", "n_children",
                                      "n_leaves", "saved_tokens"))
    token = rows["token"].to_pylist()
    edges, start, of, sizes = [], [0], np.zeros(len(part), np.int64), []
    cuts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (side[1:] != side[:-1])))
    for a, b in zip(cuts, np.append(cuts[1:], len(part))):
        if side[a]:  # the last row goes on from a prefix of the first
            shared = slice(start[-2], start[-2] + depth[a] - 1)
            edges += edges[shared]
            sizes += sizes[shared]
        skip = a if side[a] else a + 1
        edges += token[skip:b]
        sizes += size[skip:b].tolist()
        start.append(len(edges))
        of[a:b] = len(start) - 2
    start, sizes = np.array(start), np.array(sizes, np.int64)
    t = Trie(np.frombuffer(b"".join(edges), np.uint64).reshape(-1, 2), start)
    node, m = t.at(of, depth), len(t.row)

    def total(values: np.ndarray) -> np.ndarray:
        out = np.zeros(m, np.int64)
        np.add.at(out, node, values)
        return out

    members, low = total(n_convs), np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(low, node, conv)
    children = total(kids) + t.children()
    weight = np.zeros(m, np.int64)
    turn = t.depth > 0
    weight[turn] = (members[turn] - 1) * sizes[start[t.row[turn]] + t.depth[turn] - 1]
    n_leaves = total(leaves) + t.below(children == 0)
    n_saved = total(saved) + t.below(weight)
    first = np.zeros(len(part), bool)
    first[np.unique(node, return_index=True)[1]] = True
    parent = pa.array(np.where(t.parent < 0, 0, low[t.parent]), mask=t.parent < 0)
    return pa.Table.from_arrays(
        [pa.array(part, pa.int32()), pa.array(ref), pa.array(node), pa.array(first), pa.array(depth), pa.array(low[node]),
         parent.take(pa.array(node)), *(pa.array(x[node]) for x in (members, children, n_leaves, n_saved))], names)


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node over its pieces, which come in order."""
    now, digest = None, None
    for batch in batches:
        nodes, ids = [], []
        for node, piece in zip(batch["node"].to_pylist(), batch["piece"].to_pylist()):
            if node != now:
                if digest:
                    nodes.append(now)
                    ids.append(digest.hexdigest())
                now, digest = node, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ids, pa.string())], ["node", "ends"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["node", "ends"])


def prefix_trie(sequences: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, key of 16 bytes
    a turn, sizes): conv_id (the smallest member), depth, parent_conv_id (null
    for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (of
    the ascending conv_ids that end at the node, joined by commas).

    The members of a node are the sequences that begin with it. Sequences
    without turns are members of the root alone; equal sequences share all
    nodes; an empty table has no nodes. conv_ids must not repeat. A task holds
    about 2,000,000 turns of the sorted order (``tasks``: in how many ranges it
    is cut), and a sequence, however long, is in one task at 16 bytes a turn.
    The first and last rows of all tasks meet in one task. The ids that end at
    an open node are hashed as they stream by.
    """
    spark = sequences.sparkSession
    rows = written(sequences, "trie-rows")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sizes")).alias("turns")).first()
    n = tasks or max(partitions(spark), -(-(found["turns"] or 0) // TURNS_PER_TASK))
    in_order = rows.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = written(in_order.mapInArrow(_sorted_rows, PARTS), "trie-parts")
    opened = written(parts.where("kind = 1").groupBy(F.lit(0).alias("all")).applyInArrow(_open_nodes, OPEN), "trie-open")
    closed = parts.where("kind = 0")
    known = closed.where("parent_ref is null").select(*NODE)
    parents = opened.select(F.col("part").alias("p"), F.col("ref").alias("r"), F.col("conv_id").alias("parent"))
    rest = closed.where("parent_ref is not null").join(
        parents, (F.col("part") == F.col("p")) & (F.col("parent_ref") == F.col("r"))).select(
        *[F.col("parent").alias(c) if c == "parent_conv_id" else F.col(c) for c in NODE])
    pieces = parts.where("kind = 2").select(
        F.col("part").alias("p"), F.col("ref").alias("r"), F.col("depth").alias("i"), F.col("ends_sha256").alias("piece"))
    nodes = opened.select("part", "ref", "node")
    ends = pieces.join(nodes, (F.col("part") == F.col("p")) & (F.col("ref") == F.col("r"))).select(
        "node", "part", "i", "piece").repartition("node").sortWithinPartitions("node", "part", "i").select(
        "node", "piece").mapInArrow(_streamed_digests, "node long, ends string")
    top = opened.where("first").join(ends.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn(
        "ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).select(*NODE)
    return known.unionByName(rest).unionByName(top)


def conversation_trie(conversations: DataFrame, tasks: int | None = None) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations. Columns besides conv_id,
    turn, role and text are not read; rows that repeat another in full are
    turns of their own. See ``rebuilt`` for nulls and ties."""
    return prefix_trie(rebuilt(conversations), tasks)

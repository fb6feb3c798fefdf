"""Best-fit-decreasing bin packing of indivisible groups into shards.

Groups (documents with equal texts) enter in the order of falling size, each
into the bin with the least room left that still holds it. Groups of one size
are interchangeable, so the packing needs only how many groups have each size:
the tightest bin that takes one of them stays the tightest until it is too
full, so it takes as many as fit, then the next larger. That is the packing
group by group, for a short list of (size, count), which has at most
sqrt(2 * total size) entries as the sizes differ.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscope.llm.shared import lookup, number_within, parts_for, written

SHARDS = 24
#: Bytes that a row needs besides its text.
ROW_BYTES = 8
#: A packing plan of up to this many rows is broadcast; a longer one is not.
BROADCAST_PLAN_ROWS = 200_000


class RoomTree:
    """The (room, bin) pairs of open bins in a B-tree: all leaves are equally
    deep, a node that grows beyond ``WIDTH`` is halved and an emptied one goes,
    so the tightest bin is found, taken out and put back in logarithmic time.
    ``keys`` of an inner node are lower bounds of its children."""

    WIDTH = 64

    def __init__(self, keys: list[tuple[int, int]] | None = None, kids: list[RoomTree] | None = None):
        self.keys, self.kids = keys or [], kids

    def take(self, low: tuple[int, int]) -> tuple[int, int] | None:
        """The smallest pair from ``low`` up, taken out; None if there is none."""
        if self.kids is None:
            at = bisect_left(self.keys, low)
            return self.keys.pop(at) if at < len(self.keys) else None
        first = max(bisect_right(self.keys, low) - 1, 0)
        for at in range(first, min(first + 2, len(self.kids))):  # if not in this child, first of the next
            pair = self.kids[at].take(low)
            if pair is not None:
                if not self.kids[at].keys:
                    del self.keys[at], self.kids[at]
                    if not self.kids:
                        self.kids = None
                return pair
        return None

    def put(self, pair: tuple[int, int]) -> None:
        right = self._put(pair)
        if right is not None:
            left = RoomTree(self.keys, self.kids)
            self.keys, self.kids = [left.keys[0], right.keys[0]], [left, right]

    def _put(self, pair: tuple[int, int]) -> RoomTree | None:
        """Put a pair below this node; the right half if it had to be halved."""
        if self.kids is None:
            insort(self.keys, pair)
        else:
            at = max(bisect_right(self.keys, pair) - 1, 0)
            self.keys[at] = min(self.keys[at], pair)
            right = self.kids[at]._put(pair)
            if right is not None:
                self.keys.insert(at + 1, right.keys[0])
                self.kids.insert(at + 1, right)
        if len(self.keys) <= self.WIDTH:
            return None
        half = len(self.keys) // 2
        right = RoomTree(self.keys[half:], None if self.kids is None else self.kids[half:])
        del self.keys[half:]
        if self.kids is not None:
            del self.kids[half:]
        return right


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, bins: int | None = None
                        ) -> tuple[list[list[tuple[int, int]]], int] | None:
    """Pack ``sizes`` (size, count) in falling order of size. Returns for each
    size a list (number of groups, bin) in the order of placing, and the number
    of bins; None when more than ``bins`` would be needed. A group larger than
    the capacity gets a bin of its own.

    Open bins are in a balanced tree by (room, bin)."""
    room = RoomTree()
    plan, opened = [], 0
    for size, count in sizes:
        left, placed = count, []
        while left:
            tightest = room.take((size, -1))
            if tightest is not None:
                free, b = tightest
            else:
                if bins is not None and opened == bins:
                    return None
                free, b, opened = max(capacity, size), opened, opened + 1
            n = min(left, free // size) if size else left
            room.put((free - n * size, b))
            placed.append((n, b))
            left -= n
        plan.append(placed)
    return plan, opened


def smallest_capacity(sizes: list[tuple[int, int]], bins: int) -> int:
    """The least capacity, by bisection, for which best-fit-decreasing needs
    no more than ``bins`` bins. The mean plus the largest size always does."""
    total = sum(s * n for s, n in sizes)
    largest = sizes[0][0] if sizes else 0
    low = max(-(-total // bins), largest)
    high = low + largest
    while low < high:
        middle = (low + high) // 2
        if best_fit_decreasing(sizes, middle, bins):
            high = middle
        else:
            low = middle + 1
    return high


def _pack(bins: int | None, capacity: int | None):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = sorted(((int(s), int(n)) for frame in batches
                        for s, n in zip(frame["bytes"], frame["n"])), reverse=True)
        if not sizes:
            return
        limit = capacity if capacity is not None else smallest_capacity(sizes, bins)
        placed, _ = best_fit_decreasing(sizes, limit)
        rows, until = [], 0
        for (size, _), parts in zip(sizes, placed):
            until = 0
            for n, b in parts:
                until += n
                rows.append((size, until, b))
        yield pd.DataFrame(rows, columns=["bytes", "until", "shard"])
    return pack


def shard_documents(docs: DataFrame, bins: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, group_bytes.

    With ``capacity``, shards of that many bytes are opened as needed; without,
    the smallest capacity is found with which ``bins`` shards suffice, so their
    sizes are near equal. Equal texts stay together: a group larger than the
    capacity fills a shard of its own. ``slot`` numbers a shard's rows from 0.

    Null text has no bytes, size 8 and checksum 0, and is a group apart from
    empty texts. Groups of one size are ranked by their hash, so ties fall the
    same way in each run; rows that repeat an id get slots in any order among
    them. An empty table gives an empty result; other columns are not read.

    The texts are read once and not shuffled: a row travels as id, size,
    checksum and sha256. Only (size, count) pairs meet in one task.
    """
    rows = written(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("group")), "shard-rows")
    n_rows = rows.count()
    parts = parts_for(docs.sparkSession, n_rows)
    groups = written(rows.groupBy("group").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")), "shard-groups", parts)
    n_groups = groups.count()
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"))
    plan = written(sizes.repartition(1).mapInPandas(_pack(bins, capacity), "bytes long, until long, shard int")
                   .groupBy("bytes").agg(F.array_sort(F.collect_list(F.struct("until", "shard"))).alias("parts")),
                   "shard-plan", parts)
    ranked = number_within(groups, "bytes", ["group"], ["group"], n_groups, "rank")
    known = F.broadcast(plan) if plan.count() <= BROADCAST_PLAN_ROWS else plan
    part = F.filter("parts", lambda p: p["until"] > F.col("rank"))
    assigned = written(ranked.join(known, "bytes").select(
        "group", "copies", "bytes", F.element_at(part, 1)["shard"].alias("shard")), "shard-assigned", parts)
    placed = lookup(rows, assigned, ["group"], "copies", ["doc_id"])
    return number_within(
        placed.select("doc_id", "size", "text_crc32", "shard", F.col("bytes").alias("group_bytes")),
        "shard", ["doc_id", "text_crc32"], ["doc_id", "text_crc32"], n_rows, "slot")

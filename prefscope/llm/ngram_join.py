"""N-gram Jaccard self-join with prefix trees.

A document's set holds its distinct word shingles. Two sets link when the share
of their common shingles in all their shingles reaches a threshold.

Routing. Sets that may link have sizes within a factor and differ in at most H
shingles (H follows from sizes and threshold). Shingles are dealt into g > H
slices by hash, so linked sets agree in a whole slice: that slice's hash is a
routing key. An agreeing slice could be an empty one; g exceeds H by a margin,
so a set with fewer than g - H empty slices agrees with any partner in a
non-empty one, and only the rare others emit their empty slices too. H is each
set's own: a smaller set of a class differs in less.

Leaving out. A set with x = g - H - (empty slices) agrees with any partner in x
non-empty slices, so it may leave out x - 1 of them. Each set leaves out those
keys that most sets share. All sets rank the keys alike: of the keys that linked
sets have in common, the one that fewest sets share has x - 1 others before it
in both, so both keep it.

Pruning. A slice of one common shingle is shared by unrelated sets. So each set
has a bitmap: a bit for every shingle it could hold, which is the parity of the
shingles that hash there. Two sets' bitmaps differ in no more bits than the sets
in shingles; of the sets that share a key, only those whose sizes and bitmaps
allow a link are connected. Keys that more than ``GROUP`` sets keep connect all
of these unseen, each with the next. What is connected meets in one task (or, if
it is larger than a block, in a task for each pair of blocks).

Join. There the sets, as ascending shingle hashes, which is one global order,
are put in a prefix tree whose edges hold runs of shingles. All sets walk the
tree together: for sets with a common beginning what overlaps is counted once,
and a set leaves a subtree when the shingles that remain can't reach the
threshold, or when it is already connected with all sets there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from prefscope.llm import textnum as T
from prefscope.llm.components import components
from prefscope.llm.shared import lookup, written

SHINGLE = 4
#: Link when 100 * common >= PERCENT * united.
PERCENT = 85
#: Shingles in all sets that one task joins; a larger cluster of sets is joined
#: by pairs of blocks.
BLOCK_SHINGLES = 1_000_000
#: Sets of one key that are compared by their bitmaps; more are connected unseen.
GROUP = 1000
#: Keys that more sets share are left out by sets that have others to spare.
MANY = 64
#: Sets that share a key within a slice of texts; of more that can't leave it out
#: one stands for all.
BATCH_GROUP = 64
#: What ``how`` of a routed row holds, above it what its set has to spare: it is of
#: the class below the set's own; its set leaves out nothing; it stands for others
#: of its slice of texts; it is a pair of sets.
LOWER, STAYS, STANDS, PAIR, SPARE_BITS = 1, 2, 4, 8, 4
#: Words of bitmaps that are compared at a time.
PAIR_WORDS = 500_000
#: Cells of the table of which set has which shingle, while sets walk a tree.
HELD = 16_000_000
#: Bytes of text that are handled at a time, about.
SLICE_BYTES = 1_000_000


# ---- sets ------------------------------------------------------------------
def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, end to end; and where
    each text's begin. With fewer than k words, all words are one shingle."""
    t = T.Texts(texts, lower=True)
    words = t.hashes()
    first, owner = t.windows(k)
    few = np.flatnonzero((t.n_words() > 0) & (t.n_words() < k))
    hashes = np.concatenate([T.window_hashes(words, first, k),
                             T.span(T.prefix(words), t.words[few], t.words[few + 1])])
    owner = np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(t.n + 1))


def set_ids(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that identify each set, as two sums of mixed shingles."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[T.U(0)], np.cumsum(T.mix(hashes ^ T.U(salt)), dtype=np.uint64)])
        out.append(T.mix(total[begin[1:]] - total[begin[:-1]] + np.diff(begin).astype(T.U)))
    return out[0], out[1]


# ---- routing ---------------------------------------------------------------
def size_classes(percent: int, upto: int) -> np.ndarray:
    """Upper ends of the size classes: a class spans a factor of
    (100 / percent)^2, so a set's partners are in its class or the next."""
    ends, low = [], 1
    while not ends or ends[-1] < upto:
        ends.append(max(low, low * 10_000 // (percent * percent)))
        low = ends[-1] + 1
    return np.array(ends)


def class_members(size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sets that take part in their own size class, and those that do in
    the one below, as partners can be that small: (sets, class, its end)."""
    ends = size_classes(percent, int(size.max(initial=1)))
    own = np.searchsorted(ends, size)
    for lower in (0, 1):
        tag = own - lower
        takes = (size > 0) & (tag >= 0)
        if lower:
            takes &= -(-size * percent // 100) <= ends[np.maximum(tag, 0)]
        sets = np.flatnonzero(takes)
        yield sets, tag[sets], ends[tag[sets]]


def bitmaps(hashes: np.ndarray, begin: np.ndarray, percent: int) -> list[pa.Array]:
    """For the class of each set, and for the one below, its bitmap: a bit for
    each shingle of the largest set, 128 at least. Null where it takes no part."""
    size, out = np.diff(begin), []
    for sets, _, end in class_members(size, percent):
        words = np.zeros(len(size), np.int64)
        words[sets] = np.maximum(2, -(-end // 64))
        base = np.concatenate([[0], np.cumsum(words)])
        bits = np.zeros(base[-1], np.uint64)
        owner = np.repeat(np.arange(len(size)), size)
        taken = words[owner] > 0
        owner, at = owner[taken], T.mix(hashes[taken] ^ T.U(0xA0761D6478BD642F))
        at %= (64 * words[owner]).astype(T.U)
        np.bitwise_xor.at(bits, base[owner] + (at >> T.U(6)).astype(np.int64), T.U(1) << (at & T.U(63)))
        every = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(8 * base), pa.py_buffer(bits)]).cast(pa.binary())
        out.append(pc.if_else(pa.array(words > 0), every, pa.scalar(None, pa.binary())))
    return out


def slice_keys(hashes: np.ndarray, begin: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Routing keys of all sets, the set that each belongs to, and whether it
    is of the class below the set's own."""
    return routes(hashes, begin, percent)[:3]


def routes(hashes: np.ndarray, begin: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``slice_keys``, and in how many of its set's keys of this class any
    linked set agrees at least (0: all keys are needed)."""
    size = np.diff(begin)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    keys, owners, lowers, spares = [], [], [], []
    for lower, (sets, tag, end) in enumerate(class_members(size, percent)):
        # |A| + |B| is at most end + end * 100 / percent; they differ in (100 - p) / (100 + p) of that.
        differ = (100 - percent) * (end + end * 100 // percent) // (100 + percent)
        n_slices = differ + 3 + differ // 16
        count = size[sets]
        # A smaller set differs in less: its partners have count * 100 / percent shingles at most.
        largest = end if lower else count * 100 // percent
        agree = n_slices - (100 - percent) * (count + largest) // (100 + percent)
        at = np.repeat(begin[sets], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        base = np.cumsum(n_slices) - n_slices
        mixed = T.mix(hashes[at] ^ T.U(0xD6E8FEB86659FD93))
        where = np.repeat(base, count) + (mixed % np.repeat(n_slices, count).astype(T.U)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        total = np.concatenate([[T.U(0)], np.cumsum(T.mix(mixed[order]), dtype=np.uint64)])
        edges = np.searchsorted(where[order], np.arange(n_slices.sum() + 1))
        sums = total[edges[1:]] - total[edges[:-1]]
        empty = edges[1:] == edges[:-1]
        which = np.repeat(np.arange(len(sets)), n_slices)
        spare = np.maximum(0, agree - np.bincount(which[empty], minlength=len(sets)))
        unlucky = spare == 0
        emit = ~empty | unlucky[which]
        number = (np.arange(len(which)) - base[which]).astype(T.U)
        label = (tag[which] + 1).astype(T.U) << T.U(32) | number
        keys.append((T.mix(sums ^ T.mix(label)))[emit])
        owners.append(sets[which[emit]])
        lowers.append(np.full(int(emit.sum()), bool(lower)))
        spares.append(spare[which[emit]])
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(lowers), np.concatenate(spares)


def plausible(percent: int, size_a: np.ndarray, size_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes, whose bitmaps differ in so many bits, may
    link."""
    return ((100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b))
            & ((100 + percent) * differ <= (100 - percent) * (size_a + size_b)))


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the edges connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        now = label.copy()
        np.minimum.at(now, left, low)
        np.minimum.at(now, right, low)
        np.minimum.at(now, label[left], low)
        np.minimum.at(now, label[right], low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def connect(percent: int, group: np.ndarray, size: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """For each row the first of its group (groups follow one another) that
    plausible pairs connect it with."""
    n = len(group)
    words = np.array([len(b) // 8 for b in bits], np.int64)
    base = np.concatenate([[0], np.cumsum(words)])
    flat = np.frombuffer(b"".join(bits), np.uint64)
    end = np.searchsorted(group, group, "right")
    partners = end - np.arange(n) - 1
    lefts, rights = [], []
    lo = 0
    cost = np.concatenate([[0], np.cumsum(partners * np.maximum(words, 1))])
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cost, cost[lo] + PAIR_WORDS, "right")) - 1)
        count = partners[lo:hi]
        left = np.repeat(np.arange(lo, hi), count)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        fits = plausible(percent, size[left], size[right], np.zeros(len(left), np.int64)) & (words[left] == words[right])
        left, right = left[fits], right[fits]
        if len(left):
            w = words[left]
            step = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            differ = np.bitwise_count(flat[np.repeat(base[left], w) + step] ^ flat[np.repeat(base[right], w) + step])
            differ = np.add.reduceat(differ, np.cumsum(w) - w, dtype=np.int64)
            near = plausible(percent, size[left], size[right], differ)
            lefts.append(left[near])
            rights.append(right[near])
        lo = hi
    none = np.zeros(0, np.int64)
    return roots(n, np.concatenate([*lefts, none]), np.concatenate([*rights, none]))


# ---- join in a task --------------------------------------------------------
class PrefixTree:
    """Sets of numbers in ascending order, as a tree that shares beginnings.

    The sets are kept in lexicographic order, which is the tree: a node is a
    range of sets with a common beginning, its edge is what they share beyond
    the parent's, and its children are the ranges by the next number."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__))
        self.sets = [sets[i] for i in self.order]
        self.length = np.array([len(s) for s in self.sets])
        self.sizes = sizes[self.order]

    def edge(self, lo: int, hi: int, depth: int) -> np.ndarray:
        """What the sets lo..hi-1 share beyond ``depth``; as they are in
        order, that is what the first and the last share."""
        a, b = self.sets[lo][depth:], self.sets[hi - 1][depth:]
        n = min(len(a), len(b))
        same = a[:n] == b[:n]
        return a[:n] if same.all() else a[:int(same.argmin())]

    def children(self, lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
        following = np.array([self.sets[k][depth] for k in range(lo, hi)])
        cuts = np.flatnonzero(following[1:] != following[:-1]) + 1 + lo
        return list(zip([lo, *cuts], [*cuts, hi]))


def link_sets(sets: list[np.ndarray], percent: int, left: int | None = None) -> list[int]:
    """For each set, the first set of its connected component. With ``left``,
    only links between the first ``left`` sets and the others are looked for.

    All sets walk the tree together. At a node, those still on the way count
    how much of the edge they have (one count for all sets that begin like
    this); a set leaves when even all that remains below wouldn't reach the
    threshold, or when it is connected with every set below already."""
    m = len(sets)
    label = Labels(m)
    if not m or left == 0:
        return label.first()
    sizes = np.array([len(s) for s in sets])
    # Shingles of one set alone overlap with nothing: only the others are walked.
    _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    name = np.cumsum(shared) - 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    short = [name[x[shared[x]]] for x in (number[a:b] for a, b in zip(begin[:-1], begin[1:]))]
    tree = PrefixTree(short[:left], sizes[:left])
    probes = np.arange(left or 0, m)
    width = max(1, int(shared.sum()))
    step = max(1, HELD // width)
    for at in range(0, len(probes), step):
        some = probes[at:at + step]
        has = np.zeros((len(some), width), bool)
        for row, p in enumerate(some):
            has[row, short[p]] = True
        _walk(tree, some, has, sizes, label, percent)
    return label.first()


class Labels:
    """Components of sets, each with its members, so that the smaller ones are
    renamed when components meet."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def merge(self, sets: np.ndarray) -> None:
        found = np.unique(self.of[sets]).tolist()
        if len(found) > 1:
            into = max(found, key=lambda c: len(self.members[c]))
            for c in found:
                if c != into:
                    moved = self.members.pop(c)
                    self.of[moved] = into
                    self.members[into] += moved

    def first(self) -> list[int]:
        low = {c: min(m) for c, m in self.members.items()}
        return [low[c] for c in self.of.tolist()]


def _walk(tree: PrefixTree, probes: np.ndarray, has: np.ndarray, sizes: np.ndarray, label: Labels,
          percent: int) -> None:
    """Let ``probes`` walk the tree and merge the labels of sets that link."""
    rows = np.arange(len(probes))
    stack = [(0, len(tree.sets), 0, rows, np.zeros(len(probes), np.int64))]
    while stack:
        lo, hi, depth, rows, common = stack.pop()
        below = label.of[tree.order[lo:hi]]
        if (below == below[0]).all():
            on = label.of[probes[rows]] != below[0]
            rows, common = rows[on], common[on]
        if not len(rows):
            continue
        edge = tree.edge(lo, hi, depth)
        if len(edge):
            common = common + has[np.ix_(rows, edge)].sum(axis=1)
            depth += len(edge)
        n = sizes[probes[rows]]
        best = np.minimum(n, common + tree.length[lo:hi].max() - depth)
        on = (100 + percent) * best >= percent * (n + tree.sizes[lo:hi].min())
        rows, common, n = rows[on], common[on], n[on]
        if not len(rows):
            continue
        ends = lo + int(np.searchsorted(tree.length[lo:hi] > depth, True))  # sets that end here come first
        if ends > lo:
            # Sets that end here differ in size alone. The walker that may link with the largest
            # links with all below it, and any walker that links does with the smallest.
            ending = tree.sizes[lo:ends]
            upto = (100 + percent) * common // percent - n
            links = upto >= ending.min()
            if links.any():
                label.merge(np.concatenate([tree.order[lo:ends][ending <= upto.max()], probes[rows[links]]]))
        if ends < hi:
            stack += [(x, y, depth, rows, common) for x, y in tree.children(ends, hi, depth)]


# ---- Spark -----------------------------------------------------------------
def _set_rows(percent: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.slices(batch["text"], SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                hashes, begin = shingle_sets(part["text"], k)
                a, b = set_ids(hashes, begin)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(np.diff(begin).astype(np.int64)), pa.array(T.signed(a)),
                     pa.array(T.signed(b)), *bitmaps(hashes, begin, percent)],
                    ["doc_id", "n_shingles", "set_a", "set_b", "own_bits", "lower_bits"])
    return rows


def _marked_rows(k: int):
    """Rows as they are, with their set's size and bits."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.slices(batch["text"], SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                hashes, begin = shingle_sets(part["text"], k)
                a, b = set_ids(hashes, begin)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(begin).astype(np.int64)), pa.array(T.signed(a)),
                     pa.array(T.signed(b))], [*part.schema.names, "n_shingles", "set_a", "set_b"])
    return rows


def _key_rows(percent: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, a, how) for each set of a key. Where more than BATCH_GROUP sets
        of a slice share a key and have more such keys than they can leave
        out, the smallest of them alone goes on, and the others as pairs with
        it (the key being the other set)."""
        for batch in batches:
            for lo, hi in T.slices(batch["text"], SLICE_BYTES):
                hashes, begin = shingle_sets(batch["text"].slice(lo, hi - lo), k)
                key, owner, lower, spare = routes(hashes, begin, percent)
                yield _sent(key, T.signed(set_ids(hashes, begin)[0])[owner], 2 * owner + lower, spare)
    return rows


def _sent(key: np.ndarray, node: np.ndarray, who: np.ndarray, spare: np.ndarray) -> pa.RecordBatch:
    """``who``: the set's number and, as the lowest bit, LOWER."""
    order = np.lexsort((node, key))
    key, node, who, spare = key[order], node[order], who[order], spare[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, who, spare = key[new], node[new], who[new], spare[new]
    _, group, often = np.unique(key, return_inverse=True, return_counts=True)
    hot = often[group] > BATCH_GROUP
    stays = np.bincount(who[hot], minlength=int(who.max(initial=-1)) + 1)[who] >= spare
    bound = hot & stays
    as_one = bound & (np.bincount(group[bound], minlength=len(often)) > BATCH_GROUP)[group]
    at = np.flatnonzero(as_one)
    first = at[np.unique(group[at], return_index=True)[1]]
    smallest = np.zeros(len(often), np.int64)
    smallest[group[first]] = node[first]
    how = np.minimum(spare, (1 << 20) - 1) << SPARE_BITS | (who & LOWER) | STAYS * stays
    how[first] |= STANDS
    as_one[first] = False
    pairs = np.unique(np.stack([node, smallest[group]], 1)[as_one], axis=0)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([T.signed(key[~as_one]), pairs[:, 0]])),
         pa.array(np.concatenate([node[~as_one], pairs[:, 1]])),
         pa.array(np.concatenate([how[~as_one], np.full(len(pairs), PAIR)]).astype(np.int32))], ["key", "a", "how"])


def _connected_rows(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b): the sets of each group, which follow one another, that
        plausible pairs connect."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            group = table["group"].to_numpy()
            done = int(np.searchsorted(group, group[-1])) if len(group) else 0
            rest = table.slice(done)
            yield _edges(percent, table.slice(0, done))
        if rest is not None:
            yield _edges(percent, rest)
    return rows


def _edges(percent: int, table: pa.Table) -> pa.RecordBatch:
    node = table["a"].to_numpy()
    if len(node):
        root = connect(percent, table["group"].to_numpy(), table["n"].to_numpy(), table["bits"].to_pylist())
        other = root != np.arange(len(node))
        pairs = np.unique(np.stack([node[other], node[root[other]]], 1), axis=0)
    else:
        pairs = np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _linked_rows(percent: int, k: int):
    def rows(table: pa.Table) -> pa.Table:
        text, node = table["text"].combine_chunks(), table["node"].to_pylist()
        side, expected = table["side"].to_numpy(), table["set_a"].to_numpy()
        sets, right = [], []
        for lo, hi in T.slices(text, SLICE_BYTES):
            hashes, begin = shingle_sets(text.slice(lo, hi - lo), k)
            sets += [hashes[a:b] for a, b in zip(begin[:-1], begin[1:])]
            # Rows that repeat an id with another text are not the ones asked for.
            right.append(T.signed(set_ids(hashes, begin)[0]) == expected[lo:hi])
        asked = np.concatenate([*right, np.zeros(0, bool)])
        order = [i for i in np.argsort(side, kind="stable") if asked[i]]
        left = sum(side[i] == 0 for i in order)
        root = link_sets([sets[i] for i in order], percent, left if left < len(order) else None)
        names = [node[i] for i in order]
        return pa.table({"a": pa.array(names, pa.string()), "b": pa.array([names[r] for r in root], pa.string())})
    return rows


def ngram_components(docs: DataFrame, percent: int = PERCENT,
                     block_shingles: int = BLOCK_SHINGLES, k: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach, its own included).

    Words are lower-cased in A-Z. Null, empty and blank texts have no set and
    link with nothing, also not with each other; texts of fewer than k
    words have their whole sequence as their only shingle. Texts with equal
    sets are one node with the smallest of their ids. Rows that repeat an id
    with different texts are different nodes of that id. A row without an id
    has a null component_id and links with nothing. Very long texts are read
    whole. An empty table gives an empty result; columns besides doc_id and
    text are not read.

    Copies fall together by their set's 128-bit id before anything is joined.
    A key that most documents share is left out by those with others to spare;
    of the rest it sends at most 64 rows per slice of 1 MB.
    """
    return _groups(docs, percent, block_shingles, k).select("doc_id", "n_shingles", "component_id")


def _groups(docs: DataFrame, percent: int, block_shingles: int, k: int) -> DataFrame:
    """``ngram_components`` with the 128 bits of each row's set, and whether it
    is the one set of its component that stays: of those that have the
    component_id, the one with the smallest bits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(rows.mapInArrow(
        _set_rows(percent, k),
        "doc_id long, n_shingles long, set_a long, set_b long, own_bits binary, lower_bits binary"), "ngram-sets")
    in_play = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    nodes = written(sets.where(in_play).groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"),
        F.max("own_bits").alias("own_bits"), F.max("lower_bits").alias("lower_bits")
    ).withColumn("node", F.concat_ws(":", "set_a", "set_b")), "ngram-nodes")

    clusters = _clusters(rows, nodes, percent, k)
    members = nodes.join(clusters, F.col("set_a") == F.col("_set")).select(
        F.col("first_id").alias("_id"), "set_a", "node", "n", "cluster")
    sizes = members.groupBy("cluster").agg(
        F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks")).withColumnRenamed("cluster", "_c")
    placed = members.join(sizes, F.col("cluster") == F.col("_c")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A task has the sets of blocks i <= j; those of block i are on side 0.
    tasks = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "_id", "set_a", "node", "cluster", F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    # Each text goes to its tasks by one shuffle; the short side is hashed.
    joined = rows.join(tasks.hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).select(
        "cluster", "i", "j", "side", "set_a", "node", "text")
    linked = joined.groupBy("cluster", "i", "j").applyInArrow(_linked_rows(percent, k), "a string, b string")
    labels = written(components(linked.where("a != b")), "ngram-labels")

    named = nodes.drop("own_bits", "lower_bits").join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy(F.col("component").alias("_c")).agg(
        F.min(F.struct("first_id", "set_a", "set_b")).alias("_low"))
    named = written(named.join(lowest, F.col("component") == F.col("_c")).select(
        "set_a", "set_b", "copies", F.col("_low.first_id").alias("component_id"),
        ((F.col("set_a") == F.col("_low.set_a")) & (F.col("set_b") == F.col("_low.set_b"))).alias("stays")),
        "ngram-named")
    sets = sets.drop("own_bits", "lower_bits")
    found = lookup(sets.where(in_play), named, ["set_a", "set_b"], "copies", ["doc_id"])
    alone = sets.where(~in_play).withColumns({"component_id": F.col("doc_id"), "stays": F.lit(True)})
    names = ["doc_id", "n_shingles", "set_a", "set_b", "component_id", "stays"]
    return found.select(names).unionByName(alone.select(names))


def one_of_each(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """The documents that stay when one of each connected group does, with all
    their columns: the one whose doc_id is the group's component_id. Documents
    without words are a group each. Rows without an id have no group and stay.

    Rows that repeat an id are told apart by their sets, so one that goes takes
    no other text of its id with it. Where rows of one group repeat the id that
    stays, the set with the smallest bits does, and of its rows the one that is
    smallest as JSON."""
    groups = written(_groups(docs.select("doc_id", "text"), percent, BLOCK_SHINGLES, k).where(
        "doc_id is not null"), "ngram-groups")
    ids = groups.groupBy(F.col("doc_id").alias("_gone")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.col("component_id") != F.col("doc_id")).alias("_leaves"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col("doc_id").cast("long").alias("_id"))
    gone = ids.where("_n > 1 or _leaves")
    once = rows.join(gone.hint("shuffle_hash"), F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
    repeated = written(ids.where("_n > 1").select("_gone"), "ngram-repeated")
    if repeated.isEmpty():
        return once
    again = rows.join(repeated.hint("shuffle_hash"), F.col("_id") == F.col("_gone"), "left_semi").select(
        "_id", F.col("_row.text").alias("text"), F.to_json("_row").alias("_json"), "_row")
    schema = StructType([*again.schema, *(StructField(c, LongType()) for c in ("n_shingles", "set_a", "set_b"))])
    marked = written(again.mapInArrow(_marked_rows(k), schema), "ngram-marked")
    stay = groups.where("stays and component_id = doc_id and n_shingles > 0").select(
        F.col("doc_id").alias("_id"), "set_a", "set_b").distinct()
    first = marked.where("n_shingles > 0").join(stay, ["_id", "set_a", "set_b"]).groupBy(
        "_id", "set_a", "set_b").agg(F.min_by("_row", "_json").alias("_row"))
    blank = marked.where("n_shingles = 0")
    return once.unionByName(first.select("_row.*")).unionByName(blank.select("_row.*"))


def _clusters(rows: DataFrame, nodes: DataFrame, percent: int, k: int) -> DataFrame:
    """(_set, cluster): sets, by half of their id, that plausible pairs with a
    common routing key connect."""
    keyed = rows.where("doc_id is not null").select("text").mapInArrow(
        _key_rows(percent, k), "key long, a long, how int")
    has = lambda bit: F.col("how").bitwiseAND(bit) != 0
    by_key = Window.partitionBy("key")
    in_order = by_key.orderBy("a", F.desc("how"))
    shared = keyed.select(
        "*", F.lag("a").over(in_order).alias("before"), F.lead("a").over(in_order).alias("after")).where(
        has(PAIR) | F.col("before").isNotNull() | F.col("after").isNotNull())
    shared = written(shared.where(has(PAIR) | F.col("before").isNull() | (F.col("before") != F.col("a"))).select(
        "key", "a", "how", F.count(F.lit(1)).over(by_key).alias("sets"), F.max(has(STANDS)).over(by_key).alias("stands")),
        "ngram-shared")
    paired = shared.where(has(PAIR)).select("a", F.col("key").alias("b"))
    # Of the keys of many sets each set leaves out those of the most, as many as it can.
    many = F.col("stands") | (F.col("sets") > MANY)
    by_set = Window.partitionBy("a", F.col("how").bitwiseAND(LOWER)).orderBy(F.desc("stands"), F.desc("sets"), "key")
    kept = shared.where(many & ~has(PAIR)).withColumn("rank", F.row_number().over(by_set)).where(
        has(STAYS) | (F.col("rank") >= F.shiftright("how", SPARE_BITS)))
    kept = written(kept.select("key", "a", "how", "stands", F.count(F.lit(1)).over(by_key).alias("sets"),
                               F.lag("a").over(by_key.orderBy("a")).alias("before")), "ngram-kept")
    # Sets of one key within the group's limits are compared, others chained.
    unseen = F.col("stands") | (F.col("sets") > GROUP)
    chained = kept.where(unseen & F.col("before").isNotNull()).select("a", F.col("before").alias("b"))
    compared = shared.where(~many & ~has(PAIR)).select("key", "a", "how", "sets").unionByName(
        kept.where(~unseen).select("key", "a", "how", "sets"))
    # Many keys are shared by the same sets.
    groups = compared.where("sets > 1").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("a", F.col("how").bitwiseAND(LOWER).alias("lower")))).alias("g")
    ).groupBy("g").agg(F.min("key").alias("group"))
    members = groups.select("group", F.inline("g"))
    bits = nodes.select(F.col("set_a").alias("_a"), "n", "own_bits", "lower_bits")
    members = members.join(bits, F.col("a") == F.col("_a")).select(
        "group", "a", "n", F.when(F.col("lower") == 0, F.col("own_bits")).otherwise(F.col("lower_bits")).alias("bits"))
    near = members.repartition("group").sortWithinPartitions("group", "a").mapInArrow(
        _connected_rows(percent), "a long, b long")
    return components(chained.unionByName(paired).unionByName(near)).select(
        F.col("node").alias("_set"), F.col("component").alias("cluster"))

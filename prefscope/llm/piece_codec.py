"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text becomes units: a run of spaces (written as U+2581) with the characters
up to the next space. No piece of the vocabulary goes across such a border, so
the segmentation of a text is that of its units. The distinct units of a batch
are grouped by length and advance together, one character at a time: substrings
of all units of a group are hashed at once, looked up among the sorted hashes
of the pieces, and for every end the best score and a pointer to where its last
piece begins are kept. Characters that no piece covers become byte pieces.

In a unigram model any piece may follow any other and the best total score
wins. The scores of a BPE model are merge ranks and can't be summed like that.
There a piece may follow another only if merging would leave the two side by
side; just one path of such steps goes through a unit, and it is what merging
gives. Whether two pieces may be neighbours is worked out once for each pair.
So a long unit is cut into overlapping chunks that advance together: where two
chunks have the same piece in the same place, one can go on for the other, as
all pieces side by side are neighbours then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscope.llm import textnum as T

#: Where the given vocabulary is; a parameter of all functions that need one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the format: the mark for a space, and what an uncovered
#: character costs below the worst piece of a unigram model.
SPACE, SPACE_POINT, UNKNOWN_PENALTY = "▁", 0x2581, 10.0
#: Units of one length that advance together.
GROUP = 20_000
#: A chunk of a long unit has CHUNK times the longest piece's characters, and the
#: next begins STEP times as many later.
CHUNK, STEP = 8, 5
#: A worker remembers 2**PAIR_BITS verdicts on pairs of pieces, and the pieces of
#: so many units; both only save time.
PAIR_BITS = 21
UNITS = 600_000
#: Leading bits of a hash by which the sorted keys are entered.
ENTRY_BITS = 18
#: Marks in the table of last pieces: no piece yet, and an uncovered character.
NONE, UNCOVERED = -1, -2


class Vocabulary:
    """The pieces of a model file, sorted by hash. Only models that leave texts
    unchanged, mark spaces and have byte pieces are read, and whose pieces have
    spaces in front only."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("the model changes texts")
        self.merges = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        kind = pb.ModelProto.SentencePiece
        n = len(proto.pieces)
        self.byte_ids, data = np.full(256, -1, np.int32), [b""] * n
        plain: dict[str, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type in (kind.NORMAL, kind.USER_DEFINED):
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} goes across a space")
                plain[p.piece] = i
                data[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kind.BYTE:
                data[i] = bytes([int(p.piece[3:5], 16)])
                self.byte_ids[data[i][0]] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.data = np.frombuffer(b"".join(data), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        self.longest = max(map(len, plain))
        self.hash, self.size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for piece, i in plain.items():
            points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
            self.size[i] = len(points)
            self.hash[i] = (point_hash(points) * self.power[:len(points)]).sum(dtype=np.uint64)
        score = np.array([p.score for p in proto.pieces])
        if self.merges:
            # Runs of spaces alone are merged from the left; see ``Vocabulary.run``.
            self.spaces = {len(p): i for p, i in plain.items() if p == SPACE * len(p)}
            plain = {p: i for p, i in plain.items() if p.strip(SPACE) or len(p) == 1}
            self._derive(plain, score)
            plain = {p: i for p, i in plain.items() if self.left[i] >= 0 or len(p) == 1}
        self._sort(plain, score)
        self.unknown = float(min(score[i] for i in plain.values())) - UNKNOWN_PENALTY
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_ok = np.zeros(1 << PAIR_BITS, bool)
        # Remembered units: sorted hashes, and where their pieces are.
        self.unit_keys, self.unit_at = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        self.unit_ids = np.zeros(0, np.int32)

    @property
    def power(self) -> np.ndarray:
        return T.powers(self.longest + 1, 0)[0]

    def _derive(self, plain: dict[str, int], score: np.ndarray) -> None:
        """How merging makes each piece: the two pieces of its last merge, and
        ``turn``, its place in the order of merges (0: a character). A piece
        that merging doesn't make has no halves and is never used."""
        n = len(score)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.turn = np.zeros(n, np.int64)
        merged = sorted((i for p, i in plain.items() if len(p) > 1), key=lambda i: (-score[i], i))
        self.turn[merged] = np.arange(1, len(merged) + 1)
        turn = self.turn.tolist()
        for piece, i in plain.items():
            parts = list(piece)
            while len(parts) > 2:
                pairs = [plain.get(a + b, -1) for a, b in zip(parts, parts[1:])]
                k = min((k for k, j in enumerate(pairs) if j >= 0 and j != i), key=lambda k: turn[pairs[k]], default=None)
                if k is None:
                    break
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2 and all(p in plain for p in parts):
                self.left[i], self.right[i] = plain[parts[0]], plain[parts[1]]

    def _sort(self, plain: dict[str, int], score: np.ndarray) -> None:
        """Sorted hashes of all pieces and beginnings of pieces (id -1), and for
        each value of a hash's leading bits where its keys begin."""
        hashes, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for piece, i in plain.items():
            points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
            hashes.append(np.cumsum(point_hash(points) * self.power[:len(points)], dtype=np.uint64))
            ids.append(np.append(np.full(len(points) - 1, -1, np.int32), np.int32(i)))
        hashes, ids = np.concatenate(hashes), np.concatenate(ids)
        order = np.lexsort((-ids, hashes))  # of equal hashes, the piece first
        hashes, ids = hashes[order], ids[order]
        if ((hashes[1:] == hashes[:-1]) & (ids[1:] >= 0)).any():
            raise ValueError("two pieces have one hash")
        new = np.append(True, hashes[1:] != hashes[:-1])
        self.ids = np.append(ids[new], np.int32(-1))
        self.scores = score[self.ids]
        top = (hashes[new] >> T.U(64 - ENTRY_BITS)).astype(np.int64)
        self.entry = np.searchsorted(top, np.arange((1 << ENTRY_BITS) + 1)).astype(np.int32)
        self.probes = int(np.diff(self.entry).max())
        self.keys = np.append(hashes[new], np.zeros(self.probes, np.uint64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the sorted keys; the last place, whose id is -1, for
        hashes that are there neither as a piece nor as the beginning of one."""
        at = self.entry[(hashes >> T.U(64 - ENTRY_BITS)).astype(np.int64)]
        out = np.full(len(hashes), len(self.ids) - 1, np.int32)
        for k in range(self.probes):
            hit = self.keys[at + k] == hashes
            out[hit] = at[hit] + k
        return out

    def neighbours(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece ``second`` right of piece ``first``."""
        ok = np.ones(len(first), bool)
        asked = np.flatnonzero(first >= 0)
        pair = (first[asked].astype(np.int64) << 32) | second[asked]
        slot = (T.mix(pair.view(np.uint64)) >> T.U(64 - PAIR_BITS)).astype(np.int64)
        verdict = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_keys[slot] != pair)
        if len(miss):
            new, where, again = np.unique(pair[miss], return_index=True, return_inverse=True)
            fresh = self._stay_apart(new >> 32, new & 0xFFFFFFFF)
            verdict[miss] = fresh[again]
            at, last = np.unique(slot[miss][where][::-1], return_index=True)
            self.pair_keys[at], self.pair_ok[at] = new[::-1][last], fresh[::-1][last]
        ok[asked] = verdict
        return ok

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Take the later made of two neighbours apart, again and again, down to
        the characters at the border: a merge across the border that comes
        before the one just undone (or, on the left of it, with it) would have
        been made."""
        a, b = a.copy(), b.copy()
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        before = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y = a[live], b[live]
            both = self.ids[self.find(self.hash[x] + self.power[self.size[x]] * self.hash[y])]
            crossing = (both >= 0) & (self.size[x] + self.size[y] <= self.longest) & (
                self.turn[both] < before[live])
            ok[live[crossing]] = False
            on_left = self.turn[x] > self.turn[y]
            before[live] = np.where(on_left, self.turn[x], self.turn[y] + 1)
            ended = crossing | ((self.turn[x] == 0) & (self.turn[y] == 0))
            a[live] = np.where(on_left, self.right[x], x)
            b[live] = np.where(on_left, y, np.where(self.turn[y] > 0, self.left[y], y))
            live = live[~ended]
        return ok

    def run(self, n: int) -> list[int]:
        """Pieces of n spaces in a BPE model: all such merges rank alike, so
        the leftmost grows to the longest piece there is, then the next."""
        out, most = [], max(self.spaces)
        while n:
            k = next(k for k in range(min(n, most), 0, -1) if k in self.spaces)
            out.append(self.spaces[k])
            n -= k
        return out


_VOCABULARIES: dict[bytes, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a model file; one is kept per worker."""
    name = hashlib.sha256(model).digest()
    if name not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[name] = Vocabulary(model)
    return _VOCABULARIES[name]


def point_hash(points: np.ndarray) -> np.ndarray:
    return T.mix(points.astype(np.uint64) + T.U(1))


def viterbi(points: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Segmentations of rows of code points of one length: for each place the
    piece that ends there and where it begins, as (length + 1, rows) arrays."""
    n, length = points.shape
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back, piece = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), NONE, np.int32)
    hashed, power = point_hash(points.T), v.power
    for begin in range(length):
        rows, h = np.arange(n), np.zeros(n, np.uint64)
        for end in range(begin + 1, min(length, begin + v.longest) + 1):
            h = h + hashed[end - 1, rows] * power[end - begin - 1]
            at = v.find(h)
            ids = v.ids[at]
            if end == begin + 1:
                bare = rows[ids < 0]
                bare = bare[best[begin, bare] + v.unknown > best[end, bare]]
                best[end, bare], back[end, bare], piece[end, bare] = best[begin, bare] + v.unknown, begin, UNCOVERED
            whole = np.flatnonzero(ids >= 0)
            if v.merges:
                whole = whole[v.neighbours(piece[begin, rows[whole]], ids[whole])]
            score = best[begin, rows[whole]] + v.scores[at[whole]]
            better = score > best[end, rows[whole]]
            whole, score = whole[better], score[better]
            best[end, rows[whole]], back[end, rows[whole]], piece[end, rows[whole]] = score, begin, ids[whole]
            alive = at < len(v.ids) - 1  # still the beginning of a piece
            rows, h = rows[alive], h[alive]
            if not len(rows):
                break
    return piece, back


def utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of code points, end to end, and how many each has."""
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return np.frombuffer(raw, np.uint8), 1 + sum((points >= low).astype(np.int64) for low in (0x80, 0x800, 0x10000))


def segment(points: np.ndarray, begin: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece ids of units (code points end to end), where each unit's begin, and
    each id's place: four times the character of its unit at which it begins,
    plus, for byte pieces, the number of the byte."""
    size, n = np.diff(begin), len(begin) - 1
    unit_of, place, ids = [], [], []
    for length in np.unique(size):
        if not length:
            continue
        every = np.flatnonzero(size == length)
        step = max(1, GROUP * 16 // max(16, int(length)))
        for lo in range(0, len(every), step):
            rows = every[lo:lo + step]
            piece, back = viterbi(points[begin[rows][:, None] + np.arange(length)], v)
            at = np.full(len(rows), length)
            live = np.arange(len(rows))
            while len(live):  # all units follow their pointers back together
                got, start = piece[at[live], live], back[at[live], live]
                covered = got >= 0
                unit_of.append(rows[live[covered]])
                place.append(start[covered].astype(np.int64) * 4)
                ids.append(got[covered])
                bare, bare_start = rows[live[~covered]], start[~covered].astype(np.int64)
                if len(bare):
                    raw, count = utf8(points[begin[bare] + bare_start])
                    nth = np.arange(len(raw)) - np.repeat(np.cumsum(count) - count, count)
                    unit_of.append(np.repeat(bare, count))
                    place.append(np.repeat(bare_start * 4, count) + nth)
                    ids.append(v.byte_ids[raw])
                at[live] = start
                live = live[start > 0]
    if not ids:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    unit_of, place, ids = np.concatenate(unit_of), np.concatenate(place), np.concatenate(ids)
    order = np.lexsort((place, unit_of))
    return ids[order].astype(np.int32), np.searchsorted(unit_of[order], np.arange(n + 1)), place[order]


def segment_chunks(points: np.ndarray, begin: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """As ``segment``, for a BPE model and without places: units longer than a
    chunk are segmented in chunks of one length, the last of which ends with the
    unit. A chunk goes on from the first piece that it shares with the chunk
    before (the last chunk: from the last such). A unit in which two chunks share
    none, as in some runs of one character, is segmented whole."""
    chunk, step = CHUNK * v.longest, STEP * v.longest
    size, n = np.diff(begin), len(begin) - 1
    if not (size > chunk).any():
        return segment(points, begin, v)[:2]
    chunks = 1 + np.maximum(0, -(-(size - chunk) // step))
    unit = np.repeat(np.arange(n), chunks)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = np.minimum(nth * step, np.maximum(size[unit] - chunk, 0))
    length = np.minimum(size[unit], chunk)
    cut = np.concatenate([[0], np.cumsum(length)])
    ids, at, place = segment(
        points[np.repeat(begin[unit] + start - cut[:-1], length) + np.arange(cut[-1])], cut, v)
    owner = np.repeat(np.arange(len(unit)), np.diff(at))
    # Pieces of a chunk and of the one before it, by chunk, place in it and id.
    span, joint = 4 * chunk, nth > 0
    shift = 4 * np.diff(start, prepend=0)
    right = joint[owner]
    on = np.append(joint, False)[owner + 1]
    moved = place[on] - shift[owner[on] + 1]
    left_key = (((owner[on] + 1) * span + moved) << 24 | ids[on])[moved >= 0]
    right_key = (owner[right] * span + place[right]) << 24 | ids[right]
    shared = np.intersect1d(left_key, right_key, assume_unique=True) >> 24
    shared = shared[shared % 4 == 0]
    chunk_of, where = shared // span, shared % span
    low, high = np.zeros(len(unit), np.int64), np.full(len(unit), span)
    low[joint] = -1
    low[chunk_of[::-1]] = where[::-1]  # the first
    last = nth == chunks[unit] - 1
    ends = last[chunk_of]
    low[chunk_of[ends]] = where[ends]  # the last
    after = np.flatnonzero(joint)
    high[after - 1] = low[after] + shift[after]
    whole = np.zeros(n, bool)
    whole[unit[(low < 0) | (low > high)]] = True
    keep = (place >= low[owner]) & (place < high[owner]) & ~whole[unit[owner]]
    unit_of, ids = unit[owner[keep]], ids[keep]
    odd = np.flatnonzero(whole)
    if len(odd):
        cut = np.concatenate([[0], np.cumsum(size[odd])])
        more, at, _ = segment(
            points[np.repeat(begin[odd] - cut[:-1], size[odd]) + np.arange(cut[-1])], cut, v)
        unit_of, ids = np.concatenate([unit_of, np.repeat(odd, np.diff(at))]), np.concatenate([ids, more])
        order = np.argsort(unit_of, kind="stable")
        unit_of, ids = unit_of[order], ids[order]
    return ids, np.searchsorted(unit_of, np.arange(n + 1))


def segment_merged(points: np.ndarray, begin: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """As ``segment``, for a BPE model. Merges of spaces alone come last: what
    stands before a unit's last space is a run, and so is that space if it
    ends up alone."""
    n = len(begin) - 1
    spaces = np.concatenate([[0], np.cumsum(points == SPACE_POINT)])
    lead = spaces[begin[1:]] - spaces[begin[:-1]]  # spaces are in front only
    cut = begin[:-1] + np.maximum(lead - 1, 0)
    size = begin[1:] - cut
    core = np.concatenate([[0], np.cumsum(size)])
    ids, at = segment_chunks(points[np.repeat(cut - core[:-1], size) + np.arange(core[-1])], core, v)
    many = np.flatnonzero(lead > 1)
    if not len(many):
        return ids, at
    parts = np.split(ids, at[1:-1])
    for k in many.tolist():
        alone = parts[k][0] == v.spaces[1]
        parts[k] = np.concatenate([v.run(int(lead[k]) - (not alone)), parts[k][1 if alone else 0:]]).astype(np.int32)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(lead, len(data)))
    b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    first = b[lead]
    out = first.copy()
    for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        at = size == n
        x = first[at] & mask
        for k in range(1, n):
            x = (x << 6) | (b[lead[at] + k] & 0x3F)
        out[at] = x
    return out, lead


def encode(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts end to end, and where each text's begin. Null
    and empty texts have none; others get a space in front, as the model says."""
    t = T.Texts(texts)
    filled = np.diff(t.offset) > 0
    shift = np.concatenate([[0], np.cumsum(filled)])
    data = np.empty(len(t.data) + shift[-1], np.uint8)
    where = np.arange(len(t.data)) + np.repeat(shift[1:], np.diff(t.offset))
    data[where] = t.data
    data[(t.offset[:-1] + shift[:-1])[filled]] = 32
    points, lead = code_points(data)
    text_begin = np.searchsorted(lead, t.offset + shift)
    space = (points == 32) | (points == SPACE_POINT)
    points[space] = SPACE_POINT
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[text_begin[:-1][filled]] = True
    begin = np.append(np.flatnonzero(starts), len(points))
    # Distinct units, told apart by hash and length.
    h = T.span(T.prefix(points.astype(np.uint64) + T.U(1)), begin[:-1], begin[1:])
    keys, first, same = np.unique(h, return_index=True, return_inverse=True)
    at = np.searchsorted(v.unit_keys, keys)
    at[at == len(v.unit_keys)] = 0
    known = v.unit_keys[at] == keys if len(v.unit_keys) else np.zeros(len(keys), bool)
    fresh = first[~known]
    size = np.diff(begin)[fresh]
    unit = np.concatenate([[0], np.cumsum(size)])
    chosen = points[np.repeat(begin[fresh] - unit[:-1], size) + np.arange(unit[-1])]
    ids, ids_begin = segment_merged(chosen, unit, v) if v.merges else segment(chosen, unit, v)[:2]
    ids = np.concatenate([v.unit_ids, ids])
    place = np.empty((len(keys), 2), np.int64)
    place[known] = v.unit_at[at[known]]
    place[~known] = np.stack([ids_begin[:-1], ids_begin[1:]], 1) + len(v.unit_ids)
    start, count = place[same, 0], place[same, 1] - place[same, 0]
    total = np.concatenate([[0], np.cumsum(count)])
    out = ids[np.repeat(start - total[:-1], count) + np.arange(total[-1])]
    if len(v.unit_keys) + len(fresh) <= UNITS:
        where = np.searchsorted(v.unit_keys, keys[~known])
        v.unit_keys = np.insert(v.unit_keys, where, keys[~known])
        v.unit_at = np.insert(v.unit_at, where, place[~known], axis=0)
        v.unit_ids = ids
    return out, total[np.searchsorted(begin[:-1], text_begin)]


def decode(ids: np.ndarray, begin: np.ndarray, v: Vocabulary) -> pa.Array:
    """The texts of piece ids (end to end, ``begin`` as in ``encode``), without
    the space that encoding put in front."""
    size = np.diff(v.offset)[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    data = v.data[np.repeat(v.offset[ids] - total[:-1], size) + np.arange(total[-1])]
    offset = total[begin]
    drop = np.flatnonzero(np.diff(offset) > 0)
    at = offset[:-1][drop]
    drop, at = drop[data[at] == 32], at[data[at] == 32]
    gone = np.zeros(len(offset), np.int64)
    gone[drop + 1] = 1
    data, offset = np.delete(data, at), offset - np.cumsum(gone)
    raw = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(data)])
    try:
        return raw.cast(pa.large_string())
    except pa.ArrowInvalid:  # ids that are no encoding may not be UTF-8
        return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.large_string())


def _encode_batches(model: bytes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for lo, hi in T.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                ids, begin = encode(part["text"], v)
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32)))
                back = decode(ids, begin, v)
                same = pc.equal(back, pc.fill_null(part["text"], "").cast(pa.large_string()))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(np.diff(begin).astype(np.int64)), lists, same],
                    ["doc_id", "n_pieces", "piece_ids", "round_trip"])
    return rows


def read_model(path: str = MODEL) -> bytes:
    """The model file, read once by the driver; tasks get its bytes (0.5 MB),
    as executors need not have the file."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """One row per document: doc_id, n_pieces, piece_ids, and round_trip, which
    says that decoding the ids gives the text again.

    The ids are those that the model's own kind of segmentation gives: merging
    for a BPE model, the best total score for a unigram model (of equal scores,
    the longer last piece). Null and empty texts have no pieces;
    a text's own U+2581 reads as a space, so it doesn't come back. Texts are
    encoded whole, a few MB at a time; a very long unit without spaces takes
    memory in proportion to its length, and in a unigram model also as many
    steps, as it can't be cut there. Repeated rows get equal ids, an empty
    table an empty result; other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode_batches(model or read_model()),
                           "doc_id long, n_pieces long, piece_ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, piece_ids); null ids give a null text, and
    control pieces nothing."""
    data = model or read_model()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(data)
        for batch in batches:
            lists = batch["piece_ids"]
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            text = decode(flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), v).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.string()))], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "piece_ids").mapInArrow(
        rows, "doc_id long, text string")

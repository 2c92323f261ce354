"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

The segmentation of a row is drawn from the distribution over all segmentations, with probabilities raised to ``alpha``. Draws come
from a hash of (seed, row key, place in the row), so a row's segmentation depends on nothing else. No piece crosses from a word to
the space after it, so the lattice of a text is that of its units (a run of spaces with the word after it) one after the other;
a batch's distinct units are filtered together, whatever their length, and those of common length are kept for the next batches.
Sums are held as logarithms, so no ``alpha`` underflows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG_WORD, documents, slices, text_buffer

MODEL = "piece_bpe_32k.model"
ALPHA, SEED = 0.2, 1
_SPACE = "▁"
_UNITS = re.compile(" *[^ ]+| +")
#: So many characters of units are filtered at a time, and of a longer unit the edges of so many characters are held: memory has a bound, the lattice
#: and the draws are the same. A step over all units costs about as much as STEP characters of a unit by itself.
BLOCK, WINDOW, STEP = 1 << 20, 1 << 15, 8
#: A worker keeps the filtered lattices of units up to LONG_WORD long until they have so many characters (and those of one block more).
KEPT = 1 << 21
_SLOTS, _PREFIXES = 20, 22  # bits of a hash that find a piece and tell beginnings of longer pieces
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Pieces:
    """The vocabulary: probabilities by rank (a merge's rank stands for its frequency: Zipf's law), byte pieces, and bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_id = [0] * 256
        self.ids: dict[str, int] = {}
        spelled: list[bytes] = []
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                spelled.append(b"")
            else:
                spelled.append(piece.replace(_SPACE, " ").encode())
                self.ids[piece] = k
        total = sum(1 / (r + 2.7) for r in range(len(self.ids)))
        by_rank = sorted(self.ids, key=lambda p: (-model.get_score(self.ids[p]), self.ids[p]))
        self.log_prob = {p: -math.log((r + 2.7) * total) for r, p in enumerate(by_rank)}
        self.fallback = min(self.log_prob.values()) - 1.0  # for each byte
        self.longest = max(map(len, self.ids))
        # The sorted hashes of all pieces, their ids and log-probabilities; the first of them by a hash's top bits, or -1; whether a longer piece begins so.
        names, hashes, self.begun = [], [], np.zeros(1 << _PREFIXES, bool)
        for n in range(1, self.longest + 1):
            own = [p for p in self.ids if len(p) == n]
            codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), n).astype(np.uint64)
            hashed = np.zeros(len(own), np.uint64)
            for k in range(n):
                if k:
                    self.begun[hashed >> _U(64 - _PREFIXES)] = True
                hashed = _mix(hashed * _U(0x9E3779B97F4A7C15) + codes[:, k] + _U(1))
            names += own
            hashes.append(hashed)
        hashed = np.concatenate(hashes)
        order = np.argsort(hashed)
        self.hashed, self.id = hashed[order], np.array([self.ids[names[k]] for k in order], np.int32)
        self.weight = np.array([self.log_prob[names[k]] for k in order])
        self.slot = np.full(1 << _SLOTS, -1, np.int32)
        self.slot[self.hashed[::-1] >> _U(64 - _SLOTS)] = np.arange(len(order))[::-1]
        self.lengths = np.array([len(s) for s in spelled])
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.kept: Kept | None = None


def edges(real: np.ndarray, end: np.ndarray, pieces: Pieces, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All edges of the lattices of some units: first character, number of characters, alpha * log-probability and id.

    ``real``: the code points of all units; ``end``: for each, the end of its unit. A character that no piece holds falls back to its
    bytes; the id is then minus its code point.
    """
    # A space is the piece alphabet's mark; the mark itself, in a text, must not pass for a space.
    codes = np.where(real == 32, ord(_SPACE), np.where(real == ord(_SPACE), 0, real)).astype(np.uint64)
    at, hashed, stop = np.arange(len(codes)), np.zeros(len(codes), np.uint64), end
    first, size, weight, ids = [], [], [], []
    for n in range(1, pieces.longest + 1):
        if n > 1:
            on = np.flatnonzero(pieces.begun[hashed >> _U(64 - _PREFIXES)] & (at + n <= stop))
            at, hashed, stop = at[on], hashed[on], stop[on]
        hashed = _mix(hashed * _U(0x9E3779B97F4A7C15) + codes[at + n - 1] + _U(1))
        found = pieces.slot[hashed >> _U(64 - _SLOTS)]
        maybe = np.flatnonzero(found >= 0)
        found, sought = found[maybe], hashed[maybe]
        hit = pieces.hashed[found] == sought
        other = np.flatnonzero(~hit)  # a piece with the same top bits, or none
        found[other] = np.minimum(np.searchsorted(pieces.hashed, sought[other]), len(pieces.hashed) - 1)
        hit[other] = pieces.hashed[found[other]] == sought[other]
        maybe, found = maybe[hit], found[hit]
        first.append(at[maybe])
        weight.append(alpha * pieces.weight[found])
        ids.append(pieces.id[found])
        if n == 1:
            odd = np.ones(len(codes), bool)
            odd[first[0]] = False
            odd = np.flatnonzero(odd)
            wide = 1 + (real[odd] >= 0x80).astype(int) + (real[odd] >= 0x800) + (real[odd] >= 0x10000)
            first.append(odd)
            weight.append(alpha * pieces.fallback * wide)
            ids.append(-real[odd].astype(np.int32))
            size.append(np.ones(len(odd), np.int64))
        size.append(np.full(len(maybe), n))
    return np.concatenate(first), np.concatenate(size), np.concatenate(weight), np.concatenate(ids)


class Lattice:
    """The lattices of some distinct units, filtered forward.

    Unit w has the nodes ``node[w]`` (before its first character) to ``node[w] + size[w]``. The edges into node k are ``into[k]`` to
    ``into[k + 1]``; ``share`` is the probability, given a segmentation has a boundary at that node, that its last piece is that edge.
    """

    def __init__(self, units: list[str], pieces: Pieces, alpha: float) -> None:
        real = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        self.size = np.array([len(w) for w in units], np.int64)
        begin = np.cumsum(self.size) - self.size
        self.node = begin + np.arange(len(units))
        unit = np.repeat(np.arange(len(units)), self.size)
        first, size, weight, ids = edges(real, (begin + self.size)[unit], pieces, alpha)
        to = first + unit[first] + size
        nodes = len(real) + len(units)
        self.into = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=nodes))])
        # Edges by node, then length: they come one length after the other, and a node has at most one edge of each.
        free, place = self.into[:-1].copy(), np.empty(len(to), np.int64)
        bounds = np.searchsorted(size, np.arange(1, pieces.longest + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            place[a:b] = free[to[a:b]]
            free[to[a:b]] += 1
        self.length, self.piece, log = np.empty(len(to), np.int64), np.empty(len(to), np.int32), np.empty(len(to))
        self.length[place], self.piece[place], log[place] = size, ids, weight
        # Nodes by their distance from the unit's start: all sums before are known when a node's turn comes.
        falling = np.argsort(-self.size, kind="stable")
        begin = self.node[falling]
        most = int(self.size.max()) if len(units) else 0
        reach = np.searchsorted(-self.size[falling], -np.arange(1, most + 1), "right")
        forward = np.zeros(nodes)  # logarithms; 0 at each unit's first node
        self.share = np.zeros(len(to))
        for depth, count in enumerate(reach.tolist(), 1):
            here = begin[:count] + depth
            low = self.into[here]
            times = self.into[here + 1] - low
            starts = np.cumsum(times) - times
            of = np.repeat(np.arange(count), times)
            edge = np.arange(len(of)) + (low - starts)[of]
            value = forward[here[of] - self.length[edge]] + log[edge]
            value -= (top := np.maximum.reduceat(value, starts))[of]
            value = np.exp(value)
            total = np.add.reduceat(value, starts)
            forward[here] = top + np.log(total)
            self.share[edge] = value / total[of]


def _sampled_long(unit: str, draw: int, pieces: Pieces, alpha: float) -> list[int]:
    """Ids of one long unit, last first: the same filter and draws, with the edges of one window at a time."""
    real = np.frombuffer(unit.encode("utf-32-le"), np.uint32)

    def window(a: int, b: int) -> tuple[list[int], list[int], list[float], list[int]]:
        """The edges into the nodes over ``a`` up to ``b``, by node."""
        low = max(0, a - pieces.longest)
        first, size, weight, ids = edges(real[low:b], np.full(b - low, b - low), pieces, alpha)
        to = first + low + size
        order = np.flatnonzero(to > a)
        order = order[np.argsort(to[order], kind="stable")]
        return np.searchsorted(to[order], np.arange(a + 1, b + 2)).tolist(), size[order].tolist(), weight[order].tolist(), ids[order].tolist()

    forward = np.zeros(len(unit) + 1)
    windows = [(a, min(a + WINDOW, len(unit))) for a in range(0, len(unit), WINDOW)]
    for a, b in windows:
        into, size, weight, _ = window(a, b)
        low = max(0, a - pieces.longest)
        known = forward[low : a + 1].tolist()
        for k in range(b - a):
            here = a + 1 + k - low
            value = [known[here - size[e]] + weight[e] for e in range(into[k], into[k + 1])]
            top = max(value)
            known.append(top + math.log(sum(math.exp(v - top) for v in value)))
        forward[a + 1 : b + 1] = known[a + 1 - low :]
    draws = (_mix(_U(draw) + np.arange(len(unit) + 1, dtype=np.uint64)) >> _U(11)).astype(np.float64) * 2.0**-53
    found, at = [], len(unit)
    for a, b in reversed(windows):
        into, size, weight, ids = window(a, b)
        low = max(0, a - pieces.longest)
        known, drawn = forward[low : b + 1].tolist(), draws[a : b + 1].tolist()
        while at > a:
            left = drawn[at - a]
            for e in range(into[at - a - 1], into[at - a]):  # the last edge stands if rounding leaves a share over
                left -= math.exp(known[at - size[e] - low] + weight[e] - known[at - low])
                if left < 0:
                    break
            found.append(ids[e])
            at -= size[e]
    return found


class Kept:
    """The lattices of distinct units that earlier blocks had: arrays as in :class:`Lattice`, one unit after the other."""

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha
        self.known: dict[str, int] = {}
        self.size = self.node = np.zeros(0, np.int64)
        self.into = np.zeros(1, np.int64)
        self.length, self.piece, self.share = np.zeros(0, np.uint16), np.zeros(0, np.int32), np.zeros(0)

    def add(self, units: list[str], pieces: Pieces) -> None:
        lattice = Lattice(units, pieces, self.alpha)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.node = np.concatenate([self.node, lattice.node + (len(self.into) - 1)])
        self.into = np.concatenate([self.into[:-1], lattice.into + len(self.share)])
        self.size = np.concatenate([self.size, lattice.size])
        self.length = np.concatenate([self.length, lattice.length.astype(np.uint16)])
        self.piece = np.concatenate([self.piece, lattice.piece])
        self.share = np.concatenate([self.share, lattice.share])


def _drawn(lattice: Lattice | Kept, unit: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """How many pieces each of ``unit`` (numbers of the lattice's units) gets; for each step back from the units' ends, places in ``unit`` and pieces."""
    node, at = lattice.node[unit], lattice.size[unit]
    times, steps = np.zeros(len(unit), np.int64), []
    alive = np.arange(len(unit))
    while len(alive):
        left = (_mix(draw + at.astype(np.uint64)) >> _U(11)).astype(np.float64) * 2.0**-53
        edge, last = lattice.into[node + at], lattice.into[node + at + 1] - 1
        left -= lattice.share[edge]
        open_ = np.flatnonzero((left >= 0) & (edge < last))
        while len(open_):  # the last edge stands if rounding leaves a share over
            further = edge[open_] + 1
            edge[open_] = further
            rest = left[open_] - lattice.share[further]
            left[open_] = rest
            open_ = open_[(rest >= 0) & (further < last[open_])]
        steps.append((alive, lattice.piece[edge]))
        at = at - lattice.length[edge]
        more = at > 0
        times[alive[~more]] = len(steps)
        alive, at, node, draw = alive[more], at[more], node[more], draw[more]
    return times, steps


def _sampled(units: list[str], draw: np.ndarray, pieces: Pieces, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all units, in order, and how many each unit has; minus a code point where a character falls back to bytes."""
    kept = pieces.kept
    if kept is None or kept.alpha != alpha or kept.size.sum() > KEPT:
        kept = pieces.kept = Kept(alpha)
    index = np.fromiter(map(kept.known.get, units, repeat(-1)), np.int64, len(units))
    fresh = np.flatnonzero(index < 0)
    own: dict[str, int] = {}
    if len(fresh):
        names = [units[k] for k in fresh.tolist()]
        if short := [u for u in dict.fromkeys(names) if len(u) <= LONG_WORD]:
            kept.add(short, pieces)
        index[fresh] = np.fromiter(map(kept.known.get, names, repeat(-1)), np.int64, len(names))
    common, long = np.flatnonzero(index >= 0), np.flatnonzero(index < 0)
    sizes = np.array([len(units[k]) for k in long.tolist()], np.int64)
    # A few units far longer than all others are filtered by themselves, as they would have most steps alone.
    longest = np.argsort(-sizes, kind="stable")
    cost = np.cumsum(np.append(0, sizes[longest])) + STEP * np.append(sizes[longest], 0)
    apart = long[longest[: max(int(cost.argmin()), int((sizes > WINDOW).sum()))]]
    together = np.setdiff1d(long, apart)
    times = np.zeros(len(units), np.int64)
    alone = {}
    for k in apart.tolist():
        alone[k] = np.array(_sampled_long(units[k], int(draw[k]), pieces, alpha)[::-1], np.int32)
        times[k] = len(alone[k])
    drawn = []
    for some, lattice in ((common, kept), (together, None)):
        if not len(some):
            continue
        if lattice is None:
            of = np.array([own.setdefault(units[k], len(own)) for k in some.tolist()], np.int64)
            lattice = Lattice(list(own), pieces, alpha)
        else:
            of = index[some]
        times[some], steps = _drawn(lattice, of, draw[some])
        drawn.append((some, steps))
    ends = np.cumsum(times)
    piece = np.zeros(int(times.sum()), np.int32)
    for some, steps in drawn:
        last = ends[some] - 1
        for n, (alive, chosen) in enumerate(steps):
            piece[last[alive] - n] = chosen
    for k, chosen in alone.items():
        piece[ends[k] - len(chosen) : ends[k]] = chosen
    return piece, times


def encode(texts: list[str], row_keys: np.ndarray, pieces: Pieces, alpha: float = ALPHA, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts, one after the other, and the offset of each text's first id (one more than texts)."""
    found, where = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    units: list[str] = []
    runs: list[tuple[int, int, int]] = []  # row, place of the first unit there, units
    keyed = _mix(row_keys.astype(np.uint64) + _U(seed) * _U(0x9E3779B97F4A7C15))
    held = 0

    def sample() -> None:
        row, first, count = np.array(runs, np.int64).T
        of = np.repeat(row, count)
        place = np.arange(len(units)) + np.repeat(first - (np.cumsum(count) - count), count)
        piece, times = _sampled(units, _mix(keyed[of] + place.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), pieces, alpha)
        found.append(piece)
        where.append(np.repeat(of, times))
        units.clear(), runs.clear()

    for k, text in enumerate(texts):
        if len(text) + held <= BLOCK:
            own = _UNITS.findall(text)
            units += own
            runs.append((k, 0, len(own)))
            held += len(text)
            continue
        first, begin = 0, len(units)
        for m in _UNITS.finditer(text):
            units.append(m[0])
            held += len(m[0])
            if held > BLOCK:
                count = len(units) - begin
                runs.append((k, first, count))
                sample()
                first, begin, held = first + count, 0, 0
        runs.append((k, first, len(units) - begin))
    if units:
        sample()
    piece, rows = np.concatenate(found), np.concatenate(where)
    odd = np.flatnonzero(piece < 0)
    if len(odd):  # bytes of characters that no piece holds
        spelled = [[pieces.byte_id[b] for b in chr(-c).encode()] for c in piece[odd].tolist()]
        times = np.ones(len(piece), np.int64)
        times[odd] = [len(s) for s in spelled]
        ends = np.cumsum(times)
        piece, rows = np.repeat(piece, times), np.repeat(rows, times)
        for k, s in zip(odd.tolist(), spelled, strict=True):
            piece[ends[k] - len(s) : ends[k]] = s
    return piece.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))])


def decode(ids: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each text's first byte."""
    lengths = pieces.lengths[ids]
    total = np.concatenate([[0], np.cumsum(lengths)])
    places = np.repeat(pieces.begins[ids] - total[:-1], lengths) + np.arange(total[-1])
    return pieces.spelled[places], total[offsets]


_loaded: dict[str, Pieces] = {}


def _pieces(model: str) -> Pieces:
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def sample_pieces(docs: DataFrame, model: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids (array of int), n_ids and lossless.

    lossless tells whether decoding the ids gives the text's very bytes; it always does. The draw's key is doc_id, so rows
    with equal doc_id and text get equal ids. Null text: empty, no ids. Null doc_id: key 0. alpha (finite, 0 or more): 0 makes all
    segmentations equally likely, a large one the best certain (equally good ones share). Texts are encoded as they are: no space is
    put before the first word, so ids are decoded by :func:`restore`, not by a decoder that takes a leading space off.
    Other columns are ignored. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in slices(batches, "text", 2 << 20):
            keys = batch.column(2).to_numpy().view(np.uint64)
            ids, offsets = encode([t or "" for t in batch.column(1).to_pylist()], keys, pieces, alpha, seed)
            begins, data = text_buffer(batch.column(1))
            back, ends = decode(ids, offsets, pieces)
            same = np.array_equal(ends, begins) and np.array_equal(back, data)
            lossless = [True] * len(keys) if same else [back[ends[k] : ends[k + 1]].tobytes() == data[begins[k] : begins[k + 1]].tobytes() for k in range(len(keys))]
            arrays = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays, pa.array(np.diff(offsets)), pa.array(lossless)], ["doc_id", "ids", "n_ids", "lossless"])

    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("key"))
    return keyed.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, lossless boolean")


def restore(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of ``encoded`` (doc_id, ids): the inverse of :func:`sample_pieces`. Null ids: a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                got = np.array(ids or [], np.int64)
                texts.append(None if ids is None else decode(got, np.array([0, len(got)]), pieces)[0].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(documents(spark, sf_dir), model_path())

"""Best-fit packing: a configuration linear program over the length histogram, by multiplicative weights, then rounded.

Only the histogram reaches the driver: at most ``capacity`` numbers whatever the input. A plan is runs of equal sequences, and
each piece finds its place in the plan from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LONG_WORD, documents, lean, slices, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Length classes of the linear program, sized by their middle (in halves of their width); the share of tokens, from the shortest pieces, that is kept back to close sequences.
CLASSES, FILLERS = 256, 0.025
#: The program is solved for what is left until that is at most this share of its tokens, so often at most.
REST, ROUNDS = 0.02, 12
#: Each step covers this share of the scarcest class of a configuration at least and at most, between them a share that rises with the classes, so that
#: steps are about as many; ETA: how fast covered classes lose weight.
FINE, STEP, ETA, MOST_STEPS = 0.02, 0.25, 3.0, 3000
#: The largest items of a sequence, whose lengths are chosen together so that it is full; from so many classes beside their own if need be.
CLOSING, REACH = 6, (0, 2, 6)
#: So many sums are tried, from the greatest, where items compete for the last pieces of a length.
TRIES = 4
#: A sequence is taken only if real lengths fill it; once a solution places less than FEW of what is left so, also if at most LOOSE of it stays empty.
LOOSE, FEW = 1 / 128, 0.2
#: A length with more pieces than this, and than a shuffle partition's fair share, is ranked in several parts.
RANKED = 1000


# --- tokens -------------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The tokenizer lower-cases, splits at white space and never merges across it, so ids of a text of Latin-1 characters are
    those of its words, which are kept in a bounded dictionary. Other texts, and with ``added`` those that hold an added token, take the
    tokenizer's own way. Without ``added``, added tokens are encoded as plain text.
    """

    KEPT, KEPT_PARTS = 200_000, 120_000
    _parts = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^0-9\xb2\xb3\xb9\xbc-\xbea-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+")
    _odd = re.compile(rb"[\x1c-\x1f]")  # white space to Python, not to the tokenizer

    def __init__(self, path: str, added: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.model = self.tokenizer.model
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.added = re.compile("|".join(names) or "(?!)", re.IGNORECASE)  # the tokenizer may match them after lower-casing
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {**{b: b for b in plain}, **{b: 256 + k for k, b in enumerate(rest)}}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = []
        for part in self._parts.findall(word):
            known = self.parts.get(part)
            if known is None:
                spelled = part.encode().decode("latin-1").translate(self.alphabet)
                known = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
                if len(part) <= LONG_WORD:
                    self.parts[part] = known
            ids.append(known)
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        try:
            plain = not self._odd.search(text.encode("latin-1")) and not self.added.search(text)
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        known = self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > self.KEPT:
                known.clear()
            if len(self.parts) > self.KEPT_PARTS:
                self.parts.clear()
            own = {}
            for word in words:
                if word not in known:
                    (known if len(word) <= LONG_WORD else own)[word] = self._word(word)
            return b"".join([own[w] if w in own else known[w] for w in words] if own else map(known.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, as bytes); a text's ids, then ``end_id``, cut every ``capacity``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)]
    last, size = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer, added=True)
        encode = _encoders[tokenizer].encode
        for batch in slices(batches, "text"):
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encode(text or "") + last
                for k, a in enumerate(range(0, len(data), size)):
                    part = data[a : a + size]
                    rows.append((ident, k, a // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


# --- the plan -----------------------------------------------------------------------------------------------------------


def best_configuration(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming, each class any number of times: the counts that maximise the price."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    ordered, worth = sizes[order], prices[order]
    within = np.searchsorted(ordered, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        n = within[room]
        value = best[room - ordered[:n]] + worth[:n]
        k = int(value.argmax()) if n else -1
        if n and value[k] > best[room - 1]:
            best[room], taken[room] = value[k], order[k]
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return counts


def configuration_lp(counts: np.ndarray, sizes: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how many sequences of each, fractional, that cover ``counts`` items of ``sizes``.

    Multiplicative weights for the covering program (least sum of x; for each class, sum of its items times x >= its count). A class's
    weight starts at its tokens and falls exponentially with the share covered; a covered class weighs nothing. Pricing is the
    knapsack over prices weight / count. No solution is under counts @ sizes / capacity, so the gap to that is known.
    """
    covered, found = np.zeros(len(counts)), {}
    share = min(max(len(counts) / CLASSES, FINE), STEP)
    for _ in range(MOST_STEPS):
        open_ = covered < 1 - 1e-9
        if not open_.any():
            break
        prices = np.where(open_, sizes * np.exp(-ETA * covered), 0.0)
        config = best_configuration(prices, sizes, capacity)
        used = config > 0
        step = share * float((counts[used] / config[used]).min())
        covered[used] += step * config[used] / counts[used]
        key = config.tobytes()
        found[key] = found.get(key, 0.0) + step
    return [(np.frombuffer(k, np.int64), x) for k, x in found.items()]


Run = tuple[dict[int, int], int]  # a sequence as length -> number of pieces, and how many such sequences


def best_fit(left: np.ndarray, runs: list[Run], capacity: int) -> list[Run]:
    """Best fit decreasing over whole runs: ``left`` pieces by length go to the runs with the least room that holds them, then to new ones."""
    rooms: dict[int, list[Run]] = {}
    for held, n in runs:
        rooms.setdefault(capacity - sum(a * b for a, b in held.items()), []).append((held, n))
    order = sorted(rooms)

    def put(room: int, run: Run) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append(run)

    for length in range(len(left) - 1, 0, -1):
        m = int(left[length])
        while m:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = min(capacity // length, m)
                n = m // each
                put(capacity - each * length, ({length: each}, n))
                m -= each * n
                continue
            room = order[at]
            held, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = max(1, min(room // length, m // n))
            used = min(n, m // each)
            if used < n:
                put(room, (held, n - used))
            put(room - each * length, ({**held, length: held.get(length, 0) + each}, used))
            m -= each * used
    return [run for held in rooms.values() for run in held]


def realised(left: np.ndarray, config: list[tuple[int, int, int]], capacity: int, reach: int) -> list[int]:
    """Lengths of real pieces (``left``, by length) for the items of a configuration, with the greatest sum that fits; empty if there are none.

    ``config``: first and last length of a class, and how many items of it. The CLOSING largest items are chosen together, by the sums that
    they can reach, from lengths up to ``reach`` outside their class; others take the length with most pieces. A length is taken no
    more often than it has pieces.
    """
    room, fixed = left.copy(), []
    wanted = sorted(config, reverse=True)
    closing = [item for item in wanted for _ in range(min(item[2], CLOSING))][:CLOSING]
    for low, high, times in wanted:
        for _ in range(times - closing.count((low, high, times))):
            length = low + int(room[low : high + 1].argmax())
            if not room[length]:
                return []
            room[length] -= 1
            fixed.append(length)
    spare = capacity - sum(fixed)
    if spare < 0:
        return []
    slots = []
    for low, high, _ in closing:
        low, high = max(1, low - reach), min(capacity, high + reach)
        slots.append((low + np.flatnonzero(room[low : high + 1])).tolist())
    inside = (1 << (spare + 1)) - 1
    sums = [1]
    for lengths in slots:
        more = 0
        for x in lengths:
            more |= sums[-1] << x
        sums.append(more & inside)
    totals = sums[-1]
    for _ in range(TRIES):
        at, left_of, chosen = totals.bit_length() - 1, room.copy(), []
        if at < 0:
            break
        totals ^= 1 << at
        for lengths, before in zip(reversed(slots), reversed(sums[:-1]), strict=True):
            could = [x for x in lengths if x <= at and left_of[x] and before >> (at - x) & 1]
            if not could:  # an item before took the last piece
                break
            chosen.append(max(could, key=left_of.__getitem__))
            left_of[chosen[-1]] -= 1
            at -= chosen[-1]
        else:
            return fixed + chosen
    return []


def rounded(left: np.ndarray, capacity: int) -> list[Run]:
    """Sequences from configurations of the linear program, rounded; takes their pieces from ``left``.

    Whole sequences of each configuration come first, then one more of each by falling fraction, as pieces allow; the program is solved
    again for the rest. A sequence that real lengths do not fill stays without its smallest item, for best fit to close.
    """
    lengths = np.arange(capacity + 1)
    grain = max(1, capacity // CLASSES)
    of = -(-lengths // grain)  # class of a length; its size is its middle, in half grains
    tokens = np.cumsum(left * lengths)
    kept_back = int(np.searchsorted(tokens, FILLERS * tokens[-1], "right"))
    within = np.where(lengths >= kept_back, left, 0)
    least = REST * int((within * lengths).sum())
    runs: list[Run] = []
    loose = 0.0
    for _ in range(ROUNDS):
        counts = np.bincount(of, within, of[-1] + 1).astype(np.int64)
        classes = np.flatnonzero(counts)
        before = int((within * lengths).sum())
        if before <= least:
            break
        solved = configuration_lp(counts[classes].astype(float), 2 * classes - (grain > 1), 2 * capacity // grain)
        by_count = [(config, int(x)) for config, x in sorted(solved, key=lambda c: (-c[1], c[0].tobytes()))]
        by_fraction = [(config, 1) for config, x in sorted(solved, key=lambda c: (-(c[1] % 1), c[0].tobytes()))]
        for config, n in by_count + by_fraction:
            used = np.flatnonzero(config)
            slots = [(max(kept_back, int(classes[j] - 1) * grain + 1), int(classes[j]) * grain, int(config[j])) for j in used]
            n = min(n, *(int(counts[classes[j]] // config[j]) for j in used))
            while n > 0:
                for reach in REACH:
                    chosen = realised(within, slots, capacity, reach * grain)
                    if sum(chosen) == capacity:
                        break
                if not chosen or capacity - sum(chosen) > loose * capacity:
                    break
                if len(chosen) > 1 and sum(chosen) < capacity:
                    chosen.remove(min(chosen))
                held = {x: chosen.count(x) for x in chosen}
                m = min(n, *(int(within[x]) // k for x, k in held.items()))
                for x, k in held.items():
                    within[x] -= m * k
                    left[x] -= m * k
                    counts[of[x]] -= m * k
                runs.append((held, m))
                n = min(n - m, *(int(counts[classes[j]] // config[j]) for j in used))
        if int((within * lengths).sum()) > (1 - FEW) * before:
            if loose:
                break
            loose = LOOSE
    return runs


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs of sequences that hold every piece of the histogram once: rounded configurations, and best fit for what rounding leaves."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    runs: list[Run] = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    return best_fit(left, runs + rounded(left, capacity), capacity)


def places(runs: list[Run]) -> dict[str, np.ndarray]:
    """The plan by (length, rank among the pieces of that length), sorted; one entry a run and length."""
    rank: dict[int, int] = {}
    entries, sequence = [], 0
    for held, n in runs:
        offset = 0
        for length in sorted(held, reverse=True):
            each = held[length]
            entries.append((length, rank.get(length, 0), each, sequence, offset))
            rank[length] = rank.get(length, 0) + each * n
            offset += each * length
        sequence += n
    entries.sort()
    table = np.array(entries, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "first": table[:, 1], "each": table[:, 2], "sequence": table[:, 3], "offset": table[:, 4]}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text) with its sequence_id and offset; ``ids`` adds the piece's ids as bytes.

    Null text: empty, so one piece with the end id alone. Null ids and repeated rows: pieces of their own, placed like others.
    Only documents of more than ``capacity`` ids are cut. Sequences have no gaps. Other columns are ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_id, ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    # Rank among equal lengths: a length with many pieces is spread by a hash, ranked inside each part, and parts are counted before.
    share = max(RANKED, sum(histogram.values()) // int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = {length: math.ceil(n / share) for length, n in histogram.items() if n > share}
    salt = F.lit(0).cast("long")
    if parts:
        spread = F.create_map(*(x for length, n in sorted(parts.items()) for x in (F.lit(length), F.lit(n))))
        salt = F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce(F.try_element_at(spread, F.col("length")), F.lit(1)))
    salted = cut.withColumn("salt", salt)
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = ["doc_id", "piece", "ids_crc32"]
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    if parts:
        ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(table["key"], (length << 44) + rank, "right") - 1
            here = rank - table["first"][at]
            sequence = table["sequence"][at] + here // table["each"][at]
            offset = table["offset"][at] + here % table["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, F.col("rank").cast("long").alias("rank")).mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids + ", sequence_id long, offset long")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())

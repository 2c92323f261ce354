"""Near-dedup by SetSketch registers: band register values, estimate by likelihood, verify on full shingle sets.

1. Each text becomes its set of word shingles, a digest of the set and a sketch: registers of exponentially spaced, truncated
   minima, which merge by maximum and agree between two sets with a probability close to their Jaccard similarity.
2. Texts with equal sets are one class. Bands of registers deal classes into buckets.
3. Each bucket links its members to one centre: pairs that pass the likelihood test meet in tiles of bounded size, where full
   sets are compared; a tile gives a spanning forest of its links, never all of them.
4. Buckets that hold several components after that compare the rest: members are dealt into blocks, pairs of blocks are
   tiles, and pairs of different components that pass the likelihood test are verified. So no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG_WORD, documents, lean, slices, written

#: BANDS x ROWS registers. At a similarity of 0.8 a pair shares no band with probability (1 - 0.8^4)^24 < 4e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: SetSketch's base and rate; registers are 0 to LAST.
BASE, RATE, LAST = 1.001, 20.0, 65535
#: The likelihood test passes pairs whose estimate is at most so many standard deviations under the threshold.
MARGIN = 5.0
#: Classes in a block of a bucket, and members that a centre meets in one tile; both are fewer where sets are large, so that a block or a
#: tile's members hold about ELEMENTS shingles at most (or one set).
BLOCK, STAR, ELEMENTS = 512, 128, 1 << 20

_M64 = np.uint64
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M64(30))) * _M64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M64(27))) * _M64(0x94D049BB133111EB)
    return x ^ (x >> _M64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text, the sorted 64-bit hashes of its distinct shingles of ``width`` words.

    Words are runs of other characters than space and U+0009 to U+000D, with A-Z lower-cased. With fewer words the whole
    sequence is one shingle; without words the set is empty.
    """
    if len(_words) > 200_000:
        _words.clear()
    out = []
    digest = xxhash.xxh3_64_intdigest
    for text in texts:
        words = (text or "").encode().lower().split()
        if not words:
            out.append(np.zeros(0, np.uint64))
            continue
        own = {}
        for word in words:
            if word not in _words:
                (_words if len(word) <= LONG_WORD else own)[word] = digest(word)
        hashes = np.fromiter((own[w] if w in own else _words[w] for w in words) if own else map(_words.__getitem__, words), np.uint64, len(words))
        n = min(width, len(hashes))
        mixed = np.full(len(hashes) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = _mix((mixed ^ hashes[k : len(hashes) - n + 1 + k]) * _M64(0x9E3779B97F4A7C15))
        out.append(np.unique(mixed))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (sets x REGISTERS, 16 bits); rows of empty sets are zero.

    Each element makes a Poisson process of points, each in a random register; a register's minimum is exponential with the
    set's size as rate. Points come in rising order, so an element is done once its next point is over all minima of its set.
    """
    sizes = np.array([len(s) for s in sets])
    minima = np.full(len(sets) * REGISTERS, np.inf)
    element = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    at = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        draw = _mix(element + _M64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = at - np.log(((draw >> _M64(11)).astype(np.float64) + 1) * 2.0**-53) / REGISTERS
        register = (_mix(draw ^ _M64(0xD6E8FEB86659FD93)) >> _M64(33)).astype(np.int64) % REGISTERS
        np.minimum.at(minima, owner * REGISTERS + register, at)
        left = np.unique(owner)
        over = np.zeros(len(sets))
        over[left] = minima.reshape(-1, REGISTERS)[left].max(1)
        alive = at < over[owner]
        element, owner, at = element[alive], owner[alive], at[alive]
    with np.errstate(divide="ignore"):
        levels = np.floor(1 - np.log(minima / RATE) / np.log(BASE))
    return np.where(np.isfinite(minima), np.clip(levels, 0, LAST), 0).astype(np.uint16).reshape(len(sets), REGISTERS)


def passes(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """For pairs of sketches with known set sizes: whether sizes allow the similarity and the joint likelihood doesn't speak against it.

    The log-likelihood of the similarity given how many registers are larger, smaller and equal is concave, so its maximum is
    at t or over it just if it rises at t.
    """
    threshold = percent / 100
    t = threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - more - less
    u = na / (na + nb)
    v = 1 - u

    def likelihood(j: float) -> np.ndarray:
        def chance(x: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)

        up, down = chance(u - v * j), chance(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    return fits & (likelihood(t + 1e-4) >= likelihood(t - 1e-4))


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each sketch and band."""
    parts = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(parts), 1), np.uint64)
    for k in range(ROWS):
        key = _mix((key ^ parts[:, :, k]) * _M64(0x9E3779B97F4A7C15) + _M64(k + 1))
    return key


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _signatures(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            registers = sketches(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), *_names(sets), pa.array([r.tobytes() for r in registers], pa.binary())],
                ["doc_id", "text_key", "n", "node", "check", "registers"],
            )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(_registers(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys)))], ["key", "node", "band"])


def _digest(elements: np.ndarray) -> int:
    return xxhash.xxh3_128_intdigest(elements.tobytes())


def _names(sets: list[np.ndarray]) -> list[pa.Array]:
    """Both halves of each set's 128-bit digest."""
    digests = [_digest(s) for s in sets]
    return [pa.array([(d >> 64) - (1 << 63) for d in digests], pa.int64()), pa.array([(d & (1 << 64) - 1) - (1 << 63) for d in digests], pa.int64())]


def _sets(width: int) -> Callable:
    """asked, text -> asked, node, check, elements: each text's set and its names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_names(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["asked", "node", "check", "elements"])

    return run


def _star_test(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = passes(_registers(batch.column(2)), _registers(batch.column(4)), batch.column(3).to_numpy(), batch.column(5).to_numpy(), percent)
                yield batch.select([0, 1]).filter(pa.array(good))

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows that are sorted by column ``by``; small groups come several in a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(by).to_numpy()
        last = int(np.searchsorted(keys != keys[-1], False)) if keys[0] == keys[-1] else len(keys) - int(np.argmax(keys[::-1] != keys[-1]))
        if last > 0 and not (held and keys[0] == keys[-1]):
            yield pa.concat_batches([*held, batch.slice(0, last)]) if held else batch.slice(0, last)
            held = []
        elif held and held[-1].column(by)[-1].as_py() != keys[0]:
            yield pa.concat_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def _bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _tile_test(percent: int) -> Callable:
    """tile, band, side, node, label, n, registers (sorted by tile) -> tile, node of each member with a pair that must be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 0):
            tiles, band, side, label, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4, 5))
            registers = _registers(batch.column(6))
            bounds = _bounds(tiles)
            needed = np.zeros(len(tiles), bool)
            for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
                x, y = np.triu_indices(end - begin, 1)
                x, y = x + begin, y + begin
                both = side[begin] != side[end - 1] if end > begin else False
                keep = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                if both or (side[begin:end] > 0).any():  # blocks i and j: only pairs across
                    keep &= side[x] != side[y]
                x, y = x[keep], y[keep]
                for a in range(0, len(x), 20_000):
                    i, j = x[a : a + 20_000], y[a : a + 20_000]
                    equal = (registers[i] == registers[j]).reshape(-1, BANDS, ROWS).all(2)
                    good = (equal.argmax(1) == band[i]) & equal.any(1)  # each pair in its first shared band
                    good[good] = passes(registers[i[good]], registers[j[good]], n[i[good]], n[j[good]], percent)
                    needed[i[good]] = needed[j[good]] = True
            if needed.any():
                yield batch.select([0, 3]).filter(pa.array(needed))

    return run


def _verify(percent: int) -> Callable:
    """tile, node, elements (sorted by tile) -> a, b: links of a spanning forest of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 0):
            bounds = _bounds(batch.column(0).to_numpy())
            nodes = batch.column(1).to_numpy()
            left, right = [], []
            for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
                if end - begin < 2:
                    continue
                sets = [np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64) for k in range(begin, end)]
                sizes = np.array([len(s) for s in sets])
                elements, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                shared = count > 1
                place = np.cumsum(shared) - 1
                row = np.repeat(np.arange(end - begin), sizes)
                use = shared[column]
                row, column = row[use], place[column[use]]
                common = np.zeros((end - begin, end - begin))
                width = max(1, (8 << 20) // (end - begin))  # columns at a time: 32 MB of float32
                order = np.argsort(column, kind="stable")
                row, column = row[order], column[order]
                for a in range(0, int(shared.sum()), width):
                    b, c = np.searchsorted(column, [a, a + width])
                    matrix = np.zeros((end - begin, min(width, int(shared.sum()) - a)), np.float32)
                    matrix[row[b:c], column[b:c] - a] = 1
                    common += matrix @ matrix.T
                linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
                seen = np.zeros(end - begin, bool)
                for k in range(end - begin):
                    if seen[k]:
                        continue
                    reached = np.zeros(end - begin, bool)
                    reached[k] = True
                    front = reached
                    while front.any():
                        front = linked[front].any(0) & ~reached
                        reached = reached | front
                    seen |= reached
                    others = np.flatnonzero(reached)
                    others = others[others != k]
                    left.append(np.full(len(others), nodes[begin + k]))
                    right.append(nodes[begin + others])
            if left and sum(map(len, left)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (a, b): the smallest node reachable, by minimum labels and pointer jumping.

    Each round is written to the shared folder. Labels fall until nothing changes; jumping makes the rounds logarithmic in practice.
    """
    edges = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        jumped = lower.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left").select("node", "was", F.least("label", "further").alias("label"))
        table = written(jumped, "labels")
        labels = table.select("node", "label")
        if table.where("label < was").isEmpty():
            return labels


def cluster(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id of all rows reachable by links), kept, text_key (a hash of the text) and stays.

    ``stays`` marks one text of each group: that of the smallest doc_id (nulls last), of several the one with the least text_key. Texts without words all stay.

    Rows are linked if 100 * common shingles >= percent * all shingles of both. Texts without words (null, empty, white space) are linked
    with nothing: component_id is their own id. Null doc_id: takes part, never the smallest; a component of such rows alone has a null
    component_id and keeps them. Repeated rows with one doc_id are marked alike. Other columns are ignored. Empty table: no rows.
    Sets are compared as sorted 64-bit shingle hashes; classes of equal sets are told apart by 128-bit digests.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(plain.withColumn("text_key", F.xxhash64("text")).mapInArrow(lean(_signatures(width)), "doc_id long, text_key long, n long, node long, check long, registers binary"), "signatures")
    best = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "text_key")).alias("best")
    about = (F.min("doc_id").alias("first"), best, F.max("n").alias("n"), F.any_value("registers").alias("registers"))
    classes = written(signed.where("n > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"), *about), "classes")
    # Classes are named by one half of their digest; where unequal sets share that (next to never), all but one get another name.
    clashes = classes.where("low < high").select("node", "low")
    clash = not clashes.isEmpty()

    def renamed(rows: DataFrame) -> DataFrame:
        if not clash:
            return rows
        other = rows.join(F.broadcast(clashes), "node", "left")
        return other.withColumn("node", F.when(F.col("check") > F.col("low"), F.xxhash64("node", "check")).otherwise(F.col("node"))).select(rows.columns)

    if clash:
        signed = renamed(signed)
        classes = written(signed.where("n > 0").groupBy("node").agg(*about), "classes")
    keyed = classes.select("node", "registers").mapInArrow(lean(_keys), "key long, node long, band int")
    shared = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1")
    buckets = written(keyed.join(shared, "key"), "buckets")

    # Stars: each class against the centres of its buckets.
    sketch = classes.select("node", "registers", "n")
    stars = buckets.where("node <> centre").select("centre", "node").distinct()
    tested = (
        stars.join(sketch, "node")
        .select("centre", "node", "registers", "n")
        .join(sketch.select(F.col("node").alias("centre"), F.col("registers").alias("registers_2"), F.col("n").alias("n_2")), "centre")
        .select("centre", "node", "registers", "n", "registers_2", "n_2")
        .mapInArrow(lean(_star_test(percent)), "centre long, node long")
    )
    stars = written(tested, "stars")
    # A centre meets at most about STAR members in a tile; their sets are about as large as its own.
    counts = stars.groupBy("centre").agg(F.count("*").alias("members")).join(classes.select(F.col("node").alias("centre"), "n"), "centre")
    parts = F.ceil(F.greatest(F.col("members") / STAR, F.col("members") * F.col("n") / ELEMENTS))
    dealt = stars.join(counts, "centre").select("centre", "node", F.xxhash64("centre", F.pmod(F.xxhash64("node"), parts)).alias("tile"))
    star_tiles = dealt.select("tile", "node").unionAll(dealt.select("tile", F.col("centre").alias("node")).distinct())

    # Full sets of the classes that may be compared: in stars, or beside a centre in a bucket of three or more.
    needed = stars.select("node").unionAll(stars.select("centre")).unionAll(buckets.where("members > 2 AND node <> centre").select("node")).distinct()
    # One row carries a class's text: joined by id and set, so that repeated and null ids give the right text.
    named = signed.where("n > 0").join(needed, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    known = plain.join(named.where("doc_id IS NOT NULL"), "doc_id")
    unknown = plain.where("doc_id IS NULL").withColumn("node", F.lit(None).cast("long"))
    found = renamed(known.select("node", "text").unionAll(unknown.select("node", "text")).mapInArrow(lean(_sets(width)), "asked long, node long, check long, elements binary"))
    # A text of the named id may belong to another class.
    own = found.where("asked IS NULL OR asked = node").select("node", "elements")
    sets = written(own.join(needed, "node", "left_semi").dropDuplicates(["node"]), "sets")

    def verified(tiles: DataFrame) -> DataFrame:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = tiles.join(sets, "node").select("tile", "node", "elements").repartition(parts, "tile").sortWithinPartitions("tile")
        # Links are few: dealt anew, they go to a few files instead of one for each of the parts.
        return written(rows.mapInArrow(lean(_verify(percent)), "a long, b long").repartition("a", "b"), "links")

    links = verified(star_tiles)
    labels = components(links)

    # The rest: buckets that still hold several components, every pair across components.
    rest = buckets.where("members > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sized = rest.where("node <> centre").join(classes.select("node", "n"), "node")
    mixed = sized.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("others"), F.sum("n").alias("elements")).where("low < high").select("key", "others", "elements")
    blocks = F.ceil(F.greatest(F.col("others") / BLOCK, F.col("elements") / ELEMENTS)).cast("int")
    placed = rest.where("node <> centre").join(mixed, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low == high, 0).when(F.col("block") == low, 1).otherwise(2)
    tiles = spread.select(F.xxhash64("key", low, high).alias("tile"), "band", side.alias("side"), "node", "label").join(sketch, "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    compared = tiles.select("tile", "band", "side", "node", "label", "n", "registers").repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(lean(_tile_test(percent)), "tile long, node long")
    more = verified(compared)
    labelled = more
    for end in ("a", "b"):
        labelled = labelled.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    joined = labelled.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b")
    if not joined.isEmpty():
        merged = components(joined)
        every = labels.unionAll(more.select(F.col("a").alias("node")).unionAll(more.select("b")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
        labels = every.join(merged.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left").select("node", F.coalesce("final", "label").alias("label"))

    linked = labels.join(classes.select("node", "first", "best"), "node")
    smallest = linked.groupBy("label").agg(F.min("first").alias("component"), F.min("best").alias("top"))
    members = linked.join(smallest, "label").select("node", "component", "top")
    found = classes.select("node", "first", "best").join(members, "node", "left").select("node", F.coalesce("component", "first").alias("component"), F.coalesce("top", "best").alias("top"))
    out = signed.select("doc_id", "text_key", "n", "node").join(found, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    stays = (F.col("n") == 0) | ((F.col("text_key") == F.col("top.text_key")) & (F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("top.id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key", stays.alias("stays"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(documents(spark, sf_dir), width=4, percent=80).drop("text_key", "stays")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM d
), s AS (
  SELECT DISTINCT doc_id, unnest(shingles) AS shingle FROM shingled
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.other
), component AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d JOIN component c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

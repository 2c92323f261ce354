"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A cut depends on the bytes near it alone, so an insertion moves cuts nearby and no others, and a passage that
two texts share is cut alike in both. The document with the smallest id owns a chunk. In the others, chunks that lie in their owner as
they lie here are matched on byte by byte, through chunks that another document owns, and what is long enough in one owner goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, lean, slices, spread, text_buffer, written

#: The rolling hash sees WINDOW bytes (a power of two). Places for cuts are the beginnings of words, of characters of three bytes or more, and,
#: DEEP bytes after the last white space, where the hash is least among five. A cut is the least of SPAN places in a row, so that
#: 2 * SPAN + 2 words or characters that two texts share hold a whole chunk of both. In periodic text each period may be a cut: one is kept in STRIDE bytes.
WINDOW, SPAN, DEEP, STRIDE, MOST = 8, 14, 16, 40, 160
#: Runs are extended by at most so many bytes: more than lie between an end of a shared passage and its first cut, but for very long words.
REACH = 256
#: Matches of fewer words stay.
RUN_WORDS = 20
#: A character of a script without spaces counts as a word, and so do LETTERS characters of a longer word.
LETTERS = 20
#: Texts are exchanged only if their document's hash is in a table of so many places.
PLACES = 1 << 20
#: Bytes of text that a worker cuts into chunks or holds against others at a time (one row may exceed it), and rows that it hands on at once.
SLICE, ROWS = 1 << 19, 4096
#: Documents without an id count as larger than all ids under this.
NO_ID = 1 << 62

_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
_GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 11) & 0xFFFFFFFF for b in range(256)], np.uint32)


def words(text: str) -> int:
    """Words between white space; in scripts without spaces, and in very long words, characters count."""
    return sum(max(1, len(word) // LETTERS, 0 if word.isascii() else len(_UNSPACED.findall(word))) for word in text.split())


def _rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW bytes up to each byte."""
    rolling = _GEAR[data]
    step = 1
    while step < WINDOW:  # the sum over 2 * step bytes from two sums over step bytes
        rolling[step:] += rolling[:-step] << np.uint32(step)
        step *= 2
    return rolling * np.uint32(0x9E3779B1)


def cuts(offsets: np.ndarray, data: np.ndarray, rolling: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every chunk of all texts, in order. Chunks of one text cover it; they begin and end between characters."""
    rolling = _rolling(data) if rolling is None else rolling
    index = np.arange(len(data))
    space = (data == 32) | (data - 9 <= 4)
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    # A cut before byte k sees the WINDOW bytes before it, which lie in one text.
    hashed = np.append(np.uint32(0), rolling[:-1]) >> np.uint32(1)
    hashed[data & 0xC0 == 0x80] |= np.uint32(1 << 31)  # never inside a character
    since = index - np.maximum(np.maximum.accumulate(np.where(space, index, -1)), begin - 1)
    place = (since == 1) | (data >= 0xE0)
    deep = np.flatnonzero((since > DEEP) & (data & 0xC0 != 0x80))
    deep = deep[deep + 2 < len(data)]
    least = hashed[deep]
    for k in (-2, -1, 1, 2):
        least = np.minimum(least, hashed[deep + k])
    place[deep[hashed[deep] == least]] = True
    place &= (index - begin >= WINDOW) & ~space
    place = np.flatnonzero(place)
    at = np.zeros(0, np.int64)
    if len(place) >= SPAN:
        count = len(place)
        least = (hashed[place].astype(np.uint64) << np.uint64(32)) | np.arange(count - 1, -1, -1, dtype=np.uint64)  # of equal ones the last
        step = 1
        while 2 * step <= SPAN:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < SPAN:
            least = np.minimum(least[: step - SPAN], least[SPAN - step :])
        least = least[begin[place[: count - SPAN + 1]] == begin[place[SPAN - 1 :]]]  # all in one text
        found = count - 1 - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], found[1:] != found[:-1]]) if len(found) else np.zeros(0, bool)
        at, value = place[found[new]], (least[new] >> np.uint64(32)).astype(np.int64)
        if len(at):
            fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (np.diff(at) >= STRIDE)])
            block = (at - at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]) // STRIDE
            at = at[fresh | np.concatenate([[True], block[1:] != block[:-1]])]
    ends = np.unique(np.concatenate([at, offsets[1:][np.diff(offsets) > 0]]))
    return np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, row_key, text -> one row per chunk.

    ``place``: its start, and 8 bits each of the hashes of the WINDOW bytes before and after it. ``most``: bounds of the words in REACH bytes
    before it (7 bits), in it (8), in REACH bytes after it (7), and in WINDOW bytes before and after (4 each).
    """
    digest = xxhash.xxh3_64_intdigest
    for batch in slices(batches, "text", SLICE):
        offsets, data = text_buffer(batch.column(2))
        rolling = _rolling(data)
        starts, ends = cuts(offsets, data, rolling)
        if not len(starts):
            continue
        text = np.searchsorted(offsets, starts, "right") - 1
        whole = memoryview(data.tobytes())
        found = np.fromiter((digest(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
        # Words may end at any byte that Python takes for white space: each ASCII control or space, and each byte of other characters.
        gap = (data <= 32) | (data >= 0x80)
        total = np.concatenate([[0], np.cumsum(gap)])
        low, high = offsets[text], offsets[text + 1]
        most = lambda a, b, cap: np.minimum(total[b] - total[a] + (b - a) // LETTERS + 1, cap)  # noqa: E731, B023
        bounds = most(np.maximum(starts - REACH, low), starts, 127)
        for a, b, bits in ((starts, ends, 8), (ends, np.minimum(ends + REACH, high), 7), (np.maximum(starts - WINDOW, low), starts, 4), (ends, np.minimum(ends + WINDOW, high), 4)):
            bounds = (bounds << bits) | most(a, b, (1 << bits) - 1)
        beside = [rolling[np.clip(at, 0, len(data) - 1)].astype(np.int64) >> 24 for at in (starts - 1, ends + WINDOW - 1)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found.view(np.int64)),
                batch.column(0).take(pa.array(text)),
                batch.column(1).take(pa.array(text)),
                pa.array(((starts - low) << 16) | (beside[0] << 8) | beside[1]),
                pa.array((ends - starts).astype(np.int32)),
                pa.array(bounds.astype(np.int32)),
            ],
            ["digest", "doc", "row_key", "place", "length", "most"],
        )


def matches(chunks: list[dict], least: int) -> list[tuple]:
    """What must be asked of the owners: start, length, digest, digest_length, owner, place, left, right; for each, bytes beside it are needed.

    Chunks that follow each other here and in their owner are one segment. Segments of one owner and one distance go together if the
    bytes between them may be the same; they are left out if with all that may be matched on they have fewer than ``least`` words.
    """
    least = min(least, 127)  # the bounds end there
    rows = []
    runs: list[list[tuple]] = []
    for c in sorted({(c["place"] >> 16, c["length"], c["most"], c["place"], c["digest"], c["owner"], c["owner_place"]) for c in chunks}):
        if runs and c[0] == runs[-1][-1][0] + runs[-1][-1][1]:
            runs[-1].append(c)
        else:
            runs.append([c])
    for run in runs:
        low, high = run[0][0], run[-1][0] + run[-1][1]
        before = [0]  # bounds of the words in the run's chunks before each
        for c in run:
            before.append(before[-1] + (c[2] >> 15 & 255))
        lanes: dict[tuple[int, int], list[int]] = {}
        for k, c in enumerate(run):
            lanes.setdefault((c[5], (c[6] >> 16) - c[0]), []).append(k)
        for (owner, distance), lane in lanes.items():
            segments: list[list[int]] = []  # first and last chunk
            for k in lane:
                if segments and segments[-1][1] == k - 1:
                    segments[-1][1] = k
                else:
                    segments.append([k, k])
            # Unless the bytes beside a chunk may be the owner's, less than WINDOW of them are.
            left = [(run[a][3] ^ run[a][6]) & 0xFF00 == 0 for a, _ in segments]
            right = [(run[b][3] ^ run[b][6]) & 0xFF == 0 for _, b in segments]
            chains = [[0]]
            for k in range(1, len(segments)):
                if right[k - 1] and left[k]:
                    chains[-1].append(k)
                else:
                    chains.append([k])
            for chain in chains:
                (a, _), (_, b) = segments[chain[0]], segments[chain[-1]]
                bound = before[b + 1] - before[a]
                bound += before[a] + (run[0][2] >> 23 & 127) if left[chain[0]] else run[a][2] >> 4 & 15
                bound += before[-1] - before[b + 1] + (run[-1][2] >> 8 & 127) if right[chain[-1]] else run[b][2] & 15
                if bound < least:
                    continue
                for k in chain:
                    a, b = segments[k]
                    start, end = run[a][0], run[b][0] + run[b][1]
                    reach_left = 0 if k != chain[0] else start - low + REACH if left[k] else WINDOW
                    reach_right = run[segments[k + 1][0]][0] - end if k != chain[-1] else high - end + REACH if right[k] else WINDOW
                    rows.append((start, end - start, run[a][4], run[a][1], owner, start + distance, reach_left, reach_right))
    return rows


_ASKED = "doc long, row_key long, start int, length int, digest long, digest_length int, owner long, place int, reach_left int, reach_right int"


def _runs(least: int):
    """doc, row_key, chunks -> what :func:`matches` asks."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _ASKED.split(", ")]
        kinds = [pa.int64() if part.endswith("long") else pa.int32() for part in _ASKED.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            rows = []
            # One row's chunks at a time: those of a whole batch are hundreds of MB as Python's objects.
            for doc, row_key, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows += [(doc, row_key, *row) for row in matches(chunks.as_py(), least)]
                if len(rows) >= ROWS:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    return runs


_SPANS = "doc long, row_key long, start int, length int, owner long, place int, left binary, right binary"


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's text and the segments asked of it -> the bytes beside each segment there."""
    names = [part.split()[0] for part in _SPANS.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[part.split()[1]] for part in _SPANS.split(", ")]
    for batch in slices(batches, "text", SLICE):
        offsets, data = text_buffer(batch.column(0))
        whole = memoryview(data.tobytes())
        rows = []
        for k, (doc, row_key, start, length, digest, size, owner, place, left, right) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, 11)), strict=True)):
            low, high = int(offsets[k]), int(offsets[k + 1])
            a, b = low + place, low + place + length
            if place < 0 or b > high or xxhash.xxh3_64_intdigest(whole[a : a + size]) != digest % (1 << 64):
                continue  # another row of the owner's id
            rows.append((doc, row_key, start, length, owner, place, bytes(whole[max(low, a - left) : a]), bytes(whole[b : min(high, b + right)])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _common(a: bytes, b: bytes) -> int:
    """How many first bytes are the same."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def _whole_words(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without the parts of characters and of words at its ends; a part of over 2 * LETTERS stays."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    wordy = lambda k: 32 < data[k] < 0x80
    if start and wordy(start - 1):
        at = start
        while at < min(end, start + 2 * LETTERS) and wordy(at):
            at += 1
        start = at if at < start + 2 * LETTERS else start
    if end < len(data) and wordy(end):
        at = end
        while at > max(start, end - 2 * LETTERS) and wordy(at - 1):
            at -= 1
        end = at if at > end - 2 * LETTERS else end
    return start, max(start, end)


def cut_runs(text: str, spans: list[dict], least: int) -> tuple[str, list[dict]]:
    """The text without what it shares with one owner over ``least`` words or more, and those spans in code points, each inside one owner's text.

    ``spans``: start and length of a segment, its owner, its place there, and the owner's bytes to its left and right.
    """
    data = text.encode()
    lanes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for s in spans:
        start, end = s["start"], s["start"] + s["length"]
        begin = start - _common(data[max(0, start - len(s["left"])) : start][::-1], s["left"][::-1])
        lanes.setdefault((s["owner"], s["place"] - start), []).append((begin, end + _common(data[end : end + len(s["right"])], s["right"])))
    found = []
    for lane in lanes.values():
        runs: list[list[int]] = []
        for start, end in sorted(lane):
            if runs and runs[-1][1] >= start:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([start, end])
        for start, end in runs:
            start, end = _whole_words(data, start, end)
            if words(data[start:end].decode()) >= least:
                found.append((start, end))
    kept, gone, at, chars = [], [], 0, 0
    for start, end in sorted(set(found)):
        start = max(start, at)
        if start >= end:
            continue
        before, inside = data[at:start].decode(), data[start:end].decode()
        kept.append(before)
        gone.append({"start": chars + len(before), "length": len(inside)})
        chars += len(before) + len(inside)
        at = end
    kept.append(data[at:].decode())
    return "".join(kept), gone


def _among(docs: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of ``docs`` whose ``_doc`` may be in ``ids`` (one column), or the others: by a table of PLACES bits, so its size has a bound."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES)).cast("int")
    held = np.zeros(PLACES, bool)
    held[ids.select(place(ids.columns[0]).alias("at")).distinct().toArrow()["at"].to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(held))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            wanted = held[batch.column(batch.num_columns - 1).to_numpy()] == inside
            if wanted.any():
                rest = batch.select(list(range(batch.num_columns - 1)))
                yield rest if wanted.all() else rest.filter(pa.array(wanted))

    return docs.withColumn("_at", place("_doc")).mapInArrow(lean(some), docs.schema)


def dedup_substrings(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with ``text`` shortened and ``removed_spans`` (start and length in code points of the input text).

    A chunk stays in the document with the smallest doc_id that holds it, everywhere there; in the others, what such a document holds too
    goes if it is of ``least`` words or more, to whole words. So each removed span stands in one document with a smaller id. Texts are compared
    between documents only: what a document repeats inside itself stays.
    One row per input row; a text that is all repeated becomes empty. Null text: stays null, no spans. Null doc_id: each text is a document of its
    own, larger than all ids under 2^62 and in the order of a hash. Rows with one doc_id are one document. A column ``removed_spans`` of the
    input is replaced. Empty table: no rows.
    """
    docs = docs.drop("removed_spans")
    names = docs.columns
    docs = docs.toDF(*(c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(names)))  # so that no column has a name used here
    row_key = F.xxhash64("text")
    keyed = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), row_key.bitwiseAND(NO_ID - 1) + F.lit(NO_ID))).withColumn("_key", row_key)
    texts = keyed.where("length(text) > 0").select("_doc", "_key", "text")
    # Rows that repeat id and text are cut and asked once.
    repeated = texts.groupBy("_doc", "_key").agg(F.count("*").alias("n")).where("n > 1").select("_doc")
    if not repeated.isEmpty():
        texts = _among(texts, repeated, inside=False).unionAll(_among(texts, repeated).dropDuplicates(["_doc", "_key"]))
    chunks = texts.select(F.col("_doc").alias("doc"), F.col("_key").alias("row_key"), "text").mapInArrow(lean(_chunks), "digest long, doc long, row_key long, place long, length int, most int")
    owned = chunks.groupBy("digest").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.min_by("place", "doc").alias("owner_place"), F.count("*").alias("n"))
    shared = written(owned.where("owner < last").select("digest", "owner", "owner_place", "n"), "shared")
    held = spread(chunks, shared.select("digest", "owner", "owner_place"), "digest", shared.select("digest", "n"), F.col("row_key")).where("doc > owner")
    # The chunks of one row: no more than its own.
    held = held.groupBy("doc", "row_key").agg(F.collect_list(F.struct("place", "length", "most", "digest", "owner", "owner_place")).alias("chunks"))
    asked = written(held.mapInArrow(lean(_runs(least)), _ASKED), "asked")
    owners = _among(texts, asked.select("owner")).select(F.col("_doc").alias("owner"), "text")
    beside = spread(asked, owners, "owner", asked.groupBy("owner").agg(F.count("*").alias("n")), F.col("row_key"))
    beside = beside.select("text", *asked.columns).mapInArrow(lean(_beside), _SPANS)
    spans = beside.groupBy("doc", "row_key").agg(F.collect_list(F.struct("start", "length", "owner", "place", "left", "right")).alias("_spans"))
    marked = _among(keyed, asked.select("doc")).join(spans, (F.col("_doc") == F.col("doc")) & (F.col("_key") == F.col("row_key")), "left").select(*docs.columns, "_spans")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("removed_spans", T.ArrayType(span))])
    text_at, kind = docs.columns.index("text"), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            texts, gone = batch.column(text_at), [[]] * batch.num_rows
            held = batch.column(batch.num_columns - 1)
            some = [k for k, valid in enumerate(held.is_valid().to_pylist()) if valid]
            if some:
                values = texts.to_pylist()
                for k in some:
                    values[k], gone[k] = cut_runs(values[k], held[k].as_py(), least)
                texts = pa.array(values, pa.string())
            columns = [texts if k == text_at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, kind)], [*batch.schema.names[:-1], "removed_spans"])

    whole = _among(keyed, asked.select("doc"), inside=False).select(*docs.columns)
    none = F.array().cast(T.ArrayType(span))
    return marked.mapInArrow(lean(cut), schema).unionByName(whole.withColumn("removed_spans", none)).toDF(*names, "removed_spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without what an earlier document holds, and how much went."""
    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    chars = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), chars.alias("removed_chars"), "removed_spans")

"""Exact dedup: compressed radix tries own the distinct byte strings of a partition, terminals hold the smallest id.

Partitions are dealt by length and content hash, so equal strings meet in one trie. Map tasks insert their own rows into
a small trie first, so a text that fills a third of the table travels once per map task. A trie over its memory bound spills
whole subtrees: their strings go back to Spark as rows, and a further round deals them over more partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, lean, spread, written

#: Bytes of strings that one trie holds before it spills (reduce side) or hands on what it has (map side).
TRIE_BYTES = 96 << 20
COMBINE_BYTES = 32 << 20
_ROWS = 2048
_BATCH_BYTES = 4 << 20


class Node:
    """``edges``: first byte -> (label, child). ``count`` is 0 unless a string ends here."""

    __slots__ = ("count", "edges", "owner")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Node]] | None = None
        self.owner: int | None = None
        self.count = 0


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Byte strings with their smallest id and number of rows; ``size`` is the bytes of all labels plus a share per node."""

    NODE = 200

    def __init__(self) -> None:
        self.root = Node()
        self.size = 0
        self.terminals = 0

    def insert(self, text: bytes, owner: int | None, count: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            if node.edges is None:
                node.edges = {}
            edge = node.edges.get(text[at])
            if edge is None:
                child = Node()
                node.edges[text[at]] = (text[at:], child)
                self.size += len(text) - at + self.NODE
                node = child
                break
            label, child = edge
            if not text.startswith(label, at):
                cut = shared_prefix(label, text[at : at + len(label)])
                middle = Node()
                middle.edges = {label[cut]: (label[cut:], child)}
                node.edges[text[at]] = (label[:cut], middle)
                self.size += self.NODE
                node, at = middle, at + cut
                continue
            node, at = child, at + len(label)
        if owner is not None and (node.owner is None or owner < node.owner):
            node.owner = owner
        self.terminals += not node.count
        node.count += count

    def strings(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        """Every string below a node, without recursion (a trie may be as deep as a text is long). Siblings share their prefix until their turn comes."""
        stack = [(node or self.root, prefix, b"")]
        while stack:
            node, prefix, label = stack.pop()
            if label:
                prefix += label
            if node.count:
                yield prefix, node.owner, node.count
            for label, child in (node.edges or {}).values():
                stack.append((child, prefix, label))

    @classmethod
    def weigh(cls, label: bytes, node: Node) -> tuple[int, int]:
        """Bytes that a subtree adds to ``size``, its own label included, and its terminals."""
        stack, size, terminals = [(label, node)], 0, 0
        while stack:
            label, node = stack.pop()
            size += len(label) + cls.NODE
            terminals += node.count > 0
            stack += (node.edges or {}).values()
        return size, terminals

    def cut_largest(self) -> tuple[bytes, Iterator[tuple[bytes, int | None, int]]]:
        """Remove the largest subtree below the root's first fork; returns its prefix and its strings, one at a time."""
        node, prefix = self.root, b""
        while len(node.edges) == 1 and not node.count:
            label, child = next(iter(node.edges.values()))
            if not child.edges:
                break
            node, prefix = child, prefix + label
        weights = {first: self.weigh(*edge) for first, edge in node.edges.items()}
        first = max(weights, key=weights.get)
        label, child = node.edges.pop(first)
        size, terminals = weights[first]
        self.size -= size
        self.terminals -= terminals
        return prefix + label, self.strings(child, prefix + label)


_PARTIAL = "digest binary, n_bytes long, owner long, n long, body binary"
_OWNED = "digest binary, owner long, n long, n_bytes long, spilled binary"


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], body: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += len(row[body] or b"")
        if len(held) >= _ROWS or weight >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _combine(batches: Iterator[pa.RecordBatch], limit: int = COMBINE_BYTES) -> Iterator[pa.RecordBatch]:
    """Map side: each task's distinct strings, handed on whenever the trie is full."""

    def rows() -> Iterator[tuple]:
        def out() -> Iterator[tuple]:
            return ((hashlib.sha256(s).digest(), len(s), owner, n, s) for s, owner, n in trie.strings())

        trie = PatriciaTrie()
        for batch in batches:
            for ident, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                trie.insert(body.as_buffer().to_pybytes(), ident, 1)
                if trie.size > limit:
                    yield from out()
                    trie = PatriciaTrie()
        yield from out()

    yield from _batches(rows(), ["digest", "n_bytes", "owner", "n", "body"], [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], 4)


def _own(limit: int):
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reduce side: one trie a partition; rows with ``spilled`` hold a string that a later round must own."""

        def rows() -> Iterator[tuple]:
            trie, gone = PatriciaTrie(), ()
            for batch in batches:
                owners, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for k, body in enumerate(batch.column(4)):
                    text = body.as_buffer().to_pybytes()
                    if gone and text.startswith(gone):
                        yield hashlib.sha256(text).digest(), owners[k], counts[k], len(text), text
                        continue
                    trie.insert(text, owners[k], counts[k])
                    while trie.size > limit and trie.terminals > 1:
                        prefix, strings = trie.cut_largest()
                        gone += (prefix,)
                        for s, owner, n in strings:
                            yield hashlib.sha256(s).digest(), owner, n, len(s), s
            for s, owner, n in trie.strings():
                yield hashlib.sha256(s).digest(), owner, n, len(s), None

        yield from _batches(rows(), ["digest", "owner", "n", "n_bytes", "spilled"], [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], 4)

    return own


def normalised(text: Column) -> Column:
    """What equality compares: null is empty, and each run of space and U+0009 to U+000D is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def owners(docs: DataFrame, limit: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: digest (SHA-256, binary), owner (smallest doc_id, null if all are), n (rows)."""
    spark = docs.sparkSession
    partial = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(normalised(F.col("text")), "UTF-8").alias("body")).mapInArrow(lean(_combine), _PARTIAL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done: list[DataFrame] = []
    while True:
        # A string that spilled may have rows on both sides of the spill: all of them are in the next round, none is counted here.
        # The number of partitions changes each round, so strings that met before are dealt apart.
        dealt = partial.repartition(parts, "n_bytes", "digest")
        table = written(dealt.mapInArrow(lean(_own(limit)), _OWNED), "trie-owners")
        done.append(table.where("spilled IS NULL").select("digest", "owner", "n"))
        partial = table.where("spilled IS NOT NULL").select("digest", "n_bytes", "owner", "n", F.col("spilled").alias("body"))
        if partial.isEmpty():
            break
        parts = parts * 2 + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def exact_dedup(docs: DataFrame, limit: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and text_key (a hash of the text as it is); one row per row of ``docs`` (doc_id, text).

    Null text: empty, so it equals texts of nothing (not of white space: that is one space). Null doc_id: never the smallest;
    a group of only such rows has a null keep_id and keeps them. Repeated rows with one doc_id are all marked alike.
    Other columns are ignored. Empty table: no rows.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256).alias("text_sha256"))
    named = owners(docs, limit).select(F.lower(F.hex("digest")).alias("text_sha256"), F.col("owner").alias("keep_id"), F.col("n").alias("group_size"))
    # The owner of a group with a large share of all rows is joined in parts.
    joined = spread(rows, named, "text_sha256", named.select("text_sha256", F.col("group_size").alias("n")), F.xxhash64("doc_id"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "text_key")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("text_key")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""

"""Sharding: groups of equal texts are packed into shards as vectors (bytes, tokens, rows).

A group goes where the dot product of its vector with the shards' residual capacity is highest. The driver places a bounded
number of units: each unit is a hash class of small groups, a large group by itself, or a part of a group that no shard could hold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, utf8_bytes, written

#: Hash classes at least and at most; between them one for each CLASS_BYTES of text. They bound what the driver places.
CLASSES, MOST_CLASSES, CLASS_BYTES = 4096, 1 << 17, 64 << 20
#: A group over this share of a shard is placed by itself; over WHOLE shares it is split into parts of at most PART shares.
ALONE, WHOLE, PART = 1 / 256, 0.9, 1 / 8
#: A unit with more rows than this, and than a shuffle partition's fair share, is ranked in several parts.
RANKED = 1000


@dataclass(frozen=True)
class Placement:
    unit: np.ndarray
    shard: np.ndarray


def pack_vectors(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``vectors`` (non-negative, one column a resource), largest first.

    Resources are scaled so that each shard's fair share is 1. A unit goes to the shard with the highest dot product of its
    vector and the residual capacity, among those where bytes (column 0) still fit; if they fit nowhere, to the one with the most bytes left.
    Then units move from the fullest to the emptiest shard while that lowers the range of bytes. Ties: the lowest shard.
    """
    total = vectors.sum(0)
    scaled = vectors / np.where(total > 0, total / shards, 1.0)
    residual = np.ones((shards, vectors.shape[1]))
    placed = np.zeros(len(vectors), np.int64)
    for k in np.lexsort((np.arange(len(vectors)), -scaled[:, 0])):
        fits = residual[:, 0] >= scaled[k, 0] - 1e-12
        best = int(np.argmax(np.where(fits, residual @ scaled[k], -np.inf))) if fits.any() else int(np.argmax(residual[:, 0]))
        placed[k] = best
        residual[best] -= scaled[k]
    sizes = vectors[:, 0].astype(np.int64)
    load = np.bincount(placed, sizes, shards).astype(np.int64)
    for _ in range(8 * shards):
        high, low = int(load.argmax()), int(load.argmin())
        gap = int(load[high] - load[low])
        there, here = np.flatnonzero(placed == high), np.flatnonzero(placed == low)
        if gap <= 1 or not len(there):
            break
        # The move of one unit, or the swap of two, whose difference is nearest to half the gap.
        order = here[np.argsort(sizes[here], kind="stable")]
        best = (gap, -1, -1)
        for k in there:
            want = sizes[k] - gap / 2
            options = [(abs(2 * int(sizes[k]) - gap), int(k), -1)]
            at = int(np.searchsorted(sizes[order], want))
            options += [(abs(2 * int(sizes[k] - sizes[order[j]]) - gap), int(k), int(order[j])) for j in (at - 1, at) if 0 <= j < len(order)]
            best = min(best, *options)
        if best[0] >= gap:
            break
        for k, to, away in ((best[1], low, high), (best[2], high, low)):
            if k >= 0:
                placed[k] = to
                load[to] += sizes[k]
                load[away] -= sizes[k]
    return placed


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard (0 to shards-1), slot (gapless in its shard), grown_shard.

    size is the UTF-8 bytes of the text (null: none) plus 1. The law is ``bytes``: sizes near equal; tokens (runs of other characters than
    white space) and rows are balanced with them as far as that allows. Equal texts share a shard, unless they make up over 0.9 of one: then
    they are split by a hash of doc_id (so rows that also repeat the doc_id stay together). Null ids: one id. grown_shard is null.
    Other columns are ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (utf8_bytes(text) + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
            F.xxhash64(text).alias("h"),
            F.xxhash64(F.lit(1), text).alias("g"),
        ),
        "shard-rows",
    )
    weights = (F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    total = rows.agg(*weights).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    fair = total["bytes"] / shards
    classes = min(MOST_CLASSES, max(CLASSES, 1 << math.ceil(math.log2(total["bytes"] / CLASS_BYTES + 1))))
    # Large groups: at most shards / ALONE by the sum of their bytes.
    large = rows.groupBy("h", "g").agg(*weights).where(F.col("bytes") > fair * ALONE).orderBy("h", "g").collect()
    parts = [1 if r["bytes"] <= WHOLE * fair else math.ceil(r["bytes"] / (PART * fair)) for r in large]
    first = np.cumsum([classes, *parts])
    named = spark.createDataFrame(
        [(r["h"], r["g"], int(f), n) for r, f, n in zip(large, first, parts, strict=False)], "h long, g long, first long, parts long"
    )
    dealt = rows.join(F.broadcast(named), ["h", "g"], "left").select(
        "doc_id", "size", "text_crc32", "tokens",
        F.when(F.col("first").isNull(), F.pmod("h", F.lit(classes))).otherwise(F.col("first") + F.pmod(F.xxhash64("doc_id", F.lit(5)), F.coalesce("parts", F.lit(1)))).alias("unit"),
    )
    # One row a unit reaches the driver: at most MOST_CLASSES and the parts of large groups.
    units = dealt.groupBy("unit").agg(*weights).orderBy("unit").toArrow()
    placed = pack_vectors(np.column_stack([units[c].to_numpy().astype(float) for c in ("bytes", "tokens", "rows")]), shards)
    order = np.lexsort((units["unit"].to_numpy(), placed))
    counts, at = units["rows"].to_numpy(), np.zeros(len(placed), np.int64)
    for s in range(shards):
        own = order[placed[order] == s]
        at[own] = np.cumsum(counts[own]) - counts[own]
    share = max(RANKED, total["rows"] // int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = [max(1, math.ceil(n / share)) for n in counts.tolist()]
    plan = spark.createDataFrame(list(zip(units["unit"].to_pylist(), placed.tolist(), at.tolist(), salts, strict=True)), "unit long, shard int, at long, salts long")
    # Ranks inside a unit: by salt first, so that a unit with a third of all rows is ranked by many tasks.
    salted = dealt.join(F.broadcast(plan), "unit").withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "doc_id"), "salts"))
    sums = salted.groupBy("unit", "salt").agg(F.count("*").alias("n"))
    before = sums.select("unit", "salt", (F.sum("n").over(Window.partitionBy("unit").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("unit", "salt").orderBy("doc_id", "size", "text_crc32")) - 1)
    return ranked.join(before, ["unit", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("before") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))

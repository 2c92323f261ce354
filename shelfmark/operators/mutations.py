"""Changes of the catalogue as resulting tables: plain files have no in-place update, so a change is written beside and swapped in."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN

#: Ranges of a rank at most (one row each is broadcast), and values that their bounds are chosen from.
RANGES, SAMPLED = 256, 4096


def get_or_create(dimension: DataFrame, names: DataFrame) -> DataFrame:
    """``dimension`` (id, name) with a new id for each name of ``names`` (name) that it lacks; null names are no names.

    New ids follow the greatest id in order of name. Names are distinct dimension values; ranks come from one range sort, counted by part.
    """
    new = names.where("name IS NOT NULL").select("name").distinct().join(dimension, "name", "left_anti")
    top = dimension.agg(F.coalesce(F.max("id"), F.lit(-1)).cast("long").alias("top"))
    return dimension.select(F.col("id").cast("long").alias("id"), "name").unionByName(ranked(new, "name", "n").join(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("id"), "name"))


def ranked(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with its rank (from 1) by distinct strings of ``order``, nulls first, without one task sorting all.

    Values are dealt into ranges of about equal size, ranked inside them, and ranges are counted before. The bounds are quantiles of the
    SAMPLED values with the least hashes, so they are the same in every run.
    """
    parts = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = sorted(r[0] for r in df.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(SAMPLED).collect())
    bounds = sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    dealt = df.withColumn("_range", place)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before")


def overwritten(old: Column, new: Column, sentinel: bool) -> Column:
    """``new`` where it is neither null nor empty (nor "unknown", with ``sentinel``), else ``old``."""
    usable = new.isNotNull() & (new != "")
    return F.when(usable & (new != UNKNOWN) if sentinel else usable, new).otherwise(old)


def conditional_update(books: DataFrame, updates: DataFrame) -> DataFrame:
    """``books`` (id, year, some of title, isbn, udk, bbk, annotation, and others) with the usable fields of ``updates`` (same columns) by id."""
    fields = [c for c in updates.columns if c in ("title", "isbn", "udk", "bbk", "annotation")]
    new = updates.select("id", *(F.col(c).alias(f"new_{c}") for c in ("year", *fields)))
    pick = {c: overwritten(F.col(c), F.col(f"new_{c}"), c not in ("title", "isbn")) for c in fields}
    pick["year"] = F.coalesce("new_year", "year")
    return books.join(new, "id", "left").select(*(pick[c].alias(c) if c in pick else F.col(c) for c in books.columns))


def set_where(df: DataFrame, condition: Column, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def replaced_rows(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Whole-row update: rows of ``df`` with a key in ``rows`` are replaced."""
    return df.join(rows, key, "left_anti").unionByName(rows)


def deleted(df: DataFrame, keys: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """``df`` without the rows whose ``key`` is in ``keys`` (column ``by``): the deletion itself and its cascade to children."""
    gone = keys.select(F.col(by or key).alias("_gone")).distinct()
    return df.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def replaced_links(links: DataFrame, new: DataFrame, key: str, always: bool = False, touched: DataFrame | None = None) -> DataFrame:
    """Links of the keys in ``new`` replaced by those of ``new``; with ``always``, keys in ``touched`` lose theirs even without new ones."""
    cleared = touched if always and touched is not None else new
    return deleted(links, cleared, key).unionByName(new).distinct()


def inserted(books: DataFrame, images: DataFrame, requests: DataFrame, new_images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books (id, ref) and images (id, book_id, ref, type) with those of ``requests`` (ref) and ``new_images`` (ref, at, type) under new ids.

    New ids follow the greatest: books in the order of ref, images in that of their book and place. A ref comes once.
    """

    def top(df: DataFrame) -> DataFrame:
        return df.agg(F.coalesce(F.max("id"), F.lit(-1)).cast("long").alias("_top"))

    new = ranked(requests.select("ref"), "ref", "_n").join(F.broadcast(top(books))).select((F.col("_top") + F.col("_n")).alias("id"), "ref")
    owned = new_images.join(new.select(F.col("id").alias("book_id"), "ref"), "ref")
    keyed = owned.withColumn("_key", F.concat(F.lpad(F.col("book_id").cast("string"), 20, "0"), F.lpad(F.col("at").cast("string"), 20, "0")))
    kept = ranked(keyed, "_key", "_n").join(F.broadcast(top(images))).select((F.col("_top") + F.col("_n")).alias("id"), "book_id", "ref", "type")
    return books.select("id", "ref").unionByName(new), images.select("id", "book_id", "ref", "type").unionByName(kept)


def upserted(changes: DataFrame, key: str, entry: str, value: str, order: Column) -> DataFrame:
    """key and ``entries``: a map in which the last write of each entry wins."""
    last = changes.groupBy(key, entry).agg(F.max_by(value, order).alias(value))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(entry, value)))).alias("entries"))


def swap_in(df: DataFrame, path: str) -> str:
    """Write ``df`` beside ``path`` and move it there; returns the folder with what was there before (or None's name if nothing was)."""
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target):
        system.rename(target, jvm.org.apache.hadoop.fs.Path(old))
    system.rename(jvm.org.apache.hadoop.fs.Path(fresh), target)
    return old

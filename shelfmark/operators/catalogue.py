"""Reads of the catalogue: paging, lookups, filters, nested joins, ordinals and top-1 choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..sources.tables import MOST_BYTES

UNSHELVED = -1


# --- scans, sorts, paging -----------------------------------------------------------------------------------------------


def one(df: DataFrame, key: str, value) -> DataFrame:
    """The row with that key, or none."""
    return df.where(F.col(key) == F.lit(value))


def required(df: DataFrame, key: str, value) -> DataFrame:
    """The row with that key; the job fails if there is none. The check is part of the plan, so nothing runs before."""
    found = one(df, key, value)
    flagged = found.agg(F.count("*").alias("_n")).select(F.assert_true(F.col("_n") > 0, F.lit(f"no row has {key} = {value}")).alias("_checked"))
    return found.join(F.broadcast(flagged), F.col("_checked").isNull()).drop("_checked")


def sorted_by(column: str = "created_at", direction: str = "desc", tie: str = "id") -> list[Column]:
    """Ascending puts nulls last, any other direction is descending with nulls first; ``tie`` makes the order total."""
    by = F.col(column).asc_nulls_last() if direction.lower() == "asc" else F.col(column).desc_nulls_first()
    return [by, F.col(tie).asc()]


def page_of(df: DataFrame, page: int = 0, size: int = 20, column: str = "created_at", direction: str = "desc", tie: str = "id") -> DataFrame:
    """One page of ``df``, with the place of each row in the whole order: a top-k, so no full sort is exchanged."""
    order = sorted_by(column, direction, tie)
    rows = df.orderBy(*order).offset(page * size).limit(size)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) + page * size)


def page_counts(df: DataFrame, size: int = 20) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.ceil(F.col("n_rows") / size).alias("n_pages"))


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` sorted; the order itself is a range sort, so it scales with the rows."""
    return df.orderBy(*order)


# --- filters ------------------------------------------------------------------------------------------------------------


def on_shelf(books: DataFrame, shelf: int | None) -> DataFrame:
    """None: all books. -1: books without a shelf. Otherwise the books of that shelf."""
    if shelf is None:
        return books
    return books.where(F.col("shelf_id").isNull() if shelf == UNSHELVED else F.col("shelf_id") == shelf)


def valid_keys(df: DataFrame, column: str) -> DataFrame:
    """Rows whose key reads as a UUID; malformed ones are skipped."""
    return df.where(F.col(column).rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"))


def displayable(data: Column, most: int = MOST_BYTES) -> Column:
    """Not null, not empty and not over the size limit."""
    return data.isNotNull() & F.octet_length(data).between(1, most)


def has_type(pages: DataFrame, books: DataFrame, kind: str) -> DataFrame:
    return books.join(pages.where(F.col("type") == kind).select(F.col("book_id").alias("id")), "id", "left_semi")


def missing_parts(books: DataFrame, pages: DataFrame) -> DataFrame:
    """id and the list of required parts that a book lacks, as text; complete books have an empty one."""
    found = pages.groupBy(F.col("book_id").alias("id")).agg(F.bool_or(F.col("type") == "COVER").alias("cover"), F.bool_or(F.col("type") == "INFO_PAGE").alias("info"))
    absent = F.array_compact(F.array(F.when(~F.coalesce("cover", F.lit(False)), "cover"), F.when(~F.coalesce("info", F.lit(False)), "info page")))
    return books.select("id").join(found, "id", "left").select("id", F.array_join(absent, ", ").alias("missing"))


def sentinel_to_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: blank_to_null(F.col(c)) for c in columns})


# --- joins --------------------------------------------------------------------------------------------------------------


def author_names(book_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """book_id, authors (names joined by ", " in order of name) and n_authors."""
    named = book_authors.join(authors.withColumnRenamed("id", "author_id"), "author_id")
    names = named.groupBy("book_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return names.select("book_id", F.array_join("names", ", ").alias("authors"), F.size("names").alias("n_authors"))


def with_authors(books: DataFrame, book_authors: DataFrame, authors: DataFrame) -> DataFrame:
    names = author_names(book_authors, authors).withColumnRenamed("book_id", "id")
    return books.join(names, "id", "left").withColumns({"authors": F.coalesce("authors", F.lit("")), "n_authors": F.coalesce("n_authors", F.lit(0)).cast("long")})


def with_pages(books: DataFrame, pages: DataFrame, *columns: str) -> DataFrame:
    """Books with the ordered array ``pages`` of their pages' ``columns``; a book without pages has an empty one."""
    item = F.struct(*columns)
    nested = pages.groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("pages"))
    return books.join(nested, "id", "left").withColumn("pages", F.coalesce("pages", F.expr("array()").cast(nested.schema["pages"].dataType)))


def counted(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents (id first) with the number of their children, 0 included; children are counted before they are joined."""
    n = children.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    return parents.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def orphans(books: DataFrame, shelves: DataFrame) -> DataFrame:
    """Books whose shelf does not exist (any more)."""
    return books.where("shelf_id IS NOT NULL").join(shelves.select(F.col("id").alias("shelf_id")), "shelf_id", "left_anti")


# --- ordinals -----------------------------------------------------------------------------------------------------------

#: Pages have no row id; this order is total up to rows that are equal in every column.
PAGE_ORDER = ("sort_order", "partkey", "suppkey", "extent")


def ordinal_labels(pages: DataFrame) -> DataFrame:
    """"Cover", "Back Cover", "Info Page", "Info Page 2", ...: numbered from the second of a type on."""
    n = F.row_number().over(Window.partitionBy("book_id", "type").orderBy(*PAGE_ORDER))
    label = F.when(F.col("type") == "COVER", "Cover").when(F.col("type") == "BACK", "Back Cover").otherwise(F.concat(F.lit("Info Page"), F.when(n > 1, F.concat(F.lit(" "), n)).otherwise("")))
    return pages.withColumn("label", label)


def info_labels(pages: DataFrame) -> DataFrame:
    """"INFO PAGE", or "INFO PAGE 1", "INFO PAGE 2", ... where a book has several; other types as they are."""
    per = Window.partitionBy("book_id", "type")
    n, total = F.row_number().over(per.orderBy(*PAGE_ORDER)), F.count("*").over(per)
    label = F.when(F.col("type") != "INFO_PAGE", F.replace("type", F.lit("_"), F.lit(" "))).when(total > 1, F.concat(F.lit("INFO PAGE "), n)).otherwise("INFO PAGE")
    return pages.withColumn("label", label)


def next_order(books: DataFrame, pages: DataFrame) -> DataFrame:
    """id and the sort order that a book's next page gets: from 0."""
    top = pages.groupBy(F.col("book_id").alias("id")).agg(F.max("sort_order").alias("top"))
    return books.select("id").join(top, "id", "left").select("id", (F.coalesce("top", F.lit(-1)) + 1).cast("long").alias("next_order"))


def neighbours(pages: DataFrame) -> DataFrame:
    """Place of each page and of those before and after it, in a circle."""
    per = Window.partitionBy("book_id")
    place, n = F.row_number().over(per.orderBy(*PAGE_ORDER)) - 1, F.count("*").over(per)
    placed = pages.select("book_id", *PAGE_ORDER, place.cast("long").alias("place"), n.alias("n"))
    return placed.select("book_id", "place", F.pmod(F.col("place") - 1, "n").alias("previous"), F.pmod(F.col("place") + 1, "n").alias("following"))


def first_of_type(pages: DataFrame, kind: str) -> DataFrame:
    key = F.struct(*PAGE_ORDER)
    return pages.where(F.col("type") == kind).groupBy("book_id").agg(F.min_by("image_path", key).alias("image_path"))


def images_by_type(pages: DataFrame) -> DataFrame:
    """book_id, the last cover and back, and all info pages in order."""
    key = F.struct(*PAGE_ORDER)
    last = lambda kind: F.max_by("image_path", F.when(F.col("type") == kind, key))
    info = F.array_sort(F.collect_list(F.when(F.col("type") == "INFO_PAGE", F.struct(*PAGE_ORDER, "image_path"))))
    has = lambda kind: F.bool_or(F.col("type") == kind)
    return pages.groupBy("book_id").agg(F.when(has("COVER"), last("COVER")).alias("cover"), F.when(has("BACK"), last("BACK")).alias("back"), info.alias("info")).select(
        "book_id", "cover", "back", F.array_join(F.transform("info", lambda p: p["image_path"]), ",").alias("info")
    )


def longest_text(df: DataFrame, key: str, text: str, place: str) -> DataFrame:
    """The longest text of each key, the first of equally long ones."""
    return df.groupBy(key).agg(F.max_by(text, F.struct(F.length(text), -F.col(place))).alias(text))


def good_enough(df: DataFrame, key: str, text: str, place: str, enough: int = 40) -> DataFrame:
    """The first text of at least ``enough`` characters, else the longest (first of equals): a search that stops early, as one aggregate."""
    size = F.length(text)
    rank = F.struct(F.least(size, F.lit(enough)), -F.col(place))
    better = F.struct(size, -F.col(place))
    return df.groupBy(key).agg(F.max(size).alias("_most"), F.max_by(text, rank).alias("_first"), F.max_by(text, better).alias("_longest")).select(
        key, F.when(F.col("_most") >= enough, F.col("_first")).otherwise(F.col("_longest")).alias(text)
    )


def phased_pick(df: DataFrame, key: str, phase: str, place: str, text: str, enough: int = 40, poor: int = 20) -> DataFrame:
    """The text that a search through phases ends with, as one fold over a key's few candidates in order.

    A phase is entered only while the best text so far is shorter than ``poor``; the first text of at least ``enough`` ends the search;
    otherwise the longest wins, the first of equals.
    """
    listed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.col(phase).alias("phase"), F.col(text).alias("text")))).alias("tried"))
    start = F.struct(F.lit("").alias("best"), F.lit(None).cast(df.schema[phase].dataType).alias("phase"), F.lit(False).alias("over"))

    def step(state: Column, x: Column) -> Column:
        entered = ~state["over"] & (state["phase"].isNull() | (state["phase"] == x["phase"]) | (F.length(state["best"]) < poor))
        best = F.when(entered & (F.length(x["text"]) > F.length(state["best"])), x["text"]).otherwise(state["best"])
        return F.struct(best.alias("best"), x["phase"].alias("phase"), (~entered | (F.length(best) >= enough)).alias("over"))

    return listed.select(key, F.aggregate("tried", start, step, lambda state: state["best"]).alias(text))


# --- lists, sets, geometry ----------------------------------------------------------------------------------------------


def selector(shelves: DataFrame) -> DataFrame:
    """The shelf list of a selector: "All Books", "No Shelf", then the shelves by name; ``place`` is the position."""
    spark = shelves.sparkSession
    fixed = spark.createDataFrame([(0, None, "All Books"), (1, UNSHELVED, "No Shelf")], "head int, id long, name string")
    return fixed.unionByName(shelves.select(F.lit(2).alias("head"), F.col("id").cast("long").alias("id"), "name")).orderBy("head", "name", "id").drop("head")


def scaled(width: Column, height: Column, most: int, enlarge: bool = False) -> tuple[Column, Column]:
    """Size of an image whose longer edge is ``most``, truncated; smaller images stay unless ``enlarge``."""
    longer = F.greatest(width, height)
    fit = lambda edge: (edge * most / longer).cast("int")
    keep = (longer <= most) & (not enlarge)
    return F.when(keep, width).otherwise(fit(width)), F.when(keep, height).otherwise(fit(height))


def ordered_corners(points: Column) -> Column:
    """Corners of a page from an array of (x, y): top left, top right, bottom right, bottom left, by least and greatest x + y and y - x."""

    def extreme(value, last: bool) -> Column:
        keyed = F.array_sort(F.transform(points, lambda p: F.struct(value(p).alias("v"), p.alias("p"))))
        return F.get(keyed, F.size(points) - 1 if last else F.lit(0))["p"]

    add, take = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(extreme(add, False), extreme(take, False), extreme(add, True), extreme(take, True))


def warp_size(corners: Column) -> tuple[Column, Column]:
    """Width and height of the upright page of four ordered corners: the longer of opposite edges, truncated."""
    edge = lambda a, b: F.hypot(F.get(corners, a)["x"] - F.get(corners, b)["x"], F.get(corners, a)["y"] - F.get(corners, b)["y"])
    return F.greatest(edge(2, 3), edge(1, 0)).cast("int"), F.greatest(edge(1, 2), edge(0, 3)).cast("int")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and change ("insert", "delete", "update") between two snapshots; unchanged rows are left out."""
    columns = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*columns).alias("was"))
    b = new.select(key, F.struct(*columns).alias("now"))
    change = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("now")), "update")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")

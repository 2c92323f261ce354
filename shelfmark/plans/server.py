"""The server's dataflows as resulting tables: images to a record, enrichment of stored books, bulk reprocessing, manual edits.

Readings of images and replies of models enter as columns; what follows them is declared here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import catalogue as c
from ..operators import mutations as m
from . import records as r

Tables = dict[str, DataFrame]


def readings(images: DataFrame, key: str = "book_id") -> DataFrame:
    """key, cover, main, eng and raw of each key's images (key, type, at, text, eng): the texts that records are read from.

    Of several covers or backs the last counts. ``main`` and ``eng`` hold each image's text (in the book's language, in English) under its header.
    Null texts count as empty. Keys without any text in ``cover`` and ``main`` have no request to answer and are left out.
    """
    shown = F.struct("at", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("eng", F.lit("")).alias("eng"))
    of = {kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, shown))) for kind in ("COVER", "INFO_PAGE", "BACK")}
    listed = images.groupBy(key).agg(*(v.alias(k.lower()) for k, v in of.items()))
    cover, back = F.try_element_at("cover", F.lit(-1)), F.try_element_at("back", F.lit(-1))

    def under(head: Column, body: Column) -> Column:
        return F.coalesce(F.concat(head, F.lit("\n"), body, F.lit("\n")), F.lit(""))

    def pages(field: str) -> Column:
        return F.array_join(F.transform("info_page", lambda p, i: under(F.concat(F.lit("=== INFO PAGE "), i + 1, F.lit(" ===")), p[field])), "")

    main = F.concat(pages("text"), under(F.lit("=== BACK COVER ==="), back["text"]))
    eng = F.concat(under(F.lit("=== COVER ==="), cover["eng"]), pages("eng"), under(F.lit("=== BACK COVER ==="), back["eng"]))
    found = listed.select(key, F.coalesce(cover["text"], F.lit("")).alias("cover"), main.alias("main"), eng.alias("eng"))
    found = found.withColumn("raw", F.concat(F.lit("=== COVER ===\n"), "cover", F.lit("\n\n"), "main"))
    return found.where((t.strip(F.col("cover")) != "") | (t.strip(F.col("main")) != ""))


def extracted(read: DataFrame, key: str = "book_id") -> DataFrame:
    """One record per row of ``read`` (key, cover, main, eng, cover_reply, info_reply): title, author, publisher, year, isbn, udk, bbk, annotation, authors.

    The info pages' record comes first; its unknown title and author are the cover's. Without info pages all else is unknown.
    """
    has_cover, has_info = (t.strip(F.col(x)) != "" for x in ("cover", "main"))
    text = F.concat("main", F.when(F.col("eng") != "", F.concat(F.lit("\n"), "eng")).otherwise(""))
    asked = read.select(key, text.alias("text"), F.col("info_reply").alias("reply"), "main").where(has_info)
    info = r.records(asked, key)
    cover = r.cover_records(read.where(has_cover).withColumnRenamed("cover_reply", "reply"), key)
    merged = r.merged(info, cover, key)
    notes = info.select(key, "annotation")
    return merged.join(notes, key, "left").withColumn("annotation", t.or_unknown(F.col("annotation")))


def enriched(books: DataFrame, parsed: DataFrame, publishers: DataFrame, authors: DataFrame, links: DataFrame) -> Tables:
    """The tables after enrichment: ``books`` (id, title, isbn, year, udk, bbk, annotation, publisher_id), publishers, authors, links (book_id, author_id).

    Usable fields of ``parsed`` (book_id and a record) replace a book's own; its publisher and authors are found by name or made; known authors
    replace all links of the book. Records of books that are not stored change nothing.
    """
    parsed = parsed.join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi")
    fields = m.conditional_update(books, parsed.withColumnRenamed("book_id", "id"))
    publishers = m.get_or_create(publishers, parsed.select(F.col("publisher").alias("name")))
    named = parsed.where("publisher IS NOT NULL").select(F.col("book_id").alias("id"), F.col("publisher").alias("name"))
    own = named.join(publishers.select(F.col("id").alias("_publisher"), "name"), "name").select("id", "_publisher")
    fields = fields.join(own, "id", "left").withColumn("publisher_id", F.coalesce("_publisher", F.col("publisher_id").cast("long"))).drop("_publisher")
    known = parsed.select("book_id", F.explode("authors").alias("name"))
    authors = m.get_or_create(authors, known.select("name"))
    new = known.join(authors.select(F.col("id").alias("author_id"), "name"), "name").select("book_id", "author_id")
    return {"books": fields, "publishers": publishers, "authors": authors, "book_authors": m.replaced_links(links, new, "book_id")}


def reprocessed(keys: DataFrame, books: DataFrame, read: DataFrame, key: str = "ref") -> DataFrame:
    """Records of the stored books (id, ref) whose ref is in ``keys``; refs that are not well formed are skipped."""
    wanted = books.join(c.valid_keys(keys, key).select(key).distinct(), key, "left_semi").select(F.col("id").alias("book_id"))
    return extracted(read.join(wanted, "book_id", "left_semi"))


def edited(books: DataFrame, edits: DataFrame, publishers: DataFrame, authors: DataFrame, links: DataFrame) -> Tables:
    """The tables after manual edits (id, title, author, publisher, year, isbn, udk, bbk; one an id), applied in the order of id.

    The form's title and year replace the book's; "unknown" and blank codes are null. A publisher's name is changed in its row, so for all of its books
    (of several edits the last stays); a book without a publisher gets a new row, without lookup. A book's authors are new rows too, one a name.
    """
    form = edits.select("id", *(F.col(x).alias(f"_{x}") for x in ("title", "author", "publisher", "year", "isbn", "udk", "bbk")))
    both = books.join(form.withColumn("_edited", F.lit(True)), "id", "left")
    is_edited, names = F.col("_edited").isNotNull(), t.blank_to_null(F.col("_publisher"))
    values = {"title": F.col("_title"), "year": F.col("_year"), **{x: t.blank_to_null(F.col(f"_{x}")) for x in ("isbn", "udk", "bbk")}}
    touched = both.where(is_edited & names.isNotNull())
    renamed = touched.where("publisher_id IS NOT NULL").groupBy(F.col("publisher_id").alias("id")).agg(F.max_by(names, "id").alias("_name"))

    def numbered(rows: DataFrame, table: DataFrame) -> DataFrame:
        """``rows`` (book, at, name) with new ids after the greatest of ``table``."""
        keyed = rows.withColumn("_key", F.concat(F.lpad(F.col("book").cast("string"), 20, "0"), F.lpad(F.col("at").cast("string"), 10, "0")))
        top = table.agg(F.coalesce(F.max("id"), F.lit(-1)).cast("long").alias("_top"))
        return m.ranked(keyed, "_key", "_n").join(F.broadcast(top)).select((F.col("_top") + F.col("_n")).alias("id"), "name", "book")

    made = numbered(touched.where("publisher_id IS NULL").select(F.col("id").alias("book"), F.lit(0).alias("at"), names.alias("name")), publishers)
    kept = publishers.join(renamed, "id", "left").select(F.col("id").cast("long").alias("id"), F.coalesce("_name", "name").alias("name"))
    own = both.join(made.select(F.col("book").alias("id"), F.col("id").alias("_made")), "id", "left")
    publisher = F.when(is_edited & names.isNull(), None).otherwise(F.coalesce("_made", "publisher_id"))
    new_books = own.select("id", *(F.when(is_edited, v).otherwise(F.col(x)).alias(x) for x, v in values.items()), publisher.cast("long").alias("publisher_id"))
    listed = form.where(t.blank_to_null(F.col("_author")).isNotNull()).join(books.select("id"), "id", "left_semi")
    people = numbered(listed.select(F.col("id").alias("book"), F.posexplode(t.split_names(F.col("_author"))).alias("at", "name")), authors)
    left = m.deleted(links, form.join(books.select("id"), "id", "left_semi"), "book_id", "id")
    return {
        "books": new_books,
        "publishers": kept.unionByName(made.select("id", "name")),
        "authors": authors.select(F.col("id").cast("long").alias("id"), "name").unionByName(people.select("id", "name")),
        "book_authors": left.unionByName(people.select(F.col("book").alias("book_id"), F.col("id").alias("author_id"))),
    }


def shelf_changes(shelves: DataFrame, made: DataFrame, renamed: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """``shelves`` (id, name) with new ones (at, name; a missing name is made from ``now`` in milliseconds), others renamed (id, name) or deleted (id)."""
    top = shelves.agg(F.coalesce(F.max("id"), F.lit(-1)).cast("long").alias("_top"))
    keyed = made.select(F.lpad(F.col("at").cast("string"), 20, "0").alias("_key"), F.coalesce("name", F.concat(F.lit("Shelf "), now.cast("string"))).alias("name"))
    new = m.ranked(keyed, "_key", "_n").join(F.broadcast(top)).select((F.col("_top") + F.col("_n")).alias("id"), "name")
    other = shelves.join(renamed.select("id", F.col("name").alias("_name")), "id", "left").select(F.col("id").cast("long").alias("id"), F.coalesce("_name", "name").alias("name"))
    return m.deleted(other, gone, "id").unionByName(new)

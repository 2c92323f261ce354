"""Registered queries of the catalogue operators and their DuckDB twins, on the stand-in tables of :mod:`shelfmark.sources.tables`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as t
from .operators import catalogue as c
from .operators import mutations as m
from .sources import tables as s
from .streaming import status as st

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None, *using: str) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its twin after the CTEs of the stand-ins in ``using``."""

    def register(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            head = ", ".join(s.SQL[u] for u in using)
            body = sql.strip()
            _sql[name] = body if not head else f"WITH {head}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- reads --------------------------------------------------------------------------------------------------------------


@query("scan_all", "SELECT * FROM books", "books")
def _(spark, d):
    return s.books(spark, d)


@query("point_lookup", "SELECT * FROM books WHERE id = 7", "books")
def _(spark, d):
    return c.one(s.books(spark, d), "id", 7)


@query("required_lookup", "SELECT id, name FROM publishers WHERE id = 3", "publishers")
def _(spark, d):
    return c.required(s.publishers(spark, d), "id", 3)


@query("lookup_by_name", "SELECT * FROM publishers WHERE name = 'FRANCE'", "publishers")
def _(spark, d):
    return c.one(s.publishers(spark, d), "name", "FRANCE")


@query("recent_books", "SELECT id, created_at FROM books ORDER BY created_at DESC, id", "books")
def _(spark, d):
    return c.in_order(s.books(spark, d).select("id", "created_at"), F.desc("created_at"), F.asc("id"))


@query("pages_for_book", "SELECT sort_order, type, image_path FROM pages WHERE book_id = 1 ORDER BY sort_order", "pages")
def _(spark, d):
    return c.in_order(c.one(s.pages(spark, d), "book_id", 1).select("sort_order", "type", "image_path"), F.asc("sort_order"))


@query("shelves_by_name", "SELECT id, name FROM shelves ORDER BY name", "shelves")
def _(spark, d):
    return c.in_order(s.shelves(spark, d).select("id", "name"), F.asc("name"))


@query(
    "paged_list",
    """WITH names AS (SELECT ba.book_id, string_agg(DISTINCT a.name, ', ' ORDER BY a.name) AS authors, count(DISTINCT a.name) AS n_authors FROM book_authors ba JOIN authors a ON a.id = ba.author_id GROUP BY 1),
    n AS (SELECT book_id, count(*) AS n_pages FROM pages GROUP BY 1),
    p AS (SELECT id, title, status, shelf_id, created_at, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) AS position FROM books)
    SELECT p.*, coalesce(authors, '') AS authors, coalesce(n_authors, 0) AS n_authors, coalesce(n_pages, 0) AS n_pages FROM p LEFT JOIN names ON names.book_id = p.id LEFT JOIN n ON n.book_id = p.id WHERE position <= 20""",
    "books", "book_authors", "authors", "pages",
)
def _(spark, d):
    page = c.page_of(s.books(spark, d).select("id", "title", "status", "shelf_id", "created_at"))
    # Only the pages and links of the twenty books take part: the semi-join keys are one page, by definition small.
    ids = F.broadcast(page.select(F.col("id").alias("book_id")))
    links = s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_suppkey").alias("author_id")).join(ids, "book_id", "left_semi").distinct()
    own = s.pages(spark, d).join(ids, "book_id", "left_semi")
    return c.counted(c.with_authors(page, links, s.authors(spark, d)), own, "book_id", "n_pages")


@query("page_counts", "SELECT count(*) AS n_rows, CAST(ceil(count(*) / 20.0) AS BIGINT) AS n_pages FROM books", "books")
def _(spark, d):
    return c.page_counts(s.books(spark, d))


@query("second_page_ascending", "SELECT id, shelf_id, row_number() OVER (ORDER BY shelf_id ASC NULLS LAST, id) AS position FROM books QUALIFY position BETWEEN 21 AND 40", "books")
def _(spark, d):
    return c.page_of(s.books(spark, d).select("id", "shelf_id"), 1, 20, "shelf_id", "asc")


@query("descending_nulls_first", "SELECT id, shelf_id, row_number() OVER (ORDER BY shelf_id DESC NULLS FIRST, id) AS position FROM books QUALIFY position <= 20", "books")
def _(spark, d):
    return c.page_of(s.books(spark, d).select("id", "shelf_id"), 0, 20, "shelf_id", "any other word")


@query("binary_read", "SELECT page_id, octet_length(encode(html)) AS n_bytes, octet_length(encode(html)) BETWEEN 1 AND 10485760 AS displayable FROM pages")
def _(spark, d):
    data = F.encode("html", "UTF-8")
    return s.table(spark, d, "pages").select("page_id", F.octet_length(data).cast("long").alias("n_bytes"), c.displayable(data).alias("displayable"))


# --- projections --------------------------------------------------------------------------------------------------------


@query("rename_fields", "SELECT id AS bookId, year(created_at) AS publicationYear, title AS bookTitle FROM books", "books")
def _(spark, d):
    return s.books(spark, d).select(F.col("id").alias("bookId"), F.year("created_at").cast("long").alias("publicationYear"), F.col("title").alias("bookTitle"))


@query("drop_column", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(spark, d):
    return s.table(spark, d, "documents").drop("text")


@query("encode_columns", "SELECT doc_id, CASE WHEN text IS NOT NULL AND text <> '' THEN base64(encode(text)) END AS encoded FROM documents")
def _(spark, d):
    data = F.encode("text", "UTF-8")
    # Without the line breaks of MIME, which the JVM's encoder adds after every 76 characters.
    encoded = F.regexp_replace(F.base64(data), "\r\n", "")
    return s.table(spark, d, "documents").select("doc_id", F.when(F.col("text") != "", encoded).alias("encoded"))


@query("default_language", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'rus' ELSE role END AS language FROM conversations")
def _(spark, d):
    language = F.nullif(F.col("role"), F.lit("system"))
    return s.table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(language, F.lit("rus")).alias("language"))


@query("names_of_structs", "SELECT o.id, string_agg(p.type, ',' ORDER BY p.sort_order, p.type, p.image_path) AS types FROM books o JOIN pages p ON p.book_id = o.id GROUP BY 1", "books", "pages")
def _(spark, d):
    nested = c.with_pages(s.books(spark, d).select("id"), s.pages(spark, d), "sort_order", "type", "image_path")
    return nested.where(F.size("pages") > 0).select("id", F.array_join(F.transform("pages", lambda p: p["type"]), ",").alias("types"))


@query("new_book_rows", "SELECT id, 'PENDING' AS status, CASE WHEN coalesce(shelf_id, -1) > -1 THEN shelf_id END AS shelf_id FROM books", "books")
def _(spark, d):
    chosen = F.coalesce("shelf_id", F.lit(c.UNSHELVED))
    return s.books(spark, d).select("id", F.lit(st.PENDING).alias("status"), F.when(chosen > -1, chosen).alias("shelf_id"))


@query("display_defaults", "SELECT id, coalesce(CAST(shelf_id AS VARCHAR), 'Not available') AS shelf, strftime(created_at, '%b %d, %Y %H:%M') AS created FROM books", "books")
def _(spark, d):
    return s.books(spark, d).select("id", F.coalesce(F.col("shelf_id").cast("string"), F.lit("Not available")).alias("shelf"), F.date_format("created_at", "MMM dd, yyyy HH:mm").alias("created"))


@query("status_labels", "SELECT id, CASE status WHEN 'PENDING' THEN 'Pending' WHEN 'SENT' THEN 'Sent' ELSE 'Processed' END AS label, lower(replace(type, '_', ' ')) AS kind FROM books JOIN (SELECT book_id, min(type) AS type FROM pages GROUP BY 1) ON book_id = id", "books", "pages")
def _(spark, d):
    kind = s.pages(spark, d).groupBy(F.col("book_id").alias("id")).agg(F.min("type").alias("type"))
    label = F.when(F.col("status") == st.PENDING, "Pending").when(F.col("status") == st.SENT, "Sent").otherwise("Processed")
    return s.books(spark, d).join(kind, "id").select("id", label.alias("label"), F.lower(F.replace("type", F.lit("_"), F.lit(" "))).alias("kind"))


@query("generated_names", "SELECT id, 'book_' || id || '_page_' || (id % 5) || '.jpg' AS file, 'Shelf ' || strftime(created_at, '%Y%m%d') AS shelf FROM books", "books")
def _(spark, d):
    name = F.concat(F.lit("book_"), "id", F.lit("_page_"), F.col("id") % 5, F.lit(".jpg"))
    return s.books(spark, d).select("id", name.alias("file"), F.concat(F.lit("Shelf "), F.date_format("created_at", "yyyyMMdd")).alias("shelf"))


@query("books_as_json", "SELECT id, '{\"id\":' || id || ',\"title\":\"' || title || '\",\"status\":\"' || status || '\"}' AS body FROM books", "books")
def _(spark, d):
    return s.books(spark, d).select("id", F.to_json(F.struct("id", "title", "status")).alias("body"))


# --- filters ------------------------------------------------------------------------------------------------------------


@query("shelf_filter_all", "SELECT id, shelf_id FROM books", "books")
def _(spark, d):
    return c.on_shelf(s.books(spark, d).select("id", "shelf_id"), None)


@query("shelf_filter_none", "SELECT id, shelf_id FROM books WHERE shelf_id IS NULL", "books")
def _(spark, d):
    return c.on_shelf(s.books(spark, d).select("id", "shelf_id"), c.UNSHELVED)


@query("shelf_filter_one", "SELECT id, shelf_id FROM books WHERE shelf_id = 5", "books")
def _(spark, d):
    return c.on_shelf(s.books(spark, d).select("id", "shelf_id"), 5)


@query("processed_books", "SELECT id FROM books WHERE status = 'PROCESSED'", "books")
def _(spark, d):
    return s.books(spark, d).where(F.col("status") == st.PROCESSED).select("id")


@query("books_with_cover", "SELECT id FROM books b WHERE EXISTS (SELECT 1 FROM pages p WHERE p.book_id = b.id AND p.type = 'COVER')", "books", "pages")
def _(spark, d):
    return c.has_type(s.pages(spark, d), s.books(spark, d).select("id"), "COVER")


@query(
    "required_pages_missing",
    """WITH f AS (SELECT book_id, bool_or(type = 'COVER') AS cover, bool_or(type = 'INFO_PAGE') AS info FROM pages GROUP BY 1)
    SELECT id, concat_ws(', ', CASE WHEN NOT coalesce(cover, false) THEN 'cover' END, CASE WHEN NOT coalesce(info, false) THEN 'info page' END) AS missing FROM books LEFT JOIN f ON book_id = id""",
    "books", "pages",
)
def _(spark, d):
    return c.missing_parts(s.books(spark, d), s.pages(spark, d))


@query("size_guard", "SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents WHERE text <> '' AND octet_length(encode(text)) <= 4096")
def _(spark, d):
    data = F.encode("text", "UTF-8")
    return s.table(spark, d, "documents").where(c.displayable(data, 4096)).select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"))


_KEY = "CASE WHEN p_partkey % 3 = 0 THEN 'bad-' || p_partkey ELSE '00000000-0000-4000-8000-' || lpad(CAST(p_partkey AS STRING), 12, '0') END"


@query("bad_key_skip", f"WITH k AS (SELECT p_partkey, {_KEY} AS k FROM part) SELECT p_partkey, k FROM k WHERE length(k) = 36")
def _(spark, d):
    return c.valid_keys(s.table(spark, d, "part").select("p_partkey", F.expr(_KEY).alias("k")), "k")


_FIELD = "CASE p_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '  ' WHEN 2 THEN ' ' || p_brand || ' ' ELSE p_name END"


@query("sentinel_to_null", f"WITH f AS (SELECT p_partkey, {_FIELD} AS v FROM part) SELECT p_partkey, CASE WHEN v <> 'unknown' AND trim(v) <> '' THEN v END AS v FROM f")
def _(spark, d):
    return c.sentinel_to_null(s.table(spark, d, "part").select("p_partkey", F.expr(_FIELD).alias("v")), "v")


@query("blank_text_errors", "SELECT p_partkey, 'No OCR text' AS reason FROM part WHERE p_partkey % 4 = 1")
def _(spark, d):
    texts = s.table(spark, d, "part").select("p_partkey", F.expr(_FIELD).alias("v"))
    return texts.where(t.strip(t.present(F.col("v"))) == "").select("p_partkey", F.lit("No OCR text").alias("reason"))


# --- joins and aggregates -----------------------------------------------------------------------------------------------


@query("book_publisher_left", "SELECT b.id, p.name AS publisher FROM books b LEFT JOIN shelves s ON s.id = b.shelf_id LEFT JOIN publishers p ON p.id = s.publisher_id", "books", "shelves", "publishers")
def _(spark, d):
    shelf = s.shelves(spark, d).select(F.col("id").alias("shelf_id"), "publisher_id")
    publisher = s.publishers(spark, d).select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher"))
    return s.books(spark, d).select("id", "shelf_id").join(shelf, "shelf_id", "left").join(publisher, "publisher_id", "left").select("id", "publisher")


@query("book_authors_list", "SELECT ba.book_id, string_agg(DISTINCT a.name, ', ' ORDER BY a.name) AS authors, count(DISTINCT a.name) AS n_authors FROM book_authors ba JOIN authors a ON a.id = ba.author_id GROUP BY 1", "book_authors", "authors")
def _(spark, d):
    return c.author_names(s.book_authors(spark, d), s.authors(spark, d)).withColumn("n_authors", F.col("n_authors").cast("long"))


@query("book_images_nested", "SELECT b.id, count(p.book_id) AS n_pages, coalesce(string_agg(p.sort_order || ':' || p.type || ':' || p.image_path, ' ' ORDER BY p.sort_order, p.type, p.image_path), '') AS pages FROM books b LEFT JOIN pages p ON p.book_id = b.id GROUP BY 1", "books", "pages")
def _(spark, d):
    nested = c.with_pages(s.books(spark, d).select("id"), s.pages(spark, d), "sort_order", "type", "image_path")
    shown = F.transform("pages", lambda p: F.concat(p["sort_order"], F.lit(":"), p["type"], F.lit(":"), p["image_path"]))
    return nested.select("id", F.size("pages").cast("long").alias("n_pages"), F.array_join(shown, " ").alias("pages"))


@query("shelf_books_count", "SELECT s.id, count(b.id) AS n_books FROM shelves s LEFT JOIN books b ON b.shelf_id = s.id GROUP BY 1", "shelves", "books")
def _(spark, d):
    return c.counted(s.shelves(spark, d).select("id"), s.books(spark, d), "shelf_id", "n_books")


@query("shelf_with_books", "SELECT s.id, s.name, coalesce(string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id), '') AS books FROM shelves s LEFT JOIN books b ON b.shelf_id = s.id GROUP BY 1, 2", "shelves", "books")
def _(spark, d):
    listed = s.books(spark, d).where("shelf_id IS NOT NULL").groupBy(F.col("shelf_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("ids"))
    return s.shelves(spark, d).select("id", "name").join(listed, "id", "left").select("id", "name", F.coalesce(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), F.lit("")).alias("books"))


@query("book_shelf_left", "SELECT b.id, s.name AS shelf FROM books b LEFT JOIN shelves s ON s.id = b.shelf_id", "books", "shelves")
def _(spark, d):
    return s.books(spark, d).select("id", "shelf_id").join(s.shelves(spark, d).select(F.col("id").alias("shelf_id"), F.col("name").alias("shelf")), "shelf_id", "left").select("id", "shelf")


@query("books_without_pages", "SELECT id FROM books WHERE id NOT IN (SELECT book_id FROM pages)", "books", "pages")
def _(spark, d):
    return m.deleted(s.books(spark, d).select("id"), s.pages(spark, d), "id", "book_id")


@query("orphan_shelves", "SELECT id, shelf_id FROM books WHERE shelf_id IN (SELECT id FROM shelves WHERE balance < 0)", "books", "shelves")
def _(spark, d):
    left = s.shelves(spark, d).where("balance >= 0")
    return c.orphans(s.books(spark, d), left).select("id", "shelf_id")


@query("next_sort_order", "SELECT b.id, CAST(coalesce(max(p.sort_order), -1) + 1 AS BIGINT) AS next_order FROM books b LEFT JOIN pages p ON p.book_id = b.id GROUP BY 1", "books", "pages")
def _(spark, d):
    return c.next_order(s.books(spark, d), s.pages(spark, d))


@query("selection_counts", "SELECT type, count(*) AS n, count(*) FILTER (sort_order = 1) AS n_first, bool_and(sort_order <= 7) AS all_selected, bool_or(sort_order = 7) AS any_last FROM pages GROUP BY 1", "pages")
def _(spark, d):
    return s.pages(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("sort_order") == 1).alias("n_first"), F.bool_and(F.col("sort_order") <= 7).alias("all_selected"), F.bool_or(F.col("sort_order") == 7).alias("any_last"))


# --- ordinals and top-1 -------------------------------------------------------------------------------------------------

_ORDER = "sort_order, partkey, suppkey, extent"


@query("type_ordinal_label", f"SELECT book_id, {_ORDER}, type, CASE type WHEN 'COVER' THEN 'Cover' WHEN 'BACK' THEN 'Back Cover' ELSE 'Info Page' || CASE WHEN row_number() OVER w > 1 THEN ' ' || row_number() OVER w ELSE '' END END AS label FROM pages WINDOW w AS (PARTITION BY book_id, type ORDER BY {_ORDER})", "pages")
def _(spark, d):
    return c.ordinal_labels(s.pages(spark, d)).select("book_id", *c.PAGE_ORDER, "type", "label")


@query("info_page_label", f"SELECT book_id, {_ORDER}, CASE WHEN type <> 'INFO_PAGE' THEN replace(type, '_', ' ') WHEN count(*) OVER (PARTITION BY book_id, type) > 1 THEN 'INFO PAGE ' || row_number() OVER (PARTITION BY book_id, type ORDER BY {_ORDER}) ELSE 'INFO PAGE' END AS label FROM pages", "pages")
def _(spark, d):
    return c.info_labels(s.pages(spark, d)).select("book_id", *c.PAGE_ORDER, "label")


@query("circular_neighbours", f"WITH p AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY {_ORDER}) - 1 AS place, count(*) OVER (PARTITION BY book_id) AS n FROM pages) SELECT book_id, place, (place - 1 + n) % n AS previous, (place + 1) % n AS following FROM p", "pages")
def _(spark, d):
    return c.neighbours(s.pages(spark, d))


@query("first_cover", f"SELECT book_id, first(image_path ORDER BY {_ORDER}) AS image_path FROM pages WHERE type = 'COVER' GROUP BY 1", "pages")
def _(spark, d):
    return c.first_of_type(s.pages(spark, d), "COVER")


@query("images_by_type", f"SELECT book_id, last(image_path ORDER BY {_ORDER}) FILTER (type = 'COVER') AS cover, last(image_path ORDER BY {_ORDER}) FILTER (type = 'BACK') AS back, coalesce(string_agg(image_path, ',' ORDER BY {_ORDER}) FILTER (type = 'INFO_PAGE'), '') AS info FROM pages GROUP BY 1", "pages")
def _(spark, d):
    return c.images_by_type(s.pages(spark, d))


@query("nth_image", f"SELECT b.id, (SELECT any_value(image_path) FROM (SELECT book_id, image_path, row_number() OVER (PARTITION BY book_id ORDER BY {_ORDER}) AS n FROM pages) p WHERE p.book_id = b.id AND n = 3) AS image_path FROM books b", "books", "pages")
def _(spark, d):
    nested = c.with_pages(s.books(spark, d).select("id"), s.pages(spark, d), *c.PAGE_ORDER, "image_path")
    return nested.select("id", F.get("pages", F.lit(2))["image_path"].alias("image_path"))


@query("all_but_first", f"SELECT book_id, string_agg(image_path, ',' ORDER BY {_ORDER}) AS rest FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY {_ORDER}) AS n FROM pages) WHERE n > 1 GROUP BY 1", "pages")
def _(spark, d):
    nested = c.with_pages(s.books(spark, d).select("id"), s.pages(spark, d), *c.PAGE_ORDER, "image_path").where(F.size("pages") > 1)
    rest = F.slice("pages", F.lit(2), F.size("pages"))
    return nested.select(F.col("id").alias("book_id"), F.array_join(F.transform(rest, lambda p: p["image_path"]), ",").alias("rest"))


@query("longest_text", "SELECT conv_id, first(text ORDER BY length(text) DESC, turn) AS text FROM conversations GROUP BY 1")
def _(spark, d):
    return c.longest_text(s.table(spark, d, "conversations"), "conv_id", "text", "turn")


@query("candidate_threshold_pick", "SELECT conv_id, CASE WHEN max(length(text)) >= 400 THEN first(text ORDER BY length(text) < 400, turn) ELSE first(text ORDER BY length(text) DESC, turn) END AS text FROM conversations GROUP BY 1")
def _(spark, d):
    return c.good_enough(s.table(spark, d, "conversations"), "conv_id", "text", "turn", 400)


@query("vision_or_plain", "SELECT a.conv_id, CASE WHEN length(trim(b.text)) > length(trim(a.text)) THEN b.text ELSE a.text END AS text FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 1 WHERE a.turn = 0")
def _(spark, d):
    turns = s.table(spark, d, "conversations")
    plain = turns.where("turn = 0").select("conv_id", F.col("text").alias("plain"))
    vision = turns.where("turn = 1").select("conv_id", F.col("text").alias("vision"))
    return plain.join(vision, "conv_id").select("conv_id", F.when(F.length(F.trim("vision")) > F.length(F.trim("plain")), F.col("vision")).otherwise(F.col("plain")).alias("text"))

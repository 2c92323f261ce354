"""Registered queries of the server's dataflows, of files and of small functions, and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue_queries import query
from .functions import text as t
from .operators import catalogue as c
from .operators import mutations as m
from .plans import records as r
from .plans import server as sv
from .sources import tables as s
from .streaming import status as st
from .text_queries import _RECORDS, _REPLY, _REPLY_OF_CARD

# --- one request: readings, record ----------------------------------------------------------------------------------------

#: Images of part k: a cover (without a text for every seventh), one info page with the card (but for every eleventh), a back for even k.
_COVER_TEXT = "CASE WHEN p_partkey % 7 <> 0 THEN 'Cover ' || p_size END"
_HAS_INFO, _HAS_BACK = "p_partkey % 11 <> 0", "p_partkey % 2 = 0"
_ENG = "'eng ' || p_size"
_COVER_REPLY = "CASE book_id % 3 WHEN 0 THEN '{\"title\": \"Cover ' || book_id || ' : sub\", \"author\": \"Ann Lee\"}' WHEN 1 THEN 'nothing' ELSE '{\"title\": \"Rights reserved\"}' END"


def _images(spark: SparkSession, d: str) -> DataFrame:
    parts = s.table(spark, d, "part")
    image = lambda kind, at, text: f"named_struct('type', '{kind}', 'at', {at}, 'text', {text}, 'eng', {_ENG})"
    every = f"array({image('COVER', 0, _COVER_TEXT)}, CASE WHEN {_HAS_INFO} THEN {image('INFO_PAGE', 1, s.CARD)} END, CASE WHEN {_HAS_BACK} THEN {image('BACK', 2, repr('Back side'))} END)"
    return parts.select(F.col("p_partkey").alias("book_id"), F.inline(F.filter(F.expr(every), lambda x: x.isNotNull())))


_READ = f"""read AS (SELECT p_partkey AS book_id, p_size, coalesce({_COVER_TEXT}, '') AS cover,
    CASE WHEN {_HAS_INFO} THEN '=== INFO PAGE 1 ===' || chr(10) || ({s.CARD}) || chr(10) ELSE '' END || CASE WHEN {_HAS_BACK} THEN '=== BACK COVER ===' || chr(10) || 'Back side' || chr(10) ELSE '' END AS main,
    '=== COVER ===' || chr(10) || {_ENG} || chr(10) || CASE WHEN {_HAS_INFO} THEN '=== INFO PAGE 1 ===' || chr(10) || {_ENG} || chr(10) ELSE '' END || CASE WHEN {_HAS_BACK} THEN '=== BACK COVER ===' || chr(10) || {_ENG} || chr(10) ELSE '' END AS eng FROM part)"""


@query("request_readings", f"WITH {_READ} SELECT book_id, cover, main, eng, '=== COVER ===' || chr(10) || cover || chr(10) || chr(10) || main AS raw FROM read WHERE cover <> '' OR main <> ''")
def _(spark, d):
    return sv.readings(_images(spark, d))


def _read(spark: SparkSession, d: str) -> DataFrame:
    replies = {"cover_reply": F.expr(_COVER_REPLY), "info_reply": F.expr(_REPLY_OF_CARD.replace("doc_id", "book_id"))}
    return sv.readings(_images(spark, d)).withColumns(replies)


@query("cover_record", f"WITH x AS (SELECT p_partkey AS book_id FROM part) SELECT book_id, CASE book_id % 3 WHEN 0 THEN 'Cover ' || book_id ELSE 'unknown' END AS title, CASE book_id % 3 WHEN 0 THEN 'Ann Lee' ELSE 'unknown' END AS author FROM x")
def _(spark, d):
    replies = s.table(spark, d, "part").select(F.col("p_partkey").alias("book_id")).withColumn("reply", F.expr(_COVER_REPLY))
    return r.cover_records(replies, "book_id")


_EXTRACTED = f"""{_READ}, cards AS (SELECT book_id AS doc_id, main || CASE WHEN eng <> '' THEN chr(10) || eng ELSE '' END AS text FROM read WHERE main <> ''), {_RECORDS},
    info AS (SELECT doc_id AS book_id, CASE doc_id % 4 WHEN 0 THEN 'Reply ' || (doc_id % 9) WHEN 3 THEN 'X' ELSE title END AS title, CASE doc_id % 4 WHEN 0 THEN 'Kim A.' WHEN 3 THEN 'unknown' ELSE author END AS author,
      CASE WHEN doc_id % 4 IN (0, 3) THEN 'unknown' ELSE publisher END AS publisher, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 9 % 3 = 0 THEN 1990 ELSE 0 END WHEN 3 THEN 0 ELSE year END AS year,
      CASE doc_id % 4 WHEN 3 THEN '0-306-40615-2' ELSE isbn END AS isbn, udk, bbk, CASE doc_id % 4 WHEN 3 THEN 'A. B!' ELSE '' END AS annotation FROM records),
    paired AS (SELECT read.book_id, CASE WHEN cover <> '' AND read.book_id % 3 = 0 THEN 'Cover ' || read.book_id END AS c_title, CASE WHEN cover <> '' AND read.book_id % 3 = 0 THEN 'Ann Lee' END AS c_author, info.* EXCLUDE (book_id)
      FROM read LEFT JOIN info ON info.book_id = read.book_id WHERE cover <> '' OR main <> ''),
    parsed AS (SELECT book_id, coalesce(nullif(title, 'unknown'), c_title, 'unknown') AS title, coalesce(nullif(author, 'unknown'), c_author, 'unknown') AS author, coalesce(publisher, 'unknown') AS publisher, coalesce(isbn, 'unknown') AS isbn,
      coalesce(udk, 'unknown') AS udk, coalesce(bbk, 'unknown') AS bbk, coalesce(year, 0) AS year, coalesce(annotation, 'unknown') AS annotation FROM paired)"""


@query("extract_request", f"WITH {_EXTRACTED} SELECT *, CASE WHEN author = 'unknown' THEN '' ELSE author END AS authors FROM parsed")
def _(spark, d):
    """Readings of all images to one merged record."""
    return sv.extracted(_read(spark, d)).withColumn("authors", F.array_join("authors", ","))


@query(
    "layout_record",
    f"WITH b AS (SELECT p_partkey AS book_id, p_size, ({_REPLY}) AS reply FROM part WHERE p_partkey % 4 IN (0, 3)) SELECT book_id, CASE book_id % 4 WHEN 0 THEN 'Reply ' || p_size ELSE 'X' END AS title, CASE book_id % 4 WHEN 0 THEN 'Kim A.' ELSE 'unknown' END AS author, 'unknown' AS publisher, CASE WHEN book_id % 4 = 0 AND p_size % 3 = 0 THEN 1990 ELSE 0 END AS year, CASE book_id % 4 WHEN 0 THEN '9780000000002' ELSE '0-306-40615-2' END AS isbn, '821.' || p_size AS udk, 'unknown' AS bbk, CASE book_id % 4 WHEN 0 THEN 'unknown' ELSE 'A. B!' END AS annotation FROM b".replace("'unknown' ELSE 'A. B!'", "'' ELSE 'A. B!'"),
)
def _(spark, d):
    """Words of blocks to the block that looks like a citation, then the older record."""
    parts = s.table(spark, d, "part").withColumn("book_id", F.col("p_partkey"))
    lines = F.array(F.lit("noise"), F.concat(F.lit("Куваев, О. М. — Территория : роман. — Москва : Азбука, 1987. — 416 с. УДК 821."), "p_size", F.lit(" конец текста этой карточки")), F.lit("tail"))
    words = parts.select("book_id", F.posexplode(lines).alias("block", "line")).select("book_id", "block", F.posexplode(F.split("line", " ")).alias("pos", "word"))
    primary = r.primary_text(r.blocks(words, "book_id", "block").select("book_id", F.col("block").alias("first"), "text"), "book_id")
    replies = parts.select("book_id", F.expr(_REPLY).alias("reply"), F.lit("ISBN 978-0-00-000000-2").alias("eng"))
    return r.layout_records(primary.join(replies, "book_id"), "book_id")


# --- enrichment, reprocessing, edits --------------------------------------------------------------------------------------

_STORED = "stored AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'Old ' || p_size END AS title, '' AS isbn, CASE WHEN p_partkey % 3 = 0 THEN 1900 END AS year, 'old udk' AS udk, CAST(NULL AS STRING) AS bbk, CAST(NULL AS STRING) AS annotation, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 25 END AS publisher_id FROM part)"


def _stored(spark: SparkSession, d: str) -> DataFrame:
    s.table(spark, d, "part").createOrReplaceTempView("_stored_parts")
    return spark.sql(_STORED[len("stored AS (") : -1].replace("FROM part", "FROM _stored_parts"))


def _enriched(spark: SparkSession, d: str) -> sv.Tables:
    links = s.table(spark, d, "part").select(F.col("p_partkey").alias("book_id"), F.lit(1).cast("long").alias("author_id"))
    return sv.enriched(_stored(spark, d), sv.extracted(_read(spark, d)), s.publishers(spark, d), s.authors(spark, d), links)


_NEW_PUBLISHERS = "new_publishers AS (SELECT name, (SELECT max(id) FROM publishers) + row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT publisher AS name FROM parsed) WHERE name NOT IN (SELECT name FROM publishers)), every_publisher AS (SELECT id, name FROM publishers UNION ALL SELECT id, name FROM new_publishers)"


@query(
    "enrich_books",
    f"""WITH {_EXTRACTED}, {_STORED}, {_NEW_PUBLISHERS} SELECT b.id, coalesce(p.title, b.title) AS title, coalesce(p.isbn, b.isbn) AS isbn, coalesce(p.year, b.year) AS year, coalesce(nullif(nullif(p.udk, 'unknown'), ''), b.udk) AS udk,
      nullif(nullif(p.bbk, 'unknown'), '') AS bbk, nullif(nullif(p.annotation, 'unknown'), '') AS annotation, CAST(coalesce(e.id, b.publisher_id) AS BIGINT) AS publisher_id
    FROM stored b LEFT JOIN parsed p ON p.book_id = b.id LEFT JOIN every_publisher e ON e.name = p.publisher""",
    "publishers",
)
def _(spark, d):
    """Stored books after enrichment: fields, and publishers found by name or made."""
    return _enriched(spark, d)["books"]


@query(
    "enrich_authors",
    f"""WITH {_EXTRACTED} SELECT DISTINCT p.p_partkey AS book_id, CASE WHEN x.author <> 'unknown' THEN x.author ELSE (SELECT name FROM authors WHERE id = 1) END AS name FROM part p LEFT JOIN parsed x ON x.book_id = p.p_partkey""",
    "authors",
)
def _(spark, d):
    """Links of books to authors by name after enrichment."""
    out = _enriched(spark, d)
    return out["book_authors"].join(out["authors"].withColumnRenamed("id", "author_id"), "author_id").select("book_id", "name")


_REF = "'00000000-0000-4000-8000-' || lpad(CAST({0} AS STRING), 12, '0')"


@query("bulk_reprocess", f"WITH {_EXTRACTED} SELECT book_id, title, author FROM parsed WHERE book_id % 5 = 0 AND book_id % 3 <> 0")
def _(spark, d):
    """Books picked by a list of keys, every third of which is not well formed."""
    parts = s.table(spark, d, "part")
    keys = parts.where("p_partkey % 5 = 0").select(F.expr(f"CASE WHEN p_partkey % 3 = 0 THEN 'bad-' || p_partkey ELSE {_REF.format('p_partkey')} END").alias("ref"))
    books = parts.select(F.col("p_partkey").alias("id"), F.expr(_REF.format("p_partkey")).alias("ref"))
    return sv.reprocessed(keys, books, _read(spark, d)).select("book_id", "title", "author")


_EDITS = "edits AS (SELECT p_partkey AS id, 'Edited ' || p_size AS title, CASE p_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'A ' || p_partkey || ' ,B ' || p_partkey || ',' ELSE 'C ' || p_partkey END AS author, CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'unknown' ELSE 'Press ' || p_partkey END AS publisher, CASE WHEN p_partkey % 2 = 0 THEN 2001 END AS year, CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE 'i ' || p_partkey END AS isbn, '  ' AS udk, 'b' AS bbk FROM part WHERE p_partkey % 10 < 7 AND p_partkey % 3 = 1)"


def _edited(spark: SparkSession, d: str) -> sv.Tables:
    s.table(spark, d, "part").createOrReplaceTempView("_edited_parts")
    edits = spark.sql(_EDITS[len("edits AS (") : -1].replace("FROM part", "FROM _edited_parts"))
    return sv.edited(_stored(spark, d), edits, s.publishers(spark, d), s.authors(spark, d), s.book_authors(spark, d))


@query(
    "manual_edit",
    f"""WITH {_STORED}, {_EDITS}, named AS (SELECT *, CASE WHEN trim(publisher) NOT IN ('', 'unknown') THEN publisher END AS p FROM edits),
    j AS (SELECT b.*, e.id IS NOT NULL AS hit, e.title AS e_title, e.year AS e_year, e.isbn AS e_isbn, e.p FROM stored b LEFT JOIN named e ON e.id = b.id),
    renamed AS (SELECT publisher_id, last(p ORDER BY id) AS name FROM j WHERE p IS NOT NULL AND publisher_id IS NOT NULL GROUP BY 1),
    final AS (SELECT j.*, CASE WHEN hit AND p IS NULL THEN NULL WHEN publisher_id IS NULL THEN p ELSE coalesce(r.name, n.name) END AS publisher FROM j LEFT JOIN renamed r USING (publisher_id) LEFT JOIN publishers n ON n.id = j.publisher_id)
    SELECT id, CASE WHEN hit THEN e_title ELSE title END AS title, CASE WHEN hit THEN e_year ELSE year END AS year, CASE WHEN hit THEN nullif(e_isbn, 'unknown') ELSE isbn END AS isbn, CASE WHEN NOT hit THEN udk END AS udk, CASE WHEN hit THEN 'b' END AS bbk, publisher FROM final""",
    "publishers",
)
def _(spark, d):
    """Books after edits, with their publishers' names: renaming the shared row renames it for all of its books."""
    out = _edited(spark, d)
    return out["books"].join(out["publishers"].select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher")), "publisher_id", "left").drop("publisher_id")


@query(
    "manual_edit_authors",
    f"""WITH {_EDITS}, n AS (SELECT id AS book, unnest(CASE id % 4 WHEN 1 THEN ['A ' || id, 'B ' || id] ELSE ['C ' || id] END) AS name FROM edits WHERE author <> 'unknown'),
    made AS (SELECT (SELECT max(id) FROM authors) + row_number() OVER (ORDER BY book, name) AS id, book, name FROM n),
    links AS (SELECT book_id, author_id FROM book_authors WHERE book_id NOT IN (SELECT id FROM edits) UNION ALL SELECT book, id FROM made)
    SELECT CAST(book_id AS BIGINT) AS book_id, CAST(author_id AS BIGINT) AS author_id, coalesce(a.name, made.name) AS name FROM links LEFT JOIN authors a ON a.id = author_id LEFT JOIN made ON made.id = author_id""",
    "authors", "book_authors",
)
def _(spark, d):
    """Links and names after edits: each name of a form is a new author."""
    out = _edited(spark, d)
    return out["book_authors"].join(out["authors"].withColumnRenamed("id", "author_id"), "author_id", "left").select("book_id", "author_id", "name")


_REQUESTS = "SELECT DISTINCT 'req ' || p_size AS ref FROM part"


@query(
    "insert_book_with_images",
    f"""WITH top AS (SELECT (SELECT max(id) FROM books) AS b, (SELECT max(l_orderkey) FROM lineitem WHERE l_linenumber = 1) AS i), new AS (SELECT (SELECT b FROM top) + row_number() OVER (ORDER BY ref) AS id, ref FROM ({_REQUESTS})),
    made AS (SELECT (SELECT i FROM top) + row_number() OVER (ORDER BY id, place) AS id, id AS book_id, type FROM new, (VALUES (0, 'COVER'), (1, 'INFO_PAGE'), (2, 'INFO_PAGE')) AS v(place, type))
    SELECT CAST(id AS BIGINT) AS id, CAST(book_id AS BIGINT) AS book_id, type FROM made UNION ALL SELECT l_orderkey, l_orderkey, 'COVER' FROM lineitem WHERE l_linenumber = 1""",
    "books",
)
def _(spark, d):
    """Images after new books came with theirs; all get ids after the greatest."""
    books = s.books(spark, d).select("id", F.col("title").alias("ref"))
    items = s.table(spark, d, "lineitem")
    images = items.where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("book_id"), F.lit("old").alias("ref"), F.lit("COVER").alias("type"))
    requests = s.table(spark, d, "part").select(F.concat(F.lit("req "), "p_size").alias("ref")).distinct()
    kinds = F.posexplode(F.array(F.lit("COVER"), F.lit("INFO_PAGE"), F.lit("INFO_PAGE"))).alias("at", "type")
    return m.inserted(books, images, requests, requests.select("ref", kinds))[1].drop("ref")


@query("shelf_changes", "SELECT CAST(id AS BIGINT) AS id, CASE WHEN id % 10 = 1 THEN 'Renamed ' || id ELSE name END AS name FROM shelves WHERE id % 10 <> 2 UNION ALL SELECT CAST((SELECT max(id) FROM shelves) + row_number() OVER (ORDER BY n_nationkey) AS BIGINT), CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Shelf 1700000000000' END FROM nation", "shelves")
def _(spark, d):
    shelves = s.shelves(spark, d).select("id", "name")
    made = s.table(spark, d, "nation").select(F.col("n_nationkey").alias("at"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name"))
    renamed = shelves.where("id % 10 = 1").select("id", F.concat(F.lit("Renamed "), "id").alias("name"))
    return sv.shelf_changes(shelves, made, renamed, shelves.where("id % 10 = 2"), F.lit(1700000000000))


@query("microbatch_enrich", f"WITH {_RECORDS} SELECT doc_id, title, author, publisher, year, isbn FROM records", "cards")
def _(spark, d):
    """Cards arriving as files, a bounded number a micro-batch, each batch enriched and written under its number."""
    folder = f"{st.checkpoint_folder(spark)}/enrich-{uuid.uuid4().hex}"
    stream = st.stream_of(spark, f"{d}/part.parque[t]", s.table(spark, d, "part").schema).select(F.col("p_partkey").alias("doc_id"), F.expr(s.CARD).alias("text"))
    st.enrich_to(stream, r.regex_records, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("doc_id", "title", "author", "publisher", "year", "isbn")


# --- files ----------------------------------------------------------------------------------------------------------------

_GOLDEN = "'{\"title\": \"Title ' || n_nationkey || '\", \"year\": ' || (1900 + n_nationkey) || ', \"isbn\": null}'"


def _landed(spark: SparkSession, d: str) -> str:
    """A folder of cases language/book with images of several extensions and one expected record each: 25 cases, whatever the tables."""
    root = f"{st.checkpoint_folder(spark)}/cases-{uuid.uuid4().hex}"
    jvm = spark._jvm
    system = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for key, golden in s.table(spark, d, "nation").selectExpr("n_nationkey", _GOLDEN).collect():
        case = f"{root}/{'eng' if key % 2 else 'rus'}/book_{key}"
        files = {"cover.png": b"png", "expected.json": golden.encode(), **({"cover.jpg": f"jpg {key}".encode()} if key % 3 else {}), **({"info.jfif": b"jf"} if key % 4 == 0 else {}), "notes.txt": b"x"}
        for name, data in files.items():
            out = system.create(jvm.org.apache.hadoop.fs.Path(f"{case}/{name}"))
            out.write(bytearray(data))
            out.close()
    return root


@query("image_lookup", "WITH c AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 1 THEN 'eng' ELSE 'rus' END AS language, 'book_' || n_nationkey AS book FROM nation) SELECT language, book, 'cover' AS base, CASE WHEN k % 3 <> 0 THEN 'cover.jpg' ELSE 'cover.png' END AS file, CASE WHEN k % 3 <> 0 THEN 4 + length(CAST(k AS STRING)) ELSE 3 END AS n_bytes FROM c UNION ALL SELECT language, book, 'info', 'info.jfif', 2 FROM c WHERE k % 4 = 0")
def _(spark, d):
    """Cases found below a folder, one image per base name by extension, and its bytes."""
    files = s.image_files(spark, _landed(spark, d))
    chosen = s.preferred_images(files).join(files.select("path", F.octet_length("content").alias("n_bytes")), "path")
    return chosen.select("language", "book", "base", F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "n_bytes")


@query("golden_json", "SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'eng' ELSE 'rus' END AS language, 'book_' || n_nationkey AS book, 'Title ' || n_nationkey AS title, 1900 + n_nationkey AS year, NULL AS isbn FROM nation")
def _(spark, d):
    return s.golden_records(spark, _landed(spark, d)).select("language", "book", "title", "year", "isbn")


@query("base64_image", "SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN octet_length(encode(text)) END AS n_bytes, CASE WHEN turn % 3 <> 2 THEN sha256(text) END AS digest FROM conversations WHERE text IS NOT NULL")
def _(spark, d):
    """Base64 texts as bytes; every third is not Base64 and gives null."""
    rows = s.table(spark, d, "conversations").where("text IS NOT NULL")
    data = s.image_bytes(F.when(F.col("turn") % 3 != 2, F.base64(F.encode("text", "UTF-8"))).otherwise("*no base64*"))
    return rows.select("conv_id", "turn", data.alias("data")).select("conv_id", "turn", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


@query("shelf_photo", "SELECT id, octet_length(encode(name)) AS n_bytes FROM shelves WHERE id % 4 <> 0 AND id % 4 <> 1", "shelves")
def _(spark, d):
    """Photos of shelves; shelves without one, or with an empty one, are left out."""
    photo = F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, F.lit(b"")).otherwise(F.encode("name", "UTF-8"))
    return s.shelves(spark, d).select("id", photo.alias("photo")).where(c.displayable(F.col("photo"))).select("id", F.octet_length("photo").cast("long").alias("n_bytes"))


# --- small functions ------------------------------------------------------------------------------------------------------

_CHOICES = "'{\"choices\": [{\"text\": \"' || p_brand || '\"}, {\"text\": \"other\"}], \"n\": ' || p_size || '}'"


@query("reply_path", f"WITH x AS (SELECT p_partkey, {_CHOICES} AS x FROM part) SELECT p_partkey, json_extract_string(x, '$.choices[0].text') AS text, json_extract_string(x, '$.choices[1].text') AS other, json_extract_string(x, '$.choices[2].text') AS missing FROM x")
def _(spark, d):
    at = lambda k: F.get_json_object(F.expr(_CHOICES), f"$.choices[{k}].text")
    return s.table(spark, d, "part").select("p_partkey", at(0).alias("text"), at(1).alias("other"), at(2).alias("missing"))


@query("map_upsert", "WITH l AS (SELECT user_id, event_type, last(event_id ORDER BY ts, event_id) AS v FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS entries FROM l GROUP BY 1")
def _(spark, d):
    """A map per user in which the last write of each entry wins."""
    maps = m.upserted(s.table(spark, d, "events"), "user_id", "event_type", "event_id", F.struct("ts", "event_id"))
    return maps.select("user_id", F.array_join(F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("entries"))


@query("text_prefix", "SELECT doc_id, left(text, 100) AS prefix FROM documents")
def _(spark, d):
    """The prefix that is logged: the slice is the operator."""
    return s.table(spark, d, "documents").select("doc_id", F.substring("text", 1, 100).alias("prefix"))


@query("thumbnail_dims", "WITH x AS (SELECT p_partkey, p_partkey * 7 AS w, p_size * 40 + 1 AS h FROM part) SELECT p_partkey, CASE WHEN greatest(w, h) <= 200 THEN w ELSE w * 200 // greatest(w, h) END AS width, CASE WHEN greatest(w, h) <= 200 THEN h ELSE h * 200 // greatest(w, h) END AS height FROM x")
def _(spark, d):
    dims = s.table(spark, d, "part").selectExpr("p_partkey", "p_partkey * 7 AS w", "CAST(p_size * 40 + 1 AS BIGINT) AS h")
    width, height = c.scaled(F.col("w"), F.col("h"), 200)
    return dims.select("p_partkey", width.cast("long").alias("width"), height.cast("long").alias("height"))

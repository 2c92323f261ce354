"""Explicit schemas, readers and the catalogue's stand-in tables over the provided star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: DDL of the catalogue's entities; readers never infer a schema.
BOOK = "id string, title string, isbn string, publication_year int, udk string, bbk string, annotation string, publisher_id string, shelf_id string, created_at timestamp_ntz"
IMAGE = "id string, book_id string, type string, data binary, created_at timestamp_ntz"
NAMED = "id string, name string"
BOOK_AUTHOR = "book_id string, author_id string"
CLIENT_BOOK = "id bigint, client_ref_id string, status string, shelf_id bigint, created_at bigint"
CLIENT_PAGE = "id bigint, book_id bigint, type string, image_path string, sort_order int"
CLIENT_SHELF = "id bigint, name string, photo binary, created_at bigint"
RECORD = "title string, author string, publisher string, year int, isbn string, udk string, bbk string, annotation string"
REQUEST = "cover_image string, info_images array<string>, back_image string, language string"
GOLDEN = RECORD

#: Extensions in order of preference when several files share a base name.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".jfif", ".png")
#: Larger images are not displayed.
MOST_BYTES = 10 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as books: id, title, status, shelf_id (null for priority 5-LOW), custkey, price, created_at."""
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "SENT").otherwise("PROCESSED")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Book "), F.col("o_orderkey")).alias("title"),
        status.alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("shelf_id"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("created_at"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pages: book_id, sort_order, type (COVER, INFO_PAGE, BACK), image_path and three columns that break ties."""
    kind = F.when(F.col("l_returnflag") == "A", "COVER").when(F.col("l_returnflag") == "N", "INFO_PAGE").otherwise("BACK")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book_id"),
        F.col("l_linenumber").alias("sort_order"),
        kind.alias("type"),
        F.concat(F.lit("img_"), F.col("l_partkey"), F.lit(".jpg")).alias("image_path"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_extendedprice").alias("extent"),
    )


def book_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_suppkey").alias("author_id")).distinct()


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("publisher_id"), F.col("c_acctbal").alias("balance"))


#: The same stand-ins for SQL.
SQL = {
    "books": "books AS (SELECT o_orderkey AS id, 'Book ' || o_orderkey AS title, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'SENT' ELSE 'PROCESSED' END AS status, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS shelf_id, o_custkey AS custkey, o_totalprice AS price, o_orderdate AS created_at FROM orders)",
    "pages": "pages AS (SELECT l_orderkey AS book_id, l_linenumber AS sort_order, CASE l_returnflag WHEN 'A' THEN 'COVER' WHEN 'N' THEN 'INFO_PAGE' ELSE 'BACK' END AS type, 'img_' || l_partkey || '.jpg' AS image_path, l_partkey AS partkey, l_suppkey AS suppkey, l_extendedprice AS extent FROM lineitem)",
    "book_authors": "book_authors AS (SELECT DISTINCT l_orderkey AS book_id, l_suppkey AS author_id FROM lineitem)",
    "authors": "authors AS (SELECT s_suppkey AS id, s_name AS name FROM supplier)",
    "publishers": "publishers AS (SELECT n_nationkey AS id, n_name AS name FROM nation)",
    "shelves": "shelves AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS publisher_id, c_acctbal AS balance FROM customer)",
}

#: Library cards made from parts: five shapes of citation, in SQL that both engines read.
CARD = """CASE p_partkey % 5
  WHEN 0 THEN 'Smith, John. Great Book ' || p_size || '. London: Penguin Press, ' || (1950 + p_size) || '. ISBN 0-306-' || lpad(CAST(p_partkey % 100000 AS STRING), 5, '0') || '-2; paper'
  WHEN 1 THEN 'Tale of ' || p_size || ' Rings / Tolkien, John. - London : Allen Unwin, ' || (1900 + p_size) || chr(10) || 'ISBN: 978-5-17-' || lpad(CAST(p_partkey % 1000000 AS STRING), 6, '0') || '-7'
  WHEN 2 THEN 'М' || p_size || ' Мифы Русского Севера. — Москва : Эксмо, ' || (1960 + p_size) || '. — 240 с.' || chr(10) || 'УДК 39(470.' || p_size || '/2)' || chr(10) || 'ББК 83.3(2=411.2)' || p_size || ',63.5' || chr(10) || 'ISBN 978-5-04-' || lpad(CAST(p_partkey % 1000000 AS STRING), 6, '0') || '-1 (Эксмо)'
  WHEN 3 THEN 'Чернин А. Д.' || chr(10) || 'А-' || p_size || ' Звезды и физика' || chr(10) || 'ИЗДАТЕЛЬСТВО' || chr(10) || 'Наука' || chr(10) || 'УДК: 523.' || p_size || chr(10) || 'СПб, ' || (1940 + p_size)
  ELSE 'К' || p_size || ' Куваев, О. М. — Территория : роман. — Москва : Азбука, ' || (1970 + p_size) || '. — 416 с. ISBN 5-352-0' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') || '-X, УДК 821.' || p_size || ' ББК 84(2Рос-Рус)6-' || p_size END"""
SQL["cards"] = f"cards AS (SELECT p_partkey AS doc_id, {CARD} AS text FROM part)"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(CARD).alias("text"))


# --- files --------------------------------------------------------------------------------------------------------------


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` as path, base (name without extension), priority (by extension), language and book (the last two folders), content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("base"),
        (F.array_position(F.lit(list(IMAGE_EXTENSIONS)), extension) - 1).alias("priority"),
        F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("language"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("book"),
        "content",
    )


def preferred_images(files: DataFrame) -> DataFrame:
    """One file per language, book and base: the one whose extension comes first."""
    known = files.where("priority >= 0")
    return known.groupBy("language", "book", "base").agg(F.min_by("path", "priority").alias("path"))


def golden_records(spark: SparkSession, path: str) -> DataFrame:
    """Expected records, one JSON object a file, with the case's language and book from the path."""
    rows = spark.read.schema(GOLDEN).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "expected.json").json(path)
    name = F.input_file_name()
    return rows.withColumns({"language": F.regexp_extract(name, r"([^/]+)/[^/]+/[^/]+$", 1), "book": F.regexp_extract(name, r"([^/]+)/[^/]+$", 1)})


def image_bytes(encoded: Column) -> Column:
    """Base64 text as binary; null where it is not Base64."""
    return F.try_to_binary(encoded, F.lit("base64"))

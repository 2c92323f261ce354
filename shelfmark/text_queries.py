"""Registered queries of the text, record, mutation and status operators and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalogue_queries import _ORDER, query
from .functions import text as t
from .operators import catalogue as c
from .operators import mutations as m
from .plans import records as r
from .sources import tables as s
from .streaming import status as st

# --- text functions over documents --------------------------------------------------------------------------------------

_ONE_LINE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_SENTENCES = (
    "list_transform(regexp_extract_all(" + _ONE_LINE.format("text") + r", '([^.!?]*[.!?])', 1), lambda x: trim(left(x, length(x) - 1)) || right(x, 1))"
)


@query(
    "clean_annotation",
    f"""WITH d AS (SELECT doc_id, {_SENTENCES} AS x FROM documents),
    e AS (SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) AS i FROM d), f AS (SELECT doc_id, sentence, min(i) AS i FROM e GROUP BY 1, 2)
    SELECT d.doc_id, coalesce(string_agg(sentence, ' ' ORDER BY i), '') AS annotation FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1""",
)
def _(spark, d):
    return s.table(spark, d, "documents").select("doc_id", t.clean_annotation(F.col("text")).alias("annotation"))


@query("normalize_strings", f"SELECT doc_id, {_ONE_LINE.format('text')} AS text FROM documents")
def _(spark, d):
    return s.table(spark, d, "documents").select("doc_id", t.one_line(F.col("text")).alias("text"))


@query("distinct_sentences", f"WITH e AS (SELECT doc_id, unnest({_SENTENCES}) AS x FROM documents) SELECT d.doc_id, count(DISTINCT x) AS n FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY 1")
def _(spark, d):
    found = F.size(F.array_distinct(t.sentences(F.col("text"))))
    return s.table(spark, d, "documents").select("doc_id", F.greatest(found, F.lit(0)).cast("long").alias("n"))


_LOOKS = "translate(lower({0}), 'abcehkmoptxy', 'авсенкмортху')"
_COMPARABLE = r"regexp_replace(" + _LOOKS + r", '[^\p{{L}}\p{{N}}_]', '', 'g')"


@query("compare_norm", f"SELECT doc_id, {_COMPARABLE.format('text')} AS text FROM documents")
def _(spark, d):
    return s.table(spark, d, "documents").select("doc_id", t.comparable(F.col("text")).alias("text"))


_CODE = "CASE p_partkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN ' 39 (470.' || p_size || ') ' WHEN 2 THEN '' ELSE '83.3(2=411.2)' || chr(9) || p_size END"


@query("normalize_classification", rf"WITH k AS (SELECT p_partkey, {_CODE} AS k FROM part) SELECT p_partkey, CASE WHEN k = '' OR lower(k) = 'unknown' THEN 'unknown' ELSE regexp_replace(k, '\s+', '', 'g') END AS code FROM k")
def _(spark, d):
    return s.table(spark, d, "part").select("p_partkey", t.normalize_code(F.expr(_CODE)).alias("code"))


_OLD = "CASE p_partkey % 3 WHEN 0 THEN 'домъ ' || p_size || ' Ѣздъ' WHEN 1 THEN 'объектъ, міръ ѵѳ' ELSE 'объект съ ' || p_size END"


@query("old_cyrillic", rf"SELECT p_partkey, regexp_replace(translate({_OLD}, 'ѢѣІіѴѵѲѳ', 'ЕеИиИиФф'), '[Ъъ]([^\p{{L}}\p{{N}}_]|\z)', '\1', 'g') AS text FROM part")
def _(spark, d):
    return s.table(spark, d, "part").select("p_partkey", t.modern_cyrillic(F.expr(_OLD)).alias("text"))


_NAME = "CASE p_partkey % 4 WHEN 0 THEN 'Куваев, Олег, ред.' WHEN 1 THEN 'Smith, John ' || p_size WHEN 2 THEN p_brand ELSE 'Толстой ,  Лев' END"


@query("normalize_author", f"WITH n AS (SELECT p_partkey, {_NAME} AS n FROM part) SELECT p_partkey, CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 1)) || ' ' || trim(split_part(n, ',', 2)) ELSE n END AS author FROM n")
def _(spark, d):
    return s.table(spark, d, "part").select("p_partkey", t.normalize_author(F.expr(_NAME)).alias("author"))


@query("split_authors", "SELECT book_id, string_agg(trim(x), '|' ORDER BY trim(x)) AS names FROM (SELECT book_id, unnest(string_split(rtrim(l, ','), ',')) AS x FROM (SELECT book_id, string_agg(CAST(author_id AS VARCHAR), ' , ' ORDER BY author_id) || ',,' AS l FROM book_authors GROUP BY 1)) GROUP BY 1", "book_authors")
def _(spark, d):
    listed = s.book_authors(spark, d).groupBy("book_id").agg(F.array_sort(F.collect_list("author_id")).alias("ids"))
    text = F.concat(F.array_join(F.transform("ids", lambda i: i.cast("string")), " , "), F.lit(",,"))
    return listed.select("book_id", F.array_join(F.array_sort(t.split_names(text)), "|").alias("names"))


_PAIR = (
    "CASE p_partkey % 8 WHEN 0 THEN 'Бобров Ю. Г.' WHEN 1 THEN 'Петрова А.Б.' WHEN 2 THEN 'Smith J.' WHEN 3 THEN 'Cox ' || substr(p_name, 1, 1) || '. B.' WHEN 4 THEN 'Coх, A' WHEN 5 THEN p_brand WHEN 6 THEN 'Lee ' || p_name ELSE p_type END",
    "CASE p_partkey % 8 WHEN 0 THEN 'Бобров Юрий Георгиевич' WHEN 1 THEN 'Петрова Анна Борисовна' WHEN 2 THEN 'smith  John' WHEN 3 THEN 'COX ' || substr(p_brand, 7, 1) || substr(p_name, 1, 2) || ' bo' WHEN 4 THEN 'cox a' WHEN 5 THEN lower(p_brand) WHEN 6 THEN 'Lee ' || substr(p_name, 1, 1) || '. ' || substr(p_type, 1, 1) END",
)


def _initials(parts: str) -> str:
    """Initials of the words after the first, as the SQL reads them."""
    bare = f"list_filter(list_transform({parts}[2:], lambda x: regexp_replace(x, '[.,]', '', 'g')), lambda x: x <> '')"
    return f"list_transform({bare}, lambda x: {_COMPARABLE.format('upper(left(x, 1))')})"


@query(
    "author_match",
    f"""WITH x AS (SELECT p_partkey, {_PAIR[0]} AS a, {_PAIR[1]} AS b FROM part), w AS (SELECT *, string_split({_ONE_LINE.format('a')}, ' ') AS pa, string_split({_ONE_LINE.format('b')}, ' ') AS pb FROM x)
    SELECT p_partkey, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE {_COMPARABLE.format('a')} = {_COMPARABLE.format('b')}
      OR ({_COMPARABLE.format('pa[1]')} = {_COMPARABLE.format('pb[1]')} AND {_initials('pa')} = {_initials('pb')}) END AS same FROM w""",
)
def _(spark, d):
    return s.table(spark, d, "part").select("p_partkey", t.same_author(F.expr(_PAIR[0]), F.expr(_PAIR[1])).alias("same"))


_TITLE = "CASE p_partkey % 6 WHEN 0 THEN 'All Rights Reserved ' || p_size WHEN 1 THEN 'М68 Змеи / К. Маттисон' WHEN 2 THEN 'Title ' || p_size || ' : Sub' WHEN 3 THEN 'Видения. — М.: Изд-во' WHEN 4 THEN 'unknown' ELSE p_name END"


@query("garbage_title", f"WITH x AS (SELECT p_partkey, {_TITLE} AS x FROM part) SELECT p_partkey, CASE WHEN regexp_matches(lower(x), 'copyright|trademark|reserved|indicia') THEN 'unknown' ELSE x END AS title FROM x")
def _(spark, d):
    return s.table(spark, d, "part").select("p_partkey", t.reject_garbage(F.expr(_TITLE)).alias("title"))


@query("title_cleanup", rf"WITH x AS (SELECT p_partkey, {_TITLE} AS x FROM part) SELECT p_partkey, CASE WHEN x = 'unknown' THEN x ELSE trim(regexp_replace(regexp_replace(regexp_replace(x, '^[А-ЯЁA-Z][\s\-]*[0-9]+\s+', ''), '(?s)\s*/.*', ''), '(?s)(\.\s*—|\s*:).*', '')) END AS title FROM x")
def _(spark, d):
    return s.table(spark, d, "part").select("p_partkey", t.clean_title(F.expr(_TITLE)).alias("title"))


_EMBEDDED = "CASE WHEN p_partkey % 2 = 0 THEN 'Куваев, Олег. - Территория ' || p_size ELSE p_name END"


@query("embedded_author", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Территория ' || p_size ELSE p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Куваев Олег' ELSE p_brand END AS author FROM part")
def _(spark, d):
    title, author = t.embedded_author(F.expr(_EMBEDDED), F.col("p_brand"))
    return s.table(spark, d, "part").select("p_partkey", title.alias("title"), author.alias("author"))


# --- extractors over library cards --------------------------------------------------------------------------------------

_E1, _E2 = t.ENGLISH
_SQL_ISBN = t.ISBN.replace("|$)", r"|\n?\z)")


def _sql_isbn(pattern: str) -> str:
    raw = f"upper(regexp_replace(regexp_extract(text, '{pattern}', 1, 'i'), '[^0-9Xx]', '', 'g'))"
    return f"CASE WHEN regexp_matches({raw}, '{t.ISBN_VALID}') THEN {raw} ELSE 'unknown' END"


_SQL_UDK = rf"CASE WHEN regexp_matches(text, '{t.UDK}') THEN regexp_replace(trim(regexp_extract(text, '{t.UDK}', 1), ' ' || chr(9) || chr(10)), '\s+', ' ', 'g') ELSE 'unknown' END"
_SQL_BBK = rf"CASE WHEN regexp_matches(text, '{t.BBK}') THEN regexp_replace(trim(regexp_extract(text, '{t.BBK}', 1), ' ' || chr(9) || chr(10)), '(?s)(\n|\s\s).*', '') ELSE 'unknown' END"


def _hit(pattern: str, group: int) -> str:
    return f"trim(regexp_extract(text, '{pattern}', {group}))"


_WITH_E = rf"""e AS (SELECT *, CASE WHEN regexp_matches(text, '{_E1}') THEN CASE WHEN contains(regexp_extract(text, '{_E1}', 0), '/') THEN 2 ELSE 1 END WHEN regexp_matches(text, '{_E2}') THEN 3 END AS k FROM cards),
    english AS (SELECT *, CASE k WHEN 1 THEN {_hit(_E1, 1)} WHEN 2 THEN {_hit(_E1, 2)} WHEN 3 THEN {_hit(_E2, 2)} END AS e_author, CASE k WHEN 1 THEN {_hit(_E1, 2)} WHEN 2 THEN {_hit(_E1, 1)} WHEN 3 THEN {_hit(_E2, 1)} END AS e_title,
      CASE WHEN k < 3 THEN {_hit(_E1, 3)} WHEN k = 3 THEN {_hit(_E2, 3)} END AS e_publisher, CASE WHEN k < 3 THEN CAST({_hit(_E1, 4)} AS INT) WHEN k = 3 THEN CAST({_hit(_E2, 4)} AS INT) END AS e_year FROM e),
    g AS (SELECT *, regexp_matches(text, '{t.CARD}') AS has, nullif({_hit(t.CARD, 1)}, '') AS g1 FROM english),
    entries AS (SELECT *, CASE WHEN contains(g1, ',') THEN trim(split_part(g1, ',', 1)) || ' ' || trim(split_part(g1, ',', 2)) ELSE g1 END AS c_author,
      CASE WHEN has THEN trim(regexp_replace({_hit(t.CARD, 2)}, '(?s)\s*[:/].*', '')) END AS c_title, CASE WHEN has THEN {_hit(t.CARD, 4)} END AS c_publisher, CASE WHEN has THEN CAST({_hit(t.CARD, 5)} AS INT) END AS c_year FROM g)"""


def _comma(x: str) -> str:
    return f"CASE WHEN contains({x}, ',') THEN trim(split_part({x}, ',', 1)) || ' ' || trim(split_part({x}, ',', 2)) ELSE {x} END"


_SQL_AUTHOR = "coalesce(nullif(e_author, ''), c_author, " + ", ".join(_comma(f"nullif(trim(regexp_extract(text, '{p}', 1)), '')") for p in t.AUTHORS) + ", 'unknown')"
_SQL_TITLE = rf"coalesce(e_title, c_title, nullif(regexp_replace({_hit(t.TITLE, 1)}, '(?s)\s*:.*', ''), ''), 'unknown')"
_SPACES = "' ' || chr(10) || chr(9)"
_SQL_PUBLISHER = "coalesce(e_publisher, c_publisher, " + ", ".join(f"nullif(trim(regexp_extract(text, '{p}', 1), {_SPACES}), '')" for p in t.PUBLISHERS) + ", 'unknown')"
_SQL_YEAR = f"coalesce(e_year, c_year, try_cast(nullif(regexp_extract(text, '{t.YEAR}', 1), '') AS INT), 0)"


def _cards(name: str, column: str, sql: str, f, entries: bool = False) -> None:
    @query(name, f"WITH {_WITH_E} SELECT doc_id, {sql} AS {column} FROM entries" if entries else f"SELECT doc_id, {sql} AS {column} FROM cards", "cards")
    def _(spark, d):
        rows = s.cards(spark, d)
        if entries:
            rows = r.with_entries(rows)
            return rows.select("doc_id", f(F.col("text"), F.col("_english"), F.col("_card")).alias(column))
        return rows.select("doc_id", f(F.col("text")).alias(column))


_cards("extract_isbn", "isbn", _sql_isbn(_SQL_ISBN), t.extract_isbn)
_cards("extract_isbn_legacy", "isbn", _sql_isbn(t.ISBN_LEGACY), t.extract_isbn_legacy)
_cards("extract_udk", "udk", _SQL_UDK, t.extract_udk)
_cards("extract_bbk", "bbk", _SQL_BBK, t.extract_bbk)
_cards("extract_udk_legacy", "udk", f"coalesce(nullif(regexp_extract(text, '{t.UDK_LEGACY}', 1), ''), 'unknown')", t.extract_udk_legacy)
_cards("extract_bbk_legacy", "bbk", f"coalesce(nullif(regexp_extract(text, '{t.BBK_LEGACY}', 1), ''), 'unknown')", t.extract_bbk_legacy)
_cards("extract_author_legacy", "author", "coalesce(" + ", ".join(_comma(f"nullif(regexp_extract(text, '{p}', 1), '')") for p in t.AUTHORS_LEGACY) + ", 'unknown')", t.extract_author_legacy)
_cards("extract_author", "author", _SQL_AUTHOR, t.extract_author, True)
_cards("extract_title", "title", _SQL_TITLE, t.extract_title, True)
_cards("extract_publisher", "publisher", _SQL_PUBLISHER, t.extract_publisher, True)
_cards("extract_year", "year", _SQL_YEAR, t.extract_year, True)


@query("entry_english", f"WITH {_WITH_E} SELECT doc_id, e_author AS author, e_title AS title, e_publisher AS publisher, e_year AS year FROM entries WHERE k IS NOT NULL", "cards")
def _(spark, d):
    return s.cards(spark, d).select("doc_id", t.english_entry(F.col("text")).alias("e")).where("e IS NOT NULL").select("doc_id", "e.author", "e.title", "e.publisher", "e.year")


@query("entry_card", f"WITH {_WITH_E} SELECT doc_id, c_author AS author, c_title AS title, c_publisher AS publisher, c_year AS year FROM entries WHERE has", "cards")
def _(spark, d):
    return s.cards(spark, d).select("doc_id", t.card_entry(F.col("text")).alias("e")).where("e IS NOT NULL").select("doc_id", "e.author", "e.title", "e.publisher", "e.year")


_SHOWN = "CASE p_partkey % 4 WHEN 0 THEN '978-5-389-' || lpad(CAST(p_partkey % 100000 AS STRING), 5, '0') || '-7 (Азбука)' WHEN 1 THEN '978 0 7475 3274 3' WHEN 2 THEN '5-352-0110' || (p_size % 10) || '-x; pbk' ELSE 'ISBN unknown' END"


@query("isbn_final", rf"WITH x AS (SELECT p_partkey, upper(regexp_replace(regexp_replace({_SHOWN}, '(?s)\s*[(;,].*', ''), '[^0-9Xx\-]', '', 'g')) AS x FROM part) SELECT p_partkey, CASE WHEN regexp_matches(replace(x, '-', ''), '{t.ISBN_VALID}') THEN x ELSE 'unknown' END AS isbn FROM x")
def _(spark, d):
    return s.table(spark, d, "part").select("p_partkey", t.final_isbn(F.expr(_SHOWN)).alias("isbn"))


# --- records ------------------------------------------------------------------------------------------------------------

_CLEAN_TITLE = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '^[А-ЯЁA-Z][\s\-]*[0-9]+\s+', ''), '(?s)\s*/.*', ''), '(?s)(\.\s*—|\s*:).*', ''))"
_RECORDS = rf"""{_WITH_E},
    hints AS (SELECT doc_id, text, {_SQL_TITLE} AS title, {_SQL_AUTHOR} AS author, {_SQL_PUBLISHER} AS publisher, {_SQL_YEAR} AS year, {_sql_isbn(_SQL_ISBN)} AS isbn, {_SQL_UDK} AS udk, {_SQL_BBK} AS bbk FROM entries),
    records AS (SELECT doc_id, text, CASE WHEN title = 'unknown' THEN title ELSE {_ONE_LINE.format(_CLEAN_TITLE.format('title'))} END AS title, {_ONE_LINE.format('author')} AS author, {_ONE_LINE.format('publisher')} AS publisher, year, isbn,
      regexp_replace(udk, '\s+', '', 'g') AS udk, regexp_replace(bbk, '\s+', '', 'g') AS bbk, '' AS annotation FROM hints)"""


@query("regex_only_record", f"WITH {_RECORDS} SELECT doc_id, title, author, publisher, year, isbn, udk, bbk, annotation FROM records", "cards")
def _(spark, d):
    return r.regex_records(s.cards(spark, d))


_REPLY = """CASE p_partkey % 4 WHEN 0 THEN '```json' || chr(10) || '{"title": "Reply ' || p_size || '", "author": "Kim A.", "year": ' || CASE p_size % 3 WHEN 0 THEN '1990' WHEN 1 THEN '"1990"' ELSE '1990.5' END || '}' || chr(10) || '```' WHEN 1 THEN 'no object' WHEN 2 THEN '{"title": "Cut ' ELSE 'Here: {"title": "X : y", "author": null, "isbn": "0-306-40615-2", "annotation": "A. B! A. tail"} done' END"""


@query("parse_reply_json", rf"WITH x AS (SELECT p_partkey, {_REPLY} AS x FROM part), j AS (SELECT p_partkey, nullif(regexp_extract(x, '(?s)(\{{.*\}})', 1), '') AS j FROM x) SELECT p_partkey, json_extract_string(j, '$.title') AS title, json_extract_string(j, '$.author') AS author, j IS NOT NULL AS found FROM j")
def _(spark, d):
    found = s.table(spark, d, "part").select("p_partkey", t.extract_json(F.expr(_REPLY)).alias("j"))
    return found.select("p_partkey", F.get_json_object("j", "$.title").alias("title"), F.get_json_object("j", "$.author").alias("author"), F.col("j").isNotNull().alias("found"))


_REPLY_OF_CARD = _REPLY.replace("p_partkey", "doc_id").replace("p_size", "(doc_id % 9)")


@query(
    "reply_or_regex",
    f"""WITH {_RECORDS} SELECT doc_id,
      CASE doc_id % 4 WHEN 0 THEN 'Reply ' || (doc_id % 9) WHEN 3 THEN 'X' ELSE title END AS title, CASE doc_id % 4 WHEN 0 THEN 'Kim A.' WHEN 3 THEN 'unknown' ELSE author END AS author,
      CASE WHEN doc_id % 4 IN (0, 3) THEN 'unknown' ELSE publisher END AS publisher, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 9 % 3 = 0 THEN 1990 ELSE 0 END WHEN 3 THEN 0 ELSE year END AS year, CASE doc_id % 4 WHEN 3 THEN '0-306-40615-2' ELSE isbn END AS isbn,
      udk, bbk, CASE doc_id % 4 WHEN 3 THEN 'A. B!' ELSE '' END AS annotation, CASE WHEN doc_id % 4 IN (0, 3) THEN 'reply' ELSE 'patterns' END AS source FROM records""",
    "cards",
)
def _(spark, d):
    return r.records(s.cards(spark, d).withColumn("reply", F.expr(_REPLY_OF_CARD)))


@query(
    "cover_info_merge",
    f"""WITH {_RECORDS}, cover AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Cover ' || doc_id ELSE 'unknown' END AS title, 'Cover Author' AS author FROM records)
    SELECT i.doc_id, coalesce(nullif(CASE WHEN i.doc_id % 3 = 0 THEN 'unknown' ELSE i.title END, 'unknown'), nullif(c.title, 'unknown'), 'unknown') AS title, coalesce(nullif(i.author, 'unknown'), c.author) AS author,
      publisher, isbn, udk, bbk, year, 1 AS n_authors FROM records i JOIN cover c ON c.doc_id = i.doc_id""",
    "cards",
)
def _(spark, d):
    info = r.regex_records(s.cards(spark, d)).withColumn("title", F.when(F.col("doc_id") % 3 == 0, t.UNKNOWN).otherwise(F.col("title")))
    cover = s.cards(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Cover "), "doc_id")).otherwise(t.UNKNOWN).alias("title"), F.lit("Cover Author").alias("author"))
    return r.merged(info, cover).withColumn("n_authors", F.size("authors")).drop("authors")


@query(
    "field_compare",
    f"""WITH {_RECORDS}, pairs AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN upper(title) ELSE title || '!' END AS e_title, CASE WHEN doc_id % 2 = 0 THEN year ELSE year + 1 END AS e_year FROM records)
    SELECT doc_id, f.field, CASE f.field WHEN 'year' THEN year = e_year WHEN 'title' THEN {_COMPARABLE.format('title')} = {_COMPARABLE.format('e_title')} ELSE true END AS same
    FROM pairs, (VALUES ('title'), ('author'), ('publisher'), ('year'), ('isbn'), ('udk'), ('bbk')) AS f(field)""",
    "cards",
)
def _(spark, d):
    actual = r.regex_records(s.cards(spark, d))
    expected = actual.withColumns({"title": F.when(F.col("doc_id") % 3 == 0, F.upper("title")).otherwise(F.concat("title", F.lit("!"))), "year": F.when(F.col("doc_id") % 2 == 0, F.col("year")).otherwise(F.col("year") + 1)})
    return r.compared(actual, expected)


@query("cases_passed", f"WITH {_RECORDS} SELECT doc_id, doc_id % 2 = 0 AS passed FROM records", "cards")
def _(spark, d):
    actual = r.regex_records(s.cards(spark, d))
    expected = actual.withColumn("year", F.when(F.col("doc_id") % 2 == 0, F.col("year")).otherwise(F.col("year") + 1))
    return r.all_same(r.compared(actual, expected))


@query("concat_pages", "SELECT conv_id AS doc_id, string_agg('--- ' || upper(role) || ' ' || (turn + 1) || ' ---' || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def _(spark, d):
    pieces = s.table(spark, d, "conversations").withColumnRenamed("conv_id", "doc_id")
    return r.assembled(pieces, "doc_id", "turn", F.concat(F.lit("--- "), F.upper("role"), F.lit(" "), F.col("turn") + 1, F.lit(" ---")))


_WORDS = r"words AS (SELECT doc_id, block, i AS pos, w[i] AS word FROM (SELECT doc_id, b AS block, string_split(l[b], ' ') AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(b)), unnest(range(1, len(w) + 1)) AS u(i))"
_BLOCKS = rf"WITH {_WORDS}, blocks AS (SELECT doc_id, block, min(pos) AS first, string_agg(word, ' ' ORDER BY pos) AS text FROM words WHERE trim(word) <> '' GROUP BY 1, 2)"


def _found_blocks(spark, d):
    lines = s.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    words = lines.select("doc_id", (F.col("block") + 1).cast("long").alias("block"), F.posexplode(F.split("line", " ")).alias("pos", "word")).withColumn("pos", (F.col("pos") + 1).cast("long"))
    return r.blocks(words, "doc_id", "block")


@query("block_group", _BLOCKS + " SELECT * FROM blocks")
def _(spark, d):
    return _found_blocks(spark, d)


_SCORE = r"(CASE WHEN regexp_matches(text, '[А-ЯЁ][а-яё]+,\s*[А-ЯЁ]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '[—\-:]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '\b(19|20)[0-9][0-9]\b') THEN 1 ELSE 0 END + CASE WHEN contains(text, '/') THEN 1 ELSE 0 END + CASE WHEN length(text) > 80 THEN 1 ELSE 0 END)"


@query("block_score", f"SELECT doc_id, {_SCORE} AS score FROM cards", "cards")
def _(spark, d):
    return s.cards(spark, d).select("doc_id", t.block_score(F.col("text")).alias("score"))


@query("primary_block", _BLOCKS + f", scored AS (SELECT *, {_SCORE} AS score FROM blocks) SELECT doc_id, CASE WHEN max(length(text)) FILTER (score >= 1) >= 60 THEN first(text ORDER BY length(text) DESC, block) FILTER (score >= 1) ELSE string_agg(text, ' ' ORDER BY block) END AS text FROM scored GROUP BY 1")
def _(spark, d):
    return r.primary_text(_found_blocks(spark, d).select("doc_id", F.col("block").alias("first"), "text"), "doc_id", 1)


@query("json_navigation", "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.missing'), 'unknown') AS missing FROM events")
def _(spark, d):
    return s.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit(t.UNKNOWN)).alias("missing"))


@query("prompt_text", f"WITH {_RECORDS}, p AS (SELECT doc_id, text, {_SQL_AUTHOR} AS a, {_sql_isbn(_SQL_ISBN)} AS i, {_SQL_UDK} AS u, {_SQL_BBK} AS b FROM entries) SELECT doc_id, printf('{r.PROMPT}', a, i, u, b, text) AS prompt, printf('{r.COVER_PROMPT}', text) AS cover_prompt FROM p", "cards")
def _(spark, d):
    return r.prompts(r.hints(s.cards(spark, d))).select("doc_id", "prompt", "cover_prompt")


@query(
    "phased_candidate_pick",
    """WITH c AS (SELECT conv_id, turn, text, length(text) AS n, turn // 2 AS phase FROM conversations),
    m AS (SELECT *, max(n) OVER (PARTITION BY conv_id ORDER BY phase RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
    SELECT conv_id, CASE WHEN max(n) >= 900 THEN first(text ORDER BY n < 900, turn) ELSE first(text ORDER BY n DESC, turn) END AS text FROM m WHERE coalesce(before, 0) < 500 GROUP BY 1""",
)
def _(spark, d):
    turns = s.table(spark, d, "conversations").withColumn("phase", F.expr("turn div 2"))
    return c.phased_pick(turns, "conv_id", "phase", "turn", "text", 900, 500)


@query("key_value_setting", "SELECT n_nationkey, coalesce(nullif(n_name, 'FRANCE'), 'rus') AS value FROM nation")
def _(spark, d):
    """A settings table read by key with a default."""
    return s.table(spark, d, "nation").select("n_nationkey", F.coalesce(F.nullif("n_name", F.lit("FRANCE")), F.lit("rus")).alias("value"))


@query("status_map", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS progress FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    """A map per key, built by upserts: the last value of each state wins (here its count)."""
    counts = s.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return maps.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("progress"))


# --- mutations ----------------------------------------------------------------------------------------------------------


@query("get_or_create_publisher", "WITH new AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT IN (SELECT name FROM publishers)) SELECT CAST(id AS BIGINT) AS id, name FROM publishers UNION ALL SELECT CAST((SELECT max(id) FROM publishers) + row_number() OVER (ORDER BY name) AS BIGINT), name FROM new", "publishers")
def _(spark, d):
    return m.get_or_create(s.publishers(spark, d), s.table(spark, d, "part").select(F.col("p_brand").alias("name")))


@query("get_or_create_authors", "WITH x AS (SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer), new AS (SELECT name FROM x WHERE name NOT IN (SELECT name FROM authors)) SELECT CAST(id AS BIGINT) AS id, name FROM authors UNION ALL SELECT CAST((SELECT max(id) FROM authors) + row_number() OVER (ORDER BY name) AS BIGINT), name FROM new", "authors")
def _(spark, d):
    names = s.authors(spark, d).select("name").unionByName(s.shelves(spark, d).select("name"))
    return m.get_or_create(s.authors(spark, d), names)


_OLD_BOOK = "SELECT id, title, 'isbn ' || id AS isbn, CAST(year(created_at) AS INT) AS year, 'udk' AS udk FROM books"
_UPDATE = "SELECT id, CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'unknown' END AS title, CASE WHEN id % 2 = 0 THEN 'new' END AS isbn, CASE WHEN id % 5 = 0 THEN 2000 END AS year, CASE WHEN id % 2 = 0 THEN 'unknown' ELSE '821' END AS udk FROM books WHERE status <> 'PENDING'"


@query("conditional_update", f"WITH o AS ({_OLD_BOOK}), u AS ({_UPDATE}) SELECT o.id, coalesce(nullif(u.title, ''), o.title) AS title, coalesce(nullif(u.isbn, ''), o.isbn) AS isbn, coalesce(u.year, o.year) AS year, coalesce(nullif(nullif(u.udk, ''), 'unknown'), o.udk) AS udk FROM o LEFT JOIN u ON u.id = o.id", "books")
def _(spark, d):
    books = s.books(spark, d)
    old = books.select("id", "title", F.concat(F.lit("isbn "), "id").alias("isbn"), F.year("created_at").alias("year"), F.lit("udk").alias("udk"))
    i = F.col("id")
    update = books.where("status <> 'PENDING'").select(
        "id", F.when(i % 3 == 0, "").when(i % 3 == 1, t.UNKNOWN).alias("title"), F.when(i % 2 == 0, "new").alias("isbn"), F.when(i % 5 == 0, 2000).alias("year"), F.when(i % 2 == 0, t.UNKNOWN).otherwise("821").alias("udk")
    )
    return m.conditional_update(old, update)


@query("status_update", "SELECT id, CASE WHEN shelf_id = 5 THEN 'SENT' ELSE status END AS status FROM books", "books")
def _(spark, d):
    return m.set_where(s.books(spark, d).select("id", "status", "shelf_id"), F.col("shelf_id") == 5, "status", F.lit(st.SENT)).drop("shelf_id")


@query("whole_row_update", "SELECT id, CASE WHEN shelf_id IS NULL THEN 'Moved' ELSE title END AS title FROM books", "books")
def _(spark, d):
    books = s.books(spark, d)
    return m.replaced_rows(books.select("id", "title"), books.where("shelf_id IS NULL").select("id", F.lit("Moved").alias("title")), "id")


@query("replace_authors", "WITH new AS (SELECT DISTINCT book_id, 1 AS author_id FROM book_authors WHERE author_id = 7) SELECT book_id, author_id FROM book_authors WHERE book_id NOT IN (SELECT book_id FROM new) UNION SELECT book_id, author_id FROM new", "book_authors")
def _(spark, d):
    links = s.book_authors(spark, d)
    return m.replaced_links(links, links.where("author_id = 7").select("book_id", F.lit(1).cast("long").alias("author_id")), "book_id")


@query("purge_processed", "SELECT id, status FROM books WHERE status <> 'PROCESSED'", "books")
def _(spark, d):
    books = s.books(spark, d).select("id", "status")
    return m.deleted(books, books.where("status = 'PROCESSED'"), "id")


@query("cascade_delete_pages", f"SELECT book_id, {_ORDER} FROM pages WHERE book_id NOT IN (SELECT id FROM books WHERE status = 'PROCESSED')", "pages", "books")
def _(spark, d):
    gone = s.books(spark, d).where("status = 'PROCESSED'")
    return m.deleted(s.pages(spark, d).select("book_id", *c.PAGE_ORDER), gone, "book_id", "id")


@query("bulk_delete", "SELECT id FROM books WHERE id NOT IN (SELECT l_partkey FROM lineitem)", "books")
def _(spark, d):
    return m.deleted(s.books(spark, d).select("id"), s.table(spark, d, "lineitem"), "id", "l_partkey")


# --- states and streams -------------------------------------------------------------------------------------------------

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@query("latest_state", "SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type, max(event_id) AS last_id FROM events GROUP BY 1")
def _(spark, d):
    events = s.table(spark, d, "events")
    out = st.latest(events, "user_id", "event_type", F.struct("ts", "event_id"))
    return out.select("user_id", "event_type").join(events.groupBy("user_id").agg(F.max("event_id").alias("last_id")), "user_id")


_KIND = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'send' WHEN 'error' THEN 'error' ELSE 'view' END"


@query("status_machine", f"WITH e AS (SELECT user_id, {_KIND} AS e FROM events) SELECT user_id, CASE WHEN bool_or(e = 'success') THEN 'PROCESSED' WHEN bool_or(e IN ('send', 'error')) THEN 'SENT' ELSE 'PENDING' END AS state, count(*) AS n_events, count(*) FILTER (e = 'error') AS n_errors FROM e GROUP BY 1")
def _(spark, d):
    return st.advanced(s.table(spark, d, "events").select("user_id", F.expr(_KIND).alias("e")), "user_id", "e")


@query("progress_map", "SELECT user_id, event_type, max(value) AS top FROM events GROUP BY 1, 2")
def _(spark, d):
    return s.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))


@query("streamed_state", "SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type FROM events GROUP BY 1")
def _(spark, d):
    """The latest state as a stream over the events' file, run to its end."""
    folder = st.checkpoint_folder(spark)
    # A file source reads folders, so a glob that matches the one file stands for the landing folder.
    stream = st.stream_of(spark, f"{d}/events.parque[t]", _EVENTS)
    name = f"states_{uuid.uuid4().hex}"
    return st.run_to_end(st.latest(stream, "user_id", "event_type", F.struct("ts", "event_id")).select("user_id", "event_type"), name, f"{folder}/{name}")


@query("list_diff", "WITH a AS (SELECT id, status, price FROM books WHERE id % 5 <> 0), b AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'SENT' ELSE status END AS status, price FROM books WHERE id % 6 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status", "books")
def _(spark, d):
    # Two snapshots of the table: one lacks every fifth book, the other every sixth, with some states changed.
    books = s.books(spark, d).select("id", "status", "price")
    later = m.set_where(books.where("id % 6 <> 0"), F.col("id") % 7 == 0, "status", F.lit(st.SENT))
    return c.snapshot_diff(books.where("id % 5 <> 0"), later, "id")


# --- sets and geometry --------------------------------------------------------------------------------------------------


@query("shelf_selector_rows", "SELECT NULL AS id, 'All Books' AS name UNION ALL SELECT -1, 'No Shelf' UNION ALL SELECT id, name FROM shelves", "shelves")
def _(spark, d):
    return c.selector(s.shelves(spark, d))


@query("append_lists", "SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer")
def _(spark, d):
    return s.authors(spark, d).select("name").unionAll(s.shelves(spark, d).select("name"))


@query("position_in_list", "SELECT o.id, coalesce(p.place, -1) AS place FROM books o LEFT JOIN (SELECT id, row_number() OVER (ORDER BY name, id) - 1 AS place FROM shelves) p ON p.id = o.shelf_id", "books", "shelves")
def _(spark, d):
    shelves = m.ranked(s.shelves(spark, d).select("id", F.concat("name", F.lit(" "), F.lpad(F.col("id").cast("string"), 20, "0")).alias("name")), "name", "n")
    place = shelves.select(F.col("id").alias("shelf_id"), (F.col("n") - 1).cast("long").alias("place"))
    return s.books(spark, d).select("id", "shelf_id").join(place, "shelf_id", "left").select("id", F.coalesce("place", F.lit(-1).cast("long")).alias("place"))


@query("latest_per_key_map", "SELECT user_id, count(DISTINCT event_type) AS n_states FROM events GROUP BY 1")
def _(spark, d):
    return s.table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n_states"))


_DIMS = "p_partkey * 3 AS w, p_size * 40 + 1 AS h"


@query("scaled_dims", f"WITH x AS (SELECT p_partkey, {_DIMS} FROM part) SELECT p_partkey, CASE WHEN greatest(w, h) <= 800 THEN w ELSE w * 800 // greatest(w, h) END AS width, CASE WHEN greatest(w, h) <= 800 THEN h ELSE h * 800 // greatest(w, h) END AS height FROM x")
def _(spark, d):
    dims = s.table(spark, d, "part").selectExpr("p_partkey", "p_partkey * 3 AS w", "CAST(p_size * 40 + 1 AS BIGINT) AS h")
    width, height = c.scaled(F.col("w"), F.col("h"), 800)
    return dims.select("p_partkey", width.alias("width"), height.alias("height"))


@query("corner_order", "SELECT p_partkey, CAST(p_size AS BIGINT) AS left_x, CAST(p_size + 100 AS BIGINT) AS right_x, CAST(100 AS BIGINT) AS width, CAST(p_size + 200 AS BIGINT) AS height FROM part")
def _(spark, d):
    corner = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    shuffled = F.array(corner("p_size + 100", "p_size + 210"), corner("p_size", "10"), corner("p_size", "p_size + 210"), corner("p_size + 100", "10"))
    found = s.table(spark, d, "part").select("p_partkey", c.ordered_corners(shuffled).alias("k"))
    width, height = c.warp_size(F.col("k"))
    return found.select("p_partkey", F.get("k", F.lit(0))["x"].cast("long").alias("left_x"), F.get("k", F.lit(1))["x"].cast("long").alias("right_x"), width.cast("long").alias("width"), height.cast("long").alias("height"))

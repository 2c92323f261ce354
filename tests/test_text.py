"""Hand-written cases of the text functions; expectations were derived by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as t
from shelfmark.plans import records as r

CASES = [
    (t.extract_isbn, "ISBN 978-5-17-123456-7", "9785171234567"),
    (t.extract_isbn, "ISBN: 978-5-17-123456-7", "9785171234567"),
    (t.extract_isbn, "ISBN 0-306-40615-2", "0306406152"),
    (t.extract_isbn, "isbn 978-5-17-123456-7", "9785171234567"),
    (t.extract_isbn, "Text before ISBN 978-5-17-123456-7 text after", "unknown"),
    (t.extract_isbn, "ISBN-13: 978-5-17-123456-7", "unknown"),
    (t.extract_isbn, "ISBN 978-5-389-11493-7 (X)", "9785389114937"),
    (t.extract_isbn, "ISBN 5-352-01102-X", "535201102X"),
    (t.extract_isbn, "ISBN 5-352-01102-Х", "unknown"),
    (t.extract_isbn, None, "unknown"),
    (t.extract_isbn_legacy, "Text before ISBN 978-5-17-123456-7 text after", "9785171234567"),
    (t.extract_isbn_legacy, "ISBN-13: 978-5-17-123456-7", "9785171234567"),
    (t.extract_isbn_legacy, "ISBN 978-5-17-123456-7\n2021", "unknown"),
    (t.extract_udk, "УДК: 39(470.1/2)  + 5\nтекст", "39(470.1/2) + 5"),
    (t.extract_udk_legacy, "УДК 39(470.1/2)", "39(470.1"),
    (t.extract_bbk, "ББК 83.3(2=411.2)53,63.5\nтекст", "83.3(2=411.2)53,63.5"),
    (t.extract_bbk_legacy, "ББК 83.3(2=411.2)53,63.5", "83.3(2=411.2)53"),
    (t.normalize_author, "Куваев, Олег, ред.", "Куваев Олег"),
    (t.normalize_author, "Бобров Ю. Г.", "Бобров Ю. Г."),
    (t.extract_author_legacy, "x\nКуваев, Олег\ny", "Куваев Олег"),
    (t.clean_annotation, "A. B! A. tail", "A. B!"),
    (t.clean_annotation, "unknown", ""),
    (t.clean_annotation, None, "unknown"),
    (t.clean_annotation, "", "unknown"),
    (t.clean_annotation, "10.5\n x.", "10. 5 x."),
    (t.clean_annotation, "A .", "A."),
    (t.clean_title, "М68 Змеи / К. Маттисон", "Змеи"),
    (t.clean_title, "Title : Sub", "Title"),
    (t.clean_title, "Видения страшного суда. — М.: Изд-во", "Видения страшного суда"),
    (t.reject_garbage, "All Rights Reserved", "unknown"),
    (t.modern_cyrillic, "домъ", "дом"),
    (t.modern_cyrillic, "объект", "объект"),
    (t.modern_cyrillic, "Ѣхать въ міръ", "Ехать в мир"),
    (t.final_isbn, "978-5-389-11493-7 (Азбука)", "978-5-389-11493-7"),
    (t.final_isbn, "978 0 7475 3274 3", "9780747532743"),
    (t.final_isbn, "12", "unknown"),
    (t.normalize_code, " 84 (2) ", "84(2)"),
    (t.normalize_code, "UNKNOWN", "unknown"),
    (t.one_line, " a\n\t b ", "a b"),
    (t.comparable, "ABC-д ½_", "авсд½_"),
    (t.comparable_isbn, "5-352-x", "5352X"),
    (t.extract_json, '```json\n{"a": 1}\n```', '{"a": 1}'),
    (t.extract_json, "none", None),
    (t.blank_to_null, " ", None),
    (t.blank_to_null, " a ", " a "),
]


def test_text_functions(spark):
    frame = spark.createDataFrame([(k, c[1]) for k, c in enumerate(CASES)], "k int, x string").repartition(1)
    got = frame.select("k", F.coalesce(*(F.when(F.col("k") == k, c[0](F.col("x"))) for k, c in enumerate(CASES))).alias("y")).collect()
    found = {row["k"]: row["y"] for row in got}
    assert [(c[1], found[k]) for k, c in enumerate(CASES)] == [(c[1], c[2]) for c in CASES]


AUTHORS = [
    ("Бобров Ю. Г.", "Бобров Юрий Георгиевич", True),
    ("Петрова А.Б.", "Петрова Анна Борисовна", False),
    ("Smith", "Smith John", False),
    (None, None, True),
    (None, "Smith", False),
    ("smith j.", "SMITH John", True),
]


def test_author_match(spark):
    frame = spark.createDataFrame(AUTHORS, "a string, b string, want boolean")
    assert frame.where(~t.same_author(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).collect() == []


ENTRIES = [
    ("Rowling, J.K. Harry Potter and the Philosopher's Stone. London: Bloomsbury, 1997.", None),
    ("Smith, John. Great Book. London: Penguin Press, 1999.", ("Smith, John", "Great Book", "Penguin Press", 1999)),
    ("The Tale / Tolkien. - London : Allen, 1954.", ("Tolkien", "The Tale", "Allen", 1954)),
    ("", None),
    (None, None),
]
CARDS = [
    ("М68 Мифы Русского Севера, Сибири и Дальнего Востока. — Москва : Эксмо, 2024. — 240 с.", (None, "Мифы Русского Севера, Сибири и Дальнего Востока", "Эксмо", 2024)),
    ("К89 Куваев, О. М. — Территория : роман. — Москва : Азбука, 2020. — 416 с.", ("Куваев О. М.", "Территория", "Азбука", 2020)),
    ("no card", None),
]


@pytest.mark.parametrize(("entry", "cases"), [(t.english_entry, ENTRIES), (t.card_entry, CARDS)])
def test_entries(spark, entry, cases):
    frame = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, x string")
    got = {row["k"]: row["e"] and tuple(row["e"]) for row in frame.select("k", entry(F.col("x")).alias("e")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1] for c in cases]


def test_records_fall_back_and_merge(spark):
    rows = [(1, "Smith, John. Great Book. London: Penguin Press, 1999.", "broken {"), (2, "", '{"title": "A : b", "year": "1997"}'), (3, None, None)]
    years = ["1997", "1997.0", "null", "true", "[1]", "-5", "99999999999"]
    rows += [(10 + k, "", '{"year": ' + year + "}") for k, year in enumerate(years)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, reply string")
    got = {row["doc_id"]: row for row in r.records(frame).collect()}
    assert (got[1]["title"], got[1]["year"], got[1]["source"]) == ("Great Book", 1999, "patterns")
    assert (got[2]["title"], got[2]["year"], got[2]["source"]) == ("A", 0, "reply")  # a quoted year is no integer
    assert [got[10 + k]["year"] for k in range(len(years))] == [1997, 0, 0, 1, 0, -5, 0]
    assert (got[3]["title"], got[3]["isbn"], got[3]["year"]) == ("unknown", "unknown", 0)
    info = spark.createDataFrame([(1, "unknown", "unknown", "unknown", "i", "u", "b", 0)], "doc_id int, title string, author string, publisher string, isbn string, udk string, bbk string, year int")
    cover = spark.createDataFrame([(1, "X", "unknown"), (2, "Y", "Z")], "doc_id int, title string, author string")
    merged = {row["doc_id"]: row for row in r.merged(info, cover).collect()}
    assert (merged[1]["title"], merged[1]["publisher"], merged[1]["authors"]) == ("X", "unknown", [])
    assert (merged[2]["title"], merged[2]["authors"]) == ("Y", ["Z"])

"""Operators that queries on the tables do not reach: files, streams, swaps, errors."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalogue as c
from shelfmark.operators import mutations as m
from shelfmark.sources import tables as s
from shelfmark.streaming import status as st


def test_image_files_and_golden_records(spark, tmp_path):
    for path, body in {"rus/a/cover.png": "p", "rus/a/cover.jpg": "j", "eng/b/cover.jfif": "f", "eng/b/note.txt": "t", "eng/b/expected.json": '{"title": "T",\n "year": 1997}'}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(body)
    chosen = s.preferred_images(s.image_files(spark, str(tmp_path))).collect()
    assert sorted((r["language"], r["book"], r["path"].rsplit("/", 1)[1]) for r in chosen) == [("eng", "b", "cover.jfif"), ("rus", "a", "cover.jpg")]
    golden = s.golden_records(spark, str(tmp_path)).collect()
    assert [(r["title"], r["year"], r["language"], r["book"]) for r in golden] == [("T", 1997, "eng", "b")]


def test_base64(spark):
    row = spark.createDataFrame([("aGk=", "***")], "a string, b string").select(s.image_bytes(F.col("a")).alias("a"), s.image_bytes(F.col("b")).alias("b")).first()
    assert (bytes(row["a"]), row["b"]) == (b"hi", None)


def test_required_row(spark):
    frame = spark.createDataFrame([(1, "a")], "id int, name string")
    assert c.required(frame, "id", 1).collect() == [(1, "a")]
    with pytest.raises(Exception, match="no row has id = 2"):
        c.required(frame, "id", 2).collect()


def test_size_guard_is_inclusive(spark):
    sizes = spark.createDataFrame([(0,), (1,), (10,), (11,)], "n int").withColumn("x", F.encode(F.repeat(F.lit("a"), F.col("n")), "UTF-8"))
    assert [r["n"] for r in sizes.where(c.displayable(F.col("x"), 10)).orderBy("n").collect()] == [1, 10]


def test_status_sequence_in_batch_and_stream(spark, tmp_path):
    rows = [(1, 1, "SENT"), (2, 2, "SENT"), (1, 3, "PROCESSED")]
    schema = "book_id long, seq int, status string"
    frame = spark.createDataFrame(rows, schema)
    want = {1: "PROCESSED", 2: "SENT"}
    assert {r["book_id"]: r["status"] for r in st.latest(frame, "book_id", "status", F.col("seq")).collect()} == want
    frame.write.parquet(str(tmp_path / "in"))
    stream = st.stream_of(spark, str(tmp_path / "in"), schema)
    table = st.run_to_end(st.latest(stream, "book_id", "status", F.col("seq")), "states", str(tmp_path / "state"))
    assert {r["book_id"]: r["status"] for r in table.collect()} == want
    st.enrich_to(st.stream_of(spark, str(tmp_path / "in"), schema), lambda b: b.withColumn("done", F.lit(True)), str(tmp_path / "out"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_swap_and_edits(spark, tmp_path):
    path = str(tmp_path / "books")
    m.swap_in(spark.range(3), path)
    m.swap_in(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    links = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "book_id int, author_id int")
    new = spark.createDataFrame([(1, 11)], "book_id int, author_id int")
    touched = spark.createDataFrame([(1,), (2,)], "book_id int")
    assert sorted(m.replaced_links(links, new, "book_id").collect()) == [(1, 11), (2, 20), (3, 30)]
    assert sorted(m.replaced_links(links, new, "book_id", True, touched).collect()) == [(1, 11), (3, 30)]


def test_shelf_filters_and_empty_tables(spark):
    books = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id int, shelf_id int")
    assert [c.on_shelf(books, x).count() for x in (None, -1, 5)] == [3, 1, 1]
    none = spark.createDataFrame([], "book_id long, sort_order int, type string, image_path string, partkey long, suppkey long, extent double")
    assert c.next_order(books, none).select("next_order").distinct().collect() == [(0,)]
    assert c.images_by_type(none).collect() == []
    assert c.ordinal_labels(none).collect() == []


def test_geometry(spark):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    found = spark.range(1).select(c.ordered_corners(F.array(corner(0, 10), corner(10, 10), corner(0, 0), corner(10, 0))).alias("k"))
    assert [(p["x"], p["y"]) for p in found.first()["k"]] == [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert tuple(found.select(*c.warp_size(F.col("k"))).first()) == (10, 10)
    sizes = spark.range(1).select(*c.scaled(F.lit(100), F.lit(50), 200), *c.scaled(F.lit(100), F.lit(50), 200, enlarge=True))
    assert tuple(sizes.first()) == (100, 50, 200, 100)


def test_ranks_come_in_even_ranges(spark):
    """Names that all begin alike are ranked in ranges of about equal size."""
    names = spark.range(20_000).select(F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"), "id")
    got = m.ranked(names, "name", "n")
    assert got.where("n <> id + 1").isEmpty()
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000
    plan = got._jdf.queryExecution().toString()
    assert "_range" in plan
    odd = spark.createDataFrame([("b",), (None,), ("a",), ("é",)], "name string")
    assert {r["name"]: r["n"] for r in m.ranked(odd, "name", "n").collect()} == {None: 1, "a": 2, "b": 3, "é": 4}
    assert m.ranked(odd.limit(0), "name", "n").collect() == []


def test_long_texts_clean_up_in_linear_time(spark):
    import time

    from shelfmark.functions import text as t

    long = "word " * 200_000
    frame = spark.createDataFrame([(1, long), (2, "A b. " + long), (3, " " * 500_000 + "x. y"), (4, "a. " * 100_000)], "k int, x string")
    frame.limit(0).select(t.clean_annotation(F.col("x")).alias("y")).collect()
    start = time.time()
    got = {r["k"]: r["y"] for r in frame.select("k", t.clean_annotation(F.col("x")).alias("y")).collect()}
    assert got == {1: "", 2: "A b.", 3: "x.", 4: "a."} and time.time() - start < 20


def test_requests_and_edits_by_hand(spark):
    from shelfmark.plans import server as sv

    images = spark.createDataFrame(
        [(1, "COVER", 0, "first", "e0"), (1, "COVER", 3, "Cover", None), (1, "INFO_PAGE", 2, "two", "e2"), (1, "INFO_PAGE", 1, "one", "e1"), (1, "BACK", 4, None, "e4"), (2, "COVER", 0, " ", None), (3, "INFO_PAGE", 0, "x", "")],
        "book_id long, type string, at int, text string, eng string",
    )
    got = {r["book_id"]: r for r in sv.readings(images).collect()}
    assert got[1]["cover"] == "Cover" and got[1]["main"] == "=== INFO PAGE 1 ===\none\n=== INFO PAGE 2 ===\ntwo\n=== BACK COVER ===\n\n"
    assert got[1]["eng"] == "=== COVER ===\n\n=== INFO PAGE 1 ===\ne1\n=== INFO PAGE 2 ===\ne2\n=== BACK COVER ===\ne4\n" and sorted(got) == [1, 3]
    book = "id long, title string, isbn string, year int, udk string, bbk string, annotation string, publisher_id long"
    books = spark.createDataFrame([(1, "a", "", None, "u", None, None, 7), (2, "b", "", None, "u", None, None, 7), (3, "c", "", 5, "u", None, None, None)], book)
    edits = spark.createDataFrame([(1, "A", "X, Y", "New", 1, "i", "unknown", " "), (3, "C", "unknown", "New", None, "i", "", "b"), (9, "none", "Q", "Q", 1, "", "", "")], "id long, title string, author string, publisher string, year int, isbn string, udk string, bbk string")
    publishers, authors = spark.createDataFrame([(7, "Old")], "id long, name string"), spark.createDataFrame([(4, "X")], "id long, name string")
    links = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "book_id long, author_id long")
    out = {k: sorted(map(tuple, v.collect()), key=repr) for k, v in sv.edited(books, edits, publishers, authors, links).items()}
    assert out["publishers"] == [(7, "New"), (8, "New")] and out["authors"] == [(4, "X"), (5, "X"), (6, "Y")]
    assert out["book_authors"] == [(1, 5), (1, 6), (2, 4)]
    assert out["books"] == [(1, "A", 1, "i", None, None, 7), (2, "b", None, "", "u", None, 7), (3, "C", None, "i", None, "b", 8)]

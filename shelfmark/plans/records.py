"""Records from text: hints, model replies with a deterministic fallback, merging of partial records, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

REPLY = "title string, author string, publisher string, year variant, isbn string, udk string, bbk string, annotation string, _corrupt string"


def with_entries(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with both citation entries as columns, so that the four hints that read them share one evaluation."""
    return df.withColumns({"_english": t.english_entry(F.col(text)), "_card": t.card_entry(F.col(text))})


def hints(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with hint_title, hint_author, hint_publisher, hint_year, hint_isbn, hint_udk and hint_bbk."""
    body, english, card = F.col(text), F.col("_english"), F.col("_card")
    found = {
        "title": t.extract_title(body, english, card),
        "author": t.extract_author(body, english, card),
        "publisher": t.extract_publisher(body, english, card),
        "year": t.extract_year(body, english, card),
        "isbn": t.extract_isbn(body),
        "udk": t.extract_udk(body),
        "bbk": t.extract_bbk(body),
    }
    return with_entries(df, text).withColumns({f"hint_{k}": v for k, v in found.items()}).drop("_english", "_card")


FIELDS = ("title", "author", "publisher", "year", "isbn", "udk", "bbk", "annotation")


def normalised(df: DataFrame) -> DataFrame:
    """``df`` with the record's fields (FIELDS) and hints, through the clean-up that all records take, in its order."""
    title = t.clean_title(t.reject_garbage(F.col("title")))
    df = df.withColumn("_title", title)
    own_title, own_author = t.embedded_author(F.col("_title"), F.col("author"))
    df = df.withColumns({"title": own_title, "author": own_author}).drop("_title")
    df = df.withColumns({c: t.one_line(F.col(c)) for c in FIELDS if c != "year"})
    df = df.withColumns({c: F.when(F.col(c) != t.UNKNOWN, t.modern_cyrillic(F.col(c))).otherwise(F.col(c)) for c in ("title", "author", "publisher")})
    return df.withColumns(
        {
            **{c: t.or_unknown(F.nullif(F.col(c), F.lit(""))) for c in ("title", "author", "publisher")},
            "year": F.coalesce("year", F.lit(0)),
            "isbn": t.final_isbn(F.coalesce(t.known(F.col("isbn")), "hint_isbn")),
            "udk": t.normalize_code(F.coalesce(t.known(F.col("udk")), "hint_udk")),
            "bbk": t.normalize_code(F.coalesce(t.known(F.col("bbk")), "hint_bbk")),
            "annotation": t.clean_annotation(t.or_unknown(F.nullif(F.col("annotation"), F.lit("")))),
        }
    )


def regex_records(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One record per row from patterns alone."""
    found = hints(df.select(key, text), text).withColumns({**{c: F.col(f"hint_{c}") for c in FIELDS if c != "annotation"}, "annotation": F.lit("")})
    return normalised(found).select(key, *FIELDS)


def records(df: DataFrame, key: str = "doc_id", text: str = "text", reply: str = "reply") -> DataFrame:
    """One record per row from the model's reply; where it has no well-formed object, from patterns. ``source`` names which."""
    found = hints(df.select(key, text, reply), text).withColumn("_reply", F.from_json(t.extract_json(F.col(reply)), REPLY, {"columnNameOfCorruptRecord": "_corrupt"}))
    usable = F.col("_reply").isNotNull() & F.col("_reply._corrupt").isNull()
    columns: dict[str, Column] = {c: F.when(usable, F.col(f"_reply.{c}")).otherwise(F.lit("") if c == "annotation" else F.col(f"hint_{c}").cast("string")) for c in FIELDS}
    # A year counts only as a JSON integer; true and false count as 1 and 0, as integers do where replies are read.
    kind, year = F.schema_of_variant("_reply.year"), F.col("_reply.year")
    whole = F.when(kind == "BIGINT", F.try_variant_get(year, "$", "int")).when(kind == "BOOLEAN", F.try_variant_get(year, "$", "boolean").cast("int"))
    columns["year"] = F.when(usable, whole).otherwise(F.col("hint_year"))
    found = found.withColumns({**columns, "source": F.when(usable, "reply").otherwise("patterns")})
    return normalised(found).select(key, *FIELDS, "source")


def cover_records(df: DataFrame, key: str = "doc_id", reply: str = "reply") -> DataFrame:
    """title and author per row from the model's reply about a cover; both "unknown" where it has no well-formed object."""
    parsed = df.select(key, F.from_json(t.extract_json(F.col(reply)), "title string, author string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("_reply"))
    usable = F.col("_reply").isNotNull() & F.col("_reply._corrupt").isNull()
    found = parsed.select(key, *(F.when(usable, F.col(f"_reply.{c}")).otherwise(t.UNKNOWN).alias(c) for c in ("title", "author")))
    rest = {c: F.lit(0) if c == "year" else F.lit(t.UNKNOWN) for c in FIELDS if c not in ("title", "author")}
    return normalised(found.withColumns({**rest, **{f"hint_{c}": F.lit(t.UNKNOWN) for c in ("isbn", "udk", "bbk")}})).select(key, "title", "author")


def layout_records(primary: DataFrame, key: str, reply: str = "reply", english: str = "eng") -> DataFrame:
    """Records of the layout-aware way from ``primary`` (key, text, eng, reply): patterns of the older kind complete the reply, and without one there is no row."""
    body = F.col("text")
    parsed = primary.withColumn("_reply", F.from_json(t.extract_json(F.col(reply)), REPLY, {"columnNameOfCorruptRecord": "_corrupt"})).where("_reply IS NOT NULL AND _reply._corrupt IS NULL")
    hint = {"isbn": t.extract_isbn_legacy(F.coalesce(F.nullif(english, F.lit("")), body)), "udk": t.extract_udk_legacy(body), "bbk": t.extract_bbk_legacy(body)}
    given = {c: F.nullif(F.col(f"_reply.{c}"), F.lit("")) for c in FIELDS if c != "year"}
    whole = F.when(F.schema_of_variant("_reply.year") == "BIGINT", F.try_variant_get("_reply.year", "$", "int"))
    title, author = t.embedded_author(t.clean_title(t.reject_garbage(given["title"])), given["author"])
    fields = {c: t.one_line(v) for c, v in {**given, "title": title, "author": author}.items()}
    return parsed.select(
        key,
        *(t.or_unknown(fields[c]).alias(c) for c in ("title", "author", "publisher")),
        F.coalesce(whole, F.lit(0)).alias("year"),
        F.coalesce(fields["isbn"], hint["isbn"]).alias("isbn"),
        *(t.normalize_code(F.coalesce(fields[c], hint[c])).alias(c) for c in ("udk", "bbk")),
        t.clean_annotation(t.or_unknown(fields["annotation"])).alias("annotation"),
    )


PROMPT = """Fill in the record of the book whose pages are read below. Answer with one JSON object.
Fields: title, author, publisher, year, isbn, udk, bbk, annotation. Use "unknown" for what the text does not say.
Found by patterns: author %s; ISBN %s; UDK %s; BBK %s.
Text:
%s"""
COVER_PROMPT = """Give the title and the author that stand on this cover as one JSON object with the fields title and author.
Use "unknown" for what the text does not say.
Text:
%s"""


def prompts(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (with its hints) and the columns prompt, with the hints that do not depend on the title, and cover_prompt."""
    body = F.coalesce(F.col(text), F.lit(""))
    hint = F.format_string(PROMPT, "hint_author", "hint_isbn", "hint_udk", "hint_bbk", body)
    return found.withColumns({"prompt": hint, "cover_prompt": F.format_string(COVER_PROMPT, body)})


def merged(info: DataFrame, cover: DataFrame, key: str = "doc_id") -> DataFrame:
    """Info records completed by the cover's title and author; the other fields are the info record's alone. authors holds a known author."""
    cover = cover.select(key, F.col("title").alias("_title"), F.col("author").alias("_author"))
    both = info.join(cover, key, "full")
    pick = lambda a, b: F.coalesce(t.known(F.col(a)), t.known(F.col(b)), F.lit(t.UNKNOWN))
    rest = {c: t.or_unknown(F.col(c)) for c in ("publisher", "isbn", "udk", "bbk")}
    out = both.select(key, pick("title", "_title").alias("title"), pick("author", "_author").alias("author"), *(v.alias(c) for c, v in rest.items()), F.coalesce("year", F.lit(0)).alias("year"))
    return out.withColumn("authors", F.when(F.col("author") != t.UNKNOWN, F.array("author")).otherwise(F.array().cast("array<string>")))


def assembled(pieces: DataFrame, key: str, order: str, head: Column, text: str = "text") -> DataFrame:
    """One text per key: each piece under its header, in order."""
    part = F.concat(head, F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    listed = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), part.alias("part")))).alias("parts"))
    return listed.select(key, F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("text"))


def blocks(words: DataFrame, *key: str) -> DataFrame:
    """key, first (place of the first word) and text of each block of words (key, pos, word); blank words are dropped."""
    kept = words.where(F.trim("word") != "")
    return kept.groupBy(*key).agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words")).select(
        *key, "first", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("text")
    )


def primary_text(found: DataFrame, key: str, least_score: int = 3, least_chars: int = 60) -> DataFrame:
    """Of each key's blocks (key, first, text) the longest that looks like a citation, if it is long enough; else all blocks' text."""
    scored = found.withColumn("score", t.block_score(F.col("text")))
    rank = F.when(F.col("score") >= least_score, F.struct(F.length("text").alias("n"), (-F.col("first")).alias("at")))
    whole = F.array_sort(F.collect_list(F.struct("first", "text")))
    out = scored.groupBy(key).agg(F.max(rank).alias("top"), F.max_by("text", rank).alias("best"), whole.alias("whole"))
    return out.select(key, F.when(F.col("top.n") >= least_chars, F.col("best")).otherwise(F.array_join(F.transform("whole", lambda w: w["text"]), " ")).alias("text"))


COMPARED = ("title", "author", "publisher", "year", "isbn", "udk", "bbk")


def compared(actual: DataFrame, expected: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, field, same for each of the seven compared fields."""
    a, e = actual.alias("a"), expected.alias("e")
    both = a.join(e, key)

    def same(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"e.{c}")
        if c == "author":
            return t.same_author(x, y)
        if c == "isbn":
            return t.comparable_isbn(x).eqNullSafe(t.comparable_isbn(y))
        return t.comparable(x.cast("string")).eqNullSafe(t.comparable(y.cast("string")))

    fields = F.array(*(F.struct(F.lit(c).alias("field"), same(c).alias("same")) for c in COMPARED))
    return both.select(key, F.inline(fields))


def all_same(comparison: DataFrame, key: str = "doc_id") -> DataFrame:
    return comparison.groupBy(key).agg(F.bool_and("same").alias("passed"))

"""Text functions of the record extractor, as Column -> Column expressions.

Extractors give ``"unknown"`` (or 0 for years) where nothing matches. Null texts count as empty. ``(?U)`` makes classes Unicode,
``(?d)`` makes a line feed the only line end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"

# The patterns of the extraction rules.
ISBN = r"ISBN\s*[:]? ?([0-9Xx\-–—−\s]+?)(?:\s*[\(;,]|$)"
ISBN_LEGACY = r"ISBN(?:-1[03])?\s*[:]?\s*([0-9Xx\-–—−\s]+)"
ISBN_VALID = r"^([0-9]{9}[0-9X]|[0-9]{13})$"
UDK = r"УДК\s*[:.]?\s*([0-9.\s:()+=/\-]+)"
UDK_LEGACY = r"УДК\s*[:]? ?([0-9.:()+=-]+)"
BBK = r"ББК\s*[:.]?\s*([А-ЯЁа-яёA-Za-z0-9][0-9()=:,А-ЯЁа-яёA-Za-z.\-–\s]+)"
BBK_LEGACY = r"ББК\s*[:.]?\s*([А-ЯЁ0-9][0-9()=:А-ЯЁ.\-–]+)"
ENGLISH = (
    r"([A-Z][a-z]+(?:,?\s+[A-Z][a-z.]+)*)[.,]\s+([A-Z][^.:]+?)\.\s*(?:[A-Z][a-z]+)\s*:\s*([A-Z][a-zA-Z\s&]+?),\s*([0-9]{4})",
    r"([A-Z][^/]+?)\s*/\s*([A-Z][a-z]+(?:,?\s+[A-Z][a-z.]+)*)\.\s*[-—]\s*(?:[A-Z][a-z]+)\s*:\s*([A-Z][a-zA-Z\s&]+?),\s*([0-9]{4})",
)
CARD = r"[А-ЯЁA-Z][0-9]+\s+(?:([А-ЯЁ][а-яё]+(?:,?\s+[А-ЯЁ][а-яё.]+)*)\s*[.—]+\s*)?([А-ЯЁ][^.—]+?)\.\s*—\s*([А-ЯЁ][а-яё]+)\s*:\s*([А-ЯЁ][а-яёА-ЯЁ\s]+?),\s*([0-9]{4})"
AUTHORS = (
    r"([А-ЯЁ][а-яё]+\s+[А-ЯЁA-Z]\.\s?[А-ЯЁA-Z]\.)\s*[\n\s]+[А-ЯЁA-Z][0-9-]+\s",
    r"([А-ЯЁ][а-яё]+\s+[А-ЯЁA-Z]\.\s?[А-ЯЁA-Z]\.)",
    r"([А-ЯЁ][а-яё]+,\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?)",
    r"©\s+([А-ЯЁ][а-яё]+\s+[А-ЯЁA-Z]\.\s?[А-ЯЁA-Z]\.)",
)
AUTHORS_LEGACY = (r"(?m)^([А-ЯЁ][а-яё]+ [А-ЯЁ]\. ?[А-ЯЁ]\.)$", r"(?m)^([А-ЯЁ][а-яё]+, [А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+)?)$")
TITLE = r"[А-ЯЁ][0-9]+\s+([А-ЯЁ][^.—]+?)\.?\s*[—\-]"
PUBLISHERS = (r"Москва\s*:\s*([А-ЯЁ][а-яёА-ЯЁ\s]+?),\s*[0-9]{4}", r"ИЗДАТЕЛЬСТВО\s*\n?\s*([А-ЯЁ][А-ЯЁа-яё\s]+)")
YEAR = r"(?i)(?:Москва|СПб|издательство)[^,]*,\s*([0-9]{4})"
GARBAGE = ("copyright", "trademark", "reserved", "indicia")
OLD_LETTERS = ("ѢѣІіѴѵѲѳ", "ЕеИиИиФф")
LOOK_ALIKES = ("abcehkmoptxy", "авсенкмортху")
EMBEDDED_AUTHOR = r"^([А-ЯЁ][а-яё]+),\s*([А-ЯЁ][а-яё]+)\.\s*[—-]\s*(.+)"


def _p(pattern: str) -> str:
    return "(?dU)" + pattern


def present(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


#: Unicode's white space.
_WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_WHITE))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, _p(pattern), group), F.lit(""))


def first_part(text: Column, separator: str) -> Column:
    return F.get(F.split(text, "(?U)" + separator), 0)


def or_unknown(text: Column) -> Column:
    return F.coalesce(text, F.lit(UNKNOWN))


def known(text: Column) -> Column:
    """Null for null, empty and "unknown"."""
    return F.when((text != "") & (text != UNKNOWN), text)


def blank_to_null(text: Column) -> Column:
    """Null for "unknown" and blank values; others untrimmed."""
    return F.when((text != UNKNOWN) & (strip(text) != ""), text)


def normalize_author(author: Column) -> Column:
    """"Surname, Name, rest" as "Surname Name"; others unchanged."""
    parts = F.split(author, ",")
    return F.when(author.contains(","), F.concat(strip(F.get(parts, 0)), F.lit(" "), strip(F.get(parts, 1)))).otherwise(author)


def _isbn(run: Column) -> Column:
    raw = F.upper(F.regexp_replace(run, "[^0-9Xx]", ""))
    return F.when(raw.rlike(ISBN_VALID), raw).otherwise(UNKNOWN)


def extract_isbn(text: Column) -> Column:
    return _isbn(F.regexp_extract(present(text), "(?i)" + _p(ISBN), 1))


def extract_isbn_legacy(text: Column) -> Column:
    return _isbn(F.regexp_extract(present(text), "(?i)" + _p(ISBN_LEGACY), 1))


def extract_udk(text: Column) -> Column:
    text = present(text)
    return F.when(text.rlike(_p(UDK)), F.regexp_replace(strip(F.regexp_extract(text, _p(UDK), 1)), r"(?U)\s+", " ")).otherwise(UNKNOWN)


def extract_bbk(text: Column) -> Column:
    text = present(text)
    return F.when(text.rlike(_p(BBK)), first_part(strip(F.regexp_extract(text, _p(BBK), 1)), r"\n|\s{2,}")).otherwise(UNKNOWN)


def extract_udk_legacy(text: Column) -> Column:
    return or_unknown(extract(present(text), UDK_LEGACY))


def extract_bbk_legacy(text: Column) -> Column:
    return or_unknown(extract(present(text), BBK_LEGACY))


def english_entry(text: Column) -> Column:
    """author, title, publisher, year of an English citation, null if there is none; a slash in the matched text puts the title first."""
    text = present(text)

    def entry(pattern: str, author: int, title: int) -> Column:
        group = lambda n: strip(F.regexp_extract(text, _p(pattern), n))
        return F.struct(group(author).alias("author"), group(title).alias("title"), group(3).alias("publisher"), group(4).cast("int").alias("year"))

    one, two = ENGLISH
    slash = F.regexp_extract(text, _p(one), 0).contains("/")
    return F.when(text.rlike(_p(one)), F.when(slash, entry(one, 2, 1)).otherwise(entry(one, 1, 2))).when(text.rlike(_p(two)), entry(two, 2, 1))


def card_entry(text: Column) -> Column:
    """author (may be null), title, publisher, year of a Russian library card, null if there is none."""
    text = present(text)
    group = lambda n: strip(F.regexp_extract(text, _p(CARD), n))
    title = strip(first_part(group(2), r"\s*[:/]\s*"))
    author = normalize_author(F.nullif(group(1), F.lit("")))
    return F.when(text.rlike(_p(CARD)), F.struct(author.alias("author"), title.alias("title"), group(4).alias("publisher"), group(5).cast("int").alias("year")))


def extract_author(text: Column, english: Column, card: Column) -> Column:
    """``english`` and ``card`` are the two entries, computed once beside the text."""
    text = present(text)
    fallback = [normalize_author(strip(F.replace(extract(text, p), F.lit("©"), F.lit("")))) for p in AUTHORS]
    return F.coalesce(F.nullif(english["author"], F.lit("")), card["author"], *fallback, F.lit(UNKNOWN))


def extract_author_legacy(text: Column) -> Column:
    return F.coalesce(*(normalize_author(extract(present(text), p)) for p in AUTHORS_LEGACY), F.lit(UNKNOWN))


def extract_title(text: Column, english: Column, card: Column) -> Column:
    return F.coalesce(english["title"], card["title"], first_part(strip(extract(present(text), TITLE)), r"\s*:\s*"), F.lit(UNKNOWN))


def extract_publisher(text: Column, english: Column, card: Column) -> Column:
    return F.coalesce(english["publisher"], card["publisher"], *(strip(extract(present(text), p)) for p in PUBLISHERS), F.lit(UNKNOWN))


def extract_year(text: Column, english: Column, card: Column) -> Column:
    return F.coalesce(english["year"], card["year"], extract(present(text), YEAR).cast("int"), F.lit(0))


# --- clean-up -----------------------------------------------------------------------------------------------------------


def extract_json(reply: Column) -> Column:
    """The object in a model's reply, without code fences: from the first brace to the last; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(strip(reply), r"^```json\s*", ""), r"\s*```\z", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def reject_garbage(title: Column) -> Column:
    return F.when(F.lower(title).rlike("|".join(GARBAGE)), UNKNOWN).otherwise(title)


def clean_title(title: Column) -> Column:
    """Without a leading catalogue code and what follows a slash, ". —" or a colon; "unknown" and empty titles stay."""
    body = F.regexp_replace(title, r"(?U)^[А-ЯЁA-Z][\s\-]*[0-9]+\s+", "")
    body = reduce(first_part, (r"\s*/\s*", r"\.\s*—\s*", r"\s*:\s*"), body)
    return F.when((title == "") | (title == UNKNOWN), title).otherwise(strip(body))


def embedded_author(title: Column, author: Column) -> tuple[Column, Column]:
    """Title and author where the title reads "Surname, Name. - Title"."""
    title = present(title)
    group = lambda n: F.regexp_extract(title, _p(EMBEDDED_AUTHOR), n)
    found = title.rlike(_p(EMBEDDED_AUTHOR))
    return F.when(found, strip(group(3))).otherwise(title), F.when(found, F.concat(group(1), F.lit(" "), group(2))).otherwise(author)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def modern_cyrillic(text: Column) -> Column:
    """Old letters replaced, hard signs at the end of words removed."""
    return F.regexp_replace(F.translate(text, *OLD_LETTERS), r"(?U)[Ъъ]\b", "")


def sentences(text: Column) -> Column:
    """Sentences in order, each without spaces around its body; text after the last terminator goes. One split, so linear in the text."""
    parts = F.filter(F.split(one_line(text), r"(?<=[.!?])"), lambda p: F.right(p, F.lit(1)).isin(".", "!", "?"))
    return F.transform(parts, lambda p: F.concat(F.trim(F.left(p, F.length(p) - 1)), F.right(p, F.lit(1))))


def clean_annotation(text: Column) -> Column:
    """Distinct sentences in order. Null and empty: "unknown"."""
    return F.when(present(text) == "", UNKNOWN).otherwise(F.array_join(F.array_distinct(sentences(text)), " "))


def normalize_code(code: Column) -> Column:
    return F.when((present(code) == "") | (F.lower(code) == UNKNOWN), UNKNOWN).otherwise(F.regexp_replace(code, r"(?U)\s+", ""))


def final_isbn(isbn: Column) -> Column:
    """What stands before a bracket, semicolon or comma, with digits, X and ASCII dashes alone; "unknown" if it has no 10 or 13 digits."""
    shown = F.upper(F.regexp_replace(first_part(present(isbn), r"\s*[(;,]"), r"[^0-9Xx\-]", ""))
    return F.when(F.replace(shown, F.lit("-"), F.lit("")).rlike(ISBN_VALID), shown).otherwise(UNKNOWN)


def block_score(text: Column) -> Column:
    rules = ((r"[А-ЯЁ][а-яё]+,\s*[А-ЯЁ]", 2), (r"[—\-:]", 1), (r"\b(19|20)[0-9]{2}\b", 1), ("/", 1))
    return reduce(lambda a, b: a + b, [F.when(text.rlike("(?U)" + p), w).otherwise(0) for p, w in rules] + [F.when(F.length(text) > 80, 1).otherwise(0)])


# --- comparison ---------------------------------------------------------------------------------------------------------


def comparable(text: Column) -> Column:
    """Lower case, Latin look-alikes as Cyrillic, letters, digits and underscores alone; null stays null."""
    return F.regexp_replace(F.translate(F.lower(text), *LOOK_ALIKES), r"[^\p{L}\p{N}_]", "")


def comparable_isbn(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(text), "[^0-9X]", ""), F.lit(""))


def same_author(a: Column, b: Column) -> Column:
    """Equal names, or equal surnames with equal initials in number and order; glued initials count as one. Both null: true."""

    def parts(name: Column) -> Column:
        return F.split(one_line(name), " ")

    def initials(name: Column) -> Column:
        rest = F.slice(parts(name), F.lit(2), F.greatest(F.size(parts(name)) - 1, F.lit(0)))
        bare = F.filter(F.transform(rest, lambda p: F.regexp_replace(p, "[.,]", "")), lambda p: p != "")
        return F.transform(bare, lambda p: comparable(F.upper(F.left(p, F.lit(1)))))

    surname = comparable(F.get(parts(a), 0)) == comparable(F.get(parts(b), 0))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((comparable(a) == comparable(b)) | (surname & (initials(a) == initials(b))))


def split_names(names: Column) -> Column:
    """A comma list as trimmed names; empty parts at the end are dropped, others stay."""
    return F.transform(F.split(F.regexp_replace(names, ",+$", ""), ","), strip)

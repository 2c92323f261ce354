"""HTML extraction: two passes over a page's blocks.

Pass 1 decides blocks by length, link density and stop-word density; what element holds a block moves its label by one step. Pass 2 gives
each ambiguous block the label of its nearest decided neighbour, good or bad.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices

# Element names, class words and common stop words.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg object canvas title select button annotation annotation-xml".split())
#: A block in one of these stands beside those in the element around it.
LEAVES = frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol pre table tbody td tfoot th thead tr ul".split())
#: Without an end tag these run to the end of the page; others are then no more than a tag.
UNENDED = frozenset("script style textarea title".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form head dialog menu".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr hidden legal login masthead "
    "menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted recommended related replies reply respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe teaser toolbar topbar widget".split()
)
ARTICLE_WORDS = frozenset("ad ads advert comment comments promo related sponsored teaser".split())
INLINE_WORDS = frozenset("ad ads advert adverts advertisement advertising promo promoted sponsored".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not are this at from or have an they which you were all we "
    "le la les de des et en un une du dans que qui pour sur par au avec ce il est pas ne se plus ou "
    "der die das und den von zu mit ist im ein eine nicht auf für dem sich als auch es an werden aus er hat "
    "el y los las del por con no una para al lo como más pero sus este "
    "il di che è per non si da sono nel della anche ma i gli "
    "o os as do da em um uma não com mais foi dos na no "
    "het een van dat niet zijn voor op te met aan er maar "
    "i w na z że się nie do jest to o jak ale po "
    "och att det som en på är av för den inte med om "
    "и в не на я что он с как это по но из у за от так же для был "
    "і та що не на з у до як це за від є але "
    "ve bir bu da de için ile çok ne gibi daha "
    "και το να του η της με για που είναι από".split()
)

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINKS_HIGH = 0.2
LINKS_MENU = 0.5
#: Under this share of stop words, a page of TELLING characters or more is in a language without a list: length decides alone.
STOP_NONE, TELLING = 0.02, 200

# A quote counts only where a value begins.
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=\s*[\"']?(?:hidden|true)?[\"']?(?:\s|$)|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

ARTICLE, PLAIN, BOILERPLATE = 1, 0, -1


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters inside links
    hint: int  # ARTICLE, PLAIN or BOILERPLATE, by the elements that hold it
    section: int  # the outermost boilerplate element, else the innermost article or main element, that holds it; 0: none
    region: int  # the element that holds it, LEAVES aside


def _words(attributes: str, whole: bool = False) -> set[str]:
    """Words of classes and id (``whole``: undivided at hyphens); ``role=`` and a role."""
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words.update(value.split() if whole else re.split(r"[^a-z0-9]+", value))
        elif name == "role":
            words.add("role=" + value)
    return words


def _is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BOILERPLATE_TAGS or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    words = _words(attributes, tag == "article")
    return bool(words & (ARTICLE_WORDS if tag == "article" else BOILERPLATE_WORDS)) or any("role=" + r in words for r in ROLES) or bool(_HIDDEN.search(attributes))


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order; character references decoded, each run of white space one space."""
    found: list[Block] = []
    stack: list[tuple[str, int, int, int]] = [("", PLAIN, 0, 0)]  # element, hint, section, region
    opened: Counter[str] = Counter()
    paragraph: tuple[int, int] | None = None  # hint and section of an open paragraph that differs from what holds it
    pieces: list[str] = []
    linked: list[str] = []
    unended: set[str] = set()
    link: tuple[int, bool] | None = None  # where the open link began: depth, in a paragraph
    skipped: list[str] = []  # an inline advert and the elements of its name in it
    in_paragraph = False
    number = at = 0

    def flush() -> None:
        skipped.clear()
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, hint, section, region = stack[-1]
                hint, section = paragraph or (hint, section)
                found.append(Block(text, len("".join("".join(linked).split())), hint, section, region))
            pieces.clear()
            linked.clear()

    def add(text: str) -> None:
        if not skipped:
            text = html.unescape(text)
            pieces.append(text)
            if link:
                linked.append(text)

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:  # a comment or a declaration
            continue
        closing, tag, attributes = bool(m[1]), m[2].lower(), m[3]
        if tag in RAW:
            if not closing and not attributes.endswith("/") and tag not in unended:
                over = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if over or tag in UNENDED:
                    at = over.end() if over else end
                else:
                    unended.add(tag)
            continue
        if tag in INLINE:
            if skipped:
                if tag == skipped[0] and tag not in VOID:
                    skipped.pop() if closing else skipped.append(tag)
            elif not closing and attributes and tag not in VOID and (_words(attributes) & INLINE_WORDS or _HIDDEN.search(attributes)):
                skipped.append(tag)
            if tag == "a":
                link = None if closing else (len(stack), in_paragraph)
            elif tag == "br":
                add(" ")
            continue
        flush()
        if in_paragraph:  # every block ends a paragraph, and a paragraph its links
            in_paragraph, paragraph = False, None
            link = None if link and link[1] else link
        if tag in VOID:
            continue
        _, hint, section, region = stack[-1]
        if tag == "p":
            in_paragraph = not closing
            if in_paragraph and attributes and hint != BOILERPLATE and _is_boilerplate(tag, attributes, hint == ARTICLE):
                number += 1
                paragraph = (BOILERPLATE, number)
        elif closing:
            if opened[tag]:
                while True:
                    name = stack.pop()[0]
                    opened[name] -= 1
                    if name == tag:
                        break
                link = None if link and link[0] > len(stack) else link
        elif not attributes.endswith("/"):
            number += 1
            if hint != BOILERPLATE:
                if _is_boilerplate(tag, attributes, hint == ARTICLE):
                    hint, section = BOILERPLATE, number
                elif tag in ("article", "main"):
                    hint, section = ARTICLE, number
            stack.append((tag, hint, section, region if tag in LEAVES else number))
            opened[tag] += 1
    flush()
    return found


GOOD, BAD, AMBIGUOUS = "good", "bad", "ambiguous"


def density(text: str) -> tuple[int, int]:
    """Stop words and words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def first_pass(found: list[Block]) -> list[str]:
    """Each block's label by length, link density and stop-word density, moved by what holds it.

    An article raises bad blocks to ambiguous, but for menus (mostly links) and copyright lines. Boilerplate elements lower good blocks
    to ambiguous and those to bad, as does lying outside of the articles of a page that has some.
    """
    has_article = any(b.hint == ARTICLE for b in found)
    counts = [density(b.text) for b in found]
    stops, words = (sum(c[k] for c in counts) for k in (0, 1))
    long = sum(len(b.text) for b in found) >= TELLING
    telling = not long or stops >= STOP_NONE * words
    labels = []
    for block, (own_stops, own_words) in zip(found, counts, strict=True):
        length = len(block.text)
        links, share = block.linked / length, own_stops / own_words if own_words else 0.0
        hint = BOILERPLATE if has_article and block.hint == PLAIN else block.hint
        if links > LINKS_MENU or length < LENGTH_LOW and block.text.startswith("\N{COPYRIGHT SIGN}"):
            labels.append(BAD)
            continue
        if links > LINKS_HIGH:
            label = BAD
        elif length < LENGTH_LOW:
            label = BAD if links else AMBIGUOUS
        elif not telling:
            label = GOOD if length > LENGTH_HIGH else AMBIGUOUS
        elif share >= STOP_HIGH or share >= STOP_LOW and length > LENGTH_HIGH:
            label = GOOD
        else:
            label = AMBIGUOUS if share >= STOP_LOW else BAD
        if hint == ARTICLE:
            label = GOOD if label == GOOD else AMBIGUOUS
        elif hint == BOILERPLATE:
            label = AMBIGUOUS if label == GOOD else BAD
        labels.append(label)
    return labels


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Ambiguous blocks inherit from the nearest decided block of their section; of two equally near, the one in the same element, then the good one.

    A section without a decided block is good if it is an article, else bad.
    """
    n = len(found)
    near: list[list[int]] = [[] for _ in range(n)]
    for order in (range(n), reversed(range(n))):
        last: dict[int, int] = {}
        for i in order:
            if labels[i] != AMBIGUOUS:
                last[found[i].section] = i
            elif found[i].section in last:
                near[i].append(last[found[i].section])
    result = []
    for i, block in enumerate(found):
        if labels[i] != AMBIGUOUS:
            result.append(labels[i] == GOOD)
        elif near[i]:
            best = min(near[i], key=lambda j: (abs(i - j), found[j].region != block.region, labels[j] != GOOD))  # noqa: B023
            result.append(labels[best] == GOOD)
        else:
            result.append(block.hint == ARTICLE)
    return result


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, second_pass(found, first_pass(found)), strict=True) if good)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` (page_id, url and ``source``) with text and n_chars (its code points) in place of the html; one row per row.

    Null and empty html, and pages without prose: an empty text. Null ids and urls pass through, repeated rows stay. The
    whole page is read, in time in proportion to its length. Other columns are ignored. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source, 16 << 20):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", source).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))

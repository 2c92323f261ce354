import random
import re

import numpy as np
import pyarrow as pa

from shelfmark.llm import common
from shelfmark.llm import html_extract as he
from shelfmark.llm import language_id as li
from shelfmark.llm import piece_sampling as ps
from shelfmark.llm import substring_dedup as sd

PROSE = "The cat is in the house and it was the one that they have for all of us on this night."


def test_main_text_keeps_the_article_alone():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies on this site and for that.</div>
    <article><h1>Head&eacute;r &amp; more</h1><p>{PROSE}<br>line&nbsp;two</p><p>Short.<p><b>{PROSE}</b><!-- no --><form><p>{PROSE}</p></form>
    <div class="comments"><p>{PROSE}</p></div></article><aside>{PROSE}</aside><div class=ad>{PROSE}</div><footer>&copy; x</footer>"""
    assert he.main_text(page) == f"Headér & more\n{PROSE} line two\nShort.\n{PROSE}"
    assert he.main_text(f"<div class=sidebar>{PROSE}</div><div><h2>Title</h2><p>{PROSE}</p><p>End</p></div><ul><li><a>menu one</a><li><a>menu two</a></ul>") == f"Title\n{PROSE}\nEnd"
    assert [he.main_text(x) for x in (None, "", "<p", "<script>x", "&am")] == ["", "", "", "", ""]
    assert len(he.main_text("<article>" + "<p>the word of it</p>" * 20_000)) == 20_000 * 15 - 1


def test_density_and_neighbours_decide_inside_articles():
    menu = "<ul>" + "".join(f"<li><a href=/{k}>A link to page {k} of this site</a></li>" for k in range(4)) + "</ul>"
    page = f"<article><h1>Title</h1><p>{PROSE}</p><h2>A table</h2><p>a1 | b2 | c3</p><p>{PROSE}</p><div><h3>See these too</h3>{menu}</div><p>© by all</p></article>"
    assert he.main_text(page) == f"Title\n{PROSE}\nA table\na1 | b2 | c3\n{PROSE}"  # the heading of the menu inherits its label
    found = he.blocks(page)
    assert he.first_pass(found) == ["ambiguous", "good", "ambiguous", "ambiguous", "good", "ambiguous"] + ["bad"] * 5
    assert he.main_text("<article><p>junk | of | the</p><p>more</p></article>") == "junk | of | the\nmore"


def test_marked_paragraphs_inline_adverts_and_odd_markup():
    good = f"<article><p>{PROSE}</p>"
    for odd in ("<p class=advert>Buy the thing that is for all of us.", "<p hidden>not shown", "<p style='display: none'>x", "<div><div class='comments'><p>" + PROSE + "</div></div>"):
        assert he.main_text(f"{good}{odd}<p>{PROSE}") == f"{PROSE}\n{PROSE}"
    assert he.main_text(f"<article><p>{PROSE} <span class=ad>Buy <span>now</span> or</span> late") == f"{PROSE} late"
    assert he.main_text(f"{good}<p title=it's>{PROSE}<p data-a=\"x>y\" b='>'>{PROSE}") == f"{PROSE}\n{PROSE}\n{PROSE}"
    for unclosed in ("<svg>", "<select><option>", "<button>", "<object>"):
        assert he.main_text(f"{good}{unclosed}<p>{PROSE}").endswith(PROSE) and he.main_text(f"{good}{unclosed}<p>{PROSE}").count(PROSE) == 2
    assert he.main_text(f"<div><p>{PROSE}</p></div><a href=x><div>One of the menu lines</div><div>Another of the lines</div></a>") == PROSE
    assert he.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here") == "Let x=1 here"
    russian = "Это было давно и не здесь, но он не знал, что так будет для всех, и у него было много времени."
    assert he.main_text(f"<div class=menu>{russian}</div><div><p>{russian}</p></div>") == russian
    japanese = "これは長い文章です。" * 30
    assert he.main_text(f"<div>メニュー</div><div><p>{japanese}</p></div><ul><li><a>リンク</a></ul>").endswith(japanese)
    assert he.main_text("<div>" * 100_000 + "x" + "</div>" * 100_000) == ""


def brute_passes(found):
    """Both passes block by block, each ambiguous block against all others."""
    words = [[w for w in re.findall(r"[^\W\d_]+", b.text.lower())] for b in found]
    every = [w for own in words for w in own]
    known = sum(len(b.text) for b in found) < 200 or sum(w in he.STOP_WORDS for w in every) >= 0.02 * len(every)
    scale = ["bad", "ambiguous", "good"]
    labels = []
    for b, own in zip(found, words, strict=True):
        density = sum(w in he.STOP_WORDS for w in own) / max(1, len(own))
        links = b.linked / len(b.text)
        level = 0
        if len(b.text) < 70:
            level = 0 if links > 0 else 1
        elif not known:
            level = 2 if len(b.text) > 200 else 1
        elif density >= 0.15:
            level = 2 if density >= 0.3 or len(b.text) > 200 else 1
        level = 0 if links > 0.2 else level
        if b.hint > 0:
            level = max(level, 1)
        elif b.hint < 0 or any(x.hint > 0 for x in found):
            level = max(0, level - 1)
        labels.append("bad" if links > 0.5 or len(b.text) < 70 and b.text[0] == "©" else scale[level])
    kept = []
    for i, b in enumerate(found):
        others = [(abs(i - j), found[j].region != b.region, labels[j] != "good") for j in range(len(found)) if labels[j] != "ambiguous" and found[j].section == b.section]
        kept.append(labels[i] == "good" if labels[i] != "ambiguous" else not min(others)[2] if others else b.hint > 0)
    return labels, kept


def test_passes_against_brute_force_on_all_pages():
    import pyarrow.parquet as pq

    rng = random.Random(8)
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    parts = [f"<p>{PROSE}</p>", "<p>short</p>", "<ul><li><a href=x>one link here</a><li>item</ul>", "<h2>Head</h2>", f"<div class=sidebar><p>{PROSE}</p></div>", f"<article><p>{PROSE}<p>more</article>", "<p>© x</p>", "<div>", "</div>", "<p>" + "zxq vbn " * 30, "<article><h3>See</h3><ul><li><a href=x>one link here</a></ul></article>"]
    pages += ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(800)]
    seen = set()
    for page in pages:
        found = he.blocks(page)
        labels = he.first_pass(found)
        kept = he.second_pass(found, labels)
        assert (labels, kept) == brute_passes(found)
        seen |= {(b.hint, label, good) for b, label, good in zip(found, labels, kept, strict=True)}
    assert {(h, "ambiguous", good) for h in (0, 1) for good in (True, False)} <= seen and (-1, "ambiguous", False) in seen
    assert {(1, "bad", False), (1, "good", True), (0, "bad", False), (0, "good", True)} <= seen


def test_extract_edges(spark):
    rows = [(1, "u", f"<article><p>{PROSE}</article>", "t", 5), (None, None, None, None, None), (1, "u", f"<article><p>{PROSE}</article>", "t", 5)]
    got = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, PROSE, len(PROSE)), (1, PROSE, len(PROSE))]
    assert he.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_language_model_edges(spark):
    rng = random.Random(1)
    words = {"en": "the of and to that is with for".split(), "de": "der die und nicht ist mit auch zu".split()}
    rows = [(k, " ".join(rng.choices(words[lang], k=12)), lang, "clash") for k, lang in enumerate(["en", "de"] * 200)]
    rows += [(1000, None, "en", ""), (1001, "123 !", None, ""), (None, "the and of", "en", ""), (1002, "", "de", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = li.fit(frame.where(~li.held_out()), rows_per_language=50)
    got = li.predict(frame, model).withColumn("held_out", li.held_out()).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[k]["lang_pred"] == lang for k, _, lang, _ in rows[:400])
    assert [(by[k]["lang_pred"], by[k]["score"]) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[None]["lang_pred"] == "en" and not by[None]["held_out"]
    assert 0.2 < np.mean([r["held_out"] for r in got]) < 0.3
    nothing = li.fit(frame.limit(0))
    assert {r["lang_pred"] for r in li.predict(frame, nothing).collect()} == {"und"}


def test_pieces_round_trip_and_distribution():
    import collections
    import itertools
    import math

    pieces = ps.Pieces(ps.model_path())
    texts = ["", "a", " ", "  a  ", "hello world", "▁x ▁", "é中\U0001F600 z\n\n\tt", "x" * 3000 + " " + "ab" * 500, "hello world"]
    keys = np.array([1, 2, 3, 4, 5, 6, 7, 8, 5], np.uint64)
    ids, at = ps.encode(texts, keys, pieces)
    data, ends = ps.decode(ids, at, pieces)
    assert [data[ends[k] : ends[k + 1]].tobytes().decode() for k in range(len(texts))] == texts
    assert ids[at[4] : at[5]].tolist() == ids[at[8] : at[9]].tolist()
    for k, text in enumerate(texts):  # a row alone gets the ids it gets among others
        assert ps.encode([text], keys[k : k + 1], pieces)[0].tolist() == ids[at[k] : at[k + 1]].tolist()
    shown, weights = "▁the", {}
    for marks in itertools.product([0, 1], repeat=3):
        parts = "".join(ch + ("|" if m else "") for ch, m in zip(shown, (*marks, 0), strict=True)).split("|")
        if all(p in pieces.ids for p in parts):
            weights[tuple(pieces.ids[p] for p in parts)] = math.exp(0.2 * sum(pieces.log_prob[p] for p in parts))
    n = 20_000
    ids, at = ps.encode([" the"] * n, np.arange(n, dtype=np.uint64), pieces, 0.2)
    seen = collections.Counter(tuple(ids[at[k] : at[k + 1]].tolist()) for k in range(n))
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    assert all(abs(seen[k] / n - w / total) < 0.015 for k, w in weights.items())


def brute_language(rows, texts):
    """Naive Bayes by dictionaries: (language, posterior) of each text, learned from all ``rows`` (text, lang)."""
    import math
    from collections import Counter

    def grams_of(text):
        shown = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
        shown = " " + " ".join(shown.split()) + " " if shown.split() else ""
        out = []
        for n in li.SIZES:
            for a in range(len(shown) - n + 1):
                part = shown[a : a + n]
                if part.strip():
                    mixed = n
                    for c in part:
                        mixed = ((mixed ^ (0 if c == " " else ord(c))) * 0x9E3779B97F4A7C15) % (1 << 64)
                        mixed ^= mixed >> 29
                    out.append((mixed >> 20) % li.BUCKETS)
        return out

    seen = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            seen.setdefault(lang, [0, Counter()])
            seen[lang][0] += 1
            seen[lang][1].update(grams_of(text))
    total = sum(n for n, _ in seen.values())
    out = []
    for text in texts:
        own = grams_of(text)
        if not own:
            out.append(("und", 0.0))
            continue
        logs = {}
        for lang, (n, counts) in sorted(seen.items()):
            mass = sum(counts.values()) + li.SMOOTHING * li.BUCKETS
            logs[lang] = math.log(n / total) + sum(math.log((counts[g] + li.SMOOTHING) / mass) for g in own)
        best = max(logs, key=logs.get)  # of equal ones the first by name
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def test_language_against_brute_force(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text", "lang"]).to_pylist()[:80]
    rows = [(r["text"], r["lang"]) for r in table] + [("same same", "aa"), ("same same", "bb"), (None, "aa"), ("x", None)]
    texts = [t[k : k + 60] if t else t for k, (t, _) in enumerate(rows)] + ["", "12 !", "É1ß İx", "zz", "the der la el", "same"]
    model = li.fit(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, (lang, score) in enumerate(brute_language(rows, texts)):
        assert abs(got[k][1] - score) < 1e-3 and (got[k][0] == lang or score < 0.51), (texts[k], got[k], lang, score)
    tie = li.fit(spark.createDataFrame([(1, "same", "bb"), (2, "same", "aa")], "doc_id long, text string, lang string"))
    assert [tuple(r) for r in li.predict(spark.createDataFrame([("same",)], "text string"), tie).select("lang_pred", "score").collect()] == [("aa", 0.5)]


def test_too_many_languages_are_an_error(spark):
    import pytest

    with pytest.raises(ValueError, match="at most"):
        li.fit(spark.range(li.MOST_LANGUAGES + 1).selectExpr("id AS doc_id", "'a b' AS text", "CAST(id AS STRING) AS lang"))


def segmentations(shown, pieces, alpha):
    """Every segmentation of a short text (with marks for spaces) and its probability, by enumeration."""
    import itertools
    import math

    weights = {}
    for marks in itertools.product([0, 1], repeat=len(shown) - 1):
        parts = "".join(ch + ("|" if m else "") for ch, m in zip(shown, (*marks, 0), strict=True)).split("|")
        if all(p in pieces.ids for p in parts):
            weights[tuple(pieces.ids[p] for p in parts)] = alpha * sum(pieces.log_prob[p] for p in parts)
    top = max(weights.values())
    total = sum(math.exp(w - top) for w in weights.values())
    return {ids: math.exp(w - top) / total for ids, w in weights.items()}


def test_draws_follow_the_lattice_for_every_alpha(monkeypatch):
    import collections

    pieces = ps.Pieces(ps.model_path())
    n = 6000
    for text in (" there", "   a", "     ", "hello"):
        for alpha in (0, 0.2, 1, 60, 1000):
            expected = segmentations(text.replace(" ", "▁"), pieces, alpha)
            for step in (8, -(10**9)):  # units together, and each by itself
                monkeypatch.setattr(ps, "STEP", step)
                m = n if step > 0 else 300
                ids, at = ps.encode([text] * m, np.arange(m, dtype=np.uint64), pieces, alpha)
                drawn = [tuple(ids[at[k] : at[k + 1]].tolist()) for k in range(m)]
                if step > 0:
                    kept, seen = drawn, collections.Counter(drawn)
                    assert set(seen) <= {k for k, w in expected.items() if w > 1e-12}
                    assert all(abs(seen[k] / n - w) < 0.03 for k, w in expected.items())
                else:
                    assert drawn == kept[:m]
    monkeypatch.setattr(ps, "STEP", 8)


def test_long_units_have_no_places_where_pieces_never_cross(monkeypatch):
    rng = random.Random(3)
    pieces = ps.Pieces(ps.model_path())
    word = "".join(rng.choices(["the", "ing", "tion", "er", "x7", "中"], k=4000))[:10_000]
    n = 60
    texts = [word + str(k) for k in range(n)]
    alone, at = ps.encode(texts, np.arange(n, dtype=np.uint64), pieces)
    data, _ = ps.decode(alone, at, pieces)
    assert data.tobytes().decode() == "".join(texts)
    monkeypatch.setattr(ps, "WINDOW", 700)
    monkeypatch.setattr(ps, "BLOCK", 5000)
    assert ps.encode(texts[:3], np.arange(3, dtype=np.uint64), pieces)[0].tolist() == alone[: at[3]].tolist()
    # Each boundary of a repeated word is as likely at the end of the 32nd character as anywhere in its period.
    text, ids, at = "the" * 40, *ps.encode(["the" * 40] * 2000, np.arange(2000, dtype=np.uint64), pieces)
    rates = np.zeros(len(text) + 1)
    for k in range(2000):
        rates[np.cumsum(pieces.lengths[ids[at[k] : at[k + 1]]])] += 1 / 2000
    assert abs(rates[30:90].reshape(-1, 3) - rates[30:90].reshape(-1, 3).mean(0)).max() < 0.08 and rates[32] < 0.9


def test_pieces_of_a_table(spark):
    rows = [(1, "hello there\n", "c", 1), (None, None, "c", 2), (1, "hello there\n", "c", 3), (2, "", "c", 4)]
    out = ps.sample_pieces(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_ids int"), ps.model_path())
    got = sorted(out.collect(), key=lambda r: (r["doc_id"] or 0))
    assert all(r["lossless"] and r["n_ids"] == len(r["ids"]) for r in got)
    assert got[1]["ids"] == got[2]["ids"] and got[0]["ids"] == []
    assert sorted(r["text"] for r in ps.restore(out, ps.model_path()).collect()) == ["", "", "hello there\n", "hello there\n"]


def test_cuts_cover_and_resist_insertions():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 9))) for _ in range(4000)]
    text = " ".join(words)
    edited = "inserted words here " + " ".join(words[:2000]) + " more " + " ".join(words[2000:])
    pieces = []
    for value in (text, edited, "", "z" * 2000, "中" * 700):
        offsets, data = sd.text_buffer(pa.array(["pre", value]))
        starts, ends = sd.cuts(offsets, data)
        chunks = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        assert b"".join(chunks).decode() == "pre" + value and all(chunks) and all(c.decode() is not None for c in chunks)
        assert max(map(len, chunks)) <= sd.MOST + 3 * 4
        pieces.append(set(chunks))
    assert len(pieces[0] & pieces[1]) > 0.97 * len(pieces[0])


def test_substring_dedup(spark):
    rng = random.Random(6)
    make = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    shared, own = make(120), [make(100) for _ in range(8)]
    rows = [(k, f"{own[k]} {shared} {own[k][::-1]}", "x", k) for k in range(5)]
    rows += [(5, own[5], "x", 0), (6, None, "x", 0), (7, "", "x", 0), (None, f"{shared}", "x", 0), (5, own[5], "x", 0), (9, rows[0][1], "x", 0), (10, f"{own[6]} {own[6]}", "x", 0)]
    got = sd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, removed_spans string, n int")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["text"] == rows[k][1] and by[k]["removed_spans"] == [] for k in (0, 5, 6, 7))
    assert by[10]["text"] == rows[-1][1] and by[9]["text"] == ""
    for k in (1, 2, 3, 4):
        assert own[k] in by[k]["text"] or len(by[k]["text"]) > 1000
        gone = sum(s["length"] for s in by[k]["removed_spans"])
        assert 0.8 * len(shared) < gone <= len(shared) + 2
        at, left = 0, []
        for s in by[k]["removed_spans"]:
            left.append(rows[k][1][at : s["start"]])
            at = s["start"] + s["length"]
        assert "".join(left) + rows[k][1][at:] == by[k]["text"]
    assert len(by[None]["text"]) < 0.2 * len(shared)
    assert sd.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_shared_passage_goes_whole(spark):
    rng = random.Random(16)
    make = lambda n, least, most: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(least, most))) for _ in range(n))
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n))
    rows, passages = [], []
    for k in range(360):
        passage = [make(52, 1, 3), make(52, 2, 9), han(60)][k % 3]
        passages.append(passage)
        around = (lambda: han(rng.randint(20, 200))) if k % 3 == 2 else lambda: make(rng.randint(10, 60), 2, 9) + " "
        for doc in (k, 1000 + k):
            after = around()
            rows.append((doc, around() + passage + (after if k % 3 == 2 else " " + after)))
    got = {r["doc_id"]: r for r in sd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for k, passage in enumerate(passages):
        assert got[k]["removed_spans"] == [] and got[k]["text"] == texts[k]
        spans = got[1000 + k]["removed_spans"]
        assert len(spans) == 1
        gone = texts[1000 + k][spans[0]["start"] : spans[0]["start"] + spans[0]["length"]]
        assert passage.strip() in gone and len(gone) <= len(passage) + 30


def test_removed_spans_stand_in_one_earlier_document(spark, monkeypatch):
    """Against brute force: every removed span is inside one document with a smaller id; every match of that many words that ends at words is removed."""
    monkeypatch.setattr(common, "HOT", 8)  # common chunks and owners are joined in parts
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passages = [prose(rng.choice([26, 40, 90])) for _ in range(25)]
    rows = []
    for k in range(220):
        parts = [prose(rng.randint(5, 60)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):  # also side by side, and parts of a passage
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages) if rng.random() < 0.8 else " ".join(rng.choice(passages).split()[5:30]))
        rows.append((k, " ".join(parts)))
    got = {r["doc_id"]: r for r in sd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shared, caught = 0, 0
    for k, text in rows:
        spans = got[k]["removed_spans"]
        left, at = [], 0
        gone = set()
        for s in spans:
            part = text[s["start"] : s["start"] + s["length"]]
            assert any(part in other for _, other in rows[:k])
            left.append(text[at : s["start"]])
            at = s["start"] + s["length"]
            gone |= set(range(s["start"], at))
        assert "".join(left) + text[at:] == got[k]["text"]
        own, begin = text.split(" "), 0
        for a in range(len(own) - 25):
            window = " ".join(own[a : a + 26])
            if any(window in other for _, other in rows[:k]):
                shared += 1
                caught += len(gone & set(range(begin, begin + len(window)))) >= 0.9 * len(window)
            begin += len(own[a]) + 1
    assert shared > 500 and caught >= 0.95 * shared


def test_repeated_rows_and_rows_without_ids(spark):
    rng = random.Random(22)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))
    shared = prose(60)
    rows = [(1, f"{prose(1000)} {shared}")] * 1500 + [(2, f"{shared} {prose(1000)}")] * 1500 + [(None, f"{prose(30)} {shared}") for _ in range(3)]
    got = sd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "text").count().collect()
    by = {r["doc_id"]: (r["text"], r["count"]) for r in got if r["doc_id"]}
    assert by[1] == (rows[0][1], 1500) and by[2][1] == 1500 and shared not in by[2][0] and len(by[2][0]) > 3000
    assert all(len(r["text"]) < 0.6 * len(shared) + 200 and shared not in r["text"] for r in got if r["doc_id"] is None)
    alone = sd.dedup_substrings(spark.createDataFrame(rows[-3:], "doc_id long, text string")).collect()
    assert sorted(shared in r["text"] for r in alone) == [False, False, True]


def test_words_of_texts_without_spaces():
    assert sd.words("one two\tthree") == 3 and sd.words("一二三四五 two") == 6 and sd.words("z" * 400) == 20


def test_units_of_earlier_batches_are_kept(monkeypatch):
    pieces = ps.Pieces(ps.model_path())
    texts = [" ".join(f"word{k % 90} {'long' * (k % 40)}{k % 7}" for k in range(m, m + 300)) for m in range(20)]
    keys = np.arange(len(texts), dtype=np.uint64)
    filtered = []
    whole = ps.Lattice
    monkeypatch.setattr(ps, "Lattice", lambda units, *rest: filtered.extend(units) or whole(units, *rest))
    ids, at = ps.encode(texts, keys, pieces)
    short = [u for u in filtered if len(u) <= ps.LONG_WORD]
    assert len(short) == len(set(short)) > 90
    filtered.clear()
    assert ps.encode(texts, keys, pieces)[0].tolist() == ids.tolist()
    assert all(len(u) > ps.LONG_WORD for u in filtered)
    monkeypatch.setattr(ps, "KEPT", 100)  # a worker that starts anew with each text draws the same, another alpha does not
    assert [i for k, t in enumerate(texts) for i in ps.encode([t], keys[k : k + 1], pieces)[0].tolist()] == ids.tolist()
    assert ps.encode(texts, keys, pieces, 2.0)[0].tolist() != ids.tolist()
    assert ps.encode(texts, keys, pieces)[0].tolist() == ids.tolist()


def test_kept_units_are_drawn_as_by_themselves():
    pieces = ps.Pieces(ps.model_path())
    draw = ps._mix(np.arange(300, dtype=np.uint64))
    for unit in (" there", "   a", "     ", "hello", " naïve中x"):
        for alpha in (0, 0.2, 1, 60, 1000):
            piece, times = ps._sampled([unit] * 300, draw, pieces, alpha)
            assert piece.tolist() == [i for d in draw.tolist() for i in ps._sampled_long(unit, d, pieces, alpha)[::-1]]
            assert times.sum() == len(piece)

import hashlib
import random
import re

from shelfmark.llm import exact_dedup as ed


def brute(rows):
    groups = {}
    for ident, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(ident)
    out = []
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_trie_against_a_dictionary():
    rng = random.Random(1)
    trie, want = ed.PatriciaTrie(), {}
    for n in range(3000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        trie.insert(text, n, 1)
        owner, count = want.get(text, (n, 0))
        want[text] = (min(owner, n), count + 1)
    assert {s: (o, c) for s, o, c in trie.strings()} == want
    assert trie.terminals == len(want)


def test_edge_cases_and_spill(spark):
    rng = random.Random(2)
    rows = [(5, None), (3, ""), (9, " \t"), (8, "\n"), (None, "a  b"), (4, "a b"), (4, "a b"), (None, "only"), (7, "x" * 300_000), (2, "x" * 300_000)]
    rows += [(100 + k, "".join(rng.choice("ab ") for _ in range(rng.randint(1, 6)))) for k in range(400)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, kept string, n long")
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for limit in (ed.TRIE_BYTES, 2_000):  # the small limit spills in several rounds
        got = sorted((tuple(r[c] for c in names) for r in ed.exact_dedup(df, limit).collect()), key=repr)
        assert got == brute(rows)


def test_empty_table(spark):
    assert ed.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_spill_frees_what_it_counts_and_streams_its_strings():
    trie = ed.PatriciaTrie()
    families = [bytes([65 + f]) * 100_000 for f in range(2)]
    for k in range(200):
        for family in families:
            trie.insert(family + str(k).encode(), k, 1)
    before = trie.size
    prefix, strings = trie.cut_largest()
    assert prefix in families and 100_000 < trie.size <= before / 2 + 1000  # the other family's label is still there
    assert trie.size == sum(trie.weigh(*edge)[0] for edge in trie.root.edges.values())
    assert not isinstance(strings, list) and sum(1 for _ in strings) == 200 and trie.terminals == 200

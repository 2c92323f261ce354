import collections
import random
import re
import zlib

import numpy as np

from shelfmark.llm import near_dedup as nd
from shelfmark.llm import packing as pk
from shelfmark.llm import sharding as sh

# --- packing ------------------------------------------------------------------------------------------------------------


def check_plan(histogram, capacity):
    runs = pk.plan(histogram, capacity)
    held = collections.Counter()
    for lengths, n in runs:
        assert n > 0 and sum(a * b for a, b in lengths.items()) <= capacity
        for length, times in lengths.items():
            held[length] += times * n
    assert held == collections.Counter({k: v for k, v in histogram.items() if v})
    return sum(n for _, n in runs)


def test_plans_hold_every_piece_and_are_near_the_bound():
    rng = random.Random(1)
    for capacity, most in ((4096, 900), (100, 100), (7, 7)):
        for scale in (1, 1000):
            histogram = collections.Counter(min(capacity, 1 + int(rng.expovariate(4 / most))) for _ in range(2000))
            histogram = {k: v * scale for k, v in histogram.items()}
            bound = -(-sum(k * v for k, v in histogram.items()) // capacity)
            assert check_plan(histogram, capacity) <= bound * 1.005 + 3
    assert check_plan({}, 4096) == 0
    assert check_plan({4096: 5, 1: 1}, 4096) == 6
    assert check_plan({2049: 1000}, 4096) == 1000


def lengths_of(sf):
    """Histogram of lengths as in the documents of ``sf``: by characters, as tokenising them takes long."""
    import pyarrow.parquet as pq

    histogram = collections.Counter()
    for text in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist():
        whole, rest = divmod(int(len(text or "") / 2.7) + 1, 4096)
        histogram[4096] += whole
        histogram[rest] += rest > 0
    return histogram


def test_rounded_configurations_place_nearly_all():
    rng = np.random.default_rng(7)
    for sf, times in (("sf0.01", 1), ("sf0.1", 1), ("sf0.1", 10_000)):
        histogram = lengths_of(sf)
        if times > 1:  # a large table has pieces of nearly every length
            dense = np.convolve([histogram[k] if 0 < k < 4096 else 0 for k in range(4096)], np.ones(41) / 41, "same")
            histogram = {4096: histogram[4096] * times} | {k: int(rng.poisson(n * times)) for k, n in enumerate(dense) if k}
        left = np.zeros(4097, np.int64)
        for length, n in histogram.items():
            left[length] = n
        alone = sum(n for _, n in pk.best_fit(left.copy(), [], 4096))
        left[4096] = 0
        tokens = int((left * np.arange(4097)).sum())
        runs = pk.rounded(left, 4096)
        placed = sum(length * each * n for held, n in runs for length, each in held.items())
        assert placed + int((left * np.arange(4097)).sum()) == tokens and placed >= 0.9 * tokens
        whole = pk.plan(histogram)
        assert sum(n for _, n in whole) <= alone
        # What is broadcast doesn't grow with the pieces.
        assert len(pk.places(whole)["key"]) < 30_000


def test_realised_lengths_fill_the_sequence():
    left = np.zeros(101, np.int64)
    left[[38, 31, 29, 12, 10]] = [1, 2, 1, 5, 1]
    got = pk.realised(left, [(25, 40, 2), (9, 16, 3)], 100, 0)
    assert sum(got) <= 100 and all(left[x] >= got.count(x) for x in got) and sorted(x > 20 for x in got) == [False] * 3 + [True] * 2
    assert sum(got) == max(a + b + c for a in (69, 67, 62, 60) for b, c in ((0, 36), (0, 34)) if a + b + c <= 100)
    assert pk.realised(left, [(25, 40, 6)], 100, 0) == [] and pk.realised(left, [(50, 60, 1)], 100, 0) == []


def test_configuration_lp_covers():
    counts, sizes = np.array([50.0, 30.0, 20.0]), np.array([3, 5, 7])
    solved = pk.configuration_lp(counts, sizes, 16)
    total = sum(config * x for config, x in solved)
    assert (total >= counts - 1e-6).all()
    assert all(config @ sizes <= 16 for config, _ in solved)
    assert sum(x for _, x in solved) <= 1.3 * (counts @ sizes) / 16


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = pk.tokenizer_path()
    encoder, plain = pk.Encoder(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = ["", "Hello WORLD's don't 12½ éÀÿ ß", "a\x85b\xa0c\x1cd", "İstanbul ﬁ é 中文 😀", "é vs é", "x" * 5000, "<|endoftext|> ok", "'LL 'll s't", "\x00\x7f\xad|%%%"]
    for text in texts * 2:
        assert encoder.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_added_tokens_keep_their_ids(spark):
    from tokenizers import Tokenizer

    path = pk.tokenizer_path()
    encoder, plain = pk.Encoder(path, added=True), Tokenizer.from_file(path)
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    for text in ("a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> ok", "<|endoftext|>", "a <|endoftext b", "plain text"):
        assert encoder.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    (row,) = pk.pieces(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string"), path).collect()
    assert (row["length"], row["ids_crc32"]) == (4, zlib.crc32(np.array([320, 49407, 321, 1], "<u4").tobytes()))


def test_pack_a_table(spark, monkeypatch):
    monkeypatch.setattr(pk, "RANKED", 2)  # the common length is ranked in parts
    rows = [(1, "word " * 300), (None, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "x y " * 40)] + [(10 + k, "d e f") for k in range(60)]
    frame = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, piece int, offset long")
    out = pk.pack(frame, pk.tokenizer_path(), capacity=64, ids=True).collect()
    encoder = pk.Encoder(pk.tokenizer_path())
    want = collections.Counter()
    for ident, text in rows:
        data = encoder.encode(text or "") + (1).to_bytes(4, "little")
        for k, a in enumerate(range(0, len(data), 256)):
            part = data[a : a + 256]
            want[ident, k, a // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out)
    places = collections.defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert pk.pack(frame.limit(0), pk.tokenizer_path()).collect() == []


# --- sharding -----------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_groups_whole(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choices("abc é", k=rng.randint(0, 300)))) for k in range(600)]
    rows += [(1000 + k, "a group of equal texts") for k in range(60)] + [(None, None), (None, None), (7, rows[7][1]), (2000, "z" * 3000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, shard string")
    out = sh.shard(frame, 8).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8
    groups = collections.defaultdict(set)
    for r in out:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    assert sh.shard(frame.limit(0)).collect() == []


def test_a_group_larger_than_a_shard_is_split(spark, monkeypatch):
    monkeypatch.setattr(sh, "RANKED", 10)
    rows = [(k, "hot text") for k in range(3000)] + [(5000 + k, f"cold {k} " * 3) for k in range(300)]
    out = sh.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 8


# --- near-duplicates ----------------------------------------------------------------------------------------------------


def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    out = []
    for k, (ident, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        component = min(ids, default=None) if sets[k] else ident
        out.append((ident, len(sets[k]), component, component == ident))
    return sorted(out, key=repr)


def near_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for family in range(6):
        base = [word() for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(12):  # chains: some members are near others but not near the first
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                base = copy
            rows.append((len(rows) * 7 % 101 + 101 * family, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two three"), (906, "three two one"), (None, rows[0][1]), (None, "alone here"), (907, rows[3][1]), (908, rows[3][1].upper()), (907, rows[3][1])]
    return rows


def test_near_dedup_against_brute_force(spark, monkeypatch):
    rows = near_rows()
    frame = spark.createDataFrame([(*r, 3, False) for r in rows], "doc_id long, text string, n int, kept boolean")
    want = {width: brute_components(rows, width, 80) for width in (4, 5)}
    got = sorted((tuple(r)[:4] for r in nd.cluster(frame, 4).collect()), key=repr)
    assert got == want[4]
    monkeypatch.setattr(nd, "BLOCK", 3)  # several blocks a bucket, several tiles a star
    monkeypatch.setattr(nd, "ELEMENTS", 300)
    got = sorted((tuple(r)[:4] for r in nd.cluster(frame).collect()), key=repr)
    assert got == want[5]


def test_classes_that_share_half_a_digest_stay_apart(spark, monkeypatch):
    whole = nd._digest
    rows = near_rows()[:40] + [(900, None), (None, near_rows()[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 4, 80)

    def few(elements):
        d = whole(elements)
        return (d & (1 << 64) - 1) | (d % 11) << 64

    names = nd._names

    def clashing(sets):
        import pyarrow as pa

        return [pa.array([few(s) >> 64 for s in sets], pa.int64()), names(sets)[1]]

    monkeypatch.setattr(nd, "_signatures", lambda width: signatures_with(clashing, width))
    monkeypatch.setattr(nd, "_sets", lambda width: sets_with(clashing, width))
    assert sorted((tuple(r)[:4] for r in nd.cluster(frame, 4).collect()), key=repr) == want


def signatures_with(names, width):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = nd.shingle_sets(batch.column(1).to_pylist(), width)
            columns = [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), *names(sets), pa.array([r.tobytes() for r in nd.sketches(sets)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "node", "check", "registers"])

    return run


def sets_with(names, width):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = nd.shingle_sets(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), *names(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["asked", "node", "check", "elements"])

    return run


def test_near_dedup_of_an_empty_table(spark):
    assert nd.cluster(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.unique(values[:3000]), np.unique(values[600:])
    sketch = nd.sketches([a, b, np.unique(values)])
    assert (np.maximum(sketch[0], sketch[1]) == sketch[2]).all()
    agree = np.mean([(s[0] == s[1]).mean() for s in (nd.sketches([np.unique(x[:900]), np.unique(x[100:])]) for x in (rng.integers(0, 2**63, 1000, dtype=np.uint64) for _ in range(40)))])
    assert abs(agree - 0.8) < 0.03
    assert nd.sketches([np.zeros(0, np.uint64)]).tolist() == [[0] * nd.REGISTERS]

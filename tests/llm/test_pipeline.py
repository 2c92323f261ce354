import random
import re

import corpus_pipeline
from shelfmark.llm import common


def table(spark, path):
    """Clean documents in two languages with planted copies, near copies, a shared passage, rejects and odd rows."""
    rng = random.Random(8)
    vocabulary = {"en": "the of and to in that house river window morning".split(), "de": "der die und das nicht haus fluss fenster morgen auch".split()}
    prose = lambda lang, n: " ".join("".join(rng.choice(vocabulary[lang]) + rng.choice(["", "s", "en"])) for _ in range(n))
    rows = [(k, prose(lang, 150), lang) for k, lang in enumerate(["en", "de"] * 15)]
    near = rows[2][1].split()
    near[70] = "changed"
    passage = prose("en", 80)
    rows += [(100, rows[0][1], "en"), (101, rows[0][1].replace(" ", "  "), "en"), (102, " ".join(near), "en"), (103, f"{prose('en', 90)} {passage}", "en"), (104, f"{prose('en', 90)} {passage} {prose('en', 60)}", "en")]
    rows += [(105, "12345 !!!", None), (106, None, None), (107, rows[4][1], "en"), (107, rows[4][1], "en"), (None, prose("de", 100), None)]
    rows += [(1, rows[1][1], "de")]  # a repeated row
    frame = spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = table(spark, str(tmp_path))
    docs = common.documents(spark, str(tmp_path))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), "test-stage")
        kept.append((name, docs))
    ids = [sorted((r["doc_id"] for r in frame.select("doc_id").collect()), key=lambda x: (x is None, x or 0)) for _, frame in kept]
    assert all(frame.columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, frame in kept[:4])
    clean = list(range(30))
    assert ids[0] == sorted([*clean, 1, 100, 101, 102, 103, 104, 107, 107]) + [None]
    assert ids[1] == [*clean, 102, 103, 104, None]
    assert ids[2] == [*clean, 103, 104, None]
    assert ids[3] == ids[2]
    texts = {r["doc_id"]: r for r in kept[3][1].collect()}
    assert all(texts[k]["text"] == rows[k][1] for k in clean)
    assert passage in texts[103]["text"] and passage not in texts[104]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    packed = kept[4][1].collect()
    assert {r["doc_id"] for r in packed} == set(ids[3]) and all(r["offset"] + r["length"] <= 4096 for r in packed)
    assert sorted((r["doc_id"] or -1, r["piece"], r["length"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r["doc_id"] or -1, r["piece"], r["length"]) for r in packed)


def test_a_corpus_without_labels_keeps_its_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a clean document", None), (2, "12345 !!!", None), (3, None, None), (None, "Ünïcode", None)], "doc_id long, text string, lang string")
    out = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {r["text"] for r in out.collect()} == {"a clean document", "Ünïcode"}


def brute_kept(rows, width=5):
    """Exact and near dedup by comparing all pairs: the (doc_id, text) that stay."""
    order = lambda r: (r[0] is None, r[0] or 0)
    groups = {}
    for r in set(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), []).append(r)
    firsts = []
    for group in groups.values():
        least = min(map(order, group))
        firsts.append([r for r in group if order(r) == least])  # any one of these may stay
    sets = []
    for group in firsts:
        words = group[0][1].lower().split()
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    label = list(range(len(firsts)))
    for a in range(len(firsts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    out = []
    for each in set(label):
        members = [g for g, x in zip(firsts, label, strict=True) if x == each]
        least = min(order(g[0]) for g in members)
        out.append([r for g in members for r in g if order(r) == least])
    return out


def test_dedup_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for family in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 60, 120]))]
        for k in range(6):
            words = list(base)
            if k % 3:
                words[rng.randrange(len(words))] = f"x{k}"
            ident = None if family % 4 == 0 or rng.random() < 0.2 else rng.randint(0, 60)  # ids repeat, with other texts too
            rows.append((ident, rng.choice([" ", "  ", "\n"]).join(words)))
    rows += rows[:5]
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, text_key string, times int")
    once = corpus_pipeline.exact(spark, frame, "")
    out = corpus_pipeline.near(spark, once, "")
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == frame.columns and len(got) == len(set(got))
    groups = brute_kept(rows)
    assert len(got) == len(groups) and all(sum(r in group for r in got) == 1 for group in groups)


def test_the_pipeline_of_empty_and_clashing_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _key int, kept string, text_key string, key long, c0 string, removed_spans string, lang_pred string, node string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    rows, _ = table(spark, f"{tmp_path}/plain")
    plain = common.documents(spark, f"{tmp_path}/plain")
    clashing = plain.selectExpr("*", "'d' AS _doc", "7 AS _key", "'k' AS kept", "'t' AS text_key", "doc_id AS key", "'c' AS c0", "'n' AS node")
    clashing.write.parquet(f"{tmp_path}/clash/documents.parquet")
    docs = clashing
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = common.written(stage(spark, docs, ""), "test-clash")
    assert docs.columns == clashing.columns
    assert docs.where("_doc <> 'd' OR _key <> 7 OR kept <> 'k' OR text_key <> 't' OR NOT key <=> doc_id OR c0 <> 'c' OR node <> 'n'").isEmpty()
    place = lambda folder: sorted((r["doc_id"] or -1, r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, f"{tmp_path}/{folder}").collect())
    assert place("clash") == place("plain")

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import decontaminate, simhash

from .test_decontaminate import brute as brute_hits
from .test_suffixes import brute as brute_suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, folder):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("bla", "tru", "né", "so", "wi") for b in ("m", "n", "ré", "t", "x")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    passage, item = prose(40), prose(15)
    docs, labels = [], []
    for i in range(120):
        good = i % 3 != 0
        text = prose(rng.randrange(20, 120)) if good else " | ".join(rng.choice(words).upper() for _ in range(60))
        if good and i % 7 == 0:
            text += " é" + passage + "éèê"[i % 3]
        if good and i % 11 == 0:
            text += " " + item
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(200, docs[1][1], "en", "s", 0), (201, docs[1][1] + " more", "en", "s", 0), (202, None, "en", None, None), (203, "", None, "s", 0), (204, docs[2][1], None, None, None)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"{folder}"


def brute_near(rows):
    """Components of texts whose 5-word shingles have a Jaccard coefficient of 0.8 or more."""
    sets = []
    for doc_id, text in rows:
        words = (text or "").lower().split()
        sets.append((doc_id, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()))
    links = [(d, e) for d, a in sets for e, b in sets if d < e and len(a & b) >= 0.8 * len(a | b)]
    root, before = {d: d for d, _ in sets}, None
    while root != before:
        before = dict(root)
        for d, e in links:
            root[d] = root[e] = min(root[d], root[e])
    return root


def test_each_stage_on_its_input(spark, tmp_path):
    folder = make(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        if name != "packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        after.write.parquet(path)
        before, docs = [tuple(r) for r in docs.collect()], spark.read.parquet(path)
        now = [tuple(r) for r in docs.collect()]
        seen[name] = len(now)
        if name == "quality classifier":
            ids = {r[0] for r in now}
            assert all(i % 3 for i in ids if i < 120) and len([i for i in ids if i < 120]) == 80 and set(now) <= set(before)
        elif name == "simhash near-dedup":
            part = brute_near([r[:2] for r in before])
            assert sorted(map(repr, now)) == sorted(repr(r) for r in before if part[r[0]] == r[0]) and len(now) < len(before)
        elif name == "suffix-array dedup":
            kept = {r[0]: r for r in brute_suffixes([r[:2] for r in before], 100)}
            assert {r[0] for r in now} == {r[0] for r in before} and any(r[2] for r in kept.values())
            for doc_id, text, *_, n_chars in now:
                assert n_chars == len(text) and "�" not in text
                if hashlib.sha256(text.encode()).hexdigest() != kept[doc_id][4]:
                    assert 0 < kept[doc_id][1] - kept[doc_id][2] - len(text.encode()) <= 2 * kept[doc_id][3]
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert sorted(map(repr, now)) == sorted(repr(r) for r in before if not brute_hits(r[1], items, 10)[1]) and len(now) < len(before)
    assert seen["packing"] >= seen["benchmark decontamination"] > 50


def test_run_is_the_stages_in_turn(spark, tmp_path):
    folder = make(spark, tmp_path)
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = found.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(whole) > 50 and all(r.n == r.m for r in whole)


def test_one_of_each_with_odd_rows(spark):
    rows = [(1, "a b c d", None, None, None), (1, "a b c d", None, None, None), (None, "a b c d", "x", None, None), (None, "e", "x", None, None), (4, "a b c d", None, None, None)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "a b c d"), (0, "e"), (1, "a b c d")]


def test_clean_in_blocks(spark):
    docs = spark.createDataFrame([(None, "x one two y", "l", None, 1), (2, "one", None, None, None), (3, None, None, None, None)], DOCS)
    items = spark.createDataFrame([(1, "one two"), (2, "zz"), (3, "y")], "item_id long, text string")
    for max_words in (100, 1):
        assert [r.doc_id for r in decontaminate.clean(docs, items, 10, max_words).orderBy("doc_id").collect()] == [2, 3]

import random
import zlib

import numpy as np

from gristmill.llm import classify
from gristmill.llm.common import held_out
from gristmill.llm.subword import Features, train

DOCS = "doc_id long, text string, lang string, source string, score double, quality int"
WORDS = {"aa": ["kala", "mina", "sina", "talo", "vene"], "bb": ["grund", "stein", "wald", "strom", "brot"]}


def prose(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "n", "t"]) for _ in range(n))


def rows(n=300):
    rng = random.Random(0)
    return [(i, prose(rng, lang := ("aa", "bb")[i % 2]), lang, "s", 0.0, 0) for i in range(n)]


def test_held_out_rule(spark):
    got = spark.range(200).withColumnRenamed("id", "doc_id")
    assert {r.doc_id for r in got.where(held_out(got.doc_id)).collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language(spark):
    odd = [(900, None, "aa", "s", 0.0, 0), (901, "", "aa", "s", 0.0, 0), (902, "12 !! 34", "bb", "s", 0.0, 0), (903, "kala " * 20000, None, "s", 0.0, 0), (None, "grund stein", "bb", "s", 0.0, 0), (1, rows()[1][1], "bb", "s", 0.0, 0)]
    df = spark.createDataFrame(rows() + odd, DOCS).repartition(4)
    model = classify.train_language(df)
    got = classify.predict_language(df, model, 0.0).collect()
    assert len(got) == 306 and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert all(by[i][0] == ("aa", "bb")[i % 2] for i in range(300)) and len(by[1]) == 2
    assert [by[i] for i in (900, 901, 902, 903, None)] == [["und"], ["und"], ["und"], ["aa"], ["bb"]]
    assert {r.lang_pred for r in classify.predict_language(df, model, 1.01).collect()} == {"und"}
    # labels and ids of what is predicted don't matter, and training doesn't depend on the rows' order
    other = df.withColumn("lang", df.source)
    assert sorted(map(tuple, classify.predict_language(other, model, 0.0).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    again = classify.train_language(df.repartition(2))
    assert np.array_equal(again.scores, model.scores)


def test_quality(spark):
    docs = spark.createDataFrame(rows() + [(900, None, None, None, None, None), (901, "", None, None, None, None)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(5, None, 0), (None, 1, 0), (7, 1, 1), (5000, 1, 0)], "doc_id long, quality int, text int")
    model = classify.train_quality(docs, labels)
    got = {r.doc_id: r.score for r in classify.score_quality(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(i % 2) for i in range(300)) and 0 <= got[900] <= 1 and got[900] == got[901]
    kept = classify.score_quality(docs.drop("score"), model, keep=docs.drop("score").columns)
    assert kept.columns == ["doc_id", "text", "lang", "source", "quality", "score"] and kept.count() == 302


def test_without_labels(spark):
    docs = spark.createDataFrame(rows(4), DOCS)
    assert classify.train_quality(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert [r.score for r in classify.score_quality(docs, None).collect()] == [0.5] * 4
    assert {(r.lang_pred, r.score) for r in classify.predict_language(docs, classify.train_language(docs.limit(0))).collect()} == {("und", 0.0)}
    assert classify.predict_language(docs.limit(0), None).collect() == []


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "rare" if i % 400 == 0 else "often") for i in range(4000)], "key long, label string")
    counts = {r.label: r["count"] for r in classify._chosen(docs, 200).groupBy("label").count().collect()}
    assert 140 < counts["often"] < 260 and counts["rare"] == 10  # a rare label isn't thinned out
    assert classify._chosen(docs, 10_000).count() == 4000


def test_long_texts_train_within_the_budget(spark):
    some = [(i, prose(random.Random(i), ("aa", "bb")[i % 2]), ("aa", "bb")[i % 2], "s", 0.0, 0) for i in range(60)]
    some += [(100, "pitkä " * 40_000, "cc", "s", 0.0, 0), (101, "pitkä " * 30_000, "cc", "s", 0.0, 0)]
    df = spark.createDataFrame([r for r in some if not held(r[0])], DOCS)
    assert classify.train_language(df).classes == ["aa", "bb", "cc"]
    assert "cc" not in classify.train_language(df, chars=50_000).classes


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_overlapping_classes_on_rows_held_out(spark):
    """Classes that share most of their words: accuracy on rows never seen, against the best that their words allow."""
    rng = random.Random(12)
    common = ["kala", "mina", "talo", "vene", "silta", "pelto"]
    own = {"aa": ["yksi", "kaksi"], "bb": ["yhden", "kahden"]}
    docs = []
    for i in range(1200):
        lang = rng.choice(["aa", "bb"])
        docs.append((i, " ".join(rng.choice(own[lang if rng.random() < 0.9 else "ab".replace(lang[0], "") * 2]) if rng.random() < 0.25 else rng.choice(common) for _ in range(20)), lang, "s", 0.0, 0))
    df = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r for r in classify.predict_language(df, classify.train_language(df), 0.0).collect()}
    unseen = [d for d in docs if held(d[0])]
    votes = lambda text: sum(text.split().count(w) for w in own["aa"]) - sum(text.split().count(w) for w in own["bb"])
    best = sum((votes(t) > 0) == (lang == "aa") for _, t, lang, *_ in unseen if votes(t)) + sum(0.5 for _, t, *_ in unseen if not votes(t))
    hits = sum(got[d].lang_pred == lang for d, _, lang, *_ in unseen)
    assert len(unseen) > 200 and hits >= 0.95 * best
    # the score says how often the prediction is right
    assert abs(sum(got[d].score for d, *_ in unseen) / len(unseen) - hits / len(unseen)) < 0.06


def test_a_column_of_the_scores_name_is_replaced(spark):
    docs = spark.createDataFrame(rows(8), DOCS)
    got = classify.score_quality(docs, None, keep=docs.columns)
    assert got.columns == ["doc_id", "text", "lang", "source", "quality", "score"] and {r.score for r in got.collect()} == {0.5}
    other = classify.score_quality(docs, None, keep=["doc_id", "score"], score="q")
    assert other.columns == ["doc_id", "score", "q"] and {(r.score, r.q) for r in other.collect()} == {(0.0, 0.5)}
    assert classify.score_quality(docs.limit(0), None, keep=docs.columns).collect() == []


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    f = Features(char_sizes=(2, 5), buckets=1 << 10)
    texts = ["one two two", None, "", "é", " lead", "x" * 5000, "one two two"]
    bucket, ends = f.of(texts)
    parts = np.split(bucket, ends[:-1])
    for text, part in zip(texts, parts, strict=True):
        alone, _ = f.of([text])
        assert np.array_equal(alone, part)
    assert np.array_equal(parts[0], parts[-1]) and len(parts[1]) == len(parts[2]) == 0


def test_probabilities_are_calibrated():
    rng = random.Random(3)
    texts, labels = [], []
    for _ in range(600):
        lang = rng.choice(["aa", "bb"])
        texts.append(prose(rng, lang, 8))
        labels.append(lang if rng.random() < 0.8 else {"aa": "bb", "bb": "aa"}[lang])
    model = train(texts, labels, Features(buckets=1 << 12))
    p = model.probabilities(texts).max(axis=1)
    assert 0.7 < p.mean() < 0.9

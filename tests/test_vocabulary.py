import json
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import tokens, vocabulary

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def learned(spark):
    return vocabulary.read(spark, PATH)


def some_texts():
    draw = random.Random(6)
    letters = "abcdefghij   \n\t'.,-0123456789éßñ漢字\U0001f642  　 \x1c\x1d\x85​ <|>sthe ing"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(1500)] + ["", " ", "  a", "it's they'll I'D", "a" * 3000, "ab" * 2000 + " x"]


def test_ids_are_the_librarys(spark, learned):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    texts = some_texts()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    got = dict(rows.select("i", vocabulary.encode(spark, learned, F.col("text"), False, False)).collect())
    want = library.encode_batch(texts, add_special_tokens=False)
    assert all([x - tokens.FIRST_BYTE for x in got[i]] == want[i].ids for i in range(len(texts)))


def test_round_trip_with_markers_and_edges(spark, learned):
    texts = [*some_texts(), None, "<|user|>\nhi <|end|><|end|>", "<|user |>"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    ids = vocabulary.encode(spark, learned, F.col("text"))
    got = rows.select("i", ids.alias("ids"), vocabulary.decode(spark, learned, ids).alias("text")).collect()
    assert all(r.text == texts[r.i] for r in got)
    assert all(r.ids is None if texts[r.i] is None else (r.ids[0], r.ids[-1]) == (tokens.BEGIN, tokens.STOP) for r in got)
    marked = next(r.ids for r in got if texts[r.i] and texts[r.i].startswith("<|user|>"))
    assert marked[1] == learned.size - 3 and marked[-3:-1] == [learned.size - 1] * 2


def test_unknown_ids(spark, learned):
    rows = spark.createDataFrame([([1, 0, learned.size, -1, 3, 2, None],), ([],), (None,)], "ids array<int>")
    assert [r[0] for r in rows.select(vocabulary.decode(spark, learned, F.col("ids"))).collect()] == [tokens.UNKNOWN_TEXT * 4, "", None]


def test_merges_by_rank_from_the_left():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"aa"]
    merges = {(98, 99): (0, 257), (97, 257): (1, 258), (97, 98): (2, 256), (97, 97): (3, 259)}
    one = vocabulary.Vocabulary(pieces, merges, ())

    def slowly(word):
        ids = list(word)
        while True:
            best = min(((merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges), default=None)
            if not best:
                return ids
            i = best[1]
            ids[i : i + 2] = [merges[ids[i], ids[i + 1]][1]]

    draw = random.Random(1)
    for _ in range(2000):
        word = bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 14)))
        assert one.merged(word) == slowly(word)


def test_usage_and_bad_files(spark, learned, tmp_path):
    rows = spark.createDataFrame([([1, 5, 5],)], "ids array<int>")
    used = vocabulary.usage(rows, learned)
    assert used.count() == learned.size and used.where("n > 0").count() == 2
    good = {"vocab": {c: i for i, c in enumerate(vocabulary._letters())}, "merges": ["a b"]}
    for k, bad in enumerate(({}, {"model": {"vocab": {"a": 0}}}, {"model": good}, {"model": good | {"vocab": {"a": 0, "b": 2, "ab": 3}}})):
        (tmp_path / f"{k}.json").write_text(json.dumps(bad))
        with pytest.raises(vocabulary.VocabularyError):
            vocabulary.read(spark, str(tmp_path / f"{k}.json"))
    with pytest.raises(vocabulary.VocabularyError):
        vocabulary.Vocabulary([b"a"], {})


def test_an_encoder_remembers_a_bounded_number_of_words(learned, monkeypatch):
    import tracemalloc

    monkeypatch.setattr(vocabulary, "KNOWN_WORDS", 100, raising=False)
    encode = learned.encoder()
    tracemalloc.start()
    try:
        for i in range(20_000):
            encode(f" w{i}")
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
    finally:
        tracemalloc.stop()


def test_nulls_and_slices_of_batches(spark, learned):
    texts = ["a b", None, "", "\u00df c" * 9, None]
    rows = spark.createDataFrame(enumerate(texts), "k int, text string").select("k", vocabulary.encode(spark, learned, F.col("text")).alias("ids"))
    back = {r.k: r.t for r in rows.select("k", vocabulary.decode(spark, learned, F.col("ids")).alias("t")).collect()}
    assert back == dict(enumerate(texts))

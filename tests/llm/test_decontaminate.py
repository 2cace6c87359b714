import random

from gristmill.llm import decontaminate
from gristmill.llm.decontaminate import digest, removed_spans, words

DOCS, ITEMS = "doc_id long, text string, item_id long, spans string", "item_id long, text string, doc_id int"


def brute(text, items, size):
    w, marked, named = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(size, len(v))
        for i in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    marked |= set(range(p, p + n))
                    named |= {str(item)} if item is not None else set()
    return len(w), sorted(marked), sorted(named)


def test_blocks_and_brute_force(spark):
    rng = random.Random(0)
    vocabulary = ["Ab", "c", "Éa", "ß", "e1", "zz"]
    text = lambda n: rng.choice([" ", ", ", "_"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 4, 9]))) for i in range(12)] + [(10, text(4)), (3, None), (None, "only here now")]
    docs = [(i, text(rng.choice([0, 1, 5, 60]))) for i in range(40)] + [(90, None), (91, ""), (92, "x only HERE now y"), (93, text(20000))]
    d = spark.createDataFrame([(*r, 0, "") for r in docs], DOCS)
    b = spark.createDataFrame([(*r, 0) for r in items], ITEMS)
    want = {k: brute(t, items, 4) for k, t in docs if k != 93}
    for max_words in (10**6, 7):
        got = {r.doc_id: (r.n_words, [p for a, e in r.spans for p in range(a, e)], r["items"]) for r in decontaminate.hits(d, b, 4, max_words).collect()}
        assert got.pop(93)[0] == 20000
        assert got == want


def test_odd_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b", 0, ""), (1, "a b", 0, ""), (None, None, 0, "")], DOCS)
    assert sorted((r.doc_id or 0, r.n_words, r.spans, r["items"]) for r in decontaminate.hits(docs, none).collect()) == [(0, 0, [], []), (1, 2, [], []), (1, 2, [], [])]
    assert decontaminate.hits(spark.createDataFrame([], DOCS), none).collect() == []
    assert digest([]) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_spans_are_cut_out():
    assert removed_spans("One two, three; Four.", [[1, 3]]) == "One ; Four."


def test_blocks_keep_rows_apart(spark):
    docs = spark.createDataFrame([(1, "a b x c"), (1, "q c"), (None, "a b"), (None, "z"), (1, "q c")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b"), ("j", "x c"), ("k", "c")], "item_id string, text string")
    rows = [sorted(map(repr, decontaminate.hits(docs, items, 10, m).collect())) for m in (100, 1)]
    assert rows[0] == rows[1] and len(rows[0]) == 5

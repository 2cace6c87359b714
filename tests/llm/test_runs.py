import hashlib
import random
import zlib

import pytest

from gristmill.llm import queries, runs

DOCS = "doc_id long, text string, runs string, n_words string, extra int"


def brute(words, least=12):
    """Every start and period tried, periods that a smaller one explains left out."""
    found = []
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            part = words[start : i + p]
            if len(part) >= max(least, 2 * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                found.append((start, p, len(part)))
            i += 1
    return sorted(found)


class Counted(list):
    looks = 0

    def __getitem__(self, i):
        Counted.looks += 1
        return list.__getitem__(self, i)


def test_all_runs_of_random_words():
    draw = random.Random(5)
    for _ in range(1500):
        n = draw.randint(0, 60)
        words = [draw.randrange(draw.choice([1, 2, 3])) for _ in range(n)]
        if n and draw.random() < 0.5:
            a, p = draw.randrange(n), draw.randint(1, max(1, n // 2))
            words = [words[a + (i - a) % p] if i >= a and a + (i - a) % p < n else words[i] for i in range(n)]
        assert runs.find(words, 2) == brute(words, 2)
        assert runs.find(words) == brute(words)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("kind", ["one", "fibonacci", "parity", "stairs", "powers", "mirrored", "random"])
def test_work_is_linear(kind):
    per_word = []
    for n in (1000, 16000):
        draw = random.Random(n)
        words = {
            "one": [0] * n,
            "fibonacci": list(fibonacci(n)),
            "parity": [i.bit_count() % 2 for i in range(n)],
            "stairs": [(i + 1 & -i - 1).bit_length() for i in range(n)],
            "powers": ([0] * 40 + [1]) * (n // 41),
            "mirrored": list(fibonacci(n // 2) + fibonacci(n // 2)[::-1]),
            "random": [draw.randrange(2) for _ in range(n)],
        }[kind]
        rank = {w: i for i, w in enumerate(sorted(set(words)))}
        Counted.looks = 0
        for sign in (1, -1):
            t = Counted([sign * rank[w] + len(rank) for w in words] + [-1])
            end, _ = runs.lyndon(t)
            runs._back(t, end, range(len(words) - 1, -1, -1))
        per_word.append(Counted.looks / len(words))
    assert per_word[1] < 40 and per_word[1] < 1.2 * per_word[0] + 1


def test_packed_arrays_give_the_same(monkeypatch):
    words = list(fibonacci(700)) * 2
    want = runs.find(words)
    monkeypatch.setattr(runs, "PACKED", 10)
    assert runs.find(words) == want == brute(words)


def test_division_at_single_words():
    words = ["a", "b"] * 8 + ["x"] + ["a", "b"] * 5 + ["y"] + ["c", "d", "c"] * 5 + ["z", "q", "z"]
    assert runs.find(words) == brute(words) == [(0, 2, 16), (28, 3, 15)]


def test_columns_nulls_empty_texts_and_repeated_rows(spark):
    long = " ".join(["w%d" % (i % 7) for i in range(30_000)])
    rows = [(1, None, "r", "n", 1), (1, "", "r", "n", 1), (None, "a " * 20, "r", "n", None), (2, "\x0b\n \t", None, None, 2), (3, long, "r", "n", 3), (3, long, "r", "n", 3), (4, "é é " * 12 + "\x01", "r", "n", 4)]
    found = runs.periodic_runs(spark.createDataFrame(rows, DOCS)).collect()
    assert found[0].asDict().keys() == {"doc_id", "text", "extra", "n_words", "runs", "collapsed"}
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=str)
    assert got == sorted([(1, 0, [], ""), (1, 0, [], ""), (0, 20, [(0, 20, 1)], "a"), (2, 0, [], ""), (3, 30_000, [(0, 30_000, 7)], "w0 w1 w2 w3 w4 w5 w6")] + [(3, 30_000, [(0, 30_000, 7)], "w0 w1 w2 w3 w4 w5 w6"), (4, 13, [(0, 12, 1)], "é é \x01")], key=str)
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame(rows, DOCS), "runs")


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, p, m in found for i in range(s + p, s + m)}
    top = min(((-m, s, p) for s, p, m in found), default=None)
    lines = "".join(f"{s},{m},{p}\n" for s, p, m in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    head = (top[1], -top[0], top[2], -1000 * top[0] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefghij") for _ in range(draw.randint(0, 70))) for _ in range(160)] + [None, "", " \n", "one", "x y", "a\tb " * 9, "a " * 11, "a " * 12]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)] + [(None, "a b " * 9, "", "", 0), (3, texts[3], "", "", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)

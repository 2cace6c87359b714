import hashlib
import random

import numpy as np
import pytest

from gristmill.llm import suffixes

SCHEMA = "doc_id long, text string, key string, a int, bucket int"


def brute(rows, length):
    """Rows (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, sha256)."""
    order = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, data in order:
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(first.get(s, (d, i)), (d, i))
    out = []
    for (d, data), (doc_id, _) in zip(order, rows, strict=True):
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (d, i):
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, length, gram, **limits):
    df = spark.createDataFrame([(d, t, "k", 0, 0) for d, t in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(df, length, gram, **limits).collect()), key=repr)


def corpus(seed, letters="ab", n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [text(k) for k in (19, 20, 21, 30, 64)]
    texts = []
    for _ in range(n):
        parts = [text(rng.randrange(40)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randrange(6))]
        texts.append("".join(parts))
        if rng.random() < 0.2:
            edited = list(texts[-1])
            if edited:
                edited[rng.randrange(len(edited))] = "é"
            texts.append("".join(edited))
    texts += [texts[0], texts[5], texts[5], "a" * 100, "a" * 70, "ab" * 60, "", "x" * 19, "x" * 20, "x" * 20, "\0" * 45, "a\0" * 30, texts[3] + "\0\0\0"]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("limits", [{}, {"hot": 3, "locally_hot": 2, "held": 50}])
def test_equals_brute_force(spark, seed, limits):
    rows = corpus(seed, "abc" if seed % 2 else "abcdefghij")
    assert got(spark, rows, 20, 6, **limits) == brute(rows, 20)


def test_odd_rows(spark):
    s = "some passage that is long enough to count"
    rows = [(None, s), (None, None), (3, "x" + s), (3, "x" + s), (3, s + s), (1, None), (2, "long " * 3000), (7, "long " * 10)]
    assert got(spark, rows, 20, 6) == brute(rows, 20)
    assert got(spark, [], 20, 6) == []


@pytest.mark.parametrize("seed", range(5))
def test_anchors_are_those_of_every_window(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + [1, 2, 3, 26, 200][seed] % 150, 500).astype(np.uint8)
    ends = np.array([200, 210, 500])
    places, h, _ = suffixes.anchors(data, ends, 50, 12)
    by_place = dict(zip(places.tolist(), h.tolist(), strict=True))
    for a, b in ((0, 200), (210, 500)):
        _, own, _ = suffixes.anchors(data[a:b], np.array([b - a]), 50, 12)
        for s in range(a, b - 49):
            inside = {p: by_place[p] for p in range(s, s + 39) if p in by_place}
            assert inside and min(inside.values()) in own.tolist()
    assert not any(188 < p < 200 or 198 < p < 210 for p in places.tolist())
    assert len(suffixes.anchors(data[:49], np.array([49]), 50, 12)[0]) == 0


@pytest.mark.parametrize("seed", range(3))
def test_refined_buckets_are_sorted_and_reuse_pointers(seed):
    rng = np.random.default_rng(seed)
    heads = [rng.integers(97, 99, 40).astype(np.uint8) for _ in range(5)]
    sizes = rng.integers(0, 97, 400)
    data = np.zeros((400, 96), np.uint8)
    for row, size in zip(data, sizes, strict=True):
        row[:size] = rng.integers(97, 99, size)
        if size > 60:
            row[:40] = heads[rng.integers(5)]
            row[44:60] = row[28:44]
    data[1:200:7] = data[0]
    sizes[1:200:7] = sizes[0]
    bucket = rng.integers(0, 6, 400)
    order, common, reused = suffixes.refine(bucket, data, sizes)
    rows = [(int(b), r[:n].tobytes()) for b, r, n in zip(bucket, data, sizes, strict=True)]
    sorted_rows = [rows[i] for i in order]
    assert all(a <= b for a, b in zip(sorted_rows, sorted_rows[1:], strict=False) if a[0] == b[0])
    assert len({b for b, _ in sorted_rows}) == 1 + sum(a[0] != b[0] for a, b in zip(sorted_rows, sorted_rows[1:], strict=False))
    for i, (a, b) in enumerate(zip(sorted_rows, sorted_rows[1:], strict=False), 1):
        same = next((j for j, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))
        assert common[i] == (same if a[0] == b[0] else -1)
    # suffixes whose next Q bytes are equal were told apart by pointers that a later offset had refined
    assert reused > 0


def test_texts_longer_than_a_piece(spark):
    rng = random.Random(8)
    text = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    n, passage = suffixes.AT_ONCE, text(300)
    long = text(n // 2) + passage + text(n // 2 - 100) + passage + text(n)
    rows = [(5, long), (9, text(50) + long[n - 200 : n + 200] + text(30)), (2, passage[10:200])]
    assert got(spark, rows, 100, 32) == brute(rows, 100)

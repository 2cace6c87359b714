import random

import numpy as np
import pytest
import xxhash

from gristmill.llm import simhash

SCHEMA = "doc_id long, text string, u long, k string"


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius):
    nodes = sorted((d, f) for d, f in rows)
    root = {d: d for d, _ in nodes}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, f) in enumerate(nodes):
        for e, g in nodes[:i]:
            if (f ^ g).bit_count() <= radius:
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: find(d) for d, _ in nodes}


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
@pytest.mark.parametrize("n", [1, 63, 64, 65, 700])
def test_bit_sliced_links_equal_brute_force(radius, n):
    rng = random.Random(n * 10 + radius)
    base = [rng.getrandbits(64) for _ in range(max(1, n // 6))]
    fp = []
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randrange(radius + 3)):
            x ^= 1 << rng.randrange(64)
        fp.append(x)
    key = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
    got = simhash.bucket_links(key, np.array(fp, np.uint64), radius, step=50)
    for k in set(key.tolist()):
        at = np.flatnonzero(key == k)
        want = brute_components([(int(i), fp[i]) for i in at], radius)
        assert {int(i): int(got[i]) for i in at} == want


def test_documents(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma", "ä", "Ä", "x", "1,2"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40]))) for _ in range(80)]
    texts += [texts[7]] * 5 + [None, "", " \n\t", "word " * 3000, "A\x0bB\x1cC"]
    rows = [(i * 3, t, i, "fp") for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = {r.doc_id: r.fp % (1 << 64) for r in got}
    assert prints == {d: brute_fingerprint(t) for d, t, _, _ in rows}
    assert {r.doc_id: r.component_id for r in got} == brute_components(list(prints.items()), 3)


def test_odd_rows(spark):
    rows = [(None, "one two three four", 0, ""), (5, "one two three four", 0, ""), (5, "one two three four", 0, ""), (9, "other words are here now", 0, ""), (9, None, 0, ""), (12, None, 0, "")]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 5), (5, 5), (5, 5), (9, 9), (9, 9), (12, 9)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(None, "a b", 0, "")], SCHEMA)).collect()] == [None]


def test_long_chain_is_one_component(spark):
    fp, rows = 0, []
    for i in range(20):
        rows.append((fp, 100 - i))
        for b in range(3):
            fp ^= 1 << (3 * i + b)
    found = simhash.components(simhash.links(spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64), d) for f, d in rows], "fp long, node long")))
    assert {r.root for r in found.collect()} == {81} and found.count() == 20


@pytest.mark.parametrize("hot", [2, 10, 1000])
def test_large_buckets_lose_no_link(spark, hot):
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set()
    while len(fps) < 500:
        x = rng.choice(base)
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))]
    found = simhash.components(simhash.links(spark.createDataFrame(rows, "fp long, node long"), 3, hot))
    got = {i: i for _, i in rows} | {r.node: r.root for r in found.collect()}
    assert got == brute_components([(i, f % (1 << 64)) for f, i in rows], 3)


def test_finer_groups_share_the_rest():
    for mask in simhash.block_masks(3):
        groups = simhash.finer_masks(mask, 3)
        assert len(groups) == 4 and sum(groups) + mask == (1 << 64) - 1

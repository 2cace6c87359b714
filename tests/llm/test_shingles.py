import random

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import shingles, simhash

DOCS = "doc_id long, text string"


def brute_sets(rows):
    out = []
    for d, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        out.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    root = {d: d for d, _ in sets}
    for d, x in sets:
        for e, y in sets:
            if d < e and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                a, b = sorted((root[d], root[e]))
                root = {k: a if v == b else v for k, v in root.items()}
    return root


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("common", [1, 4, 10**9])
def test_components_equal_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(shingles, "COMMON", common)
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(0, None), (1, ""), (2, "A b"), (3, "a B"), (4, "a b c d e"), (5, "a b c d e f")]
    for g in range(30):
        base = " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 30, 100, 400, 1500])))
        base += " " + passage if g % 2 else ""
        rows += [(10 + 10 * g + k, edited(rng, base, rng.randrange(1 + len(base.split()) // 25))) for k in range(6)]
    want = brute_components(rows)
    rng.shuffle(rows)
    got = shingles.resembling(spark.createDataFrame(rows, DOCS))
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert 30 < len(set(want.values())) < 150
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, c in want.items() if d == c)


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(7, a), (7, b), (9, a + " more"), (8, "more " + b), (3, "alone"), (None, a)]
    got = {(r.doc_id, r.component_id) for r in shingles.resembling(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(7, 7), (9, 7), (8, 7), (3, 3)}
    assert shingles.resembling(spark.createDataFrame([], DOCS)).collect() == []


def test_pairs_are_named_once_and_rounds_name_no_more_than_came_in():
    keys, nodes = 40, 30
    rows = [(k, v, 20, shingles.parities(np.arange(20, dtype=np.uint64)), list(range(max(0, k - shingles.BEFORE), k)), v) for k in range(keys) for v in range(nodes)]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "node", "n", "bits", "before", "root"])
    every = [p for b in shingles._pairs_with(shingles.NEAR, True, 100)(iter([batch])) for p in zip(*b.to_pydict().values(), strict=True)]
    assert sorted(every) == [(a, b) for a in range(nodes) for b in range(a + 1, nodes)]
    some = [p for b in shingles._pairs_with(shingles.NEAR, False, 100)(iter([batch])) for p in zip(*b.to_pydict().values(), strict=True)]
    assert {v for p in some for v in p} == set(range(nodes)) and len(some) < nodes


def test_fingerprints_are_compared_before_the_sets(spark, monkeypatch):
    made = []

    def links(prints, radius):
        found = simhash_links(prints, radius)
        made.append((radius, found.count()))
        return found

    simhash_links = simhash.links
    monkeypatch.setattr(simhash, "links", links)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:200] + [f"x{i}"] + words[200:])) for i in range(6)] + [(9, "other text")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9]
    assert len(made) == 1 and made[0][0] == 3 and made[0][1] > 0


def test_only_rows_in_a_pair_meet_again():
    sets = {1: range(0, 100), 2: range(3, 103), 3: range(500, 600), 4: range(900, 1000)}
    rows = [(7, 1, 1), (7, 2, 2), (7, 3, 3), (8, 3, 3), (8, 4, 4)]
    names = ["key", "node", "n", "bits", "before", "root"]
    values = [[k for k, _, _ in rows], [i for _, i, _ in rows], [100] * 5, [shingles.parities(np.array(sets[i], np.uint64)) for _, i, _ in rows], [[5], [6], [], [], [4]], [r for _, _, r in rows]]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)
    met = [r for b in shingles._pairs_with((4, 5), False, onward=True)(iter([batch])) for r in b.to_pylist()]
    assert [(r["x"], r["y"]) for r in met if not r["live"]] == [(1, 2)]
    again = [r for r in met if r["live"]]
    assert [(r["x"], r["y"], r["n"], r["bits"]) for r in again] == [(7, 1, 100, values[3][0]), (7, 2, 100, values[3][1])]
    # what they remember stays as it was, filled up with their own key
    assert [set(r["before"]) - {7} for r in again] == [{5}, {6}]
    every = [r for b in shingles._pairs_with((4, 5), True, onward=True)(iter([batch])) for r in b.to_pylist()]
    assert [(r["live"], r["x"], r["y"]) for r in every] == [(False, 1, 2)]

import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.llm import spotsigs

DOCS = "doc_id long, text string, part long, next_text string, s string"
STOP = set(spotsigs.ANCHORS)


def brute(text, chain=2):
    """Signatures as sets of (anchor, content words)."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [w for w in words if w not in STOP]
    out, seen = set(), 0
    for w in words:
        if w in STOP:
            if seen < len(content):
                out.add((w, *content[seen : seen + chain]))
        else:
            seen += 1
    return out or ({tuple(words)} if words else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def corpus(n=60):
    rng = random.Random(4)
    words = ["the", "of", "und", "la", "cat", "dog", "été", "run", "blue", "x1", "sky", "tree", "sun"]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 41]))) for _ in range(n)]


def test_fingerprints_and_likeness_equal_brute_force(spark):
    texts = [*corpus(), None, "", "!!", "the the the", "cat dog", "Cat DOG", "cat dog", "of x " * 9000]
    rng = random.Random(1)
    ids = rng.sample(range(0, 9000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, 1, "n", "s") for i, t in rows], DOCS).repartition(3)
    got = {r.doc_id: r for r in spotsigs.compare_edited(df).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_text) == (len(text), edited)
        assert r.near_edited == pytest.approx(jaccard(brute(text), brute(edited))) and r.near_next == pytest.approx(jaccard(brute(text), brute(following)))
        assert len(r.fingerprint) == 16 * len(brute(text))
    by_text = {}
    for doc_id, text in rows:
        assert by_text.setdefault(text, got[doc_id].fingerprint) == got[doc_id].fingerprint


@pytest.mark.parametrize("length", [1, 7, 100_000])
@pytest.mark.parametrize("spread", ["dense", "sparse", "both"])
def test_next_over_any_ranges(spark, length, spread):
    rng = random.Random(length)
    ids = {"dense": list(range(-40, 200)), "sparse": [rng.randrange(-(1 << 62), 1 << 62) for _ in range(240)], "both": [*range(120), *(rng.randrange(1 << 62) for _ in range(120))]}[spread]
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, f"t{i}", 0, "", "") for i in ids], DOCS)
    got = {r.doc_id: r.next_text for r in spotsigs.with_next(df, length).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_rows_without_ids_are_dealt_out(spark):
    rows = [(None, f"t{i}", 0, "", "") for i in range(50)] + [(i, f"d{i}", 0, "", "") for i in range(20)]
    got = spotsigs.with_next(spark.createDataFrame(rows, DOCS), 5).collect()
    follows = {r.text: r.next_text for r in got}
    at, seen = "d19", []
    while at not in seen:
        seen.append(at)
        at = follows[at]
    # one round through all rows, those with ids first
    assert at == "d19" and seen[:20] == [f"d{i}" for i in reversed(range(20))] and sorted(seen) == sorted(r[1] for r in rows)


def test_ranges_are_about_equal(spark):
    rng = random.Random(3)
    ids = [*range(10_000), *(rng.randrange(1 << 62) for _ in range(10_000))]
    df = spark.createDataFrame([(i, "") for i in ids], "doc_id long, text string")
    block, part = spotsigs._ranges(df, 100)
    sizes = [r["count"] for r in df.groupBy(part).count().collect()]
    assert 100 <= len(sizes) <= 500 and max(sizes) < 400


def test_odd_rows(spark):
    rows = [(None, "n", 0, "", ""), (3, "b", 0, "", ""), (3, "a", 0, "", ""), (3, "a", 0, "", ""), (1, None, 0, "", "")]
    got = [(r.doc_id, r.text, r.next_text) for r in spotsigs.with_next(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=repr) == sorted([(3, "a", "a"), (3, "a", "b"), (3, "b", ""), (1, "", "n"), (None, "n", "a")], key=repr)
    assert spotsigs.compare_edited(spark.createDataFrame([], DOCS)).collect() == []
    (one,) = spotsigs.compare_edited(spark.createDataFrame(rows[1:2], DOCS)).collect()
    assert one.near_next == 1.0


def test_near_pairs_equal_brute_force(spark):
    texts = corpus(150)
    rng = random.Random(8)
    for t in texts[:60]:
        w = t.split()
        if len(w) > 10:
            w[rng.randrange(len(w))] = "new"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, 0, "", "") for i, t in enumerate(texts)], DOCS)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(frozenset(brute(t)), i)
    sets = sorted((i, s) for s, i in first.items() if s)
    want = {(i, j): jaccard(a, b) for i, a in sets for j, b in sets if i < j and jaccard(a, b) >= 0.5}
    got = {(r.a, r.b): r.likeness for r in spotsigs.near_pairs(df, 0.5).collect()}
    assert got == pytest.approx(want) and len(want) > 5


def test_classes_and_links_equal_brute_force(spark):
    texts = [*corpus(80), None, "", "!!"]
    texts += [" ".join([*t.split()[:-1], "other"]) for t in texts[:40] if t and len(t.split()) > 10] + texts[:5]
    df = spark.createDataFrame([(i, t, 0, "", "") for i, t in enumerate(texts)] + [(None, texts[0], 0, "", "")], DOCS)
    sets = [frozenset(brute(t)) for t in texts]
    first = {}
    for i, x in enumerate(sets):
        first.setdefault(x, i)
    near = {i: sum(bool(y) and x != y and jaccard(x, y) >= 0.8 for y in first) if x else 0 for x, i in first.items()}
    got = [tuple(r) for r in spotsigs.near_classes(df).collect()]
    want = [(i, first[x], near[first[x]]) for i, x in enumerate(sets)] + [(None, first[sets[0]], near[first[sets[0]]])]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(n for _, _, n in want)


def test_lengths_prune(spark):
    a, b = F.array(F.lit(1), F.lit(2)), F.array(*[F.lit(i) for i in range(1, 9)])
    r = spark.range(1).select(spotsigs.likeness(a, b).alias("x"), spotsigs.likeness(a, b, 0.5).alias("y")).first()
    assert (r.x, r.y) == (0.25, 0.0)


def test_signatures_are_made_once_for_classes_and_links(spark, monkeypatch):
    """All that follows reads tables of sets; a reading of the texts would make their signatures again."""
    df = spark.createDataFrame([(i, f"the cat {i % 7} of a dog", 0, "", "") for i in range(20)], DOCS)
    plan = spotsigs.near_classes(df)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "ExistingRDD" not in plan and "LocalTableScan" not in plan


def test_rows_that_share_an_id_have_links_of_their_own(spark):
    """A fingerprint's links are its own, also where another one has the same least doc_id."""
    words = [f"the w{i} of v{i}" for i in range(30)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "the other of x"]), "the cat of a dog"
    got = sorted(map(tuple, spotsigs.near_classes(spark.createDataFrame([(1, a, 0, "", ""), (1, c, 0, "", ""), (2, b, 0, "", "")], DOCS)).collect()))
    assert got == [(1, 1, 0), (1, 1, 1), (2, 2, 1)]

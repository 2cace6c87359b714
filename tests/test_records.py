import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import control, conversations, numeric, provenance, scoring, tokens
from gristmill.plans.queries import LESSON_FORMS
from gristmill.sources import readers
from gristmill.streaming import dedup

RECORD = "id string, dataset string, source string, category string, prompt_form string, group_id string, user string, assistant string, text string"

def record(i, **over):
    base = {"id": f"r{i}", "dataset": "v1", "source": "v1/x", "category": "fam", "prompt_form": "why", "group_id": f"g{i}", "user": f"u {i}", "assistant": f"a {i}"}
    base |= over
    base.setdefault("text", f"<|user|>\n{base['user']}\n<|assistant|>\n{base['assistant']}\n<|end|>")
    return base


@pytest.mark.parametrize(
    "over, rule",
    [
        ({"assistant": " "}, "blank field"), ({"dataset": "v2"}, "wrong dataset"), ({"category": "x"}, "unknown family"), ({"prompt_form": "x"}, "unknown form"), ({"text": "x"}, "malformed text"),
        ({"user": "say <|END|>"}, "control token"), ({"assistant": "ToDo"}, "placeholder"), ({"user": "run python chat.py.py"}, "malformed command"), ({"assistant": "torch.cuda.available"}, "malformed api"),
        ({"assistant": "this is wrong here"}, "contradiction"), ({"user": "x" * 1900}, "too long"), ({"id": "r0"}, "repeated id"), ({"user": "U, 0!"}, "repeated prompt"), ({"group_id": "g0", "category": "fam2"}, "group in several families"),
    ],
)
def test_rules(spark, over, rule):
    rows = [record(0), record(1), record(2, **over)]
    found = conversations.violations(spark.createDataFrame(rows, RECORD), "v1", ["fam", "fam2"], {"fam": ("is wrong",)}).collect()
    assert rule in {r.rule for r in found}
    good = conversations.violations(spark.createDataFrame(rows[:2], RECORD), "v1", ["fam"]).collect()
    assert good == []


def test_lessons(spark):
    lesson = [("l1", "f", "stacks", "A fact.", "A case.", "A myth.", "An example.", None), ("l2", "f", "queues", "B.", "C.", "D.", "E.", "shared")]
    df = spark.createDataFrame(lesson, "lesson_id string, family string, focus string, fact string, situation string, misconception string, example string, cluster string")
    rows = conversations.expand_lessons(df, LESSON_FORMS, "lesson-v1").collect()
    assert {f for f, _, _ in LESSON_FORMS} == set(conversations.FORMS)
    (own,) = conversations.expand_lessons(df.limit(1), [("why", "{focus}? {cluster}!", "{fact}")], "d").collect()
    assert (own.user, own.assistant, own.id) == ("stacks? !", "A fact.", "d.l1.why")
    with pytest.raises(ValueError):
        conversations.expand_lessons(df, [("why", "{nothing}", "x")], "d")
    assert len(rows) == 16 and len({r.id for r in rows}) == 16 and {r.group_id for r in rows} == {"lesson-v1:f:l1", "lesson-v1:f:shared"}


def test_capped_expansion(spark):
    rows = [("p" * 80 + str(i), "a") for i in range(30)] + [("other", "a"), ("other", "b")]
    df = spark.createDataFrame(rows, "user string, assistant string")
    got = conversations.capped_expansion(df, 100, 5, "1").collect()
    assert len(got) == 6 and got == conversations.capped_expansion(df.repartition(7), 100, 5, "1").collect()


def brute_example(p, a, block):
    most = block + 1
    if len(p) + len(a) > most:
        if len(p) < most:
            rp, ra = len(p), most - len(p)
        else:
            ra = min(len(a), most - min(len(p), 2, most - 1))
            rp = min(len(p), most - ra)
        p = p[len(p) - rp :]
        if len(a) > ra:
            a = a[:ra] if ra == 1 else a[: ra - 1] + a[-1:]
    ids = p + a
    y = ids[1:]
    n = max(0, min(len(p) - 1, len(y)))
    y = [-100] * n + y[n:]
    return (ids[:-1], y) if any(v != -100 for v in y) else None


def test_examples_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(9) for _ in range(rng.randrange(1, 14))], [rng.randrange(9) for _ in range(rng.randrange(1, 14))]) for _ in range(150)]
    df = spark.createDataFrame([(i, p, a) for i, (p, a) in enumerate(rows)], "i int, p array<int>, a array<int>")
    for block in (1, 2, 5, 10, 40):
        for r in df.select("i", tokens.example(F.col("p"), F.col("a"), block).alias("e")).collect():
            want = brute_example(*rows[r.i], block)
            assert (want is None) == (r.e is None) and (want is None or (r.e.x, r.e.y) == (want[0], want[1])), (block, rows[r.i])


def test_tokens(spark):
    (r,) = spark.createDataFrame([("aé",)], "c string").select(tokens.encode(F.col("c")).alias("ids"), tokens.decode(tokens.encode(F.col("c"))).alias("back")).collect()
    assert r.ids == [1, 0x61 + 4, 0xC3 + 4, 0xA9 + 4, 2] and r.back == "aé"
    df = spark.createDataFrame([(list(range(n)),) for n in (4, 5, 9)], "ids array<int>")
    assert [[(w.start, w.x, w.y) for w in r.w or []] for r in df.select(tokens.windows(F.col("ids"), 4).alias("w")).collect()] == [[], [(0, [0, 1, 2, 3], [1, 2, 3, 4])], [(0, [0, 1, 2, 3], [1, 2, 3, 4]), (4, [4, 5, 6, 7], [5, 6, 7, 8])]]
    rows = spark.createDataFrame([(i * 7, i % 5) for i in range(100)], "k long, n long")
    at = 0
    for r in tokens.offsets(rows.repartition(5), "k", "n").orderBy("k").collect():
        assert r.offset == at
        at += r.n


def test_scores(spark):
    rubric = [("p", [("one", ["Alpha", "Béta ß"]), ("two", ["gamma delta"])], ["Bad"], [["x", "y"]], False), ("h", [], [], [], True)]
    rows = [("p", "ALPHA  gamma\ndelta"), ("p", "béta SS gamma delta bad x, y"), ("p", None), ("h", "any"), ("q", "any")]
    got = scoring.score(spark.createDataFrame(rows, "prompt_id string, response string"), spark.createDataFrame(rubric, scoring.RUBRIC)).collect()
    by = {(r.prompt_id, r.response): r for r in got}
    assert by["p", rows[0][1]].status == "pass" and by["p", rows[0][1]].matched == ["one", "two"]
    assert by["p", rows[1][1]].status == "fail" and by["p", rows[1][1]].forbidden_matches == ["Bad", "x + y"]
    assert by["p", None].status == "fail" and by["h", "any"].status == "human-review" and by["h", "any"].passed is None and by["q", "any"].status == "unscored"


def test_early_stopping_is_the_fold(spark):
    rng = random.Random(5)
    rows = [(u, i, rng.random()) for u in range(6) for i in range(30)]
    for patience in (0, 1, 4):
        got = {r.u: (r.evaluations, r.best, r.stopped_at) for r in control.early_stopping(spark.createDataFrame(rows, "u int, i int, loss double"), "u", ["i"], "loss", patience).collect()}
        for u in range(6):
            best, left, n, stop = float("inf"), patience, 0, None
            for _, i, loss in (r for r in rows if r[0] == u):
                n += 1
                if loss < best:
                    best, left = loss, patience
                elif patience:
                    left -= 1
                    if left == 0:
                        stop = n
                        break
            assert got[u] == (n, best, stop)


def test_numbers(spark):
    (r,) = spark.createDataFrame([([1.0, 3.0, 3.0, -1.0],)], "v array<double>").select(
        numeric.softmax(numeric.top_k(F.col("v"), 1)).alias("top"), numeric.penalized(F.col("v"), F.array(F.lit(0), F.lit(3)), 2.0).alias("pen"), numeric.cross_entropy(F.col("v"), F.lit(1)).alias("loss"),
        numeric.draw(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)), F.lit(0.4)).alias("drawn"), numeric.layer_norm(F.col("v")).alias("norm"), numeric.limited(F.col("v"), 2).alias("cut"),
    ).collect()
    assert r.top == [0.0, 0.5, 0.5, 0.0] and r.pen == [0.5, 3.0, 3.0, -2.0] and r.drawn == 1 and r.cut == [1.0, 3.0, None, None]
    assert abs(r.loss - 0.767) < 1e-3 and abs(sum(r.norm)) < 1e-9


def test_catalog(spark):
    schema = "path string, version int, kind string, has_model boolean, has_optimizer boolean, has_config boolean, iter long, mtime long, tokenizer_verified boolean"
    rows = [("a.pt", 1, "pretrain", True, True, True, 5, 1, True), ("B.pt", None, None, True, True, True, 9, 2, None), ("c.pt", None, None, True, True, False, 99, 9, None), ("d.pt", None, None, True, False, False, None, 8, True), ("e.pt", 1, None, True, True, True, 1, 1, True), ("f.pt", 7, "sft", True, True, True, 1, 1, True), ("g.pt", None, None, False, True, True, 100, 1, True)]
    c = provenance.classify_checkpoints(spark.createDataFrame(rows, schema))
    got = {r.path: (r.kind, r.error) for r in c.collect()}
    assert got == {"a.pt": ("pretrain", None), "B.pt": ("pretrain", None), "c.pt": (None, None), "d.pt": ("model_only", None), "e.pt": (None, "incomplete metadata"), "f.pt": (None, "unsupported version"), "g.pt": (None, "no model")}
    assert provenance.select_checkpoint(c, True).first().path == "B.pt" and provenance.select_checkpoint(c, False).first().path == "d.pt"
    identity = provenance.tokenizer_identity(b"m", 32, {t: i for i, t in enumerate(provenance.SPECIAL_TOKENS)})
    assert provenance.differences(identity, identity | {"vocab_size": 33}) == ["vocab_size"]
    with pytest.raises(ValueError):
        provenance.tokenizer_identity(b"m", 32, dict.fromkeys(provenance.SPECIAL_TOKENS, 1))


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.md").write_text("﻿# One\ntext")
    (tmp_path / "x.jsonl").write_text('﻿{"user": "u", "assistant": "a", "category": "c"}\n\n{"user": "v", "assistant": "b", "system": "s"}\n')
    (tmp_path / "bad.jsonl").write_text('{"user": "u", "assistant": "a"}\n{"user": " ", "assistant": "a"}\n[1]\nnot json\n')
    assert [(r.source, r.text) for r in readers.markdown(spark, [str(tmp_path)]).collect()] == [("a.md", "# One\ntext")]
    rows = readers.conversations(spark, str(tmp_path / "x.jsonl")).orderBy("user").collect()
    assert rows[0].text == "<|user|>\nu\n<|assistant|>\na\n<|end|>" and rows[1].text.startswith("<|system|>\ns\n<|user|>")
    assert readers.conversations(spark, str(tmp_path / "bad.jsonl"), lenient=True).count() == 1
    with pytest.raises(Exception, match="bad line"):
        readers.conversations(spark, str(tmp_path / "bad.jsonl")).collect()
    readers.write_json_lines(spark.createDataFrame([("b", None), ("a", 'q"')], "k string, v string"), str(tmp_path / "out"), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"k":"a","v":"q\\""}', '{"k":"b","v":null}']
    with pytest.raises(Exception, match="exists"):
        readers.write_json_lines(spark.createDataFrame([("b",)], "k string"), str(tmp_path / "out"), ["k"])


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/in")
    out = dedup.run_once(spark, f"{tmp_path}/in", df.schema, "stream_out", f"{tmp_path}/check")
    assert sorted(r.text.replace("  ", " ") for r in out.collect()) == ["a b", "c"]
    got = dedup.session_settings(spark.createDataFrame([(1, 1, "k", "5"), (1, 2, "k", "8")], "session int, seq int, setting string, value string")).collect()
    assert [(r.setting, r.value) for r in got] == [("k", "8")]


def test_status_and_stages(spark):
    rows = [(False, True, 0, True, 2, "r", "r", "m", "m", False, "verified_clean"), (True, False, 0, True, None, None, None, None, None, False, "contaminated"), (False, False, 0, True, 2, "r", "r", "m", "m", False, "audit_unavailable"), (False, True, 1, False, 2, "r", "r", "m", "m", False, "contaminated"), (False, True, 0, False, 2, "r", "r", "m", "m", False, "audit_does_not_cover_suite"), (False, True, 0, True, None, "r", "r", "m", "m", False, "provenance_mismatch"), (False, True, 0, True, 1, "r", "r", "m", "m", False, "legacy_unverified"), (False, True, 0, True, 2, "r", "x", "m", "m", True, "provenance_mismatch"), (False, True, 0, True, 2, "r", "r", "m", None, False, "provenance_mismatch"), (False, True, 0, True, 2, "r", "r", "m", "m", True, "contaminated")]
    schema = "retention boolean, has_report boolean, findings int, covered boolean, manifest_version int, report_digest string, linked_report_digest string, manifest_digest string, checkpoint_digest string, override boolean, want string"
    assert all(r.status == r.want for r in scoring.contamination_status(spark.createDataFrame(rows, schema)).collect())
    stages = spark.createDataFrame([("one", [], "a"), ("two", ["a"], "b"), ("three", ["b"], "c")], "stage string, needs array<string>, makes string")
    assert {r.stage: r.ready for r in control.ready(stages, spark.createDataFrame([("a",)], "output string")).collect()} == {"one": False, "two": True, "three": False}
    h = spark.createDataFrame([([("u", "a")], "m")], "h array<struct<user: string, assistant: string>>, m string")
    assert h.select(T.chat_prompt(F.col("h"), F.col("m")).alias("v")).first().v == "<|user|>\nu\n<|assistant|>\na\n<|end|>\n<|user|>\nm\n<|assistant|>\n"


def test_candidates_are_dealt_out_before_they_are_sorted(spark):
    """Rows made of one small file aren't ordered by that file's task."""
    rows = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 80) || id AS user", "'a' AS assistant")
    found = conversations.capped_expansion(rows, 20, 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.rfind("Sort") < plan.rfind("Exchange")
    assert len(found.collect()) == 8

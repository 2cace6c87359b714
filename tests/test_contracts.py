"""Contracts, sessions, imports and reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gristmill.operators import checks, documents, numeric, provenance, sessions
from gristmill.plans import contracts, reports
from gristmill.plans.flagship import quality_report
from gristmill.sources import readers

SMALL = "/root/testdata/sf0.001"


def counts(df):
    return {r.check: r.violations for r in df.collect()}


def test_contract_queries_are_registered():
    assert set(contracts.QUERIES) <= set(__spark_entry__.queries()) and set(contracts.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_documents_and_items(spark):
    docs = spark.createDataFrame([("a", "t", "s", None), (" ", None, "/x", "test"), ("/b", "", "s", "train"), (None, "t", None, None)], "document_id string, text string, source string, explicit_split string")
    assert counts(checks.documents_contract(docs)) == {"blank text": 2, "blank id": 2, "absolute id": 1, "bad source": 2, "unknown split": 1}
    with pytest.raises(documents.DataQualityError, match=r"absolute id \(1\); bad source \(2\)"):
        checks.require(checks.documents_contract(docs))
    checks.require(checks.documents_contract(docs.limit(0)))
    items = spark.createDataFrame([("a", "x"), ("a", "y"), (None, " ")], "item_id string, text string")
    assert counts(checks.items_contract(items, 0.82)) == {"blank item_id": 1, "blank text": 1, "repeated item id": 1}
    for bad in (0, 1.1, True):
        with pytest.raises(documents.DataQualityError):
            checks.items_contract(items, bad)


def test_records(spark):
    fields = ("id", "dataset", "source", "category", "prompt_form", "group_id", "user", "assistant", "text")
    row = lambda i, family: (f"r{i}", "v", "s", family, "why", f"g{i}", f"question {i}", f"answer {i}", f"<|user|>\nquestion {i}\n<|assistant|>\nanswer {i}\n<|end|>")
    df = spark.createDataFrame([row(i, "f" if i < 3 else "h") for i in range(4)], ", ".join(f"{f} string" for f in fields))
    got = counts(checks.records_contract(df, "v", ["f", "h", "k"], rows=(1, 3), least=2, share=0.5))
    assert got == {"absent family": 1, "rare family": 2, "dominant family": 1, "number of records": 1}
    with pytest.raises(documents.DataQualityError, match="unknown"):
        checks.records_contract(df.withColumn("more", F.lit("x")), "v", ["f"])
    assert counts(checks.records_contract(df.limit(0), "v", ["f"], rows=(0, 1)))["absent family"] == 1


def test_coverage_zip_and_linkage(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "suite string, version int, ordinal int, prompt_id string")
    own = rows(("a", 1, 0, "x"), ("a", 1, 1, "y"), ("b", 1, 0, "x"), ("c", 1, 0, "x"), ("d", 1, 0, "x"))
    audit = rows(("a", 1, 0, "y"), ("a", 1, 1, "x"), ("b", 1, 0, "x"), ("c", 2, 0, "x"), ("e", 1, 0, "x"))
    assert {r.suite: r.status for r in checks.coverage(own, audit).collect()} == {"a": "reordered", "b": "covered", "c": "other version", "d": "not audited", "e": "unknown suite"}
    zipped = checks.zipped(own.select("suite", "ordinal", "prompt_id"), spark.createDataFrame([("a", 0, "r"), ("z", 0, "r")], "suite string, ordinal int, response string"))
    assert sorted(r.fault or "" for r in zipped.collect()) == ["", *["case without an output"] * 4, "output without a case"]
    assert checks.same_sets(own, audit, ["suite"]).first().asDict() == {"left_only": 1, "right_only": 1, "equal": False}


def brute_session(lines):
    """A plain reading of the commands' rules."""
    s = {"temperature": 0.3, "top_k": 8, "max_new_tokens": 120, "raw": False, "history_enabled": True, "turns": 0, "open": True}
    for line in lines:
        if not s["open"] or not (line or "").strip():
            continue
        p = line.split()
        if not p[0].startswith("/"):
            s["turns"] += s["history_enabled"]
        elif p[0].lower() in ("/quit", "/exit"):
            s["open"] = False
        elif p[0].lower() == "/reset":
            s["turns"] = 0
        elif p[0].lower() == "/raw":
            s["raw"] = not s["raw"]
        elif p[0].lower() == "/history" and len(p) == 2 and p[1].lower() in ("on", "off"):
            s["history_enabled"], s["turns"] = p[1].lower() == "on", 0
        elif len(p) == 2 and p[0].lower() in ("/temp", "/topk", "/max"):
            try:
                v = float(p[1]) if p[0].lower() == "/temp" else int(p[1])
            except ValueError:
                continue
            if v > 0:
                s[{"/temp": "temperature", "/topk": "top_k", "/max": "max_new_tokens"}[p[0].lower()]] = v
    return s


def test_sessions_equal_a_plain_reading(spark):
    rng = random.Random(2)
    lines = ["/temp 0.5", "/TEMP 2", "/topk 7", "/topk 1.5", "hello /reset", "/history off", "/history", "/history maybe", "/max -3", "/max 9", "", None, "/raw", "/temp", "/history on", "/what", "/reset", "/quit"]
    sessions_ = {k: [rng.choice(lines) for _ in range(rng.randrange(1, 25))] for k in range(40)}
    events = [(k, i, x) for k, s in sessions_.items() for i, x in enumerate(s)]
    rng.shuffle(events)
    got = sessions.folded(spark.createDataFrame(events, "session long, seq long, line string").repartition(5)).collect()
    assert len(got) == len(events)
    for k, s in sessions_.items():
        last = max((r for r in got if r.session == k), key=lambda r: r.seq)
        assert {n: last[n] for n in ("temperature", "top_k", "max_new_tokens", "raw", "history_enabled", "turns", "open")} == brute_session(s)
    assert sessions.folded(spark.createDataFrame([], "session long, seq long, line string")).collect() == []


def test_resume(spark):
    rows = [("exact", "a.pt", 5, True, True), ("exact", "b.pt", 9, True, False), ("partial", "c.pt", 1, True, False), ("other", "d.pt", 1, False, True)]
    cat = spark.createDataFrame([(f, p, "pretrain", None, True, True, True, i, k, e) for f, p, i, k, e in rows] + [("none", "e.pt", "sft", None, True, True, True, 1, True, True)], "folder string, path string, kind string, error string, has_model boolean, has_optimizer boolean, has_config boolean, iter int, tokenizer_verified boolean, exact boolean")
    assert {r.folder: (r.path, r.decision) for r in sessions.resume(cat, ["folder"]).collect()} == {"exact": ("a.pt", "exact"), "partial": ("c.pt", "error: only inexact"), "other": (None, "error: another tokenizer"), "none": (None, "fresh")}
    assert [r.decision for r in sessions.resume(cat, ["folder"], "C.PT", True).collect()] == ["inexact"] and [r.decision for r in sessions.resume(cat, ["folder"], "c.pt").collect()] == ["error: only inexact"]
    with pytest.raises(ValueError):
        sessions.resume(cat, ["folder"], None, True)


def test_readers(spark, tmp_path):
    lines = [{"text": "one", "id": "a", "split": "train"}, {"user": "u", "assistant": "v", "source": "x/y"}, {"text": "both", "user": "u", "assistant": "v"}]
    (tmp_path / "d.jsonl").write_text("﻿" + "\n\n".join(map(json.dumps, lines)) + "\n", encoding="utf-8")
    got = readers.documents(spark, str(tmp_path / "d.jsonl")).collect()
    assert sorted((r.text, r.source, len(r.fields)) for r in got) == [("<|user|>\nu\n<|assistant|>\nv\n<|end|>", "x/y", 2), ("both", "d.jsonl", 2), ("one", "d.jsonl", 0)]
    assert len({r.canonical_fingerprint for r in documents.identify(readers.documents(spark, str(tmp_path / "d.jsonl"))).collect()}) == 3
    (tmp_path / "bad.jsonl").write_text('{"text": "x"}\n\n[1]\n')
    with pytest.raises(Exception, match="bad.jsonl:3"):
        readers.documents(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(Exception, match="bad record"):
        readers.documents(spark, str(tmp_path / "d.jsonl"), conversation=True).collect()
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(documents.DataQualityError):
        readers.documents(spark, str(tmp_path / "empty.jsonl"))
    (tmp_path / "core.jsonl").write_text('{"user": "a", "assistant": "b"}\n')
    assert readers.curated_core(spark, str(tmp_path / "core.jsonl")).collect() == [("a", "b")]
    (tmp_path / "blank.jsonl").write_text('{"user": "a", "assistant": "b"}\n\n{"user": "a", "assistant": "b"}\n')
    with pytest.raises(documents.DataQualityError, match="blank line"):
        readers.curated_core(spark, str(tmp_path / "blank.jsonl"))
    (tmp_path / "cat.jsonl").write_text('{"user": " a", "assistant": "b", "category": " k "}\n')
    assert readers.category_rows(spark, str(tmp_path / "cat.jsonl"), ["k"]).collect() == [("a", "b", "k")]
    with pytest.raises(Exception, match="unknown category"):
        readers.category_rows(spark, str(tmp_path / "cat.jsonl"), ["z"]).collect()


def test_tables_and_imports(spark):
    docs = spark.createDataFrame([("b", " two "), ("a", "one"), ("c", " ")], "source string, text string").withColumn("all", F.lit(1))
    assert readers.joined_corpus(docs, ["all"]).first().text == "one\n\ntwo" and readers.joined_corpus(docs, ["all"], headed=True).first().text.startswith("# a\n\none")
    assert readers.rows_from_table(spark, [("u", "a")], ["user", "assistant"]).collect() == [("u", "a")]
    for bad in ([("u",)], [("u", " ")]):
        with pytest.raises(documents.DataQualityError):
            readers.rows_from_table(spark, bad, ["user", "assistant"])
    assert [r.text for r in readers.synthetic(spark, [["a", "b"], ["c", "d"]]).orderBy("i").collect()] == ["a c", "a d", "b c", "b d"]
    for kind in ("listed", "other"):
        with pytest.raises(documents.DataQualityError):
            readers.imported(docs, kind)


def test_reports_fail_closed(spark, tmp_path):
    rows = [(f"d{i}", f"text number {i}", "s", None) for i in range(40)]
    docs = documents.identify(spark.createDataFrame(rows, "document_id string, text string, source string, explicit_split string"))
    prompts = spark.createDataFrame([("p", "x", "no such text")], "prompt_id string, suite string, text string")
    report = quality_report(docs, prompts, 7, 0.3)
    assert checks.quality_report(report) == []
    path = str(tmp_path / "r.json")
    reports.checked_write(report, path, checks.quality_report)
    assert reports.load(path, checks.quality_report) == report and reports.orphans(path, str(tmp_path / "m.json")) == "orphaned report"
    changed = provenance.sealed({**report, "counts": {**report["counts"], "groups": report["counts"]["groups"] + 1}})
    assert any("documents are not" in w for w in checks.quality_report(changed)) and any("add up" in w for w in checks.quality_report(changed))
    with pytest.raises(documents.DataQualityError):
        reports.checked_write(changed, str(tmp_path / "no.json"), checks.quality_report)
    assert not (tmp_path / "no.json").exists() and checks.quality_report({}) != []
    artifacts = [{"role": "train", "logical_name": "a", "sha256": "0" * 64, "size_bytes": 1}]
    made = reports.rebuilt_manifest(None, artifacts, report, {"digest": "t"})
    assert checks.manifest(made, report) == [] and reports.rebuilt_manifest(made, artifacts, report, {"digest": "t"}) == made
    assert checks.manifest(made) == ["orphaned manifest: its quality report is missing"] and any("another one" in w for w in checks.manifest(made, changed))
    with pytest.raises(documents.DataQualityError):
        reports.rebuilt_manifest(made, artifacts, None, {})
    old = provenance.sealed({"version": 1, "artifacts": artifacts, "preprocessing": {}, "tokenizer": {}})
    assert checks.manifest(old) == [] and reports.rebuilt_manifest(old, artifacts, None, {}) == old and checks.manifest({"version": 3}) == ["unsupported version"]
    assert reports.checkpoint_provenance("sft", made, {"digest": "t"}, {"a": 1})["manifest"] == made["digest"]


def test_supervised_report(spark):
    records = spark.createDataFrame([(f, f"{f}{g}") for f in ("x", "y") for g in range(12)], "category string, group_id string")
    suites = {"s": (1, ["p1", "p2"])}
    report = reports.supervised_report(records, "d", "0" * 64, suites, 0, [{"left_id": "a", "classification": "expected same-cluster variant"}], 5, 0.3)
    assert checks.supervised_report(report, suites, ["x", "y"]) == []
    assert checks.supervised_report(report, {"s": (2, ["p1"])}, ["x", "y", "z"]) == ["the audit doesn't cover the suites", "a split lacks a family"]
    assert "evaluation prompts occur" in checks.supervised_report(reports.supervised_report(records, "d", "0" * 64, suites, 2, [], 5, 0.3), suites, ["x", "y"])


def test_small_rules(spark):
    assert checks.generation({"temperature": 0.7, "top_k": 5}) == [] and checks.generation({"temperature": 0, "top_p": 1}) == ["unknown setting top_p", "temperature is out of range"]
    assert reports.tiny(100, 64) and not reports.tiny(1280, 64) and reports.aligned(reports.Config(), 300).vocab_size == 300
    labels = {("r", None): "kept", (None, "verified_clean"): "clean", (None, None): "open", ("h", "contaminated"): "seen"}
    assert [reports.metric_label(s, c, labels) for s in ("r", "h", "o") for c in ("verified_clean", "contaminated")] == ["kept", "kept", "clean", "seen", "clean", "open"]
    with pytest.raises(KeyError):
        reports.metric_label("h", "contaminated", {("r", None): "kept"})
    r = spark.range(1).select(numeric.until_stop(F.array(F.lit(5), F.lit(9), F.lit(2), F.lit(7)), [2], 3, 0).alias("a"), numeric.until_stop(F.array(F.lit(5)), [2], 3, 0).alias("b"), numeric.parameters(F.array().cast("array<bigint>")).alias("c")).first()
    assert tuple(r.a) == ([5, 9, 0], True, 2) and tuple(r.b) == ([5, 0, 0], False, 1) and r.c == 1


def test_fingerprints_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, "a", 0.5, [1.0]), (2, None, None, None), (2, "", None, [])], "k int, s string, v double, e array<double>")
    got = provenance.table_fingerprint(df).first()
    assert got == provenance.table_fingerprint(df.select("e", "v", "s", "k").orderBy(F.desc("k")).repartition(3)).first() and got.rows == 3
    assert got != provenance.table_fingerprint(df.na.fill("", ["s"])).first() and provenance.table_fingerprint(df.limit(0)).first() == (0, "0")

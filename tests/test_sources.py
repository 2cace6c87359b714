import pytest
from pyspark.sql import functions as F

from gristmill.operators import checks, documents, provenance, sessions
from gristmill.plans import reports
from gristmill.sources import readers


def test_a_folder_of_notes_and_rows(spark, tmp_path):
    for name, text in {"a.md": "﻿one", "notes/a.md": "two", "notes/b c+d.md": "three", "notes/deep/x.md": "not listed", "joined.md": "left out", "other.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = readers.corpus(spark, str(tmp_path), ["notes", "absent"], ["joined.md"])
    assert {(r.source, r.text) for r in got.collect()} == {("a.md", "one"), ("notes/a.md", "two"), ("notes/b c+d.md", "three")}
    (tmp_path / "rows.jsonl").write_text('{"text": "four", "id": "r"}\n{"user": "u", "assistant": "v", "source": "own"}\n')
    got = readers.corpus(spark, f"file:{tmp_path}/", ["notes"], ["joined.md"])
    assert {r.source for r in got.collect()} == {"a.md", "notes/a.md", "notes/b c+d.md", "rows.jsonl", "own"}
    assert len({r.document_id for r in documents.identify(got, "drop").collect()}) == 5
    deep = readers.markdown(spark, [str(tmp_path)], recursive=True)
    assert {r.source for r in deep.collect()} == {"a.md", "notes/a.md", "notes/b c+d.md", "notes/deep/x.md", "joined.md"}
    (tmp_path / "empty").mkdir()
    for folder in ("empty", "absent"):
        with pytest.raises(documents.DataQualityError):
            readers.corpus(spark, f"{tmp_path}/{folder}")


def test_settings_of_a_file(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "small.yaml").write_text("# small\nvocab_size: 512\nlearning_rate: 3e-4\nn_embd: '64'\n")
    got = reports.settings(spark, f"{tmp_path}/small.yaml", seed=7, n_layer=None)
    assert (got.vocab_size, got.learning_rate, got.n_embd, got.seed, got.n_layer) == (512, 3e-4, 64, 7, reports.Config().n_layer)
    for text in ("- 1", "unknown: 2", "n_head: 3"):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ValueError):
            reports.settings(spark, f"{tmp_path}/bad.yaml")


def test_tokenizers_identities():
    special = {t: i for i, t in enumerate(provenance.SPECIAL_TOKENS)}
    one = provenance.tokenizer_identity(b"m", 32, special)
    assert checks.tokenizer(one) == [] and checks.same_tokenizer(one, one) == []
    other = provenance.tokenizer_identity(b"n", 40, {t: i + 1 for t, i in special.items()})
    assert checks.same_tokenizer(one, other) == ["model_sha256", "special_tokens", "vocab_size"]
    again = lambda **x: provenance.sealed({**{k: v for k, v in one.items() if k != "digest"}, **x})
    assert checks.tokenizer(again(vocab_size=7)) == ["special tokens share ids, or have some out of range"]
    assert checks.tokenizer(again(vocab_size=0, model_sha256="x")) == ["no digest of the model", "no vocabulary size", "special tokens share ids, or have some out of range"]
    assert checks.tokenizer({**one, "vocab_size": 33}) == ["digest mismatch"]
    with pytest.raises(ValueError, match="running"):
        checks.same_tokenizer(one, again(special_tokens={}))


def test_supervised_manifest(spark):
    records = spark.createDataFrame([(f"r{i}", f"g{i % 3}") for i in range(7)], "id string, group_id string")
    sha = "b" * 64
    report = reports_of(sha)
    output = {"logical_name": "out.jsonl", "sha256": sha, "size_bytes": 9}
    parts = [{"name": "v1", "logical_name": "out.jsonl", "sha256": sha, "record_count": 7}, {"name": "core", "logical_name": "core.jsonl", "sha256": "c" * 64, "record_count": 2}]
    value = reports.supervised_manifest(records, report, output, parts, {"order": "source"})
    assert value["grouping"]["group_sizes"] == {"2": 2, "3": 1} and [c["name"] for c in value["components"]] == ["core", "v1"]
    assert checks.supervised_manifest(value, report) == []
    assert checks.supervised_manifest(value, None) == ["orphaned manifest: its report is missing"]
    assert checks.supervised_manifest(value, provenance.sealed({**report, "version": 2})) == ["the report is another one"]
    again = lambda **x: provenance.sealed({**{k: v for k, v in value.items() if k != "digest"}, **x})
    assert checks.supervised_manifest(again(output={**value["output"], "record_count": 8}), report) == ["the groups don't add up", "the output isn't a component", "the report is of another output"]
    assert checks.supervised_manifest(again(components=parts[1:]), report) == ["the output isn't a component"]
    assert checks.supervised_manifest(again(evaluation_audit={}), report) == ["audit or split differ from the report's"]


def reports_of(sha):
    split = provenance.sealed({"group_leakage": []})
    return provenance.sealed({"version": 1, "dataset": "d", "output_sha256": sha, "counts": {"records": 7}, "split_readiness": split, "evaluation_audit": {"suites": []}})


def test_explicit_checkpoints(spark):
    rows = [("Run\\A.pt", 1, "pretrain", True, True, True, 5), ("run/b.pt", 1, "sft", True, False, True, None), ("run/c.pt", 2, "sft", True, False, True, 1)]
    catalog = provenance.classify_checkpoints(spark.createDataFrame(rows, "path string, version int, kind string, has_model boolean, has_optimizer boolean, has_config boolean, iter long"))
    assert sessions.explicit(catalog, "run/a.pt", True).first().path == "Run\\A.pt" and sessions.explicit(catalog, "RUN\\b.pt", False).count() == 1
    for path, why in (("run/b.pt", "no pretraining state,no optimizer,no iteration"), ("run/c.pt", "unsupported version"), ("x.pt", "no checkpoint")):
        with pytest.raises(ValueError, match=why):
            sessions.explicit(catalog, path, True)
    assert catalog.where(F.col("error").isNull()).count() == 2

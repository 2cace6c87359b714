import pytest

from gristmill.operators import provenance, scoring
from gristmill.plans import reports

EVIDENCE = "suite string, retention boolean, has_report boolean, findings int, covered boolean, manifest_version int, report_digest string, linked_report_digest string, manifest_digest string, checkpoint_digest string, override boolean"


def test_config():
    c = reports.Config.of({"learning_rate": "3e-4", "n_layer": "8"}, seed=None, n_head=8)
    assert (c.learning_rate, c.n_layer, c.n_head, c.seed) == (3e-4, 8, 8, 1337)
    for bad in ({"n_head": 3}, {"nothing": 1}, {"train_split": 1.0}, {"dropout": 1}):
        with pytest.raises(ValueError):
            reports.Config.of(bad)


def test_evaluation_report(spark, tmp_path):
    rubrics = spark.createDataFrame([("a", [("x", ["yes"])], [], [], False), ("b", [("x", ["yes"])], [], [], False)], scoring.RUBRIC)
    answers = reports.generate(spark.createDataFrame([("a", "q"), ("b", "no"), ("c", "q")], "prompt_id string, prompt string"), lambda texts: ["Yes." if t == "q" else "No." for t in texts], 2)
    evidence = spark.createDataFrame([("s", False, True, 0, True, 2, "r", "r", "m", "m", False)], EVIDENCE)
    report = reports.evaluation("s", scoring.score(answers, rubrics), evidence, {"seed": 1})
    assert reports.check_evaluation(report) == [] and report["summary"] == {"cases": 3, "pass": 1, "fail": 1, "human-review": 0, "unscored": 1} and report["contamination"] == "verified_clean"
    assert reports.render_evaluation(report).startswith("s: 1/3 passed (verified_clean)\n")
    forged = {**report, "summary": report["summary"] | {"pass": 3}}
    assert reports.check_evaluation(provenance.sealed({k: v for k, v in forged.items() if k != "digest"})) == ["the summary doesn't follow from the results"]
    reports.write(report, str(tmp_path / "x" / "r.json"))
    with pytest.raises(FileExistsError):
        reports.write(report, str(tmp_path / "x" / "r.json"))


def test_benchmark_report(spark):
    ticks = iter(range(100))
    runs = reports.measure(lambda: 10, 3, 2, lambda: float(next(ticks)))
    assert runs == [(1, 1.0, 10), (2, 1.0, 10), (3, 1.0, 10)]
    report = reports.benchmark(spark.createDataFrame(runs, "index int, elapsed double, tokens long"), {})
    assert reports.check_benchmark(report) == [] and reports.render_benchmark(report).startswith("3 runs, 30 tokens, 10.00 tokens/s")
    assert "mean doesn't follow from the runs" in reports.check_benchmark(provenance.sealed({**{k: v for k, v in report.items() if k != "digest"}, "aggregate": report["aggregate"] | {"mean": 2.0}}))


def test_manifests():
    artifact = {"role": "train", "logical_name": "t", "sha256": "0" * 64}
    a = provenance.manifest([artifact, artifact | {"role": "val"}], {"seed": 1}, {"digest": "t"})
    assert reports.check_manifest(a) == [] and a == provenance.manifest([artifact | {"role": "val"}, artifact], {"seed": 1}, {"digest": "t"})
    b = provenance.manifest([artifact], {"seed": 2}, {"digest": "t"})
    assert reports.first_difference(a, b) == "artifacts" and reports.first_difference(a, a) is None
    assert "repeated artifacts" in reports.check_manifest(provenance.manifest([artifact, artifact], {}, {}))

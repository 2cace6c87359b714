import copy
import json

import pytest
from pyspark.sql import functions as F

from gristmill.operators import provenance
from gristmill.operators import report_tables as R

SHA = "a" * 64


def evaluation():
    case = lambda i, status, passed: {
        "prompt_id": f"p{i}", "prompt_text": "Why?", "prompt_digest": SHA, "response": "So.", "stop_reason": "stop", "generated_token_count": 3, "warnings": [],
        "rubric": {"version": 2, "status": status, "passed": passed, "human_review_required": False, "matched_required_concepts": ["a"], "missing_required_concepts": [], "forbidden_matches": []},
    }
    return {
        "version": 1, "kind": "evaluation", "algorithm": "sha256", "runner": {"version": 1, "prompt_format_version": 1},
        "suite": {"suite_id": "s", "version": 1, "purpose": "x", "expected_mode": "y", "historical_status": "z", "case_count": 3, "digest": SHA},
        "generation": {"seed": 1, "temperature": 0.2, "top_k": 5, "max_new_tokens": 80, "repetition_penalty": 1.0, "stop_token_ids": [2], "stop_at_end": True, "dtype": "f", "device": "cpu", "compile": False, "batch_size": 1, "prompt_format_version": 1, "deterministic_algorithms": True, "sampling_mode": "m"},
        "checkpoint": None, "model_configuration": {"layers": 2, "note": "a \"/quoted\" word"}, "parameter_count": 9, "tokenizer_identity": None, "data_manifest_digest": None,
        "contamination": {"status": "not_run", "held_out_status": "unverified", "suite_covered": False, "quality_report_digest": None, "data_manifest_digest": SHA, "matching_prompt_ids": [], "override_used": False, "warnings": []},
        "environment": {"python_version": "3", "pytorch_version": "2", "device": "cpu", "dtype": "f", "compile": False, "deterministic_algorithms_enabled": True, "more": 1},
        "warnings": ["w"], "results": [case(1, "pass", True), case(2, "fail", False), case(3, "unscored", None)],
        "summary": {"metric_label": "l", "total_cases": 3, "passed": 1, "failed": 1, "unscored": 1, "held_out_generalization_measured": False},
    }


def timing(version):
    seconds, tokens = [0.5, 0.25, 0.3], [10, 20, 7]
    newer = {"attention_backend": "manual", "kv_cache": True}
    return {
        "version": version, "kind": "generation_benchmark", "algorithm": "sha256", "benchmark_version": version, "checkpoint": {"logical_name": "c", "artifact_sha256": SHA}, "model_configuration": {}, "parameter_count": None, "tokenizer_identity": {},
        "configuration": {"seed": 1, "warmup_runs": 1, "measured_runs": 3, "temperature": 1, "top_k": None, "max_new_tokens": 20, "repetition_penalty": 1.1, "stop_token_ids": [], "device": "cpu", "dtype": "f", "compile": False, "deterministic_algorithms": False, "prompt_format_version": 1, "prompt_id": "p", "prompt_digest": SHA, "input_token_count": 4} | dict(list(newer.items())[: version - 1]),
        "environment": {"python_version": "3", "pytorch_version": "2", "device": "cpu", "dtype": "f", "compile": False, "deterministic_algorithms_enabled": False},
        "measurements": {
            "runs": [{"index": i, "elapsed_seconds": s, "generated_token_count": n, "tokens_per_second": n / s} for i, (s, n) in enumerate(zip(seconds, tokens, strict=True), 1)],
            "aggregate": {"total_elapsed_seconds": sum(seconds), "mean_elapsed_seconds": sum(seconds) / 3, "minimum_elapsed_seconds": 0.25, "maximum_elapsed_seconds": 0.5, "total_generated_tokens": 37, "tokens_per_second": 37 / sum(seconds)},
            "peak_cuda_memory_mib": None,
        },
        "warnings": [],
    }


def changed(report, **at):
    """A copy with values put at dotted paths; ``...`` removes."""
    report = copy.deepcopy(report)
    for path, value in at.items():
        *above, last = path.split("__")
        here = report
        for name in above:
            here = here[int(name) if name.isdigit() else name]
        if value is ...:
            del here[last]
        else:
            here[int(last) if last.isdigit() else last] = value
    return provenance.sealed(report)


E, B = evaluation(), timing(3)
CASES = [
    (changed(E), []), *[(changed(timing(v)), []) for v in (1, 2, 3)],
    (changed(E, version=2), [("$", "future version")]), (changed(E, version=0), [("$", "unsupported version")]), (changed(E, version="1"), [("$", "unsupported version")]), (changed(E, kind="poem"), [("$", "unknown kind")]),
    (changed(E, algorithm="md5", extra=1, warnings=...), [("$.algorithm", "bad value"), ("$.extra", "unknown field"), ("$.warnings", "missing")]),
    (changed(E, runner=None, suite=[1]), [("$.runner", "null"), ("$.suite", "no object")]),
    (changed(E, suite__digest="A" * 64, suite__purpose=" \n", suite__case_count=True), [("$.suite.case_count", "bad value"), ("$.suite.digest", "bad value"), ("$.suite.purpose", "bad value")]),
    (changed(E, results__1__rubric__status="maybe", results__2__rubric__passed=..., results__0__more=1, results__0__generated_token_count=-1), [("$.results[0].generated_token_count", "bad value"), ("$.results[0].more", "unknown field"), ("$.results[1].rubric.status", "bad value"), ("$.results[2].rubric.passed", "missing")]),
    (changed(E, contamination__matching_prompt_ids=["a", "", 3]), [("$.contamination.matching_prompt_ids[1]", "bad value"), ("$.contamination.matching_prompt_ids[2]", "bad value")]),
    (changed(E, results={}, warnings="w"), [("$.results", "no list"), ("$.warnings", "no list")]),
    (changed(E, model_configuration__path="C:\\x"), [("$.model_configuration", "bad value")]), (changed(E, model_configuration__deep={"a": ["/tmp"]}), [("$.model_configuration", "bad value")]),
    (changed(E, summary__passed=2, summary__failed=0), [("$.summary.failed", "other than the results"), ("$.summary.passed", "other than the results")]),
    (changed(E, results__1__prompt_id="p1", suite__case_count=4), [("$.results", "other than the suite's cases"), ("$.results", "repeated prompt id")]),
    (changed(E, results__0__rubric__passed=False, generation__prompt_format_version=2), [("$.results", "status and verdict disagree"), ("$.runner.prompt_format_version", "other than the generation's")]),
    (changed(E, contamination__status="contaminated"), [("$.contamination.held_out_status", "other than the status says")]),
    ({**changed(E), "warnings": []}, [("$.digest", "other digest")]),
    (changed(timing(2), configuration__kv_cache=True), [("$.configuration.kv_cache", "unknown field")]), (changed(B, configuration__attention_backend=...), [("$.configuration.attention_backend", "missing")]),
    (changed(B, benchmark_version=2), [("$.benchmark_version", "bad value")]), (changed(B, measurements__runs__0__elapsed_seconds=0), [("$.measurements.runs[0].elapsed_seconds", "bad value")]),
    (changed(B, measurements__runs__1__index=3), [("$.measurements.runs", "out of order")]), (changed(B, configuration__measured_runs=2), [("$.measurements.runs", "other than configured")]),
    (changed(B, measurements__aggregate__total_generated_tokens=36), [("$.measurements.aggregate.total_generated_tokens", "other than the runs")]),
    (changed(B, measurements__runs__2__tokens_per_second=1.0), [("$.measurements.runs", "other speed than tokens and seconds give")]),
    (changed(B, environment__compile=True, environment__device="cuda"), [("$.environment.compile", "other than the configuration"), ("$.environment.device", "other than the configuration")]),
    (changed(B, measurements__peak_cuda_memory_mib=1.5), [("$.measurements.peak_cuda_memory_mib", "stated of another device, or not of this")]),
]


def test_a_folder_of_reports_in_one_query(spark, tmp_path):
    for i, (report, _) in enumerate(CASES):
        (tmp_path / f"{i:02d}.json").write_text(json.dumps(report, indent=2))
    (tmp_path / "x.json").write_text("{broken")
    (tmp_path / "y.json").write_text("[1]")
    (tmp_path / "z.txt").write_text("{}")
    found: dict = {}
    for r in R.judged(R.read(spark, str(tmp_path)), R.FORMATS).collect():
        found.setdefault(r.file, []).append((r.path, r.violation))
    assert found.pop("x.json") == [("$", "no JSON")] and found.pop("y.json") == [("$", "no object")]
    for i, (_, want) in enumerate(CASES):
        assert sorted(found.get(f"{i:02d}.json", [])) == sorted(want), i


def test_schemas_of_plain_values(spark):
    schema = R.Object({"a": R.List(R.List(R.Leaf(R._NUMBERS, most=1.9))), "b": R.Object({}, more=True, null=True)})
    rows = [(1, '{"a": [[1, 1.5], []], "b": null}'), (2, '{"a": [[1, 2], 3, null], "b": {"x": 1}}'), (3, "null"), (4, "7"), (5, None), (6, '{"a": [["1"]]}')]
    frame = spark.createDataFrame(rows, "id int, text string").withColumn("v", F.try_parse_json("text"))
    got = {tuple(r) for r in R.violations(frame, schema, ["id"], "v").collect()}
    assert got == {(2, "$.a[0][1]", "bad value"), (2, "$.a[1]", "no list"), (2, "$.a[2]", "null"), (3, "$", "null"), (4, "$", "no object"), (6, "$.a[0][0]", "bad value"), (6, "$.b", "missing")}


@pytest.mark.parametrize("text", [" ", "{}"])
def test_nothing_to_judge(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert [tuple(r)[2] for r in R.judged(R.read(spark, str(tmp_path)), R.FORMATS).collect()] == ["no JSON" if text == " " else "unknown kind"]

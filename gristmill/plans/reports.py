"""Configuration, sealed reports, and their contracts: small driver-side values over Spark's aggregates."""

from __future__ import annotations

import json
import math
import os
import time
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control, documents, provenance, scoring


@dataclass(frozen=True)
class Config:
    """Settings of a run; numbers given as text are converted, unknown names are errors."""

    # fixed values: names and defaults of the settings files
    vocab_size: int = 8000
    block_size: int = 256
    n_layer: int = 4
    n_head: int = 4
    n_embd: int = 256
    dropout: float = 0.1
    learning_rate: float = 3e-4
    warmup_iters: int = 100
    max_iters: int = 2000
    eval_interval: int = 250
    early_stopping_patience: int = 0
    train_split: float = 0.9
    seed: int = 1337

    @classmethod
    def of(cls, values: Mapping[str, Any], **overrides: Any) -> Config:
        merged = {**values, **{k: v for k, v in overrides.items() if v is not None}}
        known = {f.name: f.type for f in fields(cls)}
        if unknown := sorted(set(merged) - set(known)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        convert = {"int": lambda v: int(float(v)), "float": float}
        config = cls(**{k: convert[known[k]](v) if isinstance(v, str) else v for k, v in merged.items()})
        if wrong := config.problems():
            raise ValueError("; ".join(wrong))
        return config

    def problems(self) -> list[str]:
        tests = {
            "n_embd is no multiple of n_head": self.n_head > 0 and self.n_embd % self.n_head == 0,
            "sizes must be positive": min(self.vocab_size, self.block_size, self.n_layer, self.n_head, self.n_embd, self.max_iters, self.eval_interval) > 0,
            "dropout lies outside 0 to 1": 0 <= self.dropout < 1,
            "train_split lies outside 0 to 1": 0 < self.train_split < 1,
            "learning_rate must be positive": self.learning_rate > 0,
        }
        return [k for k, ok in tests.items() if not ok]

    def snapshot(self) -> dict[str, Any]:
        return asdict(self)


def settings(spark: SparkSession, path: str, **overrides: Any) -> Config:
    """The settings of a YAML file, which Spark reads from wherever it lies, with those given here put over them."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("settings files need a YAML reader") from e
    values = yaml.safe_load("\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(2).collect())) or {}
    if not isinstance(values, dict):
        raise ValueError(f"{path} holds no settings")
    return Config.of(values, **overrides)


def write(report: Mapping[str, Any], path: str) -> None:
    """Sorted, indented JSON with a line end; an existing file is never replaced."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "x", encoding="utf-8") as out:
        out.write(json.dumps(report, ensure_ascii=False, sort_keys=True, indent=2) + "\n")


def evaluation(suite: str, scored: DataFrame, evidence: DataFrame, config: Mapping[str, Any]) -> dict[str, Any]:
    """A sealed report of a scored suite: its summary, its results in order, and how far they may be trusted."""
    status = scoring.contamination_status(evidence.where(F.col("suite") == suite)).first()
    if status is None:
        raise documents.DataQualityError(f"no evidence for {suite}")
    rows = scored.orderBy("prompt_id").collect()
    results = [{k: r[k] for k in ("prompt_id", "response", "matched", "missing", "forbidden_matches", "passed", "status")} for r in rows]
    counts = {s: sum(r["status"] == s for r in results) for s in ("pass", "fail", "human-review", "unscored")}
    return provenance.sealed({"version": 1, "kind": "evaluation", "suite": suite, "config": dict(config), "summary": {"cases": len(results), **counts}, "results": results, "contamination": status["status"]})


_EVALUATION = {"version", "kind", "suite", "config", "summary", "results", "contamination", "digest"}


def check_evaluation(report: Mapping[str, Any]) -> list[str]:
    """What breaks the contract of an evaluation report; an empty list if nothing does."""
    wrong = provenance.verify(report, _EVALUATION, 1)
    results = report.get("results", [])
    ids = [r["prompt_id"] for r in results]
    if len(ids) != len(set(ids)):
        wrong.append("repeated prompt ids")
    summary = report.get("summary", {})
    if summary.get("cases") != len(results) or any(summary.get(s) != sum(r["status"] == s for r in results) for s in ("pass", "fail", "human-review", "unscored")):
        wrong.append("the summary doesn't follow from the results")
    for r in results:
        if (r["passed"] is True) != (r["status"] == "pass") or (r["passed"] is True and (r["missing"] or r["forbidden_matches"])):
            wrong.append(f"{r['prompt_id']}: status and matches disagree")
    return wrong


def render_evaluation(report: Mapping[str, Any]) -> str:
    head = f"{report['suite']}: {report['summary']['pass']}/{report['summary']['cases']} passed ({report['contamination']})"
    lines = [f"  {r['status']:<12} {r['prompt_id']}" + (f" missing {', '.join(r['missing'])}" if r["missing"] else "") for r in report["results"]]
    return "\n".join([head, *lines]) + "\n"


def measure(run: Callable[[], int], runs: int, warmups: int = 1, clock: Callable[[], float] = time.perf_counter) -> list[tuple[int, float, int]]:
    """(index, elapsed, tokens) of measured runs; warm-ups aren't among them. A run that takes no time is an error."""
    out = []
    for i in range(-warmups, runs):
        began = clock()
        tokens = run()
        elapsed = clock() - began
        if i >= 0:
            if elapsed <= 0:
                raise ValueError("a run took no time")
            out.append((i + 1, elapsed, tokens))
    return out


def benchmark(runs: DataFrame, config: Mapping[str, Any]) -> dict[str, Any]:
    """A sealed report of timing runs (index, elapsed, tokens) and their aggregates."""
    rows = [r.asDict() for r in runs.select("index", "elapsed", "tokens").orderBy("index").collect()]
    total = control.benchmark(runs.withColumn("_all", F.lit(1)), ["_all"]).drop("_all").first().asDict()
    return provenance.sealed({"version": 3, "kind": "benchmark", "config": dict(config), "runs": rows, "aggregate": total})


def check_benchmark(report: Mapping[str, Any]) -> list[str]:
    wrong = provenance.verify(report, {"version", "kind", "config", "runs", "aggregate", "digest"}, 3)
    runs, total = report.get("runs", []), report.get("aggregate", {})
    if [r["index"] for r in runs] != list(range(1, len(runs) + 1)) or any(r["elapsed"] <= 0 or r["tokens"] < 0 for r in runs):
        return [*wrong, "bad runs"]
    if runs:
        elapsed, tokens = sum(r["elapsed"] for r in runs), sum(r["tokens"] for r in runs)
        want = {"total": elapsed, "mean": elapsed / len(runs), "least": min(r["elapsed"] for r in runs), "most": max(r["elapsed"] for r in runs), "tokens": tokens, "tokens_per_second": tokens / elapsed}
        wrong += [f"{k} doesn't follow from the runs" for k, v in want.items() if not math.isclose(total.get(k, math.nan), v, rel_tol=1e-12)]
    return wrong


def render_benchmark(report: Mapping[str, Any]) -> str:
    a = report["aggregate"]
    return f"{a['runs']} runs, {a['tokens']:,} tokens, {a['tokens_per_second']:.2f} tokens/s (mean {a['mean']:.3f} s, {a['least']:.3f} to {a['most']:.3f})\n"


def check_manifest(manifest: Mapping[str, Any]) -> list[str]:
    wrong = provenance.verify(manifest, {"version", "artifacts", "preprocessing", "tokenizer", "digest"}, 2)
    names = [(a.get("role"), a.get("logical_name")) for a in manifest.get("artifacts", [])]
    if len(names) != len(set(names)):
        wrong.append("repeated artifacts")
    return wrong


def first_difference(a: Mapping[str, Any], b: Mapping[str, Any]) -> str | None:
    """Where two manifests differ first: in the tokenizer, in artifacts, or in preprocessing."""
    return next((k for k in ("tokenizer", "artifacts", "preprocessing") if a.get(k) != b.get(k)), None)


def generate(prompts: DataFrame, producer: Callable[[list[str]], list[str]], batch: int = 8) -> DataFrame:
    """``prompts`` (prompt_id, prompt) with the responses of a batch producer, run on the executors; it answers each prompt, in order."""

    def run(frames):
        for pdf in frames:
            texts = pdf["prompt"].tolist()
            answers = [a for i in range(0, len(texts), batch) for a in producer(texts[i : i + batch])]
            if len(answers) != len(texts):
                raise ValueError("the producer left prompts without an answer")
            yield pdf.assign(response=answers)[["prompt_id", "prompt", "response"]]

    return prompts.select("prompt_id", "prompt").mapInPandas(run, "prompt_id string, prompt string, response string")


def load(path: str, check: Callable[[Mapping[str, Any]], list[str]]) -> dict[str, Any]:
    """A report of a file, once its contract holds; what breaks it is an error."""
    with open(path, encoding="utf-8") as file:
        report = json.load(file)
    if wrong := check(report):
        raise documents.DataQualityError("; ".join(wrong))
    return report


def checked_write(report: Mapping[str, Any], path: str, check: Callable[[Mapping[str, Any]], list[str]]) -> None:
    """Write a report whose contract holds; nothing is written if it doesn't."""
    if wrong := check(report):
        raise documents.DataQualityError("; ".join(wrong))
    write(report, path)


def orphans(report: str, manifest: str) -> str | None:
    """What is missing of a report and its manifest, which belong together: a file, or nothing."""
    have = os.path.exists(report), os.path.exists(manifest)
    return None if have[0] == have[1] else "orphaned report" if have[0] else "orphaned manifest"


def preprocessing_identity(report: Mapping[str, Any]) -> dict[str, Any]:
    """What a manifest says of the quality report that its data went through."""
    return {"quality_report_digest": report["digest"], "quality_report_version": report["version"], "policy": dict(report["policy"]), "counts": dict(report["counts"])}


def rebuilt_manifest(existing: Mapping[str, Any] | None, artifacts: list[Mapping[str, Any]], report: Mapping[str, Any] | None, tokenizer: Mapping[str, Any]) -> dict[str, Any]:
    """The existing manifest if it says the same, or else a new one. Without a report only an existing version 1 manifest may stand."""
    if report is None:
        if existing is not None and existing.get("version") == 1:
            return dict(existing)
        raise documents.DataQualityError("no quality report, and no manifest from before there were any")
    new = provenance.manifest(artifacts, preprocessing_identity(report), tokenizer)
    return dict(existing) if existing is not None and first_difference(existing, new) is None else new


def checkpoint_provenance(kind: str, manifest: Mapping[str, Any], tokenizer: Mapping[str, Any], config: Mapping[str, Any]) -> dict[str, Any]:
    """The sealed origin of a checkpoint."""
    if kind not in provenance.KINDS:
        raise ValueError(f"unknown kind {kind}")
    return provenance.sealed({"version": provenance.CHECKPOINT_VERSION, "kind": kind, "manifest": manifest["digest"], "tokenizer": tokenizer["digest"], "config": provenance.digest_of(config, ())})


def supervised_report(records: DataFrame, dataset: str, output_sha256: str, suites: Mapping[str, tuple[int, list[str]]], findings: int, near: list[Mapping[str, Any]], seed: int, ratio: float) -> dict[str, Any]:
    """A sealed report of a supervised set: counts by family, both splits by family, the audit of all suites, and the review of near pairs."""
    groups = records.select(F.col("category").alias("family"), "group_id")
    splits = documents.family_splits(groups, seed, ratio)
    joined = groups.join(splits, ["family", "group_id"]).groupBy("family", "split").agg(F.count("*").alias("n")).collect()
    by_side = {side: {r.family: r.n for r in joined if r.split == side} for side in (documents.TRAIN, documents.VALIDATION)}
    leaked = [r.group_id for r in splits.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").orderBy("group_id").collect()]
    families = {f: sum(by_side[s].get(f, 0) for s in by_side) for f in sorted({r.family for r in joined})}
    audit = [provenance.sealed({"suite": k, "version": v, "prompt_ids": list(ids)}) for k, (v, ids) in sorted(suites.items())]
    value = {
        "version": 1, "kind": "supervised_quality", "dataset": dataset, "output_sha256": output_sha256, "counts": {"records": sum(families.values())}, "family_counts": families,
        "deduplication": {"near": len(near), "review": [dict(n) for n in near]}, "split_readiness": provenance.sealed({"family_counts": by_side, "group_leakage": leaked}),
        "evaluation_audit": {"suites": audit, "exact_findings": findings, "near_findings": 0},
    }
    return provenance.sealed(value)


def metric_label(suite: str, status: str, labels: Mapping[tuple[str | None, str | None], str]) -> str:
    """What a suite's share of passes may be called: the caller's label for the suite and its contamination's status. None stands for any, and a suite's own labels come first."""
    for key in ((suite, status), (suite, None), (None, status), (None, None)):
        if key in labels:
            return labels[key]
    raise KeyError(f"no label for {suite} with status {status}")


def tiny(tokens: int, block: int) -> bool:
    """Whether a set of tokens is so small that it will be memorized."""
    return tokens < block * 20


def aligned(config: Config, vocabulary: int) -> Config:
    """The settings with the tokenizer's own number of ids."""
    return Config.of(config.snapshot() | {"vocab_size": vocabulary})


def supervised_manifest(records: DataFrame, report: Mapping[str, Any], output: Mapping[str, Any], components: list[Mapping[str, Any]], build: Mapping[str, Any]) -> dict[str, Any]:
    """A sealed manifest of a supervised set: its file (logical_name, sha256, size_bytes), what it is trained with, how its records are grouped, and its sealed report.

    Records are counted by Spark; a group is a row of the aggregate, and only their sizes' distribution comes here.
    """
    sizes = records.groupBy("group_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups")).orderBy("size").collect()
    counts = {"records": sum(r.size * r.groups for r in sizes), "groups": sum(r.groups for r in sizes)}
    listed = sorted(({k: c[k] for k in ("name", "logical_name", "sha256", "record_count")} for c in components), key=lambda c: c["name"])
    return provenance.sealed({
        "version": 1, "kind": "supervised_manifest", "dataset": report["dataset"], "output": {**{k: output[k] for k in ("logical_name", "sha256", "size_bytes")}, "record_count": counts["records"]}, "components": listed, "build": dict(build),
        "grouping": {"group_count": counts["groups"], "group_sizes": {str(r.size): r.groups for r in sizes}, "split_digest": report["split_readiness"]["digest"]}, "evaluation_audit": report["evaluation_audit"], "quality_report": {"digest": report["digest"]},
    })

"""Contracts of relations and of reports: each rule with how many rows break it, and errors for what must not pass."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import conversations, provenance
from .documents import TRAIN, VALIDATION, DataQualityError

#: How many records a supervised set has, the least of a family, and its greatest share.
RECORDS, LEAST, SHARE = (750, 1100), 50, 0.15
MATCH_TYPES = ("full-document", "field-exact", "normalized-substring")
STATUSES = ("pass", "fail", "human-review", "unscored")


def tally(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(check, violations): for each rule the number of rows for which it is true, in one aggregation."""
    counted = df.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(f"r{i}") for i, test in enumerate(rules.values())])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)])))


def require(found: DataFrame) -> None:
    """An error that names every check (check, violations) with violations."""
    if broken := [f"{r.check} ({r.violations})" for r in found.where("violations > 0").orderBy("check").collect()]:
        raise DataQualityError("; ".join(broken))


def _repeats(df: DataFrame, key: Column, name: str) -> DataFrame:
    """How many rows come again, of one check."""
    return df.groupBy(key.alias("k")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("violations")).select(F.lit(name).alias("check"), "violations")


def documents_contract(docs: DataFrame) -> DataFrame:
    """(check, violations) of raw documents (document_id, text, source, explicit_split)."""
    c = F.col
    return tally(docs, {
        "blank text": T.strip(F.coalesce(c("text"), F.lit(""))) == "",
        "blank id": T.strip(F.coalesce(c("document_id"), F.lit(""))) == "",
        "absolute id": c("document_id").rlike(r"\A(?:[A-Za-z]:[\\/]|[/\\])"),
        "bad source": T.logical_name(c("source")).isNull(),
        "unknown split": ~F.coalesce(c("explicit_split"), F.lit(TRAIN)).isin(TRAIN, VALIDATION),
    })


def groups_contract(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(check, violations) of identified documents and their duplicate groups: one content an id, one asked split a group, and two groups at least."""
    ids = docs.groupBy("document_id").agg(F.count_distinct("canonical_fingerprint").alias("n"))
    few = groups.agg((F.count("*") < 2).cast("long").alias("violations")).select(F.lit("fewer than two groups").alias("check"), "violations")
    return tally(ids, {"ambiguous id": F.col("n") > 1}).unionByName(tally(groups, {"conflicting splits": F.col("explicit_split") != F.col("other_split")})).unionByName(few)


def prompts_contract(prompts: DataFrame) -> DataFrame:
    """(check, violations) of prompts (prompt_id, suite, text): each id once, and nothing blank."""
    blank = {f"blank {c}": T.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in ("prompt_id", "suite", "text")}
    return tally(prompts, blank).unionByName(_repeats(prompts, F.col("prompt_id"), "repeated prompt id"))


def items_contract(items: DataFrame, threshold: float) -> DataFrame:
    """(check, violations) of items (item_id, text) whose near pairs are sought; a threshold out of range is an error."""
    if isinstance(threshold, bool) or not 0 < threshold <= 1:
        raise DataQualityError("the threshold lies above 0 and is 1 at most")
    blank = {f"blank {c}": T.strip(F.coalesce(F.col(c), F.lit(""))) == "" for c in ("item_id", "text")}
    return tally(items, blank).unionByName(_repeats(items, F.col("item_id"), "repeated item id"))


def records_contract(records: DataFrame, dataset: str, families: list[str], opposed: Mapping[str, tuple[str, ...]] | None = None, rows: tuple[int, int] = RECORDS, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(check, violations): all rules of the supervised contract, those of single records (``conversations.violations``) and those of the set.

    The columns are those of the contract and no others; every family occurs, often enough
    and not too often; and the number of records lies in its band.
    """
    extra, missing = sorted(set(records.columns) - set(conversations.FIELDS)), sorted(set(conversations.FIELDS) - set(records.columns))
    if extra or missing:
        raise DataQualityError(f"the records' columns: missing {missing}, unknown {extra}")
    own = conversations.violations(records, dataset, families, dict(opposed or {})).groupBy(F.col("rule").alias("check")).agg(F.count("*").alias("violations"))
    counts = records.sparkSession.createDataFrame([(f,) for f in families], "category string").join(records.groupBy("category").agg(F.count("*").alias("n")), "category", "left")
    n = F.coalesce("n", F.lit(0))
    sized = counts.join(F.broadcast(records.agg(F.count("*").alias("total"))))  # one row is joined
    of_set = tally(sized, {"absent family": n == 0, "rare family": n < least, "dominant family": F.try_divide(n, F.col("total")) > share})
    band = records.agg((~F.count("*").between(*rows)).cast("long").alias("violations")).select(F.lit("number of records").alias("check"), "violations")
    return own.unionByName(of_set).unionByName(band)


def conditional(rows: DataFrame, when: Column, holds: list[str], lacks: list[str], column: str) -> DataFrame:
    """(rows', rule): rows that a condition concerns and whose text, in lower case, lacks a needed phrase or holds a forbidden one."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    tests = [F.when(~F.contains(low, F.lit(p.lower())), F.lit(f"lacks {p}")) for p in holds] + [F.when(F.contains(low, F.lit(p.lower())), F.lit(f"holds {p}")) for p in lacks]
    return rows.where(when).withColumn("rule", F.explode(F.array_compact(F.array(*tests))))


def answers(outputs: DataFrame, predicates: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """``outputs`` (prompt_id, response, ...) with ``ok`` and ``reasons``. ``predicates``: (prompt_id, phrases that the lower-cased response holds, phrases that it doesn't); of a prompt without one both are null."""
    low = F.lower(F.coalesce("response", F.lit("")))
    reasons = F.lit(None).cast("array<string>")
    for prompt, holds, lacks in predicates:
        tests = [F.when(~F.contains(low, F.lit(p.lower())), F.lit(f"lacks {p}")) for p in holds] + [F.when(F.contains(low, F.lit(p.lower())), F.lit(f"holds {p}")) for p in lacks]
        found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
        reasons = F.when(F.col("prompt_id") == prompt, found).otherwise(reasons)
    return outputs.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)


def zipped(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Cases (suite, ordinal, prompt_id) with the outputs (suite, ordinal, response) of the same place; a case without output, or the other way round, has a ``fault``."""
    joined = cases.join(outputs, ["suite", "ordinal"], "full")
    fault = F.when(F.col("prompt_id").isNull(), "output without a case").when(F.col("response").isNull(), "case without an output")
    return joined.select("suite", "ordinal", "prompt_id", "response", fault.alias("fault"))


def coverage(suites: DataFrame, audited: DataFrame) -> DataFrame:
    """(suite, status): whether an audit (suite, version, ordinal, prompt_id) covers just the cases (same columns) of each suite, in order."""
    listed = lambda d, n: d.groupBy("suite").agg(F.max("version").alias(f"{n}_version"), F.sort_array(F.collect_list(F.struct("ordinal", "prompt_id"))).alias(n))
    joined = listed(suites, "own").join(listed(audited, "audit"), "suite", "full")
    ids = lambda c: F.transform(c, lambda x: x["prompt_id"])
    status = F.when(F.col("own").isNull(), "unknown suite").when(F.col("audit").isNull(), "not audited").when(F.col("own_version") != F.col("audit_version"), "other version")
    return joined.select("suite", status.when(ids("own") == ids("audit"), "covered").when(F.array_sort(ids("own")) == F.array_sort(ids("audit")), "reordered").otherwise("other cases").alias("status"))


def same_sets(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row (left_only, right_only, equal): set equality of the keys of two tables."""
    a, b = left.select(*keys).distinct().withColumn("l", F.lit(1)), right.select(*keys).distinct().withColumn("r", F.lit(1))
    counts = a.join(b, keys, "full").agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))
    return counts.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def linkage(reports: DataFrame, manifests: DataFrame) -> DataFrame:
    """(digest, status) of reports (digest, version, policy) and of manifests (report_digest, version, policy) that name them: linked, orphans, or what differs."""
    r = reports.select("digest", F.col("version").alias("r_version"), F.col("policy").alias("r_policy"), F.lit(1).alias("r"))
    m = manifests.select(F.col("report_digest").alias("digest"), F.col("version").alias("m_version"), F.col("policy").alias("m_policy"), F.lit(1).alias("m"))
    c = F.col
    status = F.when(c("m").isNull(), "orphaned report").when(c("r").isNull(), "orphaned manifest").when(~c("r_version").eqNullSafe(c("m_version")), "other version").when(~c("r_policy").eqNullSafe(c("m_policy")), "other policy")
    return r.join(m, "digest", "full").select("digest", status.otherwise("linked").alias("status"))


def results_contract(results: DataFrame) -> DataFrame:
    """(check, violations) of an evaluation's results (prompt_id, matched, missing, forbidden_matches, passed, status)."""
    c = F.col
    found = (F.size("missing") > 0) | (F.size("forbidden_matches") > 0)
    own = tally(results, {
        "unknown status": ~c("status").isin(*STATUSES),
        "passed without status": (c("status") == "pass") != F.coalesce(c("passed"), F.lit(False)),
        "failed without verdict": (c("status") == "fail") & c("passed").isNull(),
        "verdict without scoring": c("status").isin("human-review", "unscored") & c("passed").isNotNull(),
        "passed with faults": c("passed") & found,
        "matched and missing": F.arrays_overlap("matched", "missing"),
    })
    return own.unionByName(_repeats(results, c("prompt_id"), "repeated prompt id"))


def timing_contract(runs: DataFrame, aggregates: DataFrame, by: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(check, violations) of stated aggregates (by, runs, total, mean, least, most, tokens) against their runs (by, elapsed, tokens): each worked out again."""
    again = runs.groupBy(*by).agg(F.count("*").alias("runs"), F.sum("elapsed").alias("total"), F.avg("elapsed").alias("mean"), F.min("elapsed").alias("least"), F.max("elapsed").alias("most"), F.sum("tokens").alias("tokens"))
    names = ("runs", "total", "mean", "least", "most", "tokens")
    joined = aggregates.select(*by, F.struct(*names).alias("said")).join(again.select(*by, F.struct(*names).alias("true")), by, "full")
    close = lambda n: F.abs(F.col(f"said.{n}") - F.col(f"true.{n}")) <= tolerance * F.greatest(F.abs(F.col(f"said.{n}")), F.abs(F.col(f"true.{n}")))
    both = F.col("said").isNotNull() & F.col("true").isNotNull()
    return tally(joined, {"runs without aggregate": F.col("said").isNull(), "aggregate without runs": F.col("true").isNull()} | {f"other {n}": both & ~close(n) for n in names})


def near_counts(findings: DataFrame) -> DataFrame:
    """One row: near pairs (left_group, right_group, classification), those within a group and across, and each class of the review."""
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    c = F.col
    return findings.agg(
        F.count("*").alias("findings"), count(c("left_group") == c("right_group")).alias("within"), count(c("left_group") != c("right_group")).alias("across"),
        count(c("classification") == conversations.EXPECTED).alias("expected"), count(c("classification") == conversations.LEGITIMATE).alias("legitimate"), count(c("classification") == conversations.REWRITE).alias("rewrite"),
    )


# reports and manifests: single small values


def _whole(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= 0


def _hex(value: Any, digits: int = 64) -> bool:
    return isinstance(value, str) and re.fullmatch(rf"[0-9a-f]{{{digits}}}", value) is not None


def quality_report(report: Mapping[str, Any]) -> list[str]:
    """What breaks the contract of a data quality report; an empty list if nothing does."""
    wrong = provenance.verify(report, {"version", "kind", "policy", "counts", "splits", "digest"}, 1)
    counts, splits, policy = (report.get(k) if isinstance(report.get(k), Mapping) else {} for k in ("counts", "splits", "policy"))
    names = ("documents", "groups", "removed", "raw_duplicates", "canonical_duplicates")
    if any(not _whole(counts.get(n)) for n in names):
        return [*wrong, "the counts are no whole numbers"]
    if counts["documents"] != counts["groups"] + counts["removed"]:
        wrong.append("documents are not the groups and what was removed")
    if counts["removed"] != counts["raw_duplicates"] + counts["canonical_duplicates"]:
        wrong.append("what was removed is not the raw and canonical duplicates")
    if not set(splits) <= {TRAIN, VALIDATION} or any(not _whole(v.get(n)) for v in splits.values() for n in ("groups", "documents", "contaminated")):
        wrong.append("the splits are unknown or not counted")
    elif sum(v["groups"] for v in splits.values()) != counts["groups"] or sum(v["documents"] for v in splits.values()) != counts["documents"]:
        wrong.append("the splits don't add up")
    ratio = policy.get("validation_ratio")
    if isinstance(ratio, bool) or not isinstance(ratio, (int, float)) or not 0 < ratio < 1 or isinstance(policy.get("seed"), bool) or not isinstance(policy.get("seed"), int):
        wrong.append("the policy's seed or ratio is out of range")
    for f in report.get("findings", []):
        if f.get("match_type") not in MATCH_TYPES or not _hex(f.get("document_fingerprint"), 12):
            wrong.append("a finding has an unknown match or a bad fingerprint")
    return wrong


def manifest(value: Mapping[str, Any], report: Mapping[str, Any] | None = None) -> list[str]:
    """What breaks the contract of a data manifest: of version 1, without document awareness, or of version 2, whose preprocessing names its quality report."""
    version = value.get("version")
    if version not in (1, 2):
        return ["unsupported version"]
    wrong = provenance.verify(value, {"version", "artifacts", "preprocessing", "tokenizer", "digest"}, version)
    artifacts, preprocessing = value.get("artifacts") or [], value.get("preprocessing") or {}
    names = [(a.get("role"), a.get("logical_name")) for a in artifacts]
    if len(names) != len(set(names)):
        wrong.append("repeated artifacts")
    if names != sorted(names, key=str):
        wrong.append("artifacts out of order")
    if any(not _hex(a.get("sha256")) or not _whole(a.get("size_bytes")) for a in artifacts):
        wrong.append("an artifact without size and digest")
    linked = preprocessing.get("quality_report_digest")
    if version == 1 and linked is not None:
        wrong.append("a version 1 manifest names a quality report")
    if version == 2:
        if not _hex(linked):
            wrong.append("no quality report is named")
        elif report is None:
            wrong.append("orphaned manifest: its quality report is missing")
        elif report.get("digest") != linked or report.get("policy") != preprocessing.get("policy"):
            wrong.append("the quality report is another one, or of another policy")
    return wrong


def supervised_report(report: Mapping[str, Any], suites: Mapping[str, tuple[int, list[str]]], families: Iterable[str]) -> list[str]:
    """What breaks the contract of a supervised set's report: its audit covers every suite (name: version and prompt ids) without findings, both splits have every family, and each near pair is reviewed."""
    wrong = provenance.verify(report, {"version", "kind", "dataset", "output_sha256", "counts", "family_counts", "deduplication", "split_readiness", "evaluation_audit", "digest"}, 1)
    if not _hex(report.get("output_sha256")):
        wrong.append("no digest of the output")
    audit = report.get("evaluation_audit") or {}
    if {s.get("suite"): (s.get("version"), s.get("prompt_ids")) for s in audit.get("suites", [])} != {k: (v, list(ids)) for k, (v, ids) in suites.items()}:
        wrong.append("the audit doesn't cover the suites")
    if any(s.get("digest") != provenance.digest_of(s) for s in audit.get("suites", [])):
        wrong.append("a suite's digest doesn't match")
    if audit.get("exact_findings") or audit.get("near_findings"):
        wrong.append("evaluation prompts occur")
    split = report.get("split_readiness") or {}
    if split.get("digest") != provenance.digest_of(split) or split.get("group_leakage") != []:
        wrong.append("the split has leakage or another digest")
    if any(set((split.get("family_counts") or {}).get(side, {})) != set(families) for side in (TRAIN, VALIDATION)):
        wrong.append("a split lacks a family")
    near = report.get("deduplication") or {}
    review = near.get("review", [])
    if len(review) != near.get("near") or any(r.get("classification") == conversations.REWRITE for r in review):
        wrong.append("near pairs aren't reviewed, or are to be rewritten")
    return wrong


def supervised_manifest(value: Mapping[str, Any], report: Mapping[str, Any] | None) -> list[str]:
    """What breaks the contract of a supervised set's manifest, and its link to the report that it names."""
    wrong = provenance.verify(value, {"version", "kind", "dataset", "output", "components", "build", "grouping", "evaluation_audit", "quality_report", "digest"}, 1)
    output, grouping, components = value.get("output") or {}, value.get("grouping") or {}, value.get("components") or []
    if not _hex(output.get("sha256")) or not _whole(output.get("size_bytes")) or not _whole(output.get("record_count")):
        wrong.append("the output has no digest, size and count")
    sizes = grouping.get("group_sizes") or {}
    if sum(sizes.values()) != grouping.get("group_count") or sum(int(k) * n for k, n in sizes.items()) != output.get("record_count"):
        wrong.append("the groups don't add up")
    if any(not _hex(c.get("sha256")) or not _whole(c.get("record_count")) for c in components) or len({c.get("name") for c in components}) != len(components):
        wrong.append("a component has no digest and count, or is named twice")
    own = [c for c in components if c.get("sha256") == output.get("sha256")]
    if len(own) != 1 or own[0].get("record_count") != output.get("record_count"):
        wrong.append("the output isn't a component")
    if report is None:
        return [*wrong, "orphaned manifest: its report is missing"]
    if (value.get("quality_report") or {}).get("digest") != report.get("digest"):
        return [*wrong, "the report is another one"]
    if report.get("output_sha256") != output.get("sha256") or report.get("counts", {}).get("records") != output.get("record_count") or report.get("dataset") != value.get("dataset"):
        wrong.append("the report is of another output")
    if report.get("evaluation_audit") != value.get("evaluation_audit") or (report.get("split_readiness") or {}).get("digest") != grouping.get("split_digest"):
        wrong.append("audit or split differ from the report's")
    return wrong


def tokenizer(identity: Mapping[str, Any]) -> list[str]:
    """What breaks the contract of a tokenizer's identity."""
    wrong = provenance.verify(identity, {"version", "algorithm", "model_sha256", "vocab_size", "special_tokens", "digest"}, 1)
    special = identity.get("special_tokens")
    if not _hex(identity.get("model_sha256")):
        wrong.append("no digest of the model")
    if not _whole(identity.get("vocab_size")) or not identity.get("vocab_size"):
        wrong.append("no vocabulary size")
    if not isinstance(special, Mapping) or set(special) != set(provenance.SPECIAL_TOKENS):
        wrong.append("the special tokens are incomplete")
    elif any(not _whole(i) or i >= (identity.get("vocab_size") or 0) for i in special.values()) or len(set(special.values())) < len(special):
        wrong.append("special tokens share ids, or have some out of range")
    return wrong


def same_tokenizer(saved: Mapping[str, Any], running: Mapping[str, Any]) -> list[str]:
    """In what two identities differ; broken ones are an error that says of which side."""
    for side, identity in (("saved", saved), ("running", running)):
        if wrong := tokenizer(identity):
            raise ValueError(f"the {side} tokenizer's identity: {'; '.join(wrong)}")
    return provenance.differences(saved, running)


def generation(values: Mapping[str, Any]) -> list[str]:
    """What is out of range in settings of generation."""
    number = lambda k, ok: k not in values or isinstance(values[k], (int, float)) and not isinstance(values[k], bool) and ok(values[k])
    tests = {"temperature": lambda v: v > 0, "top_k": lambda v: v >= 0 and int(v) == v, "max_new_tokens": lambda v: v > 0 and int(v) == v, "repetition_penalty": lambda v: v > 0, "batch_size": lambda v: v > 0 and int(v) == v, "seed": lambda v: int(v) == v, "runs": lambda v: v > 0 and int(v) == v, "warmups": lambda v: v >= 0 and int(v) == v}
    return [f"unknown setting {k}" for k in sorted(set(values) - set(tests))] + [f"{k} is out of range" for k, ok in tests.items() if not number(k, ok)]

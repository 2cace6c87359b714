"""The flagship plan: documents to duplicate groups, splits and overlap with evaluation prompts, and its reports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents, overlap, provenance


def split_summary(docs: DataFrame, prompts: DataFrame, seed: int, ratio: float) -> DataFrame:
    """(split, groups, documents, contaminated): a deterministic split, with how many groups hold an evaluation prompt."""
    groups = documents.assign_splits(documents.duplicate_groups(docs), seed, ratio).select("canonical_fingerprint", "members", "split")
    found = overlap.contamination(docs, prompts)
    hit = docs.select("document_id", "source", "canonical_fingerprint").join(found.select("document_id", "source"), ["document_id", "source"], "left_semi").select("canonical_fingerprint").distinct()
    joined = groups.join(hit.withColumn("hit", F.lit(1)), "canonical_fingerprint", "left")
    return joined.groupBy("split").agg(F.count("*").alias("groups"), F.sum("members").alias("documents"), F.count("hit").alias("contaminated"))


def quality_report(docs: DataFrame, prompts: DataFrame, seed: int, ratio: float, allow_contamination: bool = False) -> dict[str, Any]:
    """A sealed report of counts; it fails if evaluation prompts occur in documents, unless that is allowed."""
    counts = documents.duplicate_counts(docs).first().asDict()
    split = {r["split"]: r.asDict() for r in split_summary(docs, prompts, seed, ratio).collect()}
    hit = sum(r["contaminated"] for r in split.values())
    if hit and not allow_contamination:
        raise documents.DataQualityError(f"{hit} groups hold evaluation prompts")
    if documents.ambiguous_ids(docs).limit(1).count():
        raise documents.DataQualityError("an id stands for several contents")
    if counts["removed"] != counts["raw_duplicates"] + counts["canonical_duplicates"]:
        raise documents.DataQualityError("the counts don't add up")
    policy = {"seed": seed, "validation_ratio": ratio, "allow_eval_contamination": allow_contamination}
    return provenance.sealed({"version": 1, "kind": "data_quality", "policy": policy, "counts": counts, "splits": {k: {n: v for n, v in r.items() if n != "split"} for k, r in sorted(split.items())}})

"""Scoring of responses against rubrics, and how far a suite's results may be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters that no text of a rubric holds.
_MARK, _OUTER = "\x01", "\x02"
#: Schema of rubrics: a concept is met by any of its phrases.
RUBRIC = "prompt_id string, required array<struct<concept: string, phrases: array<string>>>, forbidden array<string>, combinations array<array<string>>, human_review boolean"


def score(responses: DataFrame, rubrics: DataFrame) -> DataFrame:
    """``responses`` (prompt_id, response, ...) with matched and missing concepts, forbidden matches, status and passed. Prompts without a rubric are unscored."""
    # lambdas can't hold the Python path of folding, so arrays are folded as one text each
    plain = lambda x: F.array_join(T.word_list(x), " ")
    flat = lambda a: F.transform(F.split(T.folded(F.array_join(a, _MARK)), _MARK, -1), plain)
    nested = lambda a: F.transform(F.split(T.folded(F.array_join(F.transform(a, lambda x: F.array_join(x, _MARK)), _OUTER)), _OUTER, -1), lambda x: F.transform(F.split(x, _MARK, -1), plain))
    rubrics = rubrics.withColumn("_phrases", nested(F.transform("required", lambda r: r["phrases"])))
    ready = rubrics.select(
        "prompt_id", "human_review", F.lit(True).alias("_known"), "forbidden", "combinations",
        F.transform("required", lambda r, i: F.struct(r["concept"].alias("concept"), F.get(F.col("_phrases"), i).alias("phrases"))).alias("required"),
        flat(F.col("forbidden")).alias("forbidden_texts"), nested(F.col("combinations")).alias("combination_texts"),
    )
    joined = responses.withColumn("_answer", T.rubric_text(F.coalesce("response", F.lit("")))).join(ready, "prompt_id", "left")
    answer = F.col("_answer")
    inside = lambda p: F.contains(answer, p)
    met = lambda r: F.exists(r["phrases"], lambda p: (p != "") & inside(p))
    concept = lambda r: r["concept"]
    terms = F.filter(F.transform("forbidden", lambda t, i: F.when(inside(F.get(F.col("forbidden_texts"), i)), t)), lambda t: t.isNotNull())
    combined = F.filter(F.transform("combinations", lambda c, i: F.when(F.forall(F.get(F.col("combination_texts"), i), inside), F.array_join(c, " + "))), lambda t: t.isNotNull())
    out = joined.withColumns({"matched": F.transform(F.filter("required", met), concept), "missing": F.transform(F.filter("required", lambda r: ~met(r)), concept), "forbidden_matches": F.concat(terms, combined)})
    known = F.coalesce("_known", F.lit(False))
    passed = F.when(known & ~F.col("human_review"), (answer != "") & (F.size("missing") == 0) & (F.size("forbidden_matches") == 0))
    status = F.when(~known, "unscored").when(F.col("human_review"), "human-review").when(passed, "pass").otherwise("fail")
    return out.select(*responses.columns, "matched", "missing", "forbidden_matches", passed.alias("passed"), status.alias("status"))


def summary(scored: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return scored.agg(F.count("*").alias("cases"), count("pass").alias("passed"), count("fail").alias("failed"), F.count_if(F.col("status").isin("unscored", "human-review")).alias("unscored"))


def contamination_status(evidence: DataFrame) -> DataFrame:
    """``evidence`` with ``status``: one chain of reasons, the first that holds.

    Columns: retention (of a suite known to overlap), has_report, findings, covered,
    manifest_version (null: none), report_digest, linked_report_digest,
    manifest_digest, checkpoint_digest, override.
    """
    c = F.col
    linked = c("linked_report_digest").eqNullSafe(c("report_digest")) & c("checkpoint_digest").isNotNull() & c("checkpoint_digest").eqNullSafe(c("manifest_digest"))
    status = (
        F.when(c("retention"), "contaminated")
        .when(~c("has_report"), "audit_unavailable")
        .when(c("findings") > 0, "contaminated")
        .when(~c("covered"), "audit_does_not_cover_suite")
        .when(c("manifest_version").isNull(), "provenance_mismatch")
        .when(c("manifest_version") != 2, "legacy_unverified")
        .when(~linked, "provenance_mismatch")
        .when(c("override"), "contaminated")
        .otherwise("verified_clean")
    )
    return evidence.withColumn("status", status)


def stop_reason(stopped: Column, tokens: Column, most: Column) -> Column:
    return F.when(stopped, "stop_token").when(tokens >= most, "max_new_tokens").otherwise("model_complete")


def requirements(rubrics: DataFrame) -> DataFrame:
    """(prompt_id, concept, phrase): rubrics laid flat."""
    return rubrics.select("prompt_id", F.inline("required")).select("prompt_id", "concept", F.explode("phrases").alias("phrase"))

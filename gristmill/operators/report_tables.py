"""Many JSON reports judged at once: closed nested schemas as tables of paths, joined with the reports' VARIANT values level by level, and rules between their parts.

A schema says which fields an object has and what each is; what doesn't fit becomes a row (file, path, violation). Each level of all reports
is one join with the schema's few rows and one explode, so the plan grows with the schema's depth only and the work with the reports' text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import provenance
from .checks import STATUSES

Test = Callable[[Column], Column]
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


@dataclass(frozen=True)
class Leaf:
    """A value of one of these kinds whose text matches ``pattern`` and whose number lies in a range, whose least may be left out; or null if that is allowed."""

    kinds: tuple[str, ...]
    pattern: str | None = None
    least: float | None = None
    most: float | None = None
    above: bool = False
    null: bool = False


@dataclass(frozen=True)
class Object:
    """An object of these fields and, unless ``more``, of no others."""

    fields: Mapping[str, Leaf | Object | List] = field(default_factory=dict)
    more: bool = False
    null: bool = False


@dataclass(frozen=True)
class List:
    item: Leaf | Object | List
    null: bool = False


Node = Leaf | Object | List


def text(filled: bool = False) -> Leaf:
    return Leaf(("STRING",), r"\S" if filled else None)


def choice(*values: str) -> Leaf:
    return Leaf(("STRING",), rf"\A({'|'.join(map(re.escape, values))})\z")


def digest(null: bool = False) -> Leaf:
    return Leaf(("STRING",), r"\A[0-9a-f]{64}\z", null=null)


def whole(least: int | None = 0, most: int | None = None, null: bool = False) -> Leaf:
    return Leaf(("BIGINT",), None, least, most, null=null)


def number(least: float | None = None, above: bool = False, null: bool = False) -> Leaf:
    return Leaf(_NUMBERS, None, least, None, above, null)


def flag(null: bool = False) -> Leaf:
    return Leaf(("BOOLEAN",), null=null)


def relative(null: bool = False) -> Leaf:
    """An object of any fields in which no text is an absolute path."""
    return Leaf(("OBJECT",), r'(?s)\A(?!.*(?<!\\)"(/|\\\\|.:(/|\\\\)))', null=null)


def _as(v: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, kind)


_SCHEMA = "schema string, place string, shape string, kinds array<string>, pattern string, least double, most double, above boolean, may_be_null boolean, fields array<string>, closed boolean"


def _places(node: Node, schema: str, place: str = "$") -> Iterator[tuple]:
    """The schema's rows: what is to be at each place, any item of a list being at the same."""
    if isinstance(node, Leaf):
        bounds = [None if x is None else float(x) for x in (node.least, node.most)]
        yield schema, place, "leaf", list(node.kinds), node.pattern, *bounds, node.above, node.null, [], False
    elif isinstance(node, List):
        yield schema, place, "list", ["ARRAY"], None, None, None, False, node.null, [], False
        yield from _places(node.item, schema, f"{place}[]")
    else:
        yield schema, place, "object", ["OBJECT"], None, None, None, False, node.null, list(node.fields), not node.more
        for name, below in node.fields.items():
            yield from _places(below, schema, f"{place}.{name}")


def _depth(node: Node) -> int:
    below = [node.item] if isinstance(node, List) else node.fields.values() if isinstance(node, Object) else []
    return 1 + max(map(_depth, below), default=0)


def _judge_level(rows: DataFrame) -> Column:
    """What is wrong with each value itself, and which fields it lacks or has beside."""
    v, c = F.col("v"), F.col
    one = lambda what, when: F.when(F.coalesce(when, F.lit(False)), F.array(F.struct(c("path"), F.lit(what).alias("violation"))))
    value = F.coalesce(F.when(c("kind") == "OBJECT", F.to_json(v)).otherwise(_as(v, "string")), F.lit(""))
    amount = F.when(c("kind").isin(*_NUMBERS), _as(v, "double"))
    in_range = F.coalesce((amount > c("least")) | ((amount == c("least")) & ~c("above")), F.lit(True)) & F.coalesce(amount <= c("most"), F.lit(True))
    fits = F.array_contains("kinds", c("kind")) & F.coalesce(F.rlike(value, c("pattern")), F.lit(True)) & in_range
    names = F.map_keys(_as(v, "map<string,variant>"))
    listed = lambda found, what: F.transform(F.array_sort(found), lambda k: F.struct(F.concat("path", F.lit("."), k).alias("path"), F.lit(what).alias("violation")))
    parts = F.concat(listed(F.array_except("fields", names), "missing"), F.when(c("closed"), listed(F.array_except(names, c("fields")), "unknown field")).otherwise(F.array().cast("array<struct<path string, violation string>>")))
    return (
        F.when(c("kind") == "VOID", one("null", ~c("may_be_null")))
        .when(c("shape") == "leaf", one("bad value", ~fits))
        .when(c("shape") == "list", one("no list", c("kind") != "ARRAY"))
        .when(c("kind") != "OBJECT", one("no object", F.lit(True)))
        .otherwise(parts)
    )


def violations(reports: DataFrame, schemas: Mapping[str, Node] | Node, keys: list[str], value: str = "report", schema: str | None = None) -> DataFrame:
    """(keys, path, violation) of every place where a row's VARIANT ``value`` departs from its schema: the one given, or that which the column ``schema`` names."""
    named = schemas if isinstance(schemas, Mapping) else {"": schemas}
    places = reports.sparkSession.createDataFrame([row for name, node in named.items() for row in _places(node, name)], _SCHEMA)
    level = reports.where(F.col(value).isNotNull()).select(*keys, (F.col(schema) if schema else F.lit("")).alias("schema"), F.lit("$").alias("path"), F.lit("$").alias("place"), F.col(value).alias("v"))
    out = None
    for _ in range(max(map(_depth, named.values()))):
        # as many rows as the schemas have places
        here = level.join(F.broadcast(places), ["schema", "place"]).withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), r"\A\w+", 0))
        found = here.select(*keys, F.explode(_judge_level(here)).alias("f")).select(*keys, "f.path", "f.violation")
        out = found if out is None else out.unionByName(found)
        fields = F.transform(F.map_entries(_as(F.col("v"), "map<string,variant>")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("at"), F.concat(F.lit("."), e["key"]).alias("step"), e["value"].alias("v")))
        items = F.transform(_as(F.col("v"), "array<variant>"), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("at"), F.lit("[]").alias("step"), x.alias("v")))
        below = F.when((F.col("shape") == "object") & (F.col("kind") == "OBJECT"), fields).when((F.col("shape") == "list") & (F.col("kind") == "ARRAY"), items)
        level = here.select(*keys, "schema", "path", "place", F.explode(below).alias("b")).select(*keys, "schema", F.concat("path", "b.at").alias("path"), F.concat("place", "b.step").alias("place"), F.col("b.v").alias("v"))
    return out


@dataclass(frozen=True)
class Format:
    """A kind of report: its schema in each version, and rules (path, violation, test of a good report) between its parts, which hold where the schema does."""

    kind: str
    versions: Mapping[int, Object]
    rules: tuple[tuple[str, str, Test], ...] = ()


@F.arrow_udf(StringType())
def _resealed(texts: pa.Array) -> pa.Array:
    """The digest that each report should have."""
    return pa.array([provenance.digest_of(json.loads(t)) if t is not None else None for t in texts.to_pylist()], pa.string())


def read(spark: SparkSession, path: str, suffix: str = "*.json") -> DataFrame:
    """(file, text, report) of a folder's reports, each a file: a VARIANT, null where the text is no JSON."""
    listed = spark.read.format("binaryFile").load(path, pathGlobFilter=suffix)  # files without a byte are passed over
    files = listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return files.withColumn("report", F.try_parse_json("text"))


def judged(reports: DataFrame, formats: list[Format]) -> DataFrame:
    """(file, path, violation) of all reports (file, text, report), each by its kind and version. A report whose schema holds is held to its rules and digest, too."""
    whole_number = F.schema_of_variant(_as(F.col("report"), "variant", "$.version")) == "BIGINT"
    version = F.when(whole_number, _as(F.col("report"), "bigint", "$.version"))
    rows = reports.select("file", "text", "report", _as(F.col("report"), "string", "$.kind").alias("_kind"), version.alias("_version"))
    known = F.lit(None).cast("string")
    for f in formats:
        of_version = F.when(F.col("_version").isin(*f.versions), "good").when(F.col("_version") > max(f.versions), "future version").otherwise("unsupported version")
        known = F.when(F.col("_kind") == f.kind, of_version).otherwise(known)
    known = F.when(F.col("report").isNull(), "no JSON").when(~F.schema_of_variant("report").startswith("OBJECT"), "no object").otherwise(F.coalesce(known, F.lit("unknown kind")))
    rows = rows.withColumn("_state", known).withColumn("_schema", F.concat_ws(" ", "_kind", "_version"))
    out = rows.where("_state <> 'good'").select("file", F.lit("$").alias("path"), F.col("_state").alias("violation"))
    good = rows.where("_state = 'good'")
    shaped = violations(good, {f"{f.kind} {v}": node for f in formats for v, node in f.versions.items()}, ["file"], "report", "_schema")
    sound = good.join(shaped.select("file").distinct(), "file", "left_anti")
    out = out.unionByName(shaped)
    other = lambda path, what, wrong: F.when(wrong, F.struct(F.lit(path).alias("path"), F.lit(what).alias("violation")))
    for f in formats:
        own = sound.where(F.col("_kind") == f.kind)
        checks = [other("$.digest", "other digest", ~_as(F.col("report"), "string", "$.digest").eqNullSafe(_resealed(F.col("text"))))]
        checks += [other(path, what, ~F.coalesce(test(F.col("report")), F.lit(False))) for path, what, test in f.rules]
        out = out.unionByName(own.select("file", F.explode(F.array_compact(F.array(*checks))).alias("f")).select("file", "f.path", "f.violation"))
    return out


# the formats of evaluation and timing reports; names and versions are fixed by the files

_TEXTS = List(text())
_IDENTITY = Object({"logical_name": text(True), "artifact_sha256": digest(True)}, more=True, null=True)
_ENVIRONMENT = Object({n: text(True) for n in ("python_version", "pytorch_version", "device", "dtype")} | {n: flag() for n in ("compile", "deterministic_algorithms_enabled")}, more=True)
_POSITIVE, _LEAST_ZERO = number(0, True), number(0)
_SAMPLING = {
    "seed": whole(None), "temperature": _POSITIVE, "top_k": whole(0, null=True), "max_new_tokens": whole(1), "repetition_penalty": _POSITIVE, "stop_token_ids": List(whole()),
    "device": text(True), "dtype": text(True), "compile": flag(), "deterministic_algorithms": flag(), "prompt_format_version": whole(1),
}
_ROOT = {"algorithm": choice("sha256"), "checkpoint": _IDENTITY, "model_configuration": relative(), "parameter_count": whole(null=True), "tokenizer_identity": relative(True), "environment": _ENVIRONMENT, "warnings": _TEXTS, "digest": digest()}


def _statuses(r: Column) -> Column:
    return F.transform(_as(r, "array<variant>", "$.results"), lambda x: _as(x, "string", "$.rubric.status"))


def _counted(name: str, *statuses: str) -> tuple[str, str, Test]:
    return (f"$.summary.{name}", "other than the results", lambda r: _as(r, "bigint", f"$.summary.{name}") == F.size(F.filter(_statuses(r), lambda s: s.isin(*statuses))))


def _distinct_ids(r: Column) -> Column:
    ids = F.transform(_as(r, "array<variant>", "$.results"), lambda x: _as(x, "string", "$.prompt_id"))
    return F.size(F.array_distinct(ids)) == F.size(ids)


def _verdicts(r: Column) -> Column:
    """Scored results say whether they passed, as their status does; others don't."""
    def fits(x: Column) -> Column:
        status, passed = _as(x, "string", "$.rubric.status"), _as(x, "boolean", "$.rubric.passed")
        return F.when(status == "pass", passed.eqNullSafe(F.lit(True))).when(status == "fail", passed.eqNullSafe(F.lit(False))).otherwise(passed.isNull())

    return F.forall(_as(r, "array<variant>", "$.results"), fits)


#: What a contamination status says of a held-out suite.
_HELD_OUT = {"verified_clean": "verified-clean", "contaminated": "contaminated"}
EVALUATION = Format(
    "evaluation",
    {
        1: Object(
            _ROOT | {
                "version": whole(1, 1), "kind": choice("evaluation"), "runner": Object({"version": whole(1, 1), "prompt_format_version": whole(1)}),
                "suite": Object({n: text(True) for n in ("suite_id", "purpose", "expected_mode", "historical_status")} | {"version": whole(1, 1), "case_count": whole(1), "digest": digest()}),
                "generation": Object(_SAMPLING | {"stop_at_end": flag(), "batch_size": whole(1), "sampling_mode": text(True)}),
                "data_manifest_digest": digest(True),
                "contamination": Object({
                    "status": text(True), "held_out_status": choice(*_HELD_OUT.values(), "unverified"), "suite_covered": flag(), "override_used": flag(), "quality_report_digest": digest(True),
                    "data_manifest_digest": digest(True), "matching_prompt_ids": List(text(True)), "warnings": _TEXTS,
                }),
                "results": List(Object({
                    "prompt_id": text(True), "prompt_text": text(), "prompt_digest": digest(), "response": text(), "stop_reason": text(True), "generated_token_count": whole(), "warnings": _TEXTS,
                    "rubric": Object({
                        "version": whole(1), "status": choice(*STATUSES), "passed": flag(True), "human_review_required": flag(),
                        **{n: _TEXTS for n in ("matched_required_concepts", "missing_required_concepts", "forbidden_matches")},
                    }),
                })),
                "summary": Object({"metric_label": text(), "held_out_generalization_measured": flag(), **{n: whole() for n in ("total_cases", "passed", "failed", "unscored")}}),
            }
        )
    },
    (
        ("$.results", "other than the suite's cases", lambda r: F.size(_as(r, "array<variant>", "$.results")) == _as(r, "bigint", "$.suite.case_count")),
        ("$.results", "repeated prompt id", _distinct_ids),
        ("$.results", "status and verdict disagree", _verdicts),
        ("$.summary.total_cases", "other than the results", lambda r: _as(r, "bigint", "$.summary.total_cases") == F.size(_as(r, "array<variant>", "$.results"))),
        _counted("passed", "pass"), _counted("failed", "fail"), _counted("unscored", *(s for s in STATUSES if s not in ("pass", "fail"))),
        ("$.runner.prompt_format_version", "other than the generation's", lambda r: _as(r, "bigint", "$.runner.prompt_format_version") == _as(r, "bigint", "$.generation.prompt_format_version")),
        ("$.contamination.held_out_status", "other than the status says", lambda r: _as(r, "string", "$.contamination.held_out_status") == F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _HELD_OUT.items() for x in kv]), _as(r, "string", "$.contamination.status")), F.lit("unverified"))),
    ),
)


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-12 * F.greatest(F.abs(a), F.abs(b))


def _runs(r: Column, name: str, kind: str = "double") -> Column:
    return F.transform(_as(r, "array<variant>", "$.measurements.runs"), lambda x: _as(x, kind, f"$.{name}"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _aggregate(name: str, again: Callable[[Column, Column], Column]) -> tuple[str, str, Test]:
    """A stated aggregate against the runs' seconds and tokens."""
    return (f"$.measurements.aggregate.{name}", "other than the runs", lambda r: _near(_as(r, "double", f"$.measurements.aggregate.{name}"), again(_runs(r, "elapsed_seconds"), _runs(r, "generated_token_count"))))


def _timing(version: int) -> Object:
    newer = {"attention_backend": text(True)} if version >= 2 else {}
    newer |= {"kv_cache": flag()} if version >= 3 else {}
    configuration = Object(_SAMPLING | newer | {"warmup_runs": whole(), "measured_runs": whole(1), "prompt_id": text(True), "prompt_digest": text(True), "input_token_count": whole()})
    runs = List(Object({"index": whole(1), "elapsed_seconds": _POSITIVE, "generated_token_count": whole(), "tokens_per_second": _LEAST_ZERO}))
    aggregate = Object({n: _LEAST_ZERO for n in ("total_elapsed_seconds", "mean_elapsed_seconds", "minimum_elapsed_seconds", "maximum_elapsed_seconds", "tokens_per_second")} | {"total_generated_tokens": whole()})
    measurements = Object({"runs": runs, "aggregate": aggregate, "peak_cuda_memory_mib": number(0, null=True)})
    return Object(_ROOT | {"version": whole(version, version), "benchmark_version": whole(version, version), "kind": choice("generation_benchmark"), "configuration": configuration, "measurements": measurements})


def _same(setting: str, environment: str) -> tuple[str, str, Test]:
    return (f"$.environment.{environment}", "other than the configuration", lambda r: _as(r, "string", f"$.environment.{environment}") == _as(r, "string", f"$.configuration.{setting}"))


TIMING = Format(
    "generation_benchmark",
    {v: _timing(v) for v in (1, 2, 3)},
    (
        ("$.measurements.runs", "other than configured", lambda r: F.size(_runs(r, "index")) == _as(r, "bigint", "$.configuration.measured_runs")),
        ("$.measurements.runs", "out of order", lambda r: _runs(r, "index", "bigint") == F.sequence(F.lit(1).cast("long"), F.greatest(F.size(_runs(r, "index")), F.lit(1)).cast("long"))),
        ("$.measurements.runs", "other speed than tokens and seconds give", lambda r: F.forall(_as(r, "array<variant>", "$.measurements.runs"), lambda x: _near(_as(x, "double", "$.tokens_per_second"), _as(x, "double", "$.generated_token_count") / _as(x, "double", "$.elapsed_seconds")))),
        _aggregate("total_elapsed_seconds", lambda s, n: _sum(s)), _aggregate("mean_elapsed_seconds", lambda s, n: _sum(s) / F.size(s)), _aggregate("minimum_elapsed_seconds", lambda s, n: F.array_min(s)),
        _aggregate("maximum_elapsed_seconds", lambda s, n: F.array_max(s)), _aggregate("total_generated_tokens", lambda s, n: _sum(n)), _aggregate("tokens_per_second", lambda s, n: _sum(n) / _sum(s)),
        _same("device", "device"), _same("dtype", "dtype"), _same("compile", "compile"), _same("deterministic_algorithms", "deterministic_algorithms_enabled"),
        ("$.measurements.peak_cuda_memory_mib", "stated of another device, or not of this", lambda r: F.is_variant_null(_as(r, "variant", "$.measurements.peak_cuda_memory_mib")) != F.lower(_as(r, "string", "$.configuration.device")).startswith("cuda")),
    ),
)
FORMATS = [EVALUATION, TIMING]

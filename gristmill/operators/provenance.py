"""Identities of artifacts and tables, their comparison, and the checkpoint catalog."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, TimestampNTZType, TimestampType

from ..functions import text as T

#: Fixed values of the catalog.
CHECKPOINT_VERSION = 1
KINDS = ("pretrain", "sft", "model_only")
SPECIAL_TOKENS = ("<unk>", "<bos>", "<eos>", "<pad>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>")


def canonical_json(value: Any) -> str:
    """The one text of a JSON value: sorted keys, no blanks, non-ASCII as it is; NaN is an error."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest_of(value: Mapping[str, Any], without: tuple[str, ...] = ("digest",)) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in value.items() if k not in without}).encode()).hexdigest()


def sealed(value: Mapping[str, Any]) -> dict[str, Any]:
    """``value`` with its digest."""
    return {**value, "digest": digest_of(value)}


def verify(value: Mapping[str, Any], keys: set[str], version: int) -> list[str]:
    """What is wrong with a sealed value of a closed schema: nothing if the list is empty."""
    wrong = [f"missing {k}" for k in sorted(keys - set(value))] + [f"unknown {k}" for k in sorted(set(value) - keys)]
    if value.get("version") != version:
        wrong.append("unsupported version")
    if value.get("digest") != digest_of(value):
        wrong.append("digest mismatch")
    if absolute_path(value):
        wrong.append("absolute path")
    return wrong


def absolute_path(value: Any) -> bool:
    """Whether an absolute path occurs anywhere in nested metadata."""
    if isinstance(value, Mapping):
        return any(absolute_path(x) for pair in value.items() for x in pair)
    if isinstance(value, (list, tuple)):
        return any(map(absolute_path, value))
    return isinstance(value, str) and (value.startswith(("/", "\\")) or value[1:3] in (":\\", ":/"))


def tokenizer_identity(model: bytes, vocab_size: int, special: Mapping[str, int]) -> dict[str, Any]:
    """The sealed identity of a tokenizer; its eight special tokens need distinct ids."""
    if set(special) != set(SPECIAL_TOKENS) or len(set(special.values())) != len(special):
        raise ValueError("the special tokens are incomplete or share ids")
    return sealed({"version": 1, "algorithm": "sha256", "model_sha256": hashlib.sha256(model).hexdigest(), "vocab_size": vocab_size, "special_tokens": dict(special)})


def differences(a: Mapping[str, Any], b: Mapping[str, Any]) -> list[str]:
    """Keys in which two identities differ."""
    return [k for k in sorted({*a, *b} - {"digest"}) if a.get(k) != b.get(k)]


def _as_text(field: StructField) -> Column:
    """A value as text, the same in any engine: numbers that aren't whole in millionths, times in microseconds."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{field.name}`)").cast("string")
    if isinstance(kind, (FloatType, DoubleType)):
        return F.floor(c.cast("double") * 1e6 + 0.5).cast("string")
    if isinstance(kind, ArrayType):
        return F.array_join(F.transform(c, lambda x: F.floor(x.cast("double") * 1e6 + 0.5).cast("string")), ",")
    return c.cast("string")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest_sum): the sum of 60 bits of each row's digest, which the order of rows and columns doesn't change. Null is told from the empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), _as_text(f)), F.lit("")) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    hashed = F.conv(F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 15), 16, 10)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"))


def file_fingerprints(files: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256) of rows of the binary file source."""
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, columns): rows of one side only, and rows whose other columns differ, with those columns' names."""
    values = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in values]))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    joined = a.join(b, keys, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return joined.select(*keys, kind.alias("change"), F.when(kind == "changed", F.array_join(changed, ",")).otherwise("").alias("columns"))


def manifest(artifacts: list[Mapping[str, Any]], preprocessing: Mapping[str, Any], tokenizer: Mapping[str, Any]) -> dict[str, Any]:
    """A sealed data manifest; the order of artifacts doesn't matter."""
    listed = sorted(artifacts, key=lambda a: (a["role"], a["logical_name"]))
    return sealed({"version": 2, "artifacts": listed, "preprocessing": dict(preprocessing), "tokenizer": dict(tokenizer)})


def classify_checkpoints(catalog: DataFrame) -> DataFrame:
    """``catalog`` (path, version, kind, has_model, has_optimizer, has_config, iter, ...) with kind, legacy, and error.

    Stated metadata counts first; without any, an optimizer with config and a valid
    iteration makes a pretraining state, an optimizer alone is ambiguous (null), and the
    rest holds only a model.
    """
    c = F.col
    stated = c("version").isNotNull()
    error = (
        F.when(stated != c("kind").isNotNull(), "incomplete metadata")
        .when(stated & (c("version") != CHECKPOINT_VERSION), "unsupported version")
        .when(stated & ~c("kind").isin(*KINDS), "unknown kind")
        .when(~c("has_model"), "no model")
        .when(stated & ~c("has_config"), "no config")
    )
    structural = F.when(c("has_optimizer") & c("has_config") & (c("iter") >= 0), "pretrain").when(~c("has_optimizer"), "model_only")
    return catalog.withColumns({"error": error, "legacy": ~stated}).withColumn("kind", F.when(error.isNotNull(), None).when(stated, c("kind")).otherwise(structural))


def normalized_path(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("\\"), F.lit("/")))


def select_checkpoint(classified: DataFrame, resume: bool, by: list[str] | None = None) -> DataFrame:
    """The best usable row (of each group ``by``): for resuming a pretraining state of most progress, else by verified tokenizer and age; then by path."""
    usable = classified.where(F.col("error").isNull())
    if resume:
        usable = usable.where((F.col("kind") == "pretrain") & F.col("has_optimizer") & F.col("has_config") & (F.col("iter") >= 0))
        rank = F.struct(F.coalesce("iter", F.lit(0)), normalized_path(F.col("path")))
    else:
        rank = F.struct(F.coalesce("tokenizer_verified", F.lit(False)), "mtime", normalized_path(F.col("path")))
    return usable.groupBy(*(by or [])).agg(F.max_by("path", rank).alias("path"))


def exact_resume_gaps(catalog: DataFrame, needed: list[str]) -> DataFrame:
    """(path, missing): state fields that an exact resume would need."""
    gone = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in needed]))
    return catalog.select("path", F.array_join(gone, ",").alias("missing"))


def short(c: Column, n: int = 12) -> Column:
    return F.substring(c, 1, n)


def evaluation_digest(c: Column) -> Column:
    return T.digest(T.json_object(text=T.json_string(c)))

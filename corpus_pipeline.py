"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir); its result is written and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import classify, decontaminate, packing, simhash, suffixes
from gristmill.llm.common import materialize, table
from gristmill.llm.queries import tokenizer_definition


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the operator's cut; the model learns from the labelled ones that aren't held out."""
    model = classify.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = classify.score_quality(docs, model, keep=docs.columns)
    return scored.where(F.col("score") >= classify.QUALITY_CUT).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 100-byte strings seen earlier cover; parts of characters left at a cut go, too."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = suffixes.deduplicate(docs, carry=others)
    # a cut within a character leaves parts of it, which become U+FFFD here and then go
    raw = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    columns = {"doc_id": F.col("doc_id"), "text": text, **{c: F.col("carried").getField(c) for c in others}}
    columns["n_chars"] = F.length(text).cast("long") if "n_chars" in columns else None
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 4096 tokens."""
    pieces = packing.with_checksums(packing.pack(docs, tokenizer_definition()))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: SQL has no form for the trained classifier, XXH64 fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None

"""Language identification and quality scoring with subword models trained here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import held_out, text_chunks
from .subword import Features, Model, train

#: The language of a text that is null, has no letter, or is rejected.
UNDETERMINED = "und"
#: Rows and characters of the training samples, about, which bound what the driver holds; and the rows of a label below which it is sampled more densely.
SAMPLE_ROWS, SAMPLE_CHARS, LEAST_ROWS = 4000, 40_000_000, 100
LANGUAGE_FEATURES = Features(char_sizes=(3,), word_pairs=False, buckets=1 << 16)
#: Repeated words are what a fifth of the documents of poor quality is told by; see the README for figures without.
QUALITY_FEATURES = Features(char_sizes=(4,), word_pairs=True, repeats=True, buckets=1 << 17)
#: From this score on a document counts as good.
QUALITY_CUT = 0.7


def _chosen(keyed: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of ``keyed`` (key, label, ...), chosen by a hash of the key; all if there aren't more.

    Every label gets the same share, or as much more as it needs for LEAST_ROWS
    rows. Only the labels' counts come to the driver.
    """
    counts = {r[0]: r[1] for r in keyed.groupBy("label").count().collect()}
    if not counts:
        return keyed.limit(0)
    share = rows / sum(counts.values())
    wanted = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, int((1 << 53) * min(1.0, max(share, LEAST_ROWS / n))))])
    return keyed.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 53)) < F.try_element_at(wanted, F.col("label")))


def _fit(sample: DataFrame, chars: int, features: Features) -> Model | None:
    """Train on the rows (key, label, text) of a bounded sample, in an order of their own; where they have more than ``chars`` characters, on as many as don't."""
    spark = sample.sparkSession
    sizes = sample.select("key", "label", F.length("text").cast("long"), F.xxhash64(F.lit("order"), "key")).collect()
    if sum(r[2] for r in sizes) > chars:
        held, room = [], chars
        for r in sorted(sizes, key=lambda r: (r[3], str(r[0]), str(r[1]))):
            if r[2] <= room:
                held.append((r[0],))
                room -= r[2]
        few = spark.createDataFrame(held, StructType([sample.schema["key"]])).distinct()
        sample = sample.join(F.broadcast(few), "key")
    found = sorted((tuple(r) for r in sample.select("key", "label", "text").collect()), key=lambda r: (str(r[0]), str(r[1]), r[2]))
    return train([r[2] for r in found], [r[1] for r in found], features)


def train_language(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """A model of ``docs.lang``, from a bounded sample of the rows that aren't held out and have text and lang. Rows without doc_id aren't held out."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return _fit(_chosen(usable.select(F.col("doc_id").alias("key"), F.col("lang").alias("label"), "text"), rows), chars, LANGUAGE_FEATURES)


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """A model of ``labels.quality``, from a bounded sample of the labelled rows that aren't held out.

    Rows with a null label or without a document are left out; a document
    labelled twice counts twice.
    """
    marked = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    chosen = F.broadcast(_chosen(marked.select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("label")), rows))  # about ``rows`` rows, whatever the size of the input
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("key"), "text")
    return _fit(texts.join(chosen, "key"), chars, QUALITY_FEATURES)


def _predict_language(shared, reject_below: float):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in text_chunks(batches):
            texts = batch.column("text").to_pylist()
            if model is None:
                best, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            else:
                p = model.probabilities(texts)
                score = p.max(axis=1)
                lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
                best = [model.classes[k] if ok and s >= reject_below else UNDETERMINED for k, ok, s in zip(p.argmax(axis=1), lettered, score, strict=True)]
                score = np.where(lettered, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return predict


def predict_language(docs: DataFrame, model: Model | None, reject_below: float = 0.5) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text; the score is the calibrated probability.

    Texts that are null or have no letter are ``und`` with score 0. So are, with
    their score, those below ``reject_below``, and all without a model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predict_language(shared, reject_below), "doc_id long, lang_pred string, score double")


def _predict_quality(shared, kept: int, at: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for part in text_chunks([batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])], f"c{at}"):
                score = np.full(part.num_rows, 0.5)
                if model is not None:
                    p = model.probabilities(part.column(at).to_pylist())
                    score = sum((p[:, k] for k, c in enumerate(model.classes) if c == 1), np.zeros(len(p)))
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(np.clip(score, 0, 1))], [f"c{i}" for i in range(kept + 1)])

    return predict


def score_quality(docs: DataFrame, model: Model | None, keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id by default) of every row, and one named by ``score``: how likely its whole text has label 1.

    Null is scored as the empty text. Without a model every score is 0.5. A column
    of ``keep`` that has the score's name is replaced by it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep or ["doc_id"] if c != score]
    names = keep if "text" in keep else [*keep, "text"]
    narrow = docs.select([F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names])
    kept = StructType([*[narrow.schema[c] for c in keep], StructField(score, DoubleType())])
    inner = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(kept.fields)])
    found = narrow.mapInArrow(_predict_quality(shared, len(keep), names.index("text")), inner)
    return found.toDF(*kept.names)

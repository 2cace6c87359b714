"""Inspection of corpora: totals, repeats, detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Patterns of secrets.
SECRETS = {
    "sk": r"sk-[A-Za-z0-9]{20,}",
    "ghp": r"ghp_[A-Za-z0-9]{20,}",
    "hf": r"hf_[A-Za-z0-9]{20,}",
    "api key": r"(?i)api[_-]?key\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}",
    "password": r"(?i)password\s*[:=]\s*['\"]?[^\s'\"]{8,}",
    "token": r"(?i)token\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}",
}


def secrets(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pattern): which secret patterns a text matches."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in SECRETS.items()]))
    return docs.select(*keys, F.explode(hits).alias("pattern"))


#: Numbered labels, and the ordinary word.
LABELS = {"check_labels": r"\bCheck\s+\d+\b", "example_labels": r"\bExample\s+\d+\b", "ordinary": r"(?i)\bcheck\b"}


def label_counts(docs: DataFrame, by: str) -> DataFrame:
    """Numbered labels and the ordinary word, by source."""
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p))).cast("long")
    return docs.groupBy(by).agg(*[n(p).alias(name) for name, p in LABELS.items()])


def phrase_hits(docs: DataFrame, by: str, phrases: list[str]) -> DataFrame:
    """(by, phrase, hits) of phrases that occur at all."""
    counts = F.array(*[F.struct(F.lit(p).alias("phrase"), T.phrase_count(F.col("text"), p).alias("hits")) for p in phrases])
    return docs.select(by, F.inline(counts)).groupBy(by, "phrase").agg(F.sum("hits").alias("hits")).where("hits > 0")


def forbidden(docs: DataFrame, rules: list[tuple[str, str | None]], category: str) -> DataFrame:
    """Rows of ``docs`` with the phrase of each rule (phrase, allowed category) that they break; in the allowed category they don't. A column ``phrase`` is replaced."""
    low = F.lower("text")
    broken = [F.when(F.contains(low, F.lit(phrase.lower())) & ~F.col(category).eqNullSafe(F.lit(allowed)), F.lit(phrase)) for phrase, allowed in rules]
    kept = [c for c in docs.columns if c != "phrase"]
    return docs.select(*kept, F.explode(F.array_compact(F.array(*broken))).alias("phrase"))


def keyword_class(c: Column, classes: dict[str, list[str]]) -> Column:
    """The first class of which a keyword occurs, or ``other``."""
    out = None
    for name, words in classes.items():
        test = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(c), w))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def class_of(rows: DataFrame, text: str, classes: dict[str, list[str]], category: str) -> DataFrame:
    """``rows`` with ``class``: where any row of all states a category, that (``other`` if null or not one of the classes); only where none does, what its text's keywords say."""
    stated = rows.agg(F.coalesce(F.bool_or(F.col(category).isNotNull()), F.lit(False)).alias("_stated"))  # one row
    known = F.when(F.col(category).isin(*classes), F.col(category)).otherwise("other")
    return rows.crossJoin(stated).withColumn("class", F.when(F.col("_stated"), known).otherwise(keyword_class(F.col(text), classes))).drop("_stated")


def totals(docs: DataFrame) -> DataFrame:
    """One row: texts, characters, estimated tokens, shortest and longest."""
    n = F.length("text").cast("long")
    return docs.agg(F.count("text").alias("texts"), F.sum(n).alias("chars"), T.token_estimate(F.sum(n)).alias("tokens"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


def duplicate_excess(docs: DataFrame, c: str) -> DataFrame:
    """One row: how many rows repeat an earlier value."""
    return docs.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("excess"))


def top_repeats(docs: DataFrame, c: str, key: str, limit: int = 5) -> DataFrame:
    """(value, n, first) of the values of greatest count that repeat; ties by the least ``key``."""
    counted = docs.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(limit).where("n > 1")


def near_topic(total: Column, count: Column) -> Column:
    """Whether one opening dominates."""
    return count > F.greatest(F.lit(25), F.floor(total / 20))


#: Characters from which a corpus is of the second and the third size, and examples below which a set is small: fixed values of the inspection.
BANDS, FEW = (100_000, 500_000), 100


def size_band(chars: Column) -> Column:
    return F.when(chars < BANDS[0], "small").when(chars < BANDS[1], "medium").otherwise("large")


def warnings(docs: DataFrame, by: str, opening: Column) -> DataFrame:
    """(by, texts, chars, band, few, dominant): each group's size, whether it has few texts, and the opening that dominates it, if one does (the least of the most frequent ones)."""
    rows = docs.select(by, F.length("text").cast("long").alias("chars"), opening.alias("opening"))
    counted = rows.groupBy(by, "opening").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    top = F.max(F.struct(F.when(F.col("opening") != "", F.col("n")).otherwise(0)))
    sums = counted.groupBy(by).agg(F.sum("n").alias("texts"), F.sum("chars").alias("chars"), top.alias("top"))
    first = counted.where("opening <> ''").groupBy(by, "n").agg(F.min("opening").alias("opening")).select(F.col(by).alias("_by"), F.col("n").alias("_n"), "opening")
    joined = sums.join(first, F.col(by).eqNullSafe(F.col("_by")) & (F.col("top.col1") == F.col("_n")), "left")
    dominant = F.when(near_topic(F.col("texts"), F.col("_n")), F.col("opening"))
    return joined.select(by, "texts", "chars", size_band(F.col("chars")).alias("band"), (F.col("texts") < FEW).alias("few"), dominant.alias("dominant"))

"""Quality rules: counts of words, lines and repeats, and the perplexity under n-grams of characters.

Spark counts the n-grams of the corpus (ORDER characters within a word, with its borders) for each language and each of two
folds, by which modified Kneser-Ney models are made. A text is judged by the model of the other fold, so that neither itself nor a copy of it vouches
for it: equal texts are in one fold. The models are kept as sorted arrays of hashes with the logarithm of the probability of each n-gram that
any text holds. A text whose perplexity a letter is beyond its language's lower or upper bound is rejected.

A model grows with what the corpus holds. Up to BROADCAST_GRAMS n-grams (12 bytes each) its arrays are broadcast; beyond, the texts' n-grams are
joined with it, with the same result.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_chunks

ORDER = 5
#: Distinct words of which a task gathers counts before it passes on their n-grams.
HELD_WORDS = 200_000
#: Bytes of text whose distinct words are looked at together.
CHUNK_BYTES = 1 << 21
BROADCAST_GRAMS = 1 << 23
#: Rules: least words, and the percentage of words that may be in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: How many interquartile ranges beyond the quartiles a language's bounds are, and the steps in which logarithms are counted for them.
SPREAD, STEPS = 4.5, 1024
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_FIRST = bytes(range(0x80, 0xC0))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

STATS = [T.StructField(c, T.LongType(), False) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
SCORED = [*STATS, T.StructField("log_perplexity", T.DoubleType())]
JUDGED = ("base_failed", "lower", "upper", "kept")


def fold(text: Column) -> Column:
    """0 or 1, the same for equal texts."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)).cast("int")


# counting


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, Counter] = defaultdict(Counter)

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, which), words in held.items():
            if not words:
                continue
            text, points, place = _padded(words)
            at = np.flatnonzero(place > 0)
            _, first, inverse = np.unique(_hashes(points, place, at), return_index=True, return_inverse=True)
            times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.diff(np.append(np.flatnonzero(place == 0), len(place))) - 1)
            # sums of integers that doubles hold exactly
            counts = np.bincount(inverse, times).astype(np.int64)
            ends = at[first]
            grams = [text[b:e] for b, e in zip((ends - np.minimum(place[ends], ORDER - 1)).tolist(), (ends + 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array([which] * len(grams), pa.int32()), pa.array(grams, pa.string()), pa.array(counts)], names=["lang", "fold", "gram", "n"])
        held.clear()

    for batch in text_chunks(batches, most=CHUNK_BYTES):
        for lang, which, text in zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist(), _bytes(batch.column("text")), strict=True):
            held[lang, which].update(text.split())
        if sum(map(len, held.values())) >= HELD_WORDS:
            yield from passed_on()
    yield from passed_on()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, c0, c1): how often each n-gram occurs in either fold of ``docs`` (lang, text), over all rows."""
    parts = docs.where(F.col("text").isNotNull()).select(_lang(docs).alias("lang"), fold(F.col("text")).alias("fold"), "text").mapInArrow(_counted, "lang string, fold int, gram string, n long")
    of = lambda f: F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"c{f}")
    return parts.groupBy("lang", "gram").agg(of(0), of(1))


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


# modified Kneser-Ney


def levels(counts: DataFrame) -> DataFrame:
    """(lang, gram, c0, c1) of all lengths: occurrences of the longest n-grams and of those that begin a word, and of others the number of letters that precede them."""
    whole = F.col("i") == 1
    ends = counts.select("lang", "c0", "c1", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("i"), "gram").select("lang", F.expr("substring(gram, i)").alias("gram"), "c0", "c1", "i")
    own = [F.sum(F.when(whole, F.col(c)).otherwise(0)).alias(c) for c in ("c0", "c1")]
    found = ends.groupBy("lang", "gram").agg(*own, *[F.max((F.col(c) > 0).cast("long")).alias(f"s{c[1]}") for c in ("c0", "c1")])
    preceded = found.select("lang", F.expr("substring(gram, 2)").alias("gram"), F.col("s0").alias("c0"), F.col("s1").alias("c1"))
    return found.select("lang", "gram", "c0", "c1").unionByName(preceded).groupBy("lang", "gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, k, d0, d1): what counts of 1, 2, and 3 or more are reduced by, from how many n-grams have counts of 1 to 4."""
    seen = [F.sum((F.col(f"c{f}") == n).cast("double")).alias(f"n{n}_{f}") for f in (0, 1) for n in (1, 2, 3, 4)]
    found = grams.groupBy("lang", "k").agg(*seen)

    def discount(f: int) -> Column:
        n = [F.col(f"n{i}_{f}") for i in (1, 2, 3, 4)]
        y = F.coalesce(F.try_divide(n[0], n[0] + 2 * n[1]), F.lit(0.5))
        each = [i + 1 - (i + 2) * y * F.coalesce(F.try_divide(n[i + 1], n[i]), F.lit(0.5)) for i in range(3)]
        # where there are too few n-grams for an estimate, it may be out of range
        return F.array(*[F.least(F.greatest(d, F.lit(0.05)), F.lit(i + 0.95)) for i, d in enumerate(each)])

    return found.select("lang", "k", discount(0).alias("d0"), discount(1).alias("d1"))


def shares(grams: DataFrame) -> DataFrame:
    """(lang, gram, a0, b0, a1, b1): what each model gives the last letter after the others by itself, and by how much it takes the probability after one letter less into account."""
    grams = grams.withColumn("k", F.length("gram"))
    letters = grams.where("k = 1").groupBy("lang").agg((1 / (F.count("*") + 1)).alias("even"))
    context = Window.partitionBy("lang", F.expr("substring(gram, 1, k - 1)"))  # contexts of one length have n-grams of one length
    share = {}
    for f in (0, 1):
        c, d = F.col(f"c{f}"), F.col(f"d{f}")
        total = F.sum(c).over(context)
        spared = sum((F.sum((c == n if n < 3 else c >= 3).cast("long")).over(context) * d[n - 1] for n in (1, 2, 3)), F.lit(0.0))
        taken = F.when(c == 0, 0.0).otherwise(c - F.get(d, F.least(c, F.lit(3)).cast("int") - 1))
        # a context that the model never saw passes everything on; single letters fall back to even chances
        a, b = F.when(total > 0, taken / total).otherwise(0.0), F.when(total > 0, spared / total).otherwise(1.0)
        share[f"a{f}"] = a + F.when(F.col("k") == 1, b * F.col("even")).otherwise(0.0)
        share[f"b{f}"] = b
    return grams.join(_discounts(grams), ["lang", "k"]).join(letters, "lang").select("lang", "gram", *[c.alias(n) for n, c in share.items()])


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, gram, p0, p1): the interpolated probability in either fold's model of the last letter of each n-gram counted."""
    known = shares(materialize(levels(counts), "grams"))
    ends = counts.select("lang", F.col("gram").alias("whole"), F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("i")).withColumn("gram", F.expr("substring(whole, i)"))
    parts = ends.join(known, ["lang", "gram"]).groupBy("lang", F.col("whole").alias("gram")).agg(F.array_sort(F.collect_list(F.struct(F.length("gram").alias("k"), "a0", "b0", "a1", "b1"))).alias("parts"))
    chance = lambda f: F.aggregate("parts", F.lit(0.0), lambda p, x: x[f"a{f}"] + x[f"b{f}"] * p)
    return parts.select("lang", "gram", chance(0).alias("p0"), chance(1).alias("p1"))


# sorted hash arrays


def _seed(lang: str, which: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{which}:{lang}".encode(), digest_size=8).digest(), "little"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def _padded(words: Iterable[bytes]) -> tuple[str, np.ndarray, np.ndarray]:
    """All words with a border before and after them in a row, its code points, and each one's place in its word."""
    text = f" {b'\n '.join(words).decode('utf-8', 'replace')}\n"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.flatnonzero(points == 32)
    return text, points, np.arange(len(points)) - np.repeat(begins, np.diff(np.append(begins, len(points))))


def _hashes(points: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the ORDER points, or as many as their part has, that end at each of ``at``."""
    letters = _mixed(points.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(at), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        out = out * _MULTIPLIER + np.where(place[at] >= back, letters[at - back], np.uint64(0))
    return out


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch.column("gram").to_pylist()
        points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        ends = np.cumsum(sizes)
        plain = _hashes(points, np.arange(len(points)) - np.repeat(ends - sizes, sizes), ends - 1)
        langs = batch.column("lang").to_pylist()
        for which in (0, 1):
            # texts of a fold are judged by the model of the other one
            seeds = {lang: _seed(lang, which) for lang in set(langs)}
            codes = _mixed(plain ^ np.fromiter((seeds[x] for x in langs), np.uint64, len(langs)))
            logs = np.log(batch.column(f"p{1 - which}").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(logs.astype(np.float32))], names=["code", "logp"])


def model(docs: DataFrame) -> DataFrame:
    """(code, logp): for each n-gram of ``docs`` the logarithm of its probability for the texts of either fold."""
    counts = materialize(gram_counts(docs), "gram-counts")
    return materialize(probabilities(counts).mapInArrow(_coded, "code long, logp float"), "gram-model")


# texts


class _Words:
    """The distinct words of one language and fold in a batch of texts, by number."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def codes(self, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all n-grams of the words one after another, and where each word's begin."""
        _, points, place = _padded(self.numbers)
        at = np.flatnonzero(place > 0)
        return _mixed(_hashes(points, place, at) ^ seed), np.flatnonzero(place == 0) - np.arange(len(self.numbers))


def _repeated(ids: np.ndarray) -> int:
    """Words in windows of WINDOW that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    if int(ids.max()) >= 1 << 62 // WINDOW:
        _, ids = np.unique(ids, return_inverse=True)
    window = ids[:n]
    for k in range(1, WINDOW):
        if len(ids) >= 1 << 62 // WINDOW:
            _, window = np.unique(window, return_inverse=True)
        window = (window << 62 // WINDOW) + ids[k : n + k]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    again = np.concatenate((order[1:][same], order[:-1][same]))
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[again + k] = True
    return int(covered.sum())


def _statistics(text: bytes, ids: np.ndarray) -> tuple[int, int, int, int, int]:
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return len(ids), len(text.translate(None, _SPACE + _NOT_FIRST)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeated(ids)


def _read(batch: pa.RecordBatch) -> tuple[list[tuple], list[tuple], dict]:
    """Statistics of each text, its unit and words, and the units."""
    units: dict[tuple, _Words] = defaultdict(_Words)
    stats, held = [], []
    for lang, which, text in zip(batch.column("_lang").to_pylist(), batch.column("_fold").to_pylist(), _bytes(batch.column("_text")), strict=True):
        raw = text or b""
        ids = units[lang, which].of(raw.split())
        stats.append(_statistics(raw, ids))
        held.append(((lang, which), ids))
    return stats, held, units


def _with_arrays(shared, keep: list[str], names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, logs = shared.value
        for batch in text_chunks(batches, "_text", CHUNK_BYTES):
            stats, held, units = _read(batch)
            scores = {}
            for unit, words in units.items():
                if words.numbers:
                    asked, begins = words.codes(_seed(*unit))
                    asked, which = np.unique(asked, return_inverse=True)  # words share most n-grams, and those in order are found faster
                    scores[unit] = np.add.reduceat(logs[np.searchsorted(codes, asked)].astype(np.float64)[which], begins)
            sums = [float(scores[unit][ids].sum()) if len(ids) else None for unit, ids in held]
            yield _result(batch, keep, names, stats, sums)

    return work


def _result(batch: pa.RecordBatch, keep: list[str], names: list[str], stats: list[tuple], sums: list) -> pa.RecordBatch:
    columns = [pa.array(list(c), pa.int64()) for c in zip(*stats, strict=True)]
    # each word's end is foretold, too
    columns.append(pa.array([None if total is None else -total / (s[1] + s[0]) for s, total in zip(stats, sums, strict=True)], pa.float64()))
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, names=names)


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, code, n) of each text's distinct n-grams."""
    for batch in text_chunks(batches, "_text"):
        _, held, units = _read(batch)
        coded = {unit: words.codes(_seed(*unit)) for unit, words in units.items() if words.numbers}
        for row, (unit, ids) in zip(batch.column("_row").to_pylist(), held, strict=True):
            if len(ids):
                codes, begins = coded[unit]
                ends = np.append(begins[1:], len(codes))
                words, times = np.unique(ids, return_counts=True)
                sizes = ends[words] - begins[words]
                within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                found, where = np.unique(codes[np.repeat(begins[words], sizes) + within], return_inverse=True)
                n = np.bincount(where, np.repeat(times, sizes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), pa.array(found.view(np.int64)), pa.array(n)], names=["_row", "code", "n"])


def _joined(keep: list[str], names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "_text"):
            yield _result(batch, keep, names, _read(batch)[0], batch.column("_sum").to_pylist())

    return work


def scored(docs: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``docs`` (lang, text, ...) with the statistics of each text and the logarithm of its perplexity a letter, which is null without words."""
    taken = {f.name for f in SCORED} | set(JUDGED)
    keep = [c for c in docs.columns if c not in taken]
    if "text" not in keep:
        raise ValueError("docs needs a column named text")
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, *SCORED])
    arrays = model(docs)
    # texts go in under a name of their own; a clashing one is moved aside
    inner = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(keep, inner, strict=True)], _lang(docs).alias("_lang"), fold(F.col("text")).alias("_fold"), F.col("text").alias("_text"))
    if arrays.count() <= broadcast_grams:
        found = arrays.toArrow()
        codes = found.column("code").to_numpy().view(np.uint64)
        order = np.argsort(codes)
        shared = docs.sparkSession.sparkContext.broadcast((codes[order], found.column("logp").to_numpy()[order]))
        return rows.mapInArrow(_with_arrays(shared, inner, schema.names), schema)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered-texts")
    asked = rows.select("_row", "_lang", "_fold", "_text").mapInArrow(_sent, "_row long, code long, n long")
    sums = asked.join(arrays, "code").groupBy("_row").agg(F.sum(F.col("n") * F.col("logp").cast("double")).alias("_sum"))
    return rows.join(sums, "_row", "left").mapInArrow(_joined(inner, schema.names), schema)


def bounds(found: DataFrame, spread: float = SPREAD) -> DataFrame:
    """(lang, lower, upper): the band of each language's texts that pass the rules, ``spread`` interquartile ranges beyond the quartiles.

    Logarithms are counted in steps, so a language has few rows however many texts it has, and bounds don't depend on how rows are dealt out.
    """
    steps = found.where(~_base_failed()).groupBy(_lang(found).alias("lang"), F.floor(F.col("log_perplexity") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    window = Window.partitionBy("lang").orderBy("step")
    below, all_rows = F.sum("n").over(window), F.sum("n").over(Window.partitionBy("lang"))
    ranked = steps.select("lang", "step", below.alias("below"), all_rows.alias("all"))
    quartile = lambda q: F.min(F.when(F.col("below") >= q * F.col("all"), F.col("step")))
    quarters = ranked.groupBy("lang").agg(quartile(0.25).alias("a"), quartile(0.75).alias("b"))
    margin = spread * (F.col("b") - F.col("a") + 1)
    return quarters.select("lang", ((F.col("a") - margin) / STEPS).alias("lower"), ((F.col("b") + 1 + margin) / STEPS).alias("upper"))


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """``docs`` (lang, text, ...) with each text's statistics, logarithm of perplexity, its language's bounds, and whether it is kept.

    Texts are taken whole. A null or empty text has no words and fails; a null lang is a language of its own, as is every row's without such a column. A language
    of one text, or of copies of one, has no model but even chances, under which its texts are kept. Repeated rows are judged alike; an empty table has no
    result. Columns named like the new ones are replaced, others stay.
    """
    found = materialize(scored(docs), "perplexities")
    keep = [c for c in found.columns if c not in {f.name for f in SCORED}]
    band = materialize(bounds(found, spread), "perplexity-bounds").withColumnRenamed("lang", "_band")
    joined = found.join(band, _lang(found) == F.col("_band"), "left")
    within = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return joined.select(*keep, *[f.name for f in SCORED], _base_failed().alias("base_failed"), "lower", "upper", (~_base_failed() & within).alias("kept"))

"""Token sequences: encoding, offsets, windows, and supervised examples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions.arrays import once

#: Ids of the special tokens, and the label that isn't learned.
UNKNOWN, BEGIN, STOP, PAD, IGNORED = 0, 1, 2, 3, -100
#: Ids of bytes begin here.
FIRST_BYTE = 4


@F.arrow_udf(ArrayType(IntegerType()))
def _byte_ids(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.binary())
    first, last = texts.offset, texts.offset + len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[first : last + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(data.astype(np.int32) + FIRST_BYTE), mask=texts.is_null())


def byte_ids(c: Column) -> Column:
    """A text's UTF-8 bytes as ids: a tokenizer that needs no model. Whole batches of texts are one addition."""
    return _byte_ids(c)


def encode(c: Column, begin: bool = True, stop: bool = True) -> Column:
    return F.concat(F.array(*[F.lit(BEGIN)] * begin).cast("array<int>"), byte_ids(c), F.array(*[F.lit(STOP)] * stop).cast("array<int>"))


#: Fixed value: how an unknown id reads.
UNKNOWN_TEXT = " \u2047 "


def decode(ids: Column, vocabulary: int = 256 + FIRST_BYTE) -> Column:
    """Text of byte ids; begin, stop and padding leave nothing, and ids out of range read as the unknown id does."""
    unknown = F.lit(UNKNOWN_TEXT.encode().hex())
    one = lambda i: F.when((i >= FIRST_BYTE) & (i < vocabulary), F.lpad(F.hex(i - FIRST_BYTE), 2, "0")).when(i.isin(BEGIN, STOP, PAD), "").otherwise(unknown)
    return F.decode(F.unhex(F.array_join(F.transform(ids, one), "")), "UTF-8")


def vocabulary_target(chars: int, requested: int) -> int:
    return min(requested, max(1000, chars // 6))


#: Keys looked at for each range that strings are dealt out by: the more, the more alike the ranges.
KEYS_A_RANGE = 100


def _string_bounds(sized: DataFrame, key: str, n: int) -> DataFrame:
    """Borders of ``n`` about equal ranges of a string key, from the keys of least hash."""
    some = sized.select(key).orderBy(F.xxhash64(key)).limit(KEYS_A_RANGE * n).agg(F.array_sort(F.collect_set(key)).alias("s"))
    return some.select(F.filter(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("s", F.floor(F.size("s") * i / n).cast("int"))), lambda x: x.isNotNull()).alias("b"))


def offsets(sized: DataFrame, key: str, size: str, ranges: int | None = None) -> DataFrame:
    """``sized`` with ``offset``: the sum of ``size`` over all rows of a smaller key. Keys are unique.

    Rows are dealt out by ranges of the key; each range adds up on its own, and the
    ranges' totals, one short row each, give their starts.
    """
    n = ranges or int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = None if n < 2 else _string_bounds(sized, key, n) if sized.schema[key].dataType == StringType() else sized.agg(F.percentile_approx(F.col(key), [i / n for i in range(1, n)], 10_000).alias("b"))
    part = F.lit(0) if bounds is None else F.size(F.filter("b", lambda x: x < F.col(key)))
    dealt = (sized if bounds is None else sized.join(F.broadcast(bounds))).withColumn("_part", part)
    dealt = dealt if bounds is None else dealt.drop("b")
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_total"))
    starts = totals.select(F.col("_part"), F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum(size).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_within", within).join(F.broadcast(starts), "_part").withColumn("offset", (F.col("_start") + F.col("_within")).cast("long")).drop("_part", "_within", "_start")


def windows(ids: Column, block: int, stride: int | None = None) -> Column:
    """Training windows (start, x, y) of a sequence: y is x one later. A sequence of ``block`` ids or fewer has none."""


    def cut(v: Column) -> Column:
        starts = F.when(F.size(v) > block, F.sequence(F.lit(0), F.size(v) - block - 1, F.lit(stride or block)))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(v, i + 1, F.lit(block)).alias("x"), F.slice(v, i + 2, F.lit(block)).alias("y")))

    return once(ids, cut)


def tiled(ids: Column, block: int) -> Column:
    """A short sequence repeated to ``block`` + 2 ids at least."""
    times = F.greatest(F.lit(1), F.ceil((block + 2) / F.size(ids)).cast("int"))
    return F.flatten(F.array_repeat(ids, times))


def example(prompt: Column, answer: Column, block: int) -> Column:
    """(x, y, kept_prompt) of a supervised pair of id arrays within ``block`` + 1 ids; null if no label would be left.

    A prompt that fits is kept whole; of a longer one at least its last two ids stay
    (fewer in tiny blocks) and as much of the answer as fits. A cut answer keeps its last id.
    Labels of the prompt are IGNORED.
    """
    return once(F.struct(prompt.alias("p"), answer.alias("a")), lambda e: _example(e["p"], e["a"], block))


def _example(prompt: Column, answer: Column, block: int) -> Column:
    most = block + 1
    np, na = F.size(prompt), F.size(answer)
    least = F.least(np, F.lit(min(2, most - 1)))
    answer_room = F.when(np + na <= most, na).when(np < most, most - np).otherwise(F.least(na, most - least))
    prompt_room = F.when((np + na <= most) | (np < most), np).otherwise(F.least(np, most - answer_room))
    kept_prompt = F.slice(prompt, np - prompt_room + 1, prompt_room)
    kept_answer = F.when(na <= answer_room, answer).when(answer_room == 1, F.slice(answer, F.lit(1), F.lit(1))).otherwise(F.concat(F.slice(answer, F.lit(1), F.greatest(answer_room - 1, F.lit(0))), F.slice(answer, F.lit(-1), F.lit(1))))

    def shifted(e: Column) -> Column:
        ids, room = e["ids"], e["room"]
        x = F.slice(ids, F.lit(1), F.size(ids) - 1)
        labels = F.transform(F.slice(ids, F.lit(2), F.size(ids) - 1), lambda v, i: F.when(i < room - 1, IGNORED).otherwise(v))
        return F.when((F.size(ids) > 1) & (room <= F.size(ids) - 1), F.struct(x.alias("x"), labels.alias("y"), room.alias("kept_prompt")))

    return F.when((np > 0) & (na > 0), once(F.struct(F.concat(kept_prompt, kept_answer).alias("ids"), prompt_room.alias("room")), shifted))


def padded(x: Column, y: Column, block: int, pad: int = STOP) -> tuple[Column, Column]:
    return F.concat(x, F.array_repeat(F.lit(pad), block - F.size(x))), F.concat(y, F.array_repeat(F.lit(IGNORED), block - F.size(y)))


def supervised(y: Column) -> Column:
    return F.size(F.filter(y, lambda v: v != IGNORED))

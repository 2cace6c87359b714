"""Token streams: documents' ids end to end in the order of their keys, cut into overlapping chunks.

A stream is never gathered. Its offsets come from ranges that add up on their own (``tokens.offsets``); each document's ids are cut at the chunks'
borders where they are, and a chunk gathers its own ids and a halo, the first ids of what follows, so each of its windows is whole. A chunk's
size is bounded whatever the documents' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once
from . import tokens

#: Ids up to this size of a vocabulary are two bytes, beyond it four: fixed by the stored format.
SMALL_VOCABULARY = 65_535
#: Ids of a chunk that windows are drawn from: the more, the less of it is its halo.
CHUNK = 1024
#: Chunks that a task adds up at once, and windows in a batch of what it finds.
CHUNKS_AT_ONCE, ROWS_AT_ONCE = 64, 1 << 16


class StreamError(ValueError):
    """A stream that can't be made or cut as asked."""


def array_type(vocabulary: int) -> str:
    """The NumPy type that a split's ids are stored as."""
    return "uint16" if vocabulary <= SMALL_VOCABULARY else "int32"


def placed(encoded: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """(key, ids, offset) of each document in the stream; keys are unique, and a document without ids is an error that names it."""
    empty = F.raise_error(F.concat(F.lit("no ids of document "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    sized = encoded.select(F.col(key).alias("key"), F.when(F.size(ids) > 0, F.col(ids)).otherwise(empty).alias("ids"))
    return tokens.offsets(sized.withColumn("n", F.size("ids").cast("long")), "key", "n").select("key", "ids", "offset")


def chunks(stream: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """(chunk, ids): the ids at ``chunk * size`` and after, ``size`` of them and ``halo`` more where there are."""
    if size < 1 or halo < 0:
        raise StreamError("a chunk has an id at least, and no halo below none")
    end = F.col("offset") + F.size("ids")
    first = F.greatest(F.lit(0), F.floor((F.col("offset") - halo - size) / size) + 1)
    spread = stream.withColumn("chunk", F.explode(F.sequence(first.cast("long"), F.floor((end - 1) / size).cast("long"))))
    start = F.greatest(F.col("offset"), F.col("chunk") * size)
    stop = F.least(end, (F.col("chunk") + 1) * size + halo)
    part = F.slice("ids", (start - F.col("offset") + 1).cast("int"), (stop - start).cast("int"))
    parts = spread.select("chunk", F.struct(start.alias("at"), part.alias("ids")).alias("part")).where(F.size("part.ids") > 0)
    return parts.groupBy("chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))


def _window(ids: Column, at: Column, block: int) -> tuple[Column, Column]:
    return F.slice(ids, at + 1, F.lit(block)), F.slice(ids, at + 2, F.lit(block))


def _sizes(block: int, stride: int | None) -> tuple[int, int]:
    """Ids of the chunks that windows are cut from, and the step from one window to the next."""
    step = stride or block
    if block < 1 or step < 1:
        raise StreamError("windows and strides have one id at least")
    return step * max(1, -(-max(block, 1024) // step)) if step < block else step, step


def windows(stream: DataFrame, block: int, stride: int | None = None) -> DataFrame:
    """(start, x, y) of the windows of ``block`` ids at every multiple of ``stride`` (``block`` by default): y is x one later, so a stream of n ids has starts 0 to n - block - 1."""
    size, step = _sizes(block, stride)

    def cut(v: Column) -> Column:
        starts = F.when(F.size(v) > block, F.filter(F.sequence(F.lit(0), F.least(F.size(v) - block, F.lit(size)) - 1, F.lit(step)), lambda i: i < size))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), *(w.alias(n) for n, w in zip("xy", _window(v, i, block), strict=True))))

    found = chunks(stream, size, block).select("chunk", F.explode(once(F.col("ids"), cut)).alias("w"))
    return found.select((F.col("chunk") * size + F.col("w.at")).alias("start"), "w.x", "w.y")


def _totals(size: int, block: int, step: int):
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, CHUNKS_AT_ONCE):
                batch = whole.slice(begin, CHUNKS_AT_ONCE)
                lists = batch.column("ids")
                n = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
                ids = lists.flatten().to_numpy().astype(np.int64)
                if not len(ids):
                    continue
                first = np.cumsum(n) - n
                most = np.clip(n - block, 0, size)  # starts that have a window and its labels
                count = -(-most // step)
                row = np.repeat(np.arange(len(n)), count)
                at = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * step
                start = batch.column("chunk").to_numpy()[row] * size + at
                before = np.concatenate(([0], np.cumsum(ids)))
                at += first[row]
                for k in range(0, len(at), ROWS_AT_ONCE):
                    part = at[k : k + ROWS_AT_ONCE]
                    columns = [start[k : k + ROWS_AT_ONCE], before[part + block] - before[part], ids[part].astype(np.int32), ids[part + block].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["start", "total", "first", "last"])

    return totals


def totals(stream: DataFrame, block: int, stride: int | None = None) -> DataFrame:
    """(start, total, first, last) of ``windows``: the sum of x, its first id, and the last of y.

    Sums are differences of a chunk's running sums, so a window costs the same whatever its length, and none is made.
    """
    size, step = _sizes(block, stride)
    return chunks(stream, size, block).mapInArrow(_totals(size, block, step), "start long, total long, first int, last int")


def length(stream: DataFrame, block: int | None = None) -> int:
    """The number of ids; too few for a window and its labels are an error."""
    n = stream.agg(F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0))).first()[0]
    if block is not None and n <= block:
        raise StreamError(f"a stream of {n} ids has no window of {block} and its labels")
    return n


def drawn_start(seed: int, keys: list[str], starts: int) -> Column:
    """A start below ``starts`` by a hash of seed and keys: with replacement, and the same at any number of partitions."""
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), *keys), 256)
    return F.pmod(F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"), F.lit(starts))


def drawn(stream: DataFrame, draws: DataFrame, keys: list[str], block: int, seed: int) -> DataFrame:
    """``draws`` with (start, x, y) of a window drawn for each row, whose ``keys`` tell it from the others.

    A start lies in one chunk, whose halo completes its window, so draws meet ids by an equal number of a chunk. Chunks are of CHUNK ids, or ``block`` if that is more: what is
    shuffled of a stream is little more than its ids.
    """
    size = max(block, CHUNK)
    placed_draws = draws.withColumn("start", drawn_start(seed, keys, length(stream, block) - block))
    met = placed_draws.withColumn("chunk", F.floor(F.col("start") / size).cast("long")).join(chunks(stream, size, block), "chunk")
    x, y = _window(F.col("ids"), (F.col("start") % size).cast("int"), block)
    return met.select(*draws.columns, "start", x.alias("x"), y.alias("y"))


def weighted(ids: Column) -> Column:
    """A checksum that tells the order of ids, too."""
    return F.aggregate(F.transform(ids, lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)

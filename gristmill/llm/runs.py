"""Periodic runs of words: maximal repetitions by Lyndon arrays on ordered alphabets.

Every run has a root that is the longest Lyndon word from where it begins, for the order of the words or for the
reverse of it. So both Lyndon arrays, with the matches to the right and to the left of each of their edges, give
all runs, and nothing is hashed or sorted. The matches that edges need overlap; each is copied from an
earlier edge as far as the match that reached furthest vouches for it, and only what lies beyond is compared.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import once
from .common import text_chunks

#: Words that a run has at least.
LEAST = 12
#: Words from which the arrays are packed, four bytes a word; up to that lists are faster.
PACKED = 1 << 18
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
SCHEMA = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False)])


def _filled(value: int, n: int):
    return [value] * n if n < PACKED else array("i", [value]) * n


def lyndon(t) -> tuple:
    """(end, match) of each position of ``t``, whose last item is less than all others.

    ``end[l]`` is where the next smaller suffix begins, so ``t[l:end[l]]`` is the longest Lyndon word at ``l``;
    ``match[l]`` is the number of items that the suffixes at ``l`` and at ``end[l]`` share.
    """
    n = len(t) - 1
    end, match = _filled(n, n), _filled(0, n)
    smaller, shared = _filled(-1, n), _filled(0, n)  # the same of the previous smaller suffix
    a = b = reach = 0  # t[b:reach] equals t[a:], and nothing was compared at or beyond reach
    for r in range(1, n):
        item, l = t[r], r - 1
        while l >= 0:
            x = t[l]
            if x != item:
                if x < item:
                    break
                end[l] = r
                l = smaller[l]
                continue
            e, known = 1, False
            if r < reach:
                q = r - b + a
                p = l - b + a if l >= b else l
                k = match[p] if end[p] == q else shared[q] if smaller[q] == p else 0
                if k:
                    known = k < reach - r
                    e = k if known else reach - r
            if not known:
                while t[l + e] == t[r + e]:
                    e += 1
                if r + e >= reach:
                    a, b, reach = l, r, r + e
            if t[l + e] < t[r + e]:
                shared[r] = e
                break
            end[l], match[l] = r, e
            l = smaller[l]
        smaller[r] = l
    return end, match


def _back(t, end, edges: Iterable[int]):
    """For each of ``edges``, which fall, the number of items that ``t[:l]`` and ``t[:end[l]]`` share at their ends."""
    n = len(end)
    back = _filled(0, n)
    a = b = low = n  # t[low:a] equals t[..b]
    for l in edges:
        r = end[l]
        e, known = 0, False
        if low < l <= a < n:
            p = l + b - a
            if p < n and (end[p] == r or r <= a and end[p] == r + b - a):
                known = back[p] < l - low
                e = back[p] if known else l - low
        if not known:
            while e < l and t[l - 1 - e] == t[r - 1 - e]:
                e += 1
            if e and l - e <= low:
                a, b, low = l, r, l - e
        back[l] = e
    return back


def _stretches(ids: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches that can hold a run: each word of a run occurs in it twice, so a word that occurs once divides."""
    todo = [(0, len(ids))]
    while todo:
        begin, end = todo.pop()
        _, ranks, counts = np.unique(ids[begin:end], return_inverse=True, return_counts=True)
        cuts = np.concatenate(([-1], np.flatnonzero(counts[ranks] == 1), [end - begin]))
        if len(cuts) == 2:
            yield begin, end
            continue
        parts = [(begin + int(cuts[k]) + 1, begin + int(cuts[k + 1])) for k in np.flatnonzero(np.diff(cuts) > least)]
        if 2 * sum(b - a for a, b in parts) > end - begin:  # each further look has half of the words at most
            yield from parts
        else:
            todo += parts


def _runs(ids: np.ndarray, least: int) -> set[tuple[int, int, int]]:
    n, found = len(ids), set()
    for order in (ids, int(ids.max()) - ids):
        t = order.tolist() if n < PACKED else array("i", order.tobytes())
        t.append(-1)
        end, match = lyndon(t)
        ends, matches = np.array(end, np.int64), np.array(match, np.int64)
        at = np.arange(n)
        # an edge without a match at either side is no run
        edges = np.flatnonzero((matches > 0) | ((at > 0) & (ids[at - 1] == ids[ends - 1])))
        back = _back(t, end, edges[::-1].tolist())
        lefts = np.fromiter((back[l] for l in edges), np.int64, len(edges))
        periods = ends[edges] - edges
        extra = lefts + matches[edges]
        for k in np.flatnonzero((extra >= periods) & (extra + periods >= least)):
            found.add((int(edges[k] - lefts[k]), int(periods[k]), int(extra[k] + periods[k])))
    return found


def find(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of ``words`` of at least ``least`` words and two periods, as sorted (start, period, length)."""
    if len(words) < least:
        return []
    rank: dict = {}
    ids = np.fromiter((rank.setdefault(w, len(rank)) for w in words), np.int32, len(words))
    return sorted((begin + start, period, length) for begin, end in _stretches(ids, least) for start, period, length in _runs(ids[begin:end], least))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: of each run its first period stays."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, period, length in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the number of its words, its runs, and the text with each run collapsed to one period.

    Words are what ASCII white space divides. A run is a stretch of at least ``least`` words and two of its
    smallest period that no neighbouring word extends; runs come by start, then period. Each row is worked on by itself, whole,
    so repeated rows give repeated results; a null or empty text has no words and an empty collapsed text, an empty table
    gives no rows. Columns of the input stay, but for those named ``n_words``, ``runs`` and ``collapsed``, which are replaced.
    """
    keep = [c for c in docs.columns if c not in SCHEMA.names]
    if text in SCHEMA.names:
        raise ValueError(f"the text's column can't be named {text}")
    schema = T.StructType([docs.schema[c] for c in keep] + SCHEMA.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names])), pa.string()]
        for batch in text_chunks(batches, text):
            counts, runs, texts = [], [], []
            for one in batch.column(text):
                words = (one.as_py() or "").encode().split()
                found = find(words, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, p, n in found])
                texts.append(b" ".join(collapse(words, found)).decode())
            columns = [pa.array(x, k) for x, k in zip((counts, runs, texts), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, names=schema.names)

    return docs.select(*keep).mapInArrow(work, schema)


def with_periods(text: Column, key: Column) -> Column:
    """``text`` with a periodic end, for every tenth key: from word a on its words repeat with period p, both following from the key's checksum."""
    h = F.crc32(key.cast("string"))

    def moved(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        again = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a.cast("int")), again), " "))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.coalesce(once(words, moved), text)).otherwise(text)


def longest(runs: Column) -> Column:
    """The run of greatest length, ties by smallest start, then period; null without a run."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(key)


def digest_of(runs: Column) -> Column:
    """SHA-256 of all runs, a line each."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


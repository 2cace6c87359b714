"""Benchmark decontamination: words of documents that lie in an occurrence of a test window.

A window is ``size`` consecutive words of an item (the whole item if it has
fewer). The windows' words become integers; the set of window hashes is
broadcast, documents are scanned once with a rolling hash, and each hit of the
hash set is verified on the words themselves. The broadcast holds at most
MAX_WORDS words: a larger benchmark is taken in blocks of that size, each
against all documents, and adds to each row's hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

#: Words of one broadcast block of items (about 150 MB at most).
MAX_WORDS = 2_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and all that isn't ASCII; null has none."""
    return _WORD.findall(text.encode().lower()) if text else []


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive ids."""
    n = len(ids) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size) if n > 0 else ():
        out *= _MULT
        out += ids[k : k + n]
    out ^= out >> np.uint64(29)
    out *= _MIX
    return out


class Windows:
    """The hash set of some items' windows: by length, sorted window hashes with the windows' word ids and items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, all_words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in all_words]
            length = min(size, len(ids))
            for i in range(len(ids) - length + 1) if length else ():
                found = by_length.setdefault(length, {}).setdefault(tuple(ids[i : i + length]), set())
                if item is not None:
                    found.add(item)
        self.tables = []
        for length, found in sorted(by_length.items()):
            grams = np.array(list(found), np.uint64).reshape(-1, length)
            hashes = np.array([_rolling(g, length)[0] for g in grams], np.uint64)
            order = np.argsort(hashes, kind="stable")
            owners = [sorted(x) for x in found.values()]
            hashes = hashes[order]
            passing = np.zeros(1 << 20, bool)
            passing[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((length, hashes, grams[order], [owners[i] for i in order], passing))

    def scan(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        """For each text: its number of words, the sorted positions of hit words, and the items with occurring windows."""
        each = [words(t) for t in texts]
        get = self.vocabulary.get
        counts = np.fromiter(map(len, each), np.int64, len(each))
        # texts are laid end to end, with a word of no window between
        starts = np.concatenate(([0], np.cumsum(counts + 1)[:-1])).astype(np.int64)
        ids = np.zeros(int(counts.sum()) + len(each), np.uint64)
        for at, x in zip(starts.tolist(), each, strict=True):
            if x:
                ids[at : at + len(x)] = [get(w, 0) for w in x]
        owner: list[set[str]] = [set() for _ in texts]
        marks = np.zeros(len(ids) + 1, np.int64)
        for length, hashes, grams, items, passing in self.tables:
            rolled = _rolling(ids, length)
            at = np.flatnonzero(passing[(rolled >> np.uint64(44)).astype(np.int64)])
            slot = np.searchsorted(hashes, rolled[at])
            while len(at):
                inside = slot < len(hashes)
                at, slot = at[inside], slot[inside]
                same = hashes[slot] == rolled[at]
                at, slot = at[same], slot[same]
                if not len(at):
                    break
                exact = (ids[at[:, None] + np.arange(length)] == grams[slot]).all(axis=1)
                for p, s in zip(at[exact].tolist(), slot[exact].tolist(), strict=True):
                    owner[int(np.searchsorted(starts, p, "right")) - 1].update(items[s])
                np.add.at(marks, at[exact], 1)
                np.add.at(marks, at[exact] + length, -1)
                slot = slot + 1  # another window with the same hash
        covered = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        lo, hi = np.searchsorted(covered, starts), np.searchsorted(covered, starts + counts)
        return [(int(n), covered[a:b] - s, o) for n, s, a, b, o in zip(counts, starts, lo, hi, owner, strict=True)]


def _runs(positions: np.ndarray) -> list[list[int]]:
    """Positions as maximal runs [first, end)."""
    if not len(positions):
        return []
    cut = np.flatnonzero(np.diff(positions) > 1)
    return np.column_stack((positions[np.concatenate(([0], cut + 1))], positions[np.append(cut, len(positions) - 1)] + 1)).tolist()


_SCHEMA = "doc_id long, n_words long, spans array<array<long>>, items array<string>"


def _scan_with(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in text_chunks(batches):
            found = windows.scan(batch.column("text").to_pylist())
            spans = [_united([*(before or []), *_runs(p)]) for before, (_, p, _) in zip(batch.column("spans").to_pylist(), found, strict=True)]
            items = [sorted(o.union(before or [])) for before, (_, _, o) in zip(batch.column("items").to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text"),
                    batch.column("doc_id"),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                ["text", "doc_id", "n_words", "spans", "items"],
            )

    return scan


def _blocks(benchmark: DataFrame, max_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items, in blocks of at most ``max_words`` words, or one item."""
    block, total = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        found = words(row[1])
        if total and total + len(found) > max_words:
            yield block
            block, total = [], 0
        block.append((row[0], found))
        total += len(found)
    yield block


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of ``docs``: runs [first, end) of hit words, and sorted item ids as strings.

    Null and blank texts have no words and no hits, and items without words have
    no windows. A window of an item without item_id hits, but names no item.
    Several blocks of items scan one after the other, each adding to the row's hits.
    """
    spark = docs.sparkSession
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = found.select("*", F.lit(None).cast("array<array<long>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for block in _blocks(benchmark, max_words):
        found = found.mapInArrow(_scan_with(spark.sparkContext.broadcast(Windows(block, size))), f"text string, {_SCHEMA}")
    return found.select("doc_id", "n_words", "spans", "items")


def _clean_with(shared):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            yield batch.filter(pa.array([not len(p) for _, p, _ in shared.value.scan(batch.column("text").to_pylist())], pa.bool_()))

    return clean


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text has no occurrence of a test window. Several blocks of items filter one after the other."""
    for block in _blocks(benchmark, max_words):
        shared = docs.sparkSession.sparkContext.broadcast(Windows(block, size))
        docs = docs.mapInArrow(_clean_with(shared), docs.schema)
    return docs


def _united(spans: list[list[int]]) -> list[list[int]]:
    """Runs that overlap or touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def removed_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the hit words in ``spans`` and what lies between them."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, data[last:]]).decode()


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()

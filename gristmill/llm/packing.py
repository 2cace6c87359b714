"""Packing of tokenised documents into training sequences, by multiway differencing.

Every document becomes token ids and an end id. Only documents longer than a
window are cut: full windows are sequences of their own. What remains of each
document is dealt into groups of about GROUP_ROWS rows, and each group into windows
by Karmarkar-Karp differencing: partial partitions are merged, those of the largest
difference first, large sums of one onto small sums of the other. For as long as a
window exceeds the capacity, the count of windows rises by one.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks

#: Documents of a group, about.
GROUP_ROWS = 1024
#: Bytes of text tokenized at once.
TOKENIZED = 1 << 22
#: Words whose ids a worker remembers.
REMEMBERED = 150_000
#: Kinds of the characters up to U+00FF in lower-case texts, as the tokenizer's own pattern tells them: white space, letters, numerals (each a word), other signs.
_SPACES, _LETTERS, _NUMERALS, _SIGNS = range(4)
_KIND = np.full(256, _SIGNS, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACES
_KIND[[*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTERS
_KIND[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMERALS
#: Texts with other characters, or with those that Python alone takes for white space, go to the tokenizer whole.
_OTHER = re.compile(r"[^\x00-\x1b\x20-\xff]")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Token ids by a tokenizers file: lower-casing, byte-level BPE with word ends. Each word is encoded once and remembered.

    New words go to the model many at a time, without the normalizer and the
    pre-tokenizer, whose work is done here for texts up to U+00FF; other texts are encoded
    by the whole tokenizer.
    """

    def __init__(self, definition: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are parallel already
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(definition)
        self.whole.encode_special_tokens = True
        bare = json.loads(definition) | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None}
        self.words = Tokenizer.from_str(json.dumps(bare))
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = bare["model"]["vocab"]
        suffix = bare["model"]["end_of_word_suffix"]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.letters = _byte_letters() | {32: " "}
        self.end_id = end_id
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.at, self.size, self.uses = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def forget(self) -> None:
        """Drop all words but those that were met again since they were learned or kept; all, if that is most of them."""
        again = np.flatnonzero(self.uses[: len(self.slot)] > 1)
        if len(again) >= len(self.slot) // 2:
            self._clear()
            return
        words, sizes, past = list(self.slot), self.size[again], np.concatenate(([0], np.cumsum(self.size[again])))
        ids = self.ids[np.arange(past[-1]) + np.repeat(self.at[again] - past[:-1], sizes)]
        self._clear()
        self._store([words[k] for k in again.tolist()], ids, past[:-1], past[1:])

    def _learn(self, new: list[bytes]) -> None:
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            groups = [part[j : j + 256] for j in range(0, len(part), 256)]
            joined = [b" ".join(g).decode("latin-1").encode().decode("latin-1").translate(self.letters) for g in groups]
            for group, encoding in zip(groups, self.words.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(encoding.ids, np.uint32)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(group):
                    raise ValueError("the vocabulary has words without an end")
                self._store(group, ids, np.concatenate(([0], ends[:-1])), ends)

    def _store(self, words: list[bytes], ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        k, n = len(self.slot), len(words)
        while k + n > len(self.at):
            self.at, self.size, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.size, self.uses))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[k : k + n], self.size[k : k + n] = self.used + begins, ends - begins
        self.used += len(ids)
        self.slot.update(zip(words, range(k, k + n), strict=True))

    def _slots(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """The slot of each of some distinct words, in one byte a character. Learns new ones."""
        if len(self.slot) > REMEMBERED:
            self.forget()
        known = self.slot
        new = [w for w in words if w not in known]
        if new:
            self._learn(new)
        slots = np.array([known[w] for w in words], np.int64)
        self.uses[slots] += counts.astype(np.int32)
        return slots

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text, the end id included; null is like the empty text."""
        plain = [not t or (t.isascii() and "\x1c" not in t and "\x1d" not in t and "\x1e" not in t and "\x1f" not in t) or not _OTHER.search(t) for t in texts]
        # the plain texts in one byte a character, each after a line end
        parts = [(t or "").lower().encode("latin-1") for t, ok in zip(texts, plain, strict=True) if ok]
        begins = np.cumsum([0, *(len(x) + 1 for x in parts)])
        offsets, letters, first = _words(np.frombuffer(b"\n".join([b"", *parts]), np.uint8), begins)
        found = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)]).dictionary_encode()
        which = found.indices.to_numpy()
        slots = self._slots(found.dictionary.to_pylist(), np.bincount(which, minlength=len(found.dictionary)))[which]
        sizes = self.size[slots]
        past = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.arange(past[-1]) + np.repeat(self.at[slots] - past[:-1], sizes)]
        bounds = iter(zip(past[first[:-1]].tolist(), past[first[1:]].tolist(), strict=True))
        end = np.uint32(self.end_id)
        out = []
        for t, ok in zip(texts, plain, strict=True):
            if ok:
                a, b = next(bounds)
                out.append(np.append(ids[a:b], end))
            else:
                out.append(np.array([*self.whole.encode(t, add_special_tokens=False).ids, self.end_id], np.uint32))
        return out


def _words(letters: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(where words begin and the last ends, all without white space; the letters left; the first word of each text). Texts begin with white space, at ``begins``; its last is the end."""
    kind = _KIND[letters]
    start = np.ones(len(letters) + 1, bool)
    start[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMERALS)
    # a sign that begins a run, is a quote, and is followed by s, t, m, d, re, ve or ll makes a word with these
    quote = np.flatnonzero((letters == 39) & start[:-1])
    quote = quote[quote + 1 < len(letters)]
    one, two = letters[quote + 1], letters[np.minimum(quote + 2, len(letters) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (quote + 2 < len(letters)) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
    start[quote[short | long] + 1] = False
    start[quote[short] + 2] = True
    start[quote[long] + 3] = True
    solid = kind != _SPACES
    start[:-1] &= solid
    at = np.flatnonzero(start[:-1])
    before = np.cumsum(solid, dtype=np.int32)  # letters up to each place, itself included
    offsets = np.append(before[at] - 1, before[-1] if len(before) else 0)
    return offsets, letters[solid], np.searchsorted(at, begins).tolist()


_workers: dict[int, WordTokenizer] = {}


def _tokenize(shared, end_id: int, capacity: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition = shared.value
        key = hash((definition, end_id))
        if key not in _workers:
            _workers[key] = WordTokenizer(definition, end_id)
        tokenizer, task = _workers[key], TaskContext.get().partitionId() << 40
        rows, full = count(task), count(task)
        for batch in text_chunks(batches, most=TOKENIZED):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(batch.column("text").to_pylist()), strict=True):
                row = next(rows)
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    out.append((row, doc_id, start, len(part), len(ids), -1 - next(full) if len(part) == capacity else None, part.astype(width).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 6 + (pa.binary(),), strict=True)], ["row", "doc_id", "block", "n", "doc_tokens", "own", "ids"])

    return run


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: items 0..n-1 in k windows of near-equal sums; a window is a list of items."""
    tie = count()
    # (difference, tie, sums descending, their items); sums of zero aren't held
    heap = [(-s, next(tie), [s], [[i]]) for i, s in sorted(enumerate(sizes), key=lambda x: -x[1])]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, items_a = heapq.heappop(heap)
        _, _, b, items_b = heapq.heappop(heap)
        free = k - len(b)  # so many of a's largest sums meet a zero of b
        sums, items = a[:free], items_a[:free]
        met = len(a) - free
        if met > 0:
            sums += [x + y for x, y in zip(a[free:], reversed(b[-met:]), strict=True)]
            items += [x + y for x, y in zip(items_a[free:], reversed(items_b[-met:]), strict=True)]
            sums += reversed(b[:-met])
            items += reversed(items_b[:-met])
        else:
            sums, items = sums + b, items + items_b
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, items = [sums[i] for i in order], [items[i] for i in order]
        heapq.heappush(heap, ((sums[-1] if len(sums) == k else 0) - sums[0], next(tie), sums, items))
    found = heap[0][3] if heap else []
    return found + [[] for _ in range(k - len(found))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``, each a list of items; no item is larger than that.

    The count starts at the least possible and rises by one for as long as a window exceeds the capacity.
    """
    k = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        k += 1


def _plan_group(capacity: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "row"], ascending=[False, True], ignore_index=True)
        rows, sizes, group = pdf["row"].tolist(), pdf["n"].tolist(), int(pdf["g"].iloc[0])
        out = []
        for w, items in enumerate(windows(sizes, capacity)):
            offset = 0
            for i in items:
                out.append((rows[i], group << 32 | w, offset))
                offset += sizes[i]
        return pd.DataFrame(out, columns=["row", "sequence_id", "offset"])

    return plan


def pack(docs: DataFrame, definition: str, end_id: int = 2, capacity: int = 4096, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of packed sequences: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``definition`` is the text of a tokenizers file. ``ids`` are the piece's
    token ids, little-endian, in 2 bytes each (4 for vocabularies over 65,536). A null
    text counts as empty and is its end id alone; repeated rows are packed each on
    their own; an empty table gives no pieces. A document of more than ``capacity``
    ids is cut into full windows and a rest, any other one is a single piece.
    """
    spark = docs.sparkSession
    size = max(json.loads(definition)["model"]["vocab"].values()) + 1
    width = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(definition)
    schema = "row long, doc_id long, block long, n long, doc_tokens long, own long, ids binary"
    blocks = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tokenize(shared, end_id, capacity, width), schema), "tokens")
    rest = blocks.where("own is null")
    groups = max(1, -(-rest.count() // group_rows))
    plan = rest.select("row", "n", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g")).groupBy("g")
    plan = plan.applyInPandas(_plan_group(capacity), "row long, sequence_id long, offset long")
    dealt = rest.join(plan, "row").select("doc_id", F.col("block").alias("start"), F.col("n").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")
    whole = blocks.where("own is not null").select("doc_id", F.col("block").alias("start"), F.col("n").alias("length"), "ids", "doc_tokens", F.col("own").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(dealt)


def with_checksums(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by ids_crc32: CRC-32 of the piece's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x, f"<u{len(x) // max(n, 1) or 2}").astype("<u4").tobytes()) for x, n in zip(b.column("ids").to_pylist(), b.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    names = [c for c in pieces.columns if c != "ids"]
    schema = ", ".join(f"{c} long" for c in names)
    return pieces.mapInArrow(run, f"{schema}, ids_crc32 long")

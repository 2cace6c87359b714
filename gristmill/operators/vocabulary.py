"""Encoding and decoding by a learned vocabulary of byte pairs, which a file gives; nothing is trained here.

A vocabulary's ids follow the special ones (unknown, begin, stop, padding), and the chat markers follow its own, each an id by
itself. A word that was met of late isn't merged again; others are, by a heap of its neighbouring pairs, so a long word costs little more than its length.
"""

from __future__ import annotations

import heapq
import json
import uuid
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions import text as T
from .tokens import BEGIN, FIRST_BYTE, PAD, STOP, UNKNOWN, UNKNOWN_TEXT

#: Pieces that a vocabulary has at most, which bounds what is sent to each task: some 100 bytes a piece.
MOST_PIECES = 1 << 20
#: Words whose ids an encoder remembers, which bounds its memory whatever it reads.
KNOWN_WORDS = 1 << 16
#: Fixed value: white space, of which one character may begin a word.
_WHITE = r"\t-\r\x20\x85\xa0  -     　"
#: Fixed value: what byte-pair vocabularies of this kind count as a word.
_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
MARKERS = (T.SYSTEM, T.USER, T.ASSISTANT, T.END)


class VocabularyError(ValueError):
    """A file that is no vocabulary that can be used."""


def _letters() -> dict[str, int]:
    """How the files write bytes: printable ones as they are, others as letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Pieces by number, and for each pair of numbers that merge their rank and what they become."""

    pieces: list[bytes]
    merges: dict[tuple[int, int], tuple[int, int]]
    markers: tuple[str, ...] = MARKERS
    _bytes: list[int] = field(init=False)

    def __post_init__(self):
        number = {p: i for i, p in enumerate(self.pieces)}
        if len(self.pieces) > MOST_PIECES:
            raise VocabularyError(f"{len(self.pieces)} pieces are more than {MOST_PIECES}")
        if any(bytes([b]) not in number for b in range(256)):
            raise VocabularyError("a byte has no piece")
        self._bytes = [number[bytes([b])] for b in range(256)]

    @property
    def size(self) -> int:
        """All ids, special ones and markers too."""
        return FIRST_BYTE + len(self.pieces) + len(self.markers)

    def merged(self, word: bytes) -> list[int]:
        """The pieces of a word: of all neighbours that merge, those of least rank do first, from the left."""
        ids = [self._bytes[b] for b in word]
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of them has merged otherwise
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (found := self.merges.get((ids[k], ids[right[k]]))):
                    heapq.heappush(queue, (found[0], k, ids[k], ids[right[k]], found[1]))
        return [i for i in ids if i >= 0]

    def encoder(self):
        """A function from texts to arrays of ids; the KNOWN_WORDS words that it met last aren't merged again."""
        words, parts = regex.compile(_WORD), regex.compile("(" + "|".join(map(regex.escape, self.markers)) + ")") if self.markers else None
        special = {m: [FIRST_BYTE + len(self.pieces) + i] for i, m in enumerate(self.markers)}

        @lru_cache(KNOWN_WORDS)
        def known(word: str) -> list[int]:
            return [FIRST_BYTE + i for i in self.merged(word.encode("utf-8", "surrogatepass"))]

        def encode(text: str) -> list[int]:
            ids: list[int] = []
            for part in parts.split(text) if parts else [text]:
                if part in special:
                    ids += special[part]
                    continue
                for word in words.findall(part):
                    ids += known(word)
            return ids

        return encode

    def decoder(self):
        """A function from ids to a text; begin, stop and padding leave nothing, ids out of range read as the unknown one."""
        table = [UNKNOWN_TEXT.encode(), b"", b"", b"", *self.pieces, *(m.encode() for m in self.markers)]
        assert (UNKNOWN, BEGIN, STOP, PAD) == (0, 1, 2, 3)
        joined, sizes = np.frombuffer(b"".join(table), np.uint8), np.fromiter(map(len, table), np.int64, len(table))
        starts = np.cumsum(sizes) - sizes

        def decode(ids) -> str:
            ids = ids.astype(np.int64) if isinstance(ids, np.ndarray) else np.array([UNKNOWN if i is None else i for i in ids], np.int64)
            ids = np.where((ids >= 0) & (ids < len(table)), ids, UNKNOWN)
            n = sizes[ids]
            return joined[np.repeat(starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes().decode("utf-8", "replace")

        return decode


def read(spark: SparkSession, path: str, markers: tuple[str, ...] = MARKERS) -> Vocabulary:
    """The vocabulary of a JSON file of byte pairs, read by Spark from wherever it lies."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise VocabularyError(f"{path} isn't one file")
    model = json.loads(rows[0][0]).get("model", {})
    if not model.get("vocab") or not model.get("merges"):
        raise VocabularyError(f"{path} has no pieces or no merges")
    letters = _letters()
    added = {name for name in model["vocab"] if not all(c in letters for c in name)}
    order = sorted((i, name) for name, i in model["vocab"].items() if name not in added)
    number = {name: k for k, (_, name) in enumerate(order)}
    if [i for i, _ in order] != list(range(len(order))):
        raise VocabularyError(f"{path} numbers its pieces with gaps")
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if a not in number or b not in number or a + b not in number:
            raise VocabularyError(f"{path}: merge {rank} is of pieces that aren't there")
        merges[number[a], number[b]] = (rank, number[a + b])
    return Vocabulary([bytes(letters[c] for c in name) for _, name in order], merges, markers)


_tools: dict[str, object] = {}


def _made(token: str, make):
    """An encoder or a decoder, made once a worker; a worker keeps the last few."""
    if token not in _tools:
        if len(_tools) > 3:
            _tools.clear()
        _tools[token] = make()
    return _tools[token]


def encode(spark: SparkSession, vocabulary: Vocabulary, text: Column, begin: bool = True, stop: bool = True) -> Column:
    """A text's ids, with begin and stop around it; null for null."""
    shared, token = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        one = _made(token, lambda: shared.value.encoder())
        # four bytes an id from the start: a batch's ids as Python's lists are many times its text
        parts = [np.array(one(t.as_py()) if t.is_valid else (), np.int32) for t in texts]
        offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum([len(p) for p in parts], dtype=np.int32)))
        values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=texts.is_null())

    edge = lambda on, i: F.array(*[F.lit(i)] * on).cast("array<int>")
    return F.concat(edge(begin, BEGIN), ids(text), edge(stop, STOP))


def decode(spark: SparkSession, vocabulary: Vocabulary, ids: Column) -> Column:
    """The text of an array of ids; null for null."""
    shared, token = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    @F.arrow_udf(StringType())
    def texts(arrays: pa.Array) -> pa.Array:
        one = _made(token, lambda: shared.value.decoder())
        values, offsets, valid = arrays.values.fill_null(UNKNOWN).to_numpy(), arrays.offsets.to_numpy(), arrays.is_valid().to_pylist()
        return pa.array([one(values[a:b]) if v else None for a, b, v in zip(offsets[:-1], offsets[1:], valid, strict=True)], pa.string())

    return texts(ids)


def usage(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """(id, n): how often each id of the vocabulary occurs, those that never do too."""
    counts = encoded.select(F.explode(ids).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    every = encoded.sparkSession.range(vocabulary.size).select(F.col("id").cast("int").alias("id"))
    return every.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))

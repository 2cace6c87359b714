"""Word shingles, and all pairs of texts whose sets of shingles reach a Jaccard coefficient.

Sets near enough share one of their first elements in any order that holds for all
(of n, n // 5 + 1 for 0.8), so those are keys. What a sample shows to be common
comes last in the order; the sample decides how many rows meet, never which pairs
are found. Rows that meet are compared by length and by a bitmap of parities, which
reject no pair that is near enough, and then by their sets. A first round compares
each set with one other, the least that it meets, and with those that the caller
names, say by their fingerprints. The next ones compare, for each component under a
key, the two sets of most alike bitmaps of it and of any other, until that links
no more. Then all that meet and have no link yet are compared, so a large group of copies
isn't compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, text_chunks
from .graph import components

_LOWER = bytes(range(256)).lower()
#: Words in a shingle, and the least Jaccard coefficient as a fraction, for stages on word shingles.
SIZE, NEAR = 5, (4, 5)
#: Documents sampled for common shingles, how many of them make one common, and how many shingles are kept.
SAMPLE_DOCS, COMMON, MOST_COMMON = 4000, 4, 200_000
#: Bits of a bitmap of parities at least; it has as many as its set has elements, rounded up to a power of two.
BITS = 512
#: Byte b as eight bytes, one for each of its bits: sums of up to 255 of them don't overflow.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
#: Places of the bitmap of wanted documents.
SLOTS = 1 << 22
_ROWS = "node long, n long, bits binary, fp long"
_SETS = "doc_id long, node long, hashes binary"
#: Keys before a key that a row remembers, so that a pair with one of them in common isn't named again.
BEFORE = 8
#: Sets that are compared with one other in one task, about.
DEALT = 50


def shingle_hashes(text: str | None, size: int = 3) -> list[int]:
    """XXH64 (seed 42) of every shingle of ``size`` words, repeats included; fewer words give one shingle, none give none."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, 42)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [digest(joined[a:b], 42) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``counts[i]`` hashes: bits set in over half of the run; zero for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    pieces = -(-n // 255)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    which = np.repeat(np.arange(len(full)), pieces)
    head = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    starts = first[which] + (np.arange(len(which)) - head[which]) * 255
    octets = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.empty((len(full), 64), np.uint8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], starts).view(np.uint8).reshape(-1, 8)
        bits[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums, head, axis=0, dtype=np.int64) * 2 > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _sets(batch: pa.RecordBatch, size: int) -> tuple[list[np.ndarray], pa.Array]:
    """Each row's sorted set of shingle hashes, and a hash of it."""
    found = [np.unique(np.array(shingle_hashes(t, size), np.uint64)) for t in batch.column("text").to_pylist()]
    return found, pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in found], np.uint64).view(np.int64))


def _lists(found: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat))


def parities(values: np.ndarray) -> bytes:
    """Whether an odd number of the values fall on each bit. The bitmaps of two sets differ in at most as many bits as the sets in elements; so do the larger's halves, one folded on the other, and the smaller's bitmap."""
    size = max(BITS, 1 << max(len(values) - 1, 0).bit_length())
    return np.packbits((np.bincount((values & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of several sizes, compared pair by pair."""

    def __init__(self, column: list[bytes]):
        self.column = column
        self.sizes = np.fromiter(map(len, column), np.int64, len(column))

    def _folded(self, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Those rows at ``size`` bytes, as a matrix of their own, and each one's place in it."""
        own, place = np.unique(rows, return_inverse=True)
        out = np.empty((len(own), size // 8), np.uint64)
        for k, r in enumerate(own.tolist()):
            bits = np.frombuffer(self.column[r], np.uint64)
            out[k] = np.bitwise_xor.reduce(bits.reshape(-1, size // 8), axis=0)
        return out, place

    def apart(self, other: Bitmaps, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits row a[i] and row b[i] of the other's differ."""
        size = np.minimum(self.sizes[a], other.sizes[b])
        out = np.zeros(len(a), np.int64)
        for w in np.unique(size).tolist():
            at = np.flatnonzero(size == w)
            x, i = self._folded(a[at], w)
            y, j = other._folded(b[at], w)
            for k in range(0, len(at), 1 << 14):  # a few at a time: long sets have long bitmaps
                part = slice(k, k + (1 << 14))
                out[at[part]] = np.bitwise_count(x[i[part]] ^ y[j[part]]).sum(axis=1, dtype=np.int64)
        return out


def _keys_with(shared, size: int, near: tuple[int, int]):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in text_chunks(batches):
            found, node = _sets(batch, size)
            first = []
            for x in found:
                late = common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x if len(common) else np.zeros(len(x), bool)
                first.append(np.concatenate((x[~late], x[late]))[: len(x) - -(-near[0] * len(x) // near[1]) + 1])
            n = np.array([len(x) for x in found], np.int64)
            fp = pa.array(majority(np.concatenate(found), n).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), node, pa.array(n), pa.array(list(map(parities, found)), pa.binary()), fp, _lists(first)], ["doc_id", "node", "n", "bits", "fp", "keys"])

    return keys


def _shared(x: bytes, y: bytes) -> int:
    """How many elements two sets have in common."""
    both = np.sort(np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _sets_of(size: int, shared):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(shared.value[batch.column("slot").to_numpy()]))
            for part in text_chunks([batch]):
                found, node = _sets(part, size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), node, pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "node", "hashes"])

    return sets


def _hashes_of(size: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([_lists(_sets(batch, size)[0])], ["hashes"])

    return hashes


def _compare(near: tuple[int, int]):
    p, q = near

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("center", "node", "n", "hashes")), strict=True)]
        centers = {c: (n, x) for c, node, n, x in rows if c == node}
        found = []
        for c, node, n, x in rows:
            if c != node:
                m, y = centers[c]
                if _shared(x, y) * (p + q) >= (n + m) * p:
                    found.append((node, c))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    return compare


def _verified(narrow: DataFrame, facts: DataFrame, pairs: DataFrame, size: int, near: tuple[int, int]) -> DataFrame:
    """Links (u, v) of those pairs (a, b) of nodes whose sets are near. ``facts``: (node, least, n, bits).

    Each b's set goes to a's once; an a of many b is dealt out in parts. A bitmap of
    fixed size tells most texts of no pair, so these are neither hashed nor shuffled.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / DEALT).alias("parts"))
    members = pairs.join(many, "a").select(F.col("b").alias("node"), F.col("a").alias("center"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    tags = members.unionByName(many.select(F.col("a").alias("node"), F.col("a").alias("center"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    tags = materialize(tags.join(facts.select("node", F.col("least").alias("doc_id"), "n"), "node"), "wanted")
    at = tags.select(slot(F.col("doc_id")).alias("at"))
    words = at.groupBy(F.shiftright("at", 15).alias("word")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    marked = np.zeros(SLOTS, bool)
    for word, bits in words.collect():
        marked[word << 15 : (word + 1) << 15] = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little").astype(bool)
    shared = narrow.sparkSession.sparkContext.broadcast(marked)
    # rows that share a doc_id may have other sets, and rows that share a set other ids; copies of a row bring the same links again
    sets = narrow.withColumn("slot", slot(F.col("doc_id"))).mapInArrow(_sets_of(size, shared), _SETS)
    dealt = sets.join(tags, ["node", "doc_id"]).select("center", "part", "node", "n", "hashes").repartition("center", "part")
    found = materialize(dealt.mapInArrow(_compare(near), "u long, v long"), "near")
    discard(tags)
    return found


def _common(narrow: DataFrame, size: int) -> np.ndarray:
    total = narrow.count()
    sample = narrow.where(F.pmod(F.xxhash64(F.lit("common"), "doc_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE_DOCS / max(total, 1))))
    counted = sample.mapInArrow(_hashes_of(size), "hashes array<long>").select(F.explode("hashes").alias("h")).groupBy("h").count()
    found = counted.where(F.col("count") >= COMMON).orderBy(F.col("count").desc()).limit(MOST_COMMON).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().astype(np.int64).view(np.uint64))


def _columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> list[np.ndarray] | None:
    parts = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(c).to_numpy() for b in parts]) for c in names] if parts else None


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keys with two nodes or more the distinct rows (key, node), with star false, and with star true (least node, other node); a task has all rows of its keys."""
    found = _columns(batches, ("key", "node"))
    if not found:
        return
    key, node = found
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    other = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))  # copies bring the same rows
    key, node = key[other], node[other]
    same = key[1:] == key[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
    key, node = key[keep], node[keep]
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), bool)), pa.array(key), pa.array(node)], ["star", "x", "y"])
    new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    least = node[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(key) else node
    stars = np.unique(np.column_stack((least[~new], node[~new])), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(stars), bool)), pa.array(stars[:, 0]), pa.array(stars[:, 1])], ["star", "x", "y"])


def _alike(near: tuple[int, int], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and of m elements can be near."""
    return near[1] * np.minimum(n, m) >= near[0] * np.maximum(n, m)


def _close(near: tuple[int, int], n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets whose bitmaps differ in so many bits can be near: such differ in at most (n + m) (q - p) / (q + p) elements."""
    return apart * (near[0] + near[1]) <= (n + m) * (near[1] - near[0])


def _fitting(near: tuple[int, int]):
    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(c).to_numpy() for c in ("n", "m"))
            at = np.flatnonzero(_alike(near, n, m))
            apart = Bitmaps(b.column("x").to_pylist()).apart(Bitmaps(b.column("y").to_pylist()), at, at)
            yield b.select(["a", "b"]).take(pa.array(at[_close(near, n[at], m[at], apart)]))

    return fitting


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, node, root) whose key has two roots or more; a task has all rows of its keys."""
    found = _columns(batches, ("key", "node", "root"))
    if not found:
        return
    key, node, root = found
    order = np.argsort(key, kind="stable")
    key, node, root = key[order], node[order], root[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(begin, len(key)))
    keep = np.repeat(np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin), size)
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, root)], ["key", "node", "root"])


def _before(column: pa.ListArray, key: np.ndarray) -> np.ndarray:
    """Each row's list of at most BEFORE keys, filled up with its own."""
    sizes = pa.compute.list_value_length(column).to_numpy()
    out = np.repeat(key[:, None], BEFORE, axis=1)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _named_before(before: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a[i] and b[i] remember a key in common, under which they have met."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 14):
        x, y, top = before[a[k : k + (1 << 14)]], before[b[k : k + (1 << 14)]], key[a[k : k + (1 << 14)], None]
        for j in range(BEFORE):
            out[k : k + (1 << 14)] |= ((x == y[:, j, None]) & (x != top)).any(axis=1)
    return out


_MET_NAMES = ["live", "x", "y", "n", "bits", "before"]
_MET = "live boolean, x long, y long, n long, bits binary, before array<long>"
#: Rows that are passed on to the next round at once.
LIVE_AT_ONCE = 10_000


def _pairs_with(near: tuple[int, int], every: bool, step: int = 1 << 16, onward: bool = False):
    """Pairs of different roots under a key that may be near: all, or for each root under a key that of most alike bitmaps, which are no more than rows came in.

    With ``onward`` pairs are rows (false, node, node), and unless all are given, the rows that are in such a pair follow, as (true, key, node)
    with what else they had; roots only merge, so the others are in none later, either.
    """

    def paired(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        if not onward:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        others = [pa.nulls(len(a), t) for t in (pa.int64(), pa.binary(), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), bool)), pa.array(a), pa.array(b), *others], _MET_NAMES)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        found = _columns(iter(parts), ("key", "node", "n", "root"))
        if not found:
            return
        key, node, n, root = found
        bits = [x for b in parts for x in b.column("bits").to_pylist()]
        order = np.lexsort((node, key))
        key, node, n, root = key[order], node[order], n[order], root[order]
        bits = Bitmaps([bits[i] for i in order.tolist()])
        before = np.concatenate([_before(b.column("before"), b.column("key").to_numpy()) for b in parts])[order]
        parts.clear()
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        end = np.append(begin[1:], len(key))
        rows = np.arange(len(key))
        others = end[np.searchsorted(begin, rows, "right") - 1] - rows - 1  # a row meets those after it in its bucket
        ahead = np.concatenate(([0], np.cumsum(others)))
        same = np.lexsort((root, key))
        other = np.concatenate(([True], (key[same][1:] != key[same][:-1]) | (root[same][1:] != root[same][:-1])))
        group = np.empty(len(key), np.int64)  # of each row's key and root
        group[same] = np.cumsum(other) - 1
        live = np.zeros(len(key), bool)
        best = np.full((int(other.sum()), 3), np.iinfo(np.int64).max)  # for each group the least distance, and the rows of that pair
        for start in range(0, int(ahead[-1]), step):
            at = np.arange(start, min(start + step, int(ahead[-1])))
            a = np.searchsorted(ahead, at, "right") - 1
            b = a + 1 + at - ahead[a]
            some = (root[a] != root[b]) & _alike(near, n[a], n[b])
            a, b = a[some], b[some]
            if not len(a):
                continue
            apart = bits.apart(bits, a, b)
            fit = _close(near, n[a], n[b], apart)
            a, b, apart = a[fit], b[fit], apart[fit]
            again = _named_before(before, key, a, b)
            a, b, apart = a[~again], b[~again], apart[~again]
            if every and len(a):
                yield paired(node[a], node[b])
            elif len(a):
                live[a] = live[b] = True
                at, apart, a, b = np.concatenate((group[a], group[b])), np.tile(apart, 2), np.tile(a, 2), np.tile(b, 2)
                o = np.lexsort((b, a, apart, at))
                o = o[np.concatenate(([True], at[o][1:] != at[o][:-1]))]
                o = o[apart[o] < best[at[o], 0]]
                best[at[o]] = np.column_stack((apart[o], a[o], b[o]))
        best = best[best[:, 1] < len(key)]
        if len(best):
            chosen = np.unique(np.column_stack((node[best[:, 1]], node[best[:, 2]])), axis=0)
            yield paired(chosen[:, 0], chosen[:, 1])
        live = np.flatnonzero(live) if onward else live[:0]
        for k in range(0, len(live), LIVE_AT_ONCE):
            at = live[k : k + LIVE_AT_ONCE]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * BEFORE, pa.int32()), pa.array(before[at].ravel()))
            bitmaps = pa.array([bits.column[i] for i in at.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), bool)), *(pa.array(x[at]) for x in (key, node, n)), bitmaps, lists], _MET_NAMES)

    return pairs


def resembling(docs: DataFrame, size: int = SIZE, near: tuple[int, int] = NEAR, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, component_id) for every row that has a doc_id: the least doc_id that is reached by links of near texts.

    Two texts are near if the Jaccard coefficient of their sets of shingles is at
    least ``near``; all such pairs are linked, whatever the length of the texts.
    Texts without words are near one another. Rows that share a doc_id count as
    one document. ``first`` makes pairs (u, v) of nodes that are compared before any
    others, from (fp, node): the SimHash of each set and a number that stands for it.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    shared = spark.sparkContext.broadcast(_common(narrow, size))
    prints = materialize(narrow.mapInArrow(_keys_with(shared, size, near), f"doc_id long, {_ROWS}, keys array<long>"), "shingles")
    # equal sets are one node, and its least doc_id stands for it
    facts = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fp").alias("fp")), "shingle-nodes")
    rows = materialize(prints.select("doc_id", "node"), "shingle-rows")
    met = materialize(prints.select(F.explode("keys").alias("key"), "node").repartition("key").mapInArrow(_several, "star boolean, x long, y long"), "shared-shingles")
    discard(prints)
    # a doc_id of several rows joins their nodes
    several = rows.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("doc_id", "low")
    own = rows.join(several, "doc_id").where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    # each node with the least that it meets and may be near to
    stars = met.where("star").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    stars = stars.join(facts.select(F.col("node").alias("a"), "n", F.col("bits").alias("x")), "a").join(facts.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    stars = materialize(stars.select("a", "b", "n", "m", "x", "y").mapInArrow(_fitting(near), "a long, b long").groupBy("b").agg(F.min("a").alias("a")), "stars")
    if first:
        given = first(facts.select("fp", "node")).where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        stars = materialize(stars.select("a", "b").unionByName(given).distinct(), "first-pairs")
    roots = components(own.unionByName(_verified(narrow, facts, stars, size, near)))
    # then what meets under a key and has no link yet
    rooted = lambda d: d.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keyed = rooted(met.where("not star").select(F.col("x").alias("key"), F.col("y").alias("node"))).select("key", "node", "root")
    mixed = keyed.repartition("key").mapInArrow(_mixed, "key long, node long, root long").select("key", "node")
    # with the keys right before each: sets with many keys in common then meet under the first of them, not under all
    earlier = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-BEFORE, -1))
    mixed = materialize(mixed.withColumn("before", earlier).join(facts.select("node", "n", "bits"), "node"), "mixed-shingles")
    discard(met)
    every = False
    while True:
        found = rooted(mixed).select("key", "node", "n", "bits", "before", "root").repartition("key").mapInArrow(_pairs_with(near, every, onward=True), _MET)
        before, found = mixed, materialize(found, "met-shingles")
        discard(before)
        # only rows that are in a pair meet again: most keys in common are those of texts that aren't near
        mixed = found.where("live").select(F.col("x").alias("key"), F.col("y").alias("node"), "n", "bits", "before")
        mixed.scratch_path = found.scratch_path
        pairs = materialize(found.where("not live").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "shingle-pairs")
        links = _verified(narrow, facts, pairs, size, near)
        discard(pairs)
        some = bool(links.limit(1).count())
        if some:
            roots = components(links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        if every:
            break
        every = not some
    discard(mixed)
    rooted = rows.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")

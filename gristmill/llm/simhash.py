"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance.

Fingerprints that differ in at most ``radius`` bits agree on at least two of
``radius + 2`` blocks of bits, so every pair of blocks gives a bucket key, and
linked fingerprints share a bucket. A bucket of over HOT fingerprints is dealt out
once more: of ``radius + 1`` groups of the bits that its blocks leave, linked
fingerprints agree on one. Inside buckets the bits are stored as
vertical planes, 64 fingerprints to a word; distances of one fingerprint to 64
others are counted at once by carry-save bitwise counters, and a word is
abandoned once all its distances exceed the radius. A bucket leaves a star of
links, never all its pairs; the stars are joined into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks
from .graph import components
from .shingles import majority, resembling, shingle_hashes

#: Fingerprints of a bucket from which on it is dealt out by further bits.
HOT = 20_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        each = [shingle_hashes(t) for t in batch.column("text").to_pylist()]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((h for x in each for h in x), np.uint64, int(counts.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(majority(flat, counts).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint, as a signed long, of every row's whole text; null and blank texts have zero."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def block_masks(radius: int) -> list[int]:
    """Masks of two blocks each, of ``radius + 2`` blocks: fingerprints within the radius agree under one of them."""
    edges = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [x | y for x, y in combinations(blocks, 2)]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i]; ``parent`` points at the least member afterwards."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int, step: int = 1 << 16) -> np.ndarray:
    """For rows sorted by ``key``: the least row that each is linked to, directly or not, within its bucket."""
    n = len(fp)
    parent = np.arange(n)
    if n < 2:
        return parent
    words = -(-n // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = fp
    planes = np.empty((64, words), np.uint64)
    for bit in range(64):
        planes[bit] = np.packbits(((padded >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    bucket = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], n)[bucket]  # the end of each row's bucket
    rows = np.arange(n)
    first, last = (rows + 1) // 64, (ends - 1) // 64
    tries = np.where(rows + 1 < ends, last - first + 1, 0)
    levels = int(radius).bit_length()
    beyond = np.cumsum(tries)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(beyond, (beyond[at - 1] if at else 0) + step, "right")))
        row = np.repeat(rows[at:to], tries[at:to])
        word = first[row] + np.arange(len(row)) - np.repeat(beyond[at:to] - tries[at:to] - (beyond[at - 1] if at else 0), tries[at:to])
        at = to
        if not len(row):
            continue
        low = np.maximum(row + 1 - word * 64, 0)
        high = np.minimum(ends[row] - word * 64, 64)
        live = (_ALL << low.astype(np.uint64)) & (_ALL >> (64 - high).astype(np.uint64))
        mine = fp[row]
        counter = [np.zeros(len(row), np.uint64) for _ in range(levels)]
        for bit in range(64):
            carry = planes[bit][word] ^ (np.uint64(0) - ((mine >> np.uint64(bit)) & np.uint64(1)))
            for k in range(levels):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            live &= ~carry  # the counters ran over
            if bit % 8 == 7:
                if radius + 1 < 1 << levels:  # counts from radius + 1 up to what the counters hold are beyond, too
                    live &= ~_exceeds(counter, radius)
                keep = live != 0
                if not keep.all():
                    row, word, live, mine = row[keep], word[keep], live[keep], mine[keep]
                    counter = [c[keep] for c in counter]
                if not len(row):
                    break
        if len(row):
            hits = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            t, lane = np.nonzero(hits)
            _unite(parent, row[t], word[t] * 64 + lane)
    return parent


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    over, same = np.zeros_like(counter[0]), np.full_like(counter[0], _ALL)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same &= counter[k]
        else:
            over |= same & counter[k]
            same &= ~counter[k]
    return over


def _link_partition(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t, k, fp, node = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]) for c in ("t", "k", "fp", "node"))
        order = np.lexsort((node, k, t))
        t, k, fp, node = t[order], k[order], fp[order], node[order]
        changed = np.concatenate(([True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
        parent = bucket_links(np.cumsum(changed), fp.view(np.uint64), radius)
        u = np.flatnonzero(parent != np.arange(len(parent)))
        yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[parent[u]])], ["u", "v"])

    return link


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer_masks(mask: int, radius: int) -> list[int]:
    """The bits outside ``mask`` in ``radius + 1`` groups: fingerprints that agree under the mask and are within the radius agree on one group."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in rest[i :: radius + 1]) for i in range(radius + 1)]


def links(prints: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """Links (u, v) that connect all fingerprints within the radius. ``prints``: (fp, node), a row for each fingerprint."""
    masks = block_masks(radius)
    key = lambda m: F.col("fp").bitwiseAND(F.lit(_signed(m)))
    keyed = prints.select("fp", "node", F.inline(F.array(*[F.struct(F.lit(i).alias("t"), key(m).alias("k")) for i, m in enumerate(masks)])))
    # counted map-side; few keys, if any, come of it
    large = materialize(keyed.groupBy("t", "k").count().where(F.col("count") > hot).select("t", "k"), "large-buckets")
    if large.limit(1).count():
        finer = F.lit(None)
        for i, m in enumerate(masks):
            groups = [F.struct(F.lit(len(masks) * (g + 1) + i).alias("t"), F.xxhash64("k", key(part)).alias("k")) for g, part in enumerate(finer_masks(m, radius))]
            finer = F.when(F.col("t") == i, F.array(*groups)).otherwise(finer)
        dealt = keyed.join(large, ["t", "k"], "left_semi").select("fp", "node", F.inline(finer))
        keyed = keyed.join(large, ["t", "k"], "left_anti").select("fp", "node", "t", "k").unionByName(dealt)
    return keyed.repartition("t", "k").mapInArrow(_link_partition(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the least doc_id of all that its links reach.

    Equal fingerprints are one node, so copies never meet as pairs. A row without
    doc_id gets the component of its fingerprint, or null if no row has an id.
    Rows that share a doc_id count as one document. An empty table gives none.
    """
    prints = materialize(fingerprints(docs), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    roots = components(links(nodes.where("node is not null"), radius).distinct())
    # a doc_id of several rows joins their fingerprints
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    if several.limit(1).count():
        own = prints.join(several.select("doc_id"), "doc_id", "left_semi").join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(own))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def set_links(sets: DataFrame, radius: int = 3) -> DataFrame:
    """Links (u, v) that connect all nodes whose fingerprints are within the radius. ``sets``: (fp, node), any number of nodes of a fingerprint."""
    named = materialize(sets.groupBy("fp").agg(F.min("node").alias("least")), "set-prints")
    equal = sets.join(named, "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return links(named.select("fp", F.col("least").alias("node")), radius).unionByName(equal)


def one_of_each(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, all their columns, without near copies: of each component of near texts the row of its least doc_id.

    Near are texts whose sets of 5-word shingles have a Jaccard coefficient of 0.8
    or more. The SimHash of each set is linked within the radius, as by
    ``near_duplicates``, and the texts so linked are compared by their sets first.
    Fingerprints of near texts often differ in more bits, so ``shingles.resembling``
    adds what its join of the sets finds. Of rows that share a doc_id one stays.
    Rows without doc_id all stay, as none of them can be told from another.
    """
    found = resembling(docs, first=lambda sets: set_links(sets, radius))
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    several = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    if not several.limit(1).count():
        return kept
    return kept.join(several, "doc_id", "left_anti").unionByName(kept.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)

"""Exact removal of long repeated substrings, by bucket-pointer refinement of sampled suffixes.

Every string of ``length`` bytes holds one anchor: of its ``gram``-byte substrings
the one of least hash, the leftmost of equals. Equal strings have their anchor at
the same place, so only suffixes at anchors (about one in 37 bytes) are sorted.

1. Anchors. Each task finds its documents' anchors and their contexts: the bytes
   that any string around the anchor can reach. A context seen before is repeated
   whole, so within a task only its first occurrence goes on; the others become
   spans at once. This also bounds the copies of a context by the number of tasks.
2. Buckets. Anchors meet by the hash of their gram, the initial bucket. Repeated
   contexts become spans; first occurrences are candidates if their bucket holds
   other contexts, too. A bucket that is large within one task is dealt out by
   context, all its anchors being candidates.
3. Refinement. Candidates get their bytes from the texts, once to the right of the
   anchors and once to the left. Each suffix is pointed at the bucket of its first
   q bytes; a bucket is sorted by its suffixes' pointers q bytes on, which have been
   refined before and so tell all the bytes from there on, and its parts are pointed at
   at once, for the sort of the buckets q bytes before (``refine``). The common prefixes of
   neighbours then give the class of each stretch, and the pair of a left and a right
   class that of each string: all of a class but its first become spans. Buckets of over
   HOT candidates are resolved by their strings' digests instead, with first occurrences
   aggregated map-side.
4. Spans are joined with the texts.

Step 3 compares bytes. Whole contexts, and strings of buckets beyond HOT, are equal
if their 128-bit BLAKE2b digests are. A gram's hash only says which rows meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks

LENGTH, GRAM = 100, 32
#: Candidates of a bucket from which on strings are compared by digest, and contexts of one bucket in one task from which on it is dealt out.
HOT, LOCALLY_HOT = 50_000, 256
#: Anchors that a task holds before it sends on what it has, and candidates that it refines at a time.
HELD, REFINED = 200_000, 30_000
#: Bytes of text whose anchors are sought at once: their arrays fit the caches of a core. Longer texts go in overlapping pieces.
AT_ONCE = 1 << 17
#: Bytes of the initial buckets in step 3.
Q = 8
_NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(23).integers(1, 1 << 63, 256).astype(np.uint64)
_U = np.uint64
_power_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64; the longest so far is kept."""
    if len(_power_cache.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _power_cache[base] = np.multiply.accumulate(out)
    return _power_cache[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, gram hashes, running hash) of the anchors of all ``length``-byte strings of texts laid end to end.

    A place is an anchor if its hash is the least of some string's. Of equal least
    hashes all are anchors, and strings that reach over a border add a few; both only
    add to the work.
    """
    n, span = len(data), length - gram + 1
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=running[1:])
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), running
    h = running[gram:] - running[:-gram]
    h *= _powers(_INVERSE, n - gram + 1)
    h = _mixed(h)
    m = len(h)
    over = (ends[:-1, None] - np.arange(1, gram)).ravel()  # grams over a border
    h[over[(over >= 0) & (over < m)]] = _U(0xFFFFFFFFFFFFFFFF)
    least = _sliding(h, span, np.minimum)
    # the greatest of the least hashes of the strings that hold a place
    padded = np.zeros(m + span - 1, np.uint64)
    padded[span - 1 : m] = least
    places = np.flatnonzero(h == _sliding(padded, span, np.maximum))
    found = h[places]
    inside = found != _U(0xFFFFFFFFFFFFFFFF)
    return places[inside], found[inside], running


def _sliding(x: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``span`` consecutive values."""
    m = len(x)
    tail = -m % span
    blocks = (np.concatenate((x, np.repeat(x[-1:], tail))) if tail else x).reshape(-1, span)
    ahead = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = best.accumulate(blocks, axis=1).ravel()
    return best(ahead[: m - span + 1], behind[span - 1 : m])


#: Of an anchor, ``a`` is its place, and ``context`` and ``b`` are its context's digest.
_ROW = "kind int, bucket long, context long, doc long, key long, a long, b long"
_NAMES = ["kind", "bucket", "context", "doc", "key", "a", "b"]
SPAN, ANCHOR, MARK, DEALT = 0, 1, 2, 3


def _batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [np.full(len(columns[0]), kind, np.int32), *columns]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in arrays], _NAMES)


def _spans(doc: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """Span rows, those of a document merged where they touch; dealt out by document."""
    if not len(key):
        return None
    order = np.lexsort((a, key))
    key, a, b = key[order], a[order], b[order]
    rank = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
    wide = rank * (1 << 44)  # documents one after the other on one line
    reach = np.maximum.accumulate(b + wide)
    new = np.concatenate(([True], (a + wide)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return _batch(SPAN, _mixed(key[first].astype(np.uint64)), np.zeros(len(first), np.int64), key[first], key[first], a[first], np.maximum.reduceat(b, first))


def _sorted(columns: list[np.ndarray], keys: tuple[int, ...]) -> list[np.ndarray]:
    """All columns, ordered by those of the given numbers, the first of them first. Takes the columns over."""
    order = np.lexsort([columns[k] for k in reversed(keys)])
    for i in range(len(columns)):
        columns[i] = columns[i][order]
    return columns


_digest = partial(hashlib.blake2b, digest_size=16)


def _digests(data: bytes, starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the given stretches, as two numbers each."""
    found = np.frombuffer(b"".join([_digest(data[a:b]).digest() for a, b in zip(starts, ends, strict=True)]), np.uint64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def _find(length: int, gram: int, locally_hot: int, held: int):
    left, right = length - gram, length  # how far a context reaches from its anchor
    margin = 2 * length  # anchors depend on no bytes further off

    def flush(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket, c, d, doc, key, at, lo, hi = _sorted(columns, (0, 1, 2, 3, 5))
        new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[head]) | (at != at[head])
        found = _spans(doc[later], key[later], lo[later], hi[later])
        if found:
            yield found
        bucket, c, d, doc, key, at = (x[~later] for x in (bucket, c, d, doc, key, at))
        head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        size = np.diff(np.append(head, len(bucket)))
        hot = np.repeat(size > locally_hot, size)
        if hot.any():
            marks = bucket[head[size > locally_hot]]
            nothing = np.zeros(len(marks), np.int64)
            yield _batch(MARK, marks, nothing, nothing, nothing, nothing, nothing)
            yield _batch(DEALT, *(x[hot] for x in (bucket, c, doc, key, at, d)))
        yield _batch(ANCHOR, *(x[~hot] for x in (bucket, c, doc, key, at, d)))

    def find(doc: np.ndarray, key: np.ndarray, texts: list[bytes], base: int = 0, core: tuple[int, int] | None = None) -> list[np.ndarray]:
        """Columns of the anchors. One text may be a piece that begins at ``base`` of the whole, with anchors wanted from ``core`` only."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        joined = b"".join(texts)
        at, h, _ = anchors(np.frombuffer(joined, np.uint8), ends, length, gram)
        i = np.searchsorted(ends, at, "right")
        wanted = sizes[i] >= length
        if core:
            wanted &= (at >= core[0]) & (at < core[1])
        at, h, i = at[wanted], h[wanted], i[wanted]
        lo, hi = np.maximum(at - left, starts[i]), np.minimum(at + right, ends[i])
        c, d = _digests(joined, lo.tolist(), hi.tolist())
        c += (at - lo).astype(np.uint64) * _U(0xD6E8FEB86659FD93) + (hi - at).astype(np.uint64) * _U(0x94D049BB133111EB)
        shift = base - starts[i]
        return [h, c, d, doc[i], key[i], at + shift, lo + shift, hi + shift]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in text_chunks(batches, most=AT_ONCE):
            doc, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            if len(texts) > 1 or len(texts[0]) <= AT_ONCE:
                yield find(doc, key, texts)
                continue
            for p in range(0, len(texts[0]), AT_ONCE):
                base = max(0, p - margin)
                yield find(doc, key, [texts[0][base : p + AT_ONCE + margin]], base, (p - base, p - base + AT_ONCE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        size = 0

        def together() -> list[np.ndarray]:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            parts.clear()
            return columns

        for part in pieces(batches):
            parts.append(part)
            size += len(part[0])
            if size >= held:
                yield from flush(together())
                size = 0
        if size:
            yield from flush(together())

    return run


def _meet(length: int, gram: int):
    """Step 2, over rows of whole buckets: spans, and candidates as rows of kind ANCHOR. Context ends are unknown here, so a span's are clipped later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = []
        for batch in batches:
            kind, *columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in _NAMES)
            ready = kind == SPAN
            if ready.any():
                yield _batch(SPAN, *(c[ready] for c in columns))
            if not ready.all():
                rows.append([c[~ready] for c in (kind.astype(np.int8), *columns)])
        if not rows:
            return
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
        rows.clear()
        kind, bucket, c, doc, key, at, d = _sorted(columns, (1, 2, 6, 3, 5))
        marked = np.isin(bucket, bucket[kind == MARK])
        true = kind != MARK
        kind, bucket, c, doc, key, at, d, marked = (x[true] for x in (kind, bucket, c, doc, key, at, d, marked))
        if not len(bucket):
            return
        new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[head]) | (at != at[head])
        found = _spans(doc[later], key[later], at[later] - (length - gram), at[later] + length)
        if found:
            yield found
        kind, bucket, doc, key, at, marked = (x[~later] for x in (kind, bucket, doc, key, at, marked))
        # of each context one place is left, or the same place of rows that share a doc_id
        other = np.cumsum(new)[~later]
        head = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        group = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(bucket)) - 1
        chosen = (other[last] > other[first])[group] | marked | (kind == DEALT)
        bucket, doc, key, at = (x[chosen] for x in (bucket, doc, key, at))
        nothing = np.zeros(len(bucket), np.int64)
        yield _batch(ANCHOR, bucket, nothing, doc, key, at, nothing)

    return run


_CONTEXT = "bucket long, doc long, key long, at long, before binary, after binary"


def _contexts(length: int, gram: int, hot: bool):
    """Candidates with the bytes before (nearest first) and from their anchor on; of hot buckets the digests of their strings."""
    left = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for key, text, found in zip(*(batch.column(c) for c in ("key", "text", "found")), strict=True):
                key, data = key.as_py(), text.as_py().encode()
                for f in found.as_py():
                    at = f["at"]
                    if hot:
                        out += [(f["doc"], key, s, _digest(data[s : s + length]).digest()) for s in range(max(0, at - left), min(at, len(data) - length) + 1)]
                    else:
                        out.append((f["bucket"], f["doc"], key, at, data[max(0, at - left) : at][::-1], data[at : at + length]))
                if len(out) > 20_000:
                    yield _rows(out, hot)
                    out = []
        if out:
            yield _rows(out, hot)

    return run


_STRING = "doc long, key long, start long, string binary"


def _rows(out: list[tuple], hot: bool) -> pa.RecordBatch:
    types = (pa.int64(),) * 3 + (pa.binary(),) if hot else (pa.int64(),) * 4 + (pa.binary(),) * 2
    names = ["doc", "key", "start", "string"] if hot else ["bucket", "doc", "key", "at", "before", "after"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _words(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of ``width`` bytes, filled with zeros, and their lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros((len(column), width), np.uint8)
    row = np.repeat(np.arange(len(column)), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, within] = flat[np.repeat(offsets[:-1], sizes) + within]
    return out, sizes


def refine(bucket: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, common, reused): rows sorted by bucket, then bytes; how many bytes each has in common with the one before it in its bucket, -1 for a bucket's first;
    and how many suffixes got their place by pointers that had been refined before.

    ``data`` holds the rows' bytes, a multiple of Q, filled with zeros. The suffixes at every Q-th
    offset of every row first point at the bucket of their first Q bytes, among all of
    them. From the last offset to the first, the buckets of several suffixes are then sorted by
    the pointers of the suffixes Q bytes on. These have their final bucket, that of all
    bytes from there to the row's end, so one sort settles a bucket, and its parts get pointers of
    their own, by which the offset before is sorted next. At the first offset the rows of
    different ``bucket`` are apart from the start, and those alone in one are in place.
    """
    n = len(bucket)
    words = data.view(">u8").astype(np.uint64)
    pointer = np.unique(words, return_inverse=True)[1].reshape(words.shape)
    reused = 0
    for k in range(words.shape[1] - 1, -1, -1):
        now = pointer[:, k]
        if k == 0:
            now = np.unique(np.column_stack((np.unique(bucket, return_inverse=True)[1], now)), axis=0, return_inverse=True)[1].reshape(-1)
        size = np.bincount(now)
        place = (np.cumsum(size) - size)[now]  # the first place of each suffix's bucket, in order
        if k + 1 < words.shape[1]:
            later = pointer[:, k + 1]
            several = np.flatnonzero(size[now] > 1)
            o = several[np.lexsort((later[several], place[several]))]
            if len(o):
                b, w = place[o], later[o]
                begins = np.concatenate(([True], b[1:] != b[:-1]))
                changed = begins | np.concatenate(([True], w[1:] != w[:-1]))
                at = b + np.arange(len(o)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
                place[o] = at[np.flatnonzero(changed)][np.cumsum(changed) - 1]
                same_word = np.concatenate(([False], words[o[1:], k + 1] == words[o[:-1], k + 1]))
                reused += int(np.count_nonzero(changed & ~begins & same_word))
        pointer[:, k] = place
    order = np.lexsort((sizes, pointer[:, 0]))
    common = np.full(n, -1, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        together = bucket[a] == bucket[b]
        same = data[a] == data[b]
        equal = np.where(same.all(axis=1), data.shape[1], same.argmin(axis=1))
        common[1:] = np.where(together, np.minimum(equal, np.minimum(sizes[a], sizes[b])), -1)
    return order, common, reused


def _resolve(length: int, gram: int, at_once: int):
    left = length - gram

    def resolve(rows: pa.Table) -> pa.RecordBatch | None:
        bucket, doc, key, at = (rows.column(c).to_numpy() for c in ("bucket", "doc", "key", "at"))
        n = len(bucket)
        sides = []
        # the furthest that each row agrees with any other of its bucket, to the left and to the right
        for side, width in (("before", left), ("after", length)):
            order, common, _ = refine(bucket, *_words(rows.column(side).combine_chunks(), -(-width // Q) * Q))
            most = np.zeros(n, np.int64)
            most[order] = np.maximum(common, np.append(common[1:], -1))
            sides.append((order, common, most))
        (by_left, common_left, most_left), (by_right, common_right, most_right) = sides
        shortest, longest = np.full(n, left + 1), np.full(n, -1)
        rank = np.empty(n, np.int64)
        order = np.lexsort((at, doc))
        d, p = doc[order], at[order]
        rank[order] = np.cumsum(np.concatenate(([False], (d[1:] != d[:-1]) | (p[1:] != p[:-1]))))
        for o in range(left + 1):
            live = (most_left >= o) & (most_right >= length - o)
            if not live.any():
                continue
            # classes of the o bytes before and the rest from the anchor on: runs of neighbours with so much in common
            cl, cr = np.empty(n, np.int64), np.empty(n, np.int64)
            cl[by_left] = np.cumsum(common_left < o)
            cr[by_right] = np.cumsum(common_right < length - o)
            i = np.flatnonzero(live)
            i = i[np.lexsort((rank[i], cr[i], cl[i]))]
            new = np.concatenate(([True], (cl[i][1:] != cl[i][:-1]) | (cr[i][1:] != cr[i][:-1])))
            head = i[np.flatnonzero(new)[np.cumsum(new) - 1]]
            later = i[rank[i] != rank[head]]
            shortest[later] = np.minimum(shortest[later], o)
            longest[later] = np.maximum(longest[later], o)
        hit = longest >= 0  # all its strings hold the anchor, so they make one span
        return _spans(doc[hit], key[hit], at[hit] - longest[hit], at[hit] - shortest[hit] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        parts.clear()
        bucket = rows.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        start = 0
        while start < len(bucket):  # whole buckets, about ``at_once`` rows of them
            end = int(ends[min(np.searchsorted(ends, start + at_once), len(ends) - 1)])
            found = resolve(rows.take(pa.array(order[start:end])))
            if found:
                yield found
            start = end

    return run


def _keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(doc_id, text, carried, key): whole texts; ``key`` is the doc_id, or a hash of the row where ids repeat."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    unique = not rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    doc = F.coalesce(F.col("doc_id"), F.lit(_NO_ID))
    return rows.withColumn("key", doc if unique else F.xxhash64(doc, "text"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, locally_hot: int = LOCALLY_HOT, held: int = HELD, refined: int = REFINED) -> DataFrame:
    """(key, a, b): spans of bytes, which may overlap or reach over a text's ends, whose union is all bytes to remove."""
    with_order = keyed.select("key", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "text")
    rows = with_order.mapInArrow(_find(length, gram, locally_hot, held), _ROW)
    deal = F.when(F.col("kind") == DEALT, F.xxhash64("bucket", "context")).otherwise(F.col("bucket"))
    met = materialize(rows.withColumn("deal", deal).repartition("deal").select(_NAMES).mapInArrow(_meet(length, gram), _ROW), "suffixes")
    found = met.where(F.col("kind") == SPAN).select("key", "a", "b")
    candidates = met.where(F.col("kind") == ANCHOR).select("bucket", "doc", "key", F.col("a").alias("at"))
    # a table, so that its size is known: of one bucket in so many candidates at most, it is broadcast where it is small
    large = materialize(candidates.groupBy("bucket").count().where(F.col("count") > hot).select("bucket"), "large-buckets")
    some_hot = bool(large.limit(1).count())
    plain = candidates.join(large, "bucket", "left_anti") if some_hot else candidates
    spans = _with_texts(keyed, plain).mapInArrow(_contexts(length, gram, False), _CONTEXT).repartition("bucket").mapInArrow(_resolve(length, gram, refined), _ROW)
    found = found.unionByName(spans.select("key", "a", "b"))
    if some_hot:
        # strings by digest: the first of each is aggregated before any shuffle, and the join back is one that Spark can split
        strings = _with_texts(keyed, candidates.join(large, "bucket", "left_semi")).mapInArrow(_contexts(length, gram, True), _STRING)
        strings = materialize(strings, "strings")
        first = strings.groupBy("string").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = strings.join(first, "string").where(F.struct("doc", "start") != F.col("first"))
        # a table of its own: together with the dealt out buckets Spark could not split this join
        found = found.unionByName(materialize(again.select("key", F.col("start").alias("a"), (F.col("start") + length).alias("b")), "string-spans"))
    return found


def _with_texts(keyed: DataFrame, candidates: DataFrame) -> DataFrame:
    listed = candidates.groupBy("key").agg(F.collect_list(F.struct("bucket", "doc", "at")).alias("found"))
    # the columns that the last join takes, too, so that Spark deals out the texts once for both
    return keyed.join(listed, "key").select("key", "doc_id", "text", "carried", "found")


def merged(spans: list, n: int) -> list[list[int]]:
    """Spans cut to 0..n, sorted, and joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted((max(s["a"], 0), min(s["b"], n)) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, parts, last = text.encode(), [], 0
            gone = merged(spans, len(data))
            for a, b in gone:
                parts.append(data[last:a])
                last = b
            parts.append(data[last:])
            rest = b"".join(parts)
            n_bytes.append(len(data))
            n_removed.append(len(data) - len(rest))
            n_spans.append(len(gone))
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("carried"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], ["doc_id", "carried", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: list[str] | None = None, **limits: int) -> DataFrame:
    """(doc_id, carried, n_bytes, n_removed, n_spans, kept, kept_sha256) for every row: what stays of its text's UTF-8 bytes.

    ``carried`` holds the columns of ``docs`` named in ``carry``.

    A byte goes if a string of ``length`` bytes that covers it starts earlier, too, in
    a smaller doc_id or earlier in the same one. Null texts are empty, a null doc_id is
    before all others, and rows that share a doc_id are one document: a string
    at the same place of both isn't earlier in either. ``kept`` may begin or end
    within a character. An empty table gives no rows.
    """
    keyed = _keyed(docs, carry or [])
    spans = repeated_spans(keyed, length, gram, **limits).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    rows = keyed.join(spans, "key", "left").select("key", "doc_id", "text", "carried", "spans")
    carried = keyed.schema["carried"].dataType.simpleString()
    return rows.mapInArrow(_cut, f"doc_id long, carried {carried}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")

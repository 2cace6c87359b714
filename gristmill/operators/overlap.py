"""Overlap between texts: evaluation prompts inside documents, and near-identical wording."""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scratch
from . import tokens
from .documents import DataQualityError

FULL, FIELD, SUBSTRING = "full-document", "field-exact", "normalized-substring"
THRESHOLD = 0.82
#: Characters of prompts that are searched for at once; more are taken in blocks.
BLOCK_CHARS = 1_000_000
#: Rows of a batch that a task searches at once.
SEARCHED = 256
#: Bits of a token set's bitmap; rows that offer a token in one part, about; tokens counted to be ranked; rows under tokens in a task, about.
BITS, DEALT, RANKED, ENTRIES = 512, 20_000, 200_000, 400_000


_automata: dict[str, object] = {}


def _search(shared, token: str):
    def automaton():
        """Built once a worker for each block; a worker keeps the last one."""
        import ahocorasick

        if token not in _automata:
            made = ahocorasick.Automaton()
            for text, ids in shared.value.items():
                made.add_word(text, (text, ids))
            made.make_automaton()
            _automata.clear()
            _automata[token] = made
        return _automata[token]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, SEARCHED):
                batch = whole_batch.slice(start, SEARCHED)
                rows, prompt, whole = [], [], []
                for i, text in enumerate(batch.column("_part").to_pylist()):
                    for found, ids in {v[0]: v[1] for _, v in automaton().iter(text or "")}.items() if shared.value else ():
                        rows += [i] * len(ids)
                        prompt += ids
                        whole += [len(found) == len(text)] * len(ids)
                out = batch.take(pa.array(rows, pa.int64())).drop_columns(["_part"])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(prompt, pa.string()), pa.array(whole, pa.bool_())], [*out.schema.names, "prompt_id", "_whole"])

    return run


def repeated_prompts(prompts: DataFrame) -> DataFrame:
    """(prompt_id, rows) of prompt ids that occur more than once."""
    return prompts.groupBy("prompt_id").agg(F.count("*").alias("rows")).where("rows > 1")


def contamination(docs: DataFrame, prompts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(prompt_id, suite, document_id, source, match_type, document_fingerprint) of prompts that occur in documents.

    ``docs`` are identified documents, with further text columns ``fields``;
    ``prompts`` has prompt_id, suite, text. Texts are compared in canonical form,
    with case. If ``docs`` has the map ``fields``, its values are searched, too. Of a
    document's texts the strongest match counts, and of rows that
    share an id and source the one of greatest raw fingerprint. All prompts
    are searched for in one pass over a text; blank ones are left out, as they
    would match everything. A repeated prompt_id is an error.
    """
    if found := [r.prompt_id for r in repeated_prompts(prompts).orderBy("prompt_id").limit(5).collect()]:
        raise DataQualityError(f"repeated prompt ids: {', '.join(map(str, found))}")
    fields = fields or []
    listed = prompts.select("prompt_id", "suite", T.normalize(F.col("text")).alias("text")).where("text <> ''")
    parts = F.array(F.struct(F.lit(False).alias("field"), F.col("canonical_text").alias("text")), *[F.struct(F.lit(True).alias("field"), T.normalize(F.col(c)).alias("text")) for c in fields])
    identity = ["document_id", "source", "raw_fingerprint", "canonical_fingerprint"]
    if "fields" in docs.columns:
        # each value is a row of its own before it is normalized, as that may need Python
        values = docs.select(*identity, F.explode(F.map_values("fields")).alias("v")).select(*identity, F.lit(True).alias("_field"), T.normalize(F.col("v")).alias("_part"))
    narrow = docs.select(*identity, F.explode(parts).alias("p")).select("document_id", "source", "raw_fingerprint", "canonical_fingerprint", F.col("p.field").alias("_field"), F.col("p.text").alias("_part"))
    if "fields" in docs.columns:
        narrow = narrow.unionByName(values)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_part") + ", prompt_id string, _whole boolean"
    found = None
    blocks = _blocks(listed)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        narrow = scratch.kept(narrow, "searched-texts")  # texts are brought into canonical form once, however many blocks there are
    for block in chain([first], [second] if second is not None else [], blocks):
        part = narrow.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex), schema)
        found = part if found is None else found.unionByName(part)
    kind = F.when(F.col("_whole") & ~F.col("_field"), 0).when(F.col("_whole"), 1).otherwise(2)
    best = found.groupBy("prompt_id", "document_id", "source", "raw_fingerprint", "canonical_fingerprint").agg(F.min(kind).alias("kind"))
    best = best.groupBy("prompt_id", "document_id", "source").agg(F.max(F.struct("raw_fingerprint", "canonical_fingerprint", "kind")).alias("b"))
    named = F.element_at(F.array(F.lit(FULL), F.lit(FIELD), F.lit(SUBSTRING)), F.col("b.kind") + 1)
    return best.join(listed.select("prompt_id", "suite"), "prompt_id").select("prompt_id", "suite", "document_id", "source", named.alias("match_type"), F.substring("b.canonical_fingerprint", 1, 12).alias("document_fingerprint"))


def in_order(findings: DataFrame) -> DataFrame:
    """Findings with ``ordinal``, their place by prompt, source, document and fingerprint, from 0: counted range by range, not sorted in one task."""
    null = lambda c: F.coalesce(F.col(c), F.lit(""))
    keyed = findings.withColumn("_key", F.concat_ws("\u0001", *map(null, ("prompt_id", "source", "document_id", "document_fingerprint", "match_type")))).withColumn("_one", F.lit(1).cast("long"))
    return tokens.offsets(keyed, "_key", "_one").withColumnRenamed("offset", "ordinal").drop("_key", "_one")


def _blocks(prompts: DataFrame) -> Iterator[dict[str, list[str]]]:
    block: dict[str, list[str]] = {}
    size = 0
    for r in prompts.select("prompt_id", "text").toLocalIterator():
        if size and size + len(r.text) > BLOCK_CHARS:
            yield block
            block, size = {}, 0
        block.setdefault(r.text, []).append(r.prompt_id)
        size += len(r.text)
    yield block


def _cover(shared, token: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if token not in _automata:
            made = ahocorasick.Automaton()
            for text, ids in shared.value.items():
                made.add_word(text, ids)
            made.make_automaton()
            listed = list(shared.value.items())
            begins, joined = [], []
            for text, _ in listed:
                begins.append(sum(map(len, joined[-1:])) + (begins[-1] if begins else 0))
                joined.append(text + "\0")
            _automata.clear()
            _automata[token] = made, listed, begins, "".join(joined), max(map(len, shared.value), default=0)
        made, listed, begins, joined, longest = _automata[token]
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, SEARCHED):
                found, digests = [], []
                for text in whole_batch.column("text").slice(start, SEARCHED).to_pylist():
                    if not text or not listed:
                        continue
                    hit = {i for _, ids in made.iter(text) for i in ids}
                    at = joined.find(text) if len(text) <= longest else -1
                    while at >= 0:
                        k = bisect_right(begins, at) - 1
                        hit.update(listed[k][1])
                        at = joined.find(text, begins[k] + len(listed[k][0]))
                    if hit:
                        found += hit
                        digests += [hashlib.sha256(text.encode()).digest()] * len(hit)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(digests, pa.binary())], ["prompt_id", "digest"])

    return run


def covered(texts: DataFrame, prompts: DataFrame) -> DataFrame:
    """(prompt_id, turns): how many different texts hold each prompt or lie in it, both in canonical form and lower case. Blank ones count nowhere; prompts without any are left out.

    Texts are searched where they are read, each one once, and only the digests of those with a prompt are shuffled; equal texts have equal ones.
    """
    spark = texts.sparkSession
    form = F.lower(T.normalize(F.col("text")))
    each = texts.select(form.alias("text"))  # blank ones are passed over by the search: a filter here would bring all texts into canonical form again
    found = None
    blocks = _blocks(prompts.select("prompt_id", form.alias("text")).where("text <> ''"))
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        each = scratch.kept(each, "searched-texts")
    for block in chain([first], [second] if second is not None else [], blocks):
        part = each.mapInArrow(_cover(spark.sparkContext.broadcast(block), uuid.uuid4().hex), "prompt_id string, digest binary")
        found = part if found is None else found.unionByName(part)
    return found.distinct().groupBy("prompt_id").agg(F.count("*").alias("turns"))


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two token arrays, 0 to 1: the greatest of the Dice coefficients of sets and of bags, and of containment. ``a`` is the shorter of equally long ones.

    The longest matching blocks of two sequences never hold more than their bags
    share, so no sequence matcher is needed.
    """
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    return scores(F.size(a), F.size(b), F.size(sa), F.size(sb), F.size(F.array_intersect(sa, sb)), F.size(F.array_intersect(_numbered(a), _numbered(b))), _inside(F.array_join(a, " "), F.array_join(b, " "), F.size(a), F.size(b)), a == b)


def _numbered(a: Column) -> Column:
    """Tokens with the number of their occurrence, for short arrays."""
    return F.transform(a, lambda x, i: F.concat(x, F.lit(" "), F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def _inside(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Whether the shorter of two joined token sequences is a stretch of the longer."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.when(na <= nb, F.contains(pad(b), pad(a))).otherwise(F.contains(pad(a), pad(b)))


def scores(na: Column, nb: Column, da: Column, db: Column, shared_set: Column, shared_bag: Column, inside: Column, equal: Column) -> Column:
    short, long, few = F.least(na, nb), F.greatest(na, nb), F.when(na <= nb, da).otherwise(db)
    contained = F.when(short < 2, 0.0).when(inside, 1.0).when(shared_set / few >= 0.9, F.least(F.lit(1.0), short / long + 0.35)).otherwise(0.0)
    best = F.greatest(2.0 * shared_set / (da + db), 2.0 * shared_bag / (na + nb), contained)
    return F.when((na == 0) | (nb == 0), 0.0).when(equal, 1.0).otherwise(F.bround(best, 6))


def sequence_classes(items: DataFrame) -> DataFrame:
    """(rep, tokens, joined) of each token sequence of items (item_id, text), with its least item_id. Null texts and those without a token are in no class."""
    tokens = items.select("item_id", T.overlap_tokens(F.col("text")).alias("tokens")).withColumn("joined", F.array_join("tokens", " "))
    # the filter comes after the grouping and isn't on its key: before it, all texts would be cut into tokens for it and once more
    return tokens.groupBy("joined").agg(F.min("item_id").alias("rep"), F.first("tokens").alias("tokens")).where(F.size("tokens") > 0).select("rep", "tokens", "joined")


def sequence_members(items: DataFrame) -> DataFrame:
    """(item_id, rep): all items that are in a class of ``sequence_classes``. Texts are cut into tokens in one pass, and only digests of the sequences are shuffled."""
    joined = F.array_join(T.overlap_tokens(F.col("text")), " ")
    digests = scratch.kept(items.select("item_id", F.unhex(F.sha2(F.nullif(joined, F.lit("")), 256)).alias("sequence")), "sequences").where("sequence is not null")
    return digests.join(digests.groupBy("sequence").agg(F.min("item_id").alias("rep")), "sequence").select("item_id", "rep")


def token_classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): ``sequence_classes`` and ``sequence_members`` of items."""
    return sequence_classes(items), sequence_members(items)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's tokens' hashes as its bag's elements, those of first occurrences first and ``m`` of them; later ones get hashes of their own."""
    for batch in batches:
        lists = batch.column("hashes")
        sizes = pa.compute.list_value_length(lists).to_numpy()
        row, h = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().view(np.uint64)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))[: len(h)]
        k = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
        e = (h ^ (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[np.lexsort((h, k > 0, row))]
        made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(e.view(np.int64)))
        m = pa.array(np.bincount(row[new], minlength=len(sizes)), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "side", "rep", "joined")), made, m], ["node", "side", "rep", "joined", "elements", "m"])


def _least(share: float, n: np.ndarray) -> np.ndarray:
    return np.ceil(share * n - 1e-9)


def _entries(shared, t: float):
    """Rows under each token that may tell a pair: its rarest as a bag and as a set, which ask and offer, and for containment the few that ask and all that offer.

    A token of many offers is dealt out in parts; who asks goes to all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                lists, m = batch.column("elements"), batch.column("m").to_numpy()
                n = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
                node, row, e = batch.column("node").to_numpy(), np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy()
                begin = np.cumsum(n) - n
                single = np.arange(len(e)) - begin[row] < m[row]
                bits = np.zeros((len(n), BITS), bool)
                bits[row[single], e[single] & (BITS - 1)] = True
                bits = pa.array(list(map(bytes, np.packbits(bits, axis=1))), pa.binary())
                df = np.zeros(len(e), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, e), len(known) - 1)
                    df = np.where(known[at] == e, counts[at], 0)
                order = np.lexsort((e, df, row))
                e, df, single = e[order], df[order], single[order]
                place = np.arange(len(e)) - begin[row]
                among = np.cumsum(single) - single
                among = among - among[begin[row]]
                dice, size = t / (2 - t), m[row]
                bag, few, tenth = place < n[row] - _least(dice, n[row]) + 1, single & (among < size - _least(dice, size) + 1), single & (among < size - _least(0.9, size) + 1)
                for kind, ask, offer in ((0, bag, bag), (1, tenth, single), (2, few, few)):
                    parts = -(-np.maximum(df, 1) // DEALT)
                    one = np.flatnonzero((ask | offer) & (parts == 1))
                    given, asked = np.flatnonzero(offer & (parts > 1)), np.flatnonzero(ask & (parts > 1))
                    many = np.repeat(asked, parts[asked])
                    part = np.concatenate((np.zeros(len(one), np.int64), node[row[given]] % parts[given], np.arange(len(many)) - np.repeat(np.cumsum(parts[asked]) - parts[asked], parts[asked])))
                    role = np.concatenate((ask[one] + 2 * offer[one], np.full(len(given), 2), np.full(len(many), 1)))
                    at = np.concatenate((one, given, many))
                    of = pa.array(row[at])
                    longs = [pa.array(x.astype(np.int64)) for x in (np.full(len(at), kind), e[at], part, role, n[row[at]])]
                    yield pa.RecordBatch.from_arrays([*longs, *(batch.column(c).take(of) for c in ("m", "node", "side")), bits.take(of)], _ENTRY_NAMES)

    return run


_ENTRY_NAMES = ["kind", "token", "part", "role", "n", "m", "node", "side", "bits"]
_ENTRY = "kind long, token long, part long, role long, n long, m long, node long, side int, bits binary"


def _meet(t: float, across: bool, step: int = 1 << 17):
    """Pairs (a, b) of nodes under a token that can be near by their sizes and bitmaps; a bit that only one set has stands for a token that only it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        kind, token, part, role, n, m, node, side = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in _ENTRY_NAMES[:-1])
        bits = np.concatenate([np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64) for b in parts])
        parts.clear()
        order = np.lexsort((role & 2 == 0, part, token, kind))  # what offers comes first
        kind, token, part, role, n, m, node, side, bits = (x[order] for x in (kind, token, part, role, n, m, node, side, bits))
        new = np.concatenate(([True], (kind[1:] != kind[:-1]) | (token[1:] != token[:-1]) | (part[1:] != part[:-1])))
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        ahead = np.concatenate(([0], np.cumsum(np.where(role & 1, np.add.reduceat((role & 2) // 2, begin)[group], 0))))
        for start in range(0, int(ahead[-1]), step):
            at = np.arange(start, min(start + step, int(ahead[-1])))
            a = np.searchsorted(ahead, at, "right") - 1
            b = begin[group[a]] + at - ahead[a]
            k = kind[a]
            x, y = (side[a], side[b]) if across else (node[a], node[b])
            size, other = np.where(k == 2, m[a], n[a]), np.where(k == 2, m[b], n[b])
            some = np.where(k == 1, (x != y) & (n[a] <= n[b]) & (n[a] > 1), (x < y) & (np.minimum(size, other) >= t / (2 - t) * np.maximum(size, other) - 1e-9))
            a, b, k, size, other = a[some], b[some], k[some], size[some], other[some]
            mine, others = bits[a], bits[b]
            alone = np.bitwise_count(mine & ~others).sum(axis=1, dtype=np.int64)
            apart = alone + np.bitwise_count(others & ~mine).sum(axis=1, dtype=np.int64)
            inside = (alone <= m[a] - _least(0.9, m[a])) & ((alone == 0) | (n[a] >= (t - 0.35) * n[b] - 1e-6))
            fit = np.where(k == 1, inside, apart <= (1 - t) * (size + other) + 1e-6)
            a, b = a[fit], b[fit]
            if len(a):
                turn = side[a] > side[b] if across else node[a] > node[b]
                found = np.unique(np.column_stack((np.where(turn, node[b], node[a]), np.where(turn, node[a], node[b]))), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``scores`` needs of each pair, from its token sequences."""
    for batch in batches:
        rows = []
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = Counter(x.split(" ")), Counter(y.split(" "))
            na, nb = a.total(), b.total()
            short, long = (x, y) if na <= nb else (y, x)
            rows.append((na, nb, len(a), len(b), len(a.keys() & b.keys()), (a & b).total(), f" {short} " in f" {long} ", x == y))
        types = [pa.int64()] * 6 + [pa.bool_()] * 2
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([batch.column("left_id"), batch.column("right_id"), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], ["left_id", "right_id", *_PAIR_FACTS])


_PAIR_FACTS = ["na", "nb", "da", "db", "shared_set", "shared_bag", "inside", "equal"]


def near_pairs(classes: DataFrame, others: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(left_id, right_id, similarity) of classes at least ``threshold`` alike: within one table each pair once, left below right, or across two.

    Only a bag overlap of t / (2 - t) of either side, or nine tenths of the
    shorter's set in the longer, can reach the threshold. So the rarest tokens of
    one, as many as can't all be missing from the other, are looked up among the
    other's: the short prefixes of both, as bags and as sets, for the Dice coefficients, and the
    shorter's in all of the longer for containment. The most common tokens are
    counted and come last in the order; any order finds all pairs. Of those that meet
    under a token the sizes and bitmaps leave few pairs, and only these leave
    the task; so what is shuffled grows with the tokens. The exact score follows.
    """
    spark = classes.sparkSession
    t = threshold - 5e-7  # scores are rounded before they are compared
    both = classes.withColumn("side", F.lit(0)) if others is None else classes.withColumn("side", F.lit(0)).unionByName(others.withColumn("side", F.lit(1)))
    rep = both.schema["rep"].dataType.simpleString()
    hashed = both.select(F.monotonically_increasing_id().alias("node"), "side", "rep", "joined", F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes"))
    bags = scratch.kept(hashed.mapInArrow(_elements, f"node long, side int, rep {rep}, joined string, elements array<long>, m long"), "token-bags")
    common = bags.select(F.explode("elements").alias("e")).groupBy("e").count().where("count > 1").orderBy(F.desc("count"), "e").limit(RANKED).orderBy("e").toArrow()
    shared = spark.sparkContext.broadcast((common.column("e").to_numpy(), common.column("count").to_numpy()))
    entries = bags.mapInArrow(_entries(shared, t), _ENTRY)
    if others is not None:
        entries = entries.join(scratch.kept(bags.where("side = 1").select(F.explode("elements").alias("token")).distinct(), "asked-tokens"), "token", "left_semi").select(_ENTRY_NAMES)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bags.count() * 100 // ENTRIES)
    pairs = scratch.kept(entries.repartition(parts, "kind", "token", "part").mapInArrow(_meet(t, others is not None), "a long, b long").distinct(), "met-pairs")
    one = F.struct(F.col("x.rep").alias("rep"), F.col("x.joined").alias("joined"))
    two = F.struct(F.col("y.rep").alias("rep"), F.col("y.joined").alias("joined"))
    facts = bags.select("node", "rep", "joined")
    joined = pairs.join(facts.select(F.col("node").alias("a"), F.struct("rep", "joined").alias("x")), "a").join(facts.select(F.col("node").alias("b"), F.struct("rep", "joined").alias("y")), "b")
    joined = joined.select((F.least(one, two) if others is None else one).alias("l"), (F.greatest(one, two) if others is None else two).alias("r"))
    joined = joined.select(F.col("l.rep").alias("left_id"), F.col("r.rep").alias("right_id"), F.col("l.joined").alias("a"), F.col("r.joined").alias("b"))
    counted = joined.mapInArrow(_counted, f"left_id {rep}, right_id {rep}, na long, nb long, da long, db long, shared_set long, shared_bag long, inside boolean, equal boolean")
    return counted.select("left_id", "right_id", scores(*map(F.col, _PAIR_FACTS)).alias("similarity")).where(F.col("similarity") >= threshold)


class _Wording:
    """Prompts' token sequences in a form to be searched for: those inside an item by one automaton, and those that share tokens with it by lists of the prompts under each token."""

    def __init__(self, block: dict[str, list[str]], t: float) -> None:
        import ahocorasick

        self.t, self.sequences, self.ids = t, list(block), list(block.values())
        self.padded = [f" {s} " for s in self.sequences]
        bags = [Counter(s.split(" ")) for s in self.sequences]
        self.n, self.d = np.array([b.total() for b in bags], np.int64), np.array([len(b) for b in bags], np.int64)
        under: dict[str, list[tuple[int, int]]] = {}
        for k, bag in enumerate(bags):
            for word, times in bag.items():
                under.setdefault(word, []).append((k, times))
        self.known = {word: i for i, word in enumerate(under)}
        self.begin = np.cumsum([0, *map(len, under.values())])
        self.prompt, self.times = np.array([x for v in under.values() for x in v], np.int64).reshape(-1, 2).T
        self.automaton = ahocorasick.Automaton()
        for k in np.flatnonzero(self.n > 1).tolist():
            self.automaton.add_word(self.padded[k], k)
        self.automaton.make_automaton()
        # an item with more tokens, and more different ones, can be near by what it holds whole only
        self.most, self.kinds = int(self.n.max()) / (t - 0.35) + 1 if t > 0.35 else np.inf, int(self.d.max()) * (2 - t) / t + 1

    def near(self, sequence: str) -> list[tuple]:
        """(prompt, na, nb, da, db, shared_set, shared_bag, inside, equal) of all prompts that can be near the sequence."""
        bag = Counter(sequence.split(" "))
        na, da, padded = bag.total(), len(bag), f" {sequence} "
        held = {k for _, k in self.automaton.iter(padded)} if len(self.automaton) else set()
        rows = [(k, na, int(self.n[k]), da, int(self.d[k]), int(self.d[k]), int(self.n[k]), True, self.sequences[k] == sequence) for k in sorted(held)]
        if na > self.most and da > self.kinds:
            return rows
        words = [(self.known[w], c) for w, c in bag.items() if w in self.known]
        if not words:
            return rows
        at = np.concatenate([np.arange(self.begin[i], self.begin[i + 1]) for i, _ in words])
        mine = np.repeat([c for _, c in words], [self.begin[i + 1] - self.begin[i] for i, _ in words])
        shared = np.bincount(self.prompt[at], minlength=len(self.n))
        both = np.bincount(self.prompt[at], np.minimum(self.times[at], mine), len(self.n))
        short, long, few = np.minimum(na, self.n), np.maximum(na, self.n), np.where(na <= self.n, da, self.d)
        t = self.t - 1e-9
        fit = (2 * shared >= t * (da + self.d)) | (2 * both >= t * (na + self.n)) | ((shared >= (0.9 - 1e-9) * few) & (short / long + 0.35 >= t))
        part = (na > 1) & (na <= self.n) & (shared == da)  # the item may be a stretch of the prompt
        for k in np.flatnonzero((fit | part) & (shared > 0)).tolist():
            if k not in held and ((inside := bool(part[k]) and padded in self.padded[k]) or fit[k]):
                rows.append((k, na, int(self.n[k]), da, int(self.d[k]), int(shared[k]), int(both[k]), inside, self.sequences[k] == sequence))
        return rows


def _worded(shared, token: str, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _automata:
            made = _Wording(shared.value, t) if shared.value else None
            _automata.clear()
            _automata[token] = made
        prompts = _automata[token]
        for whole in batches:
            for start in range(0, whole.num_rows, SEARCHED):
                batch = whole.slice(start, SEARCHED)
                rows = []
                for item, sequence in zip(batch.column("item_id").to_pylist(), batch.column("joined").to_pylist(), strict=True):
                    if sequence and prompts:
                        found = prompts.near(sequence)
                        digest = hashlib.sha256(sequence.encode()).digest() if found else b""
                        rows += [(item, digest, prompt, *facts) for k, *facts in found for prompt in prompts.ids[k]]
                types = [batch.schema.field("item_id").type, pa.binary(), pa.string(), *[pa.int64()] * 6, *[pa.bool_()] * 2]
                columns = zip(*rows, strict=True) if rows else [[]] * 11
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["item_id", "sequence", "right_id", *_PAIR_FACTS])

    return run


def near_prompts(items: DataFrame, prompts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(left_id, right_id, similarity) of classes of items and of prompts, both (item_id, text), at least ``threshold`` alike: the pairs of ``near_pairs(sequence_classes(items), sequence_classes(prompts))``.

    Prompts are broadcast in blocks. Each item is compared where it is read: with
    those that it holds whole, and unless it is too long for any other likeness, by
    counts of all tokens shared. Only items near a prompt are shuffled, by
    digests of their sequences; as equal sequences are near the same prompts, the
    least id among them is that of the class.
    """
    spark = items.sparkSession
    each = items.select("item_id", F.array_join(T.overlap_tokens(F.col("text")), " ").alias("joined"))
    item = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {item}, sequence binary, right_id string, na long, nb long, da long, db long, shared_set long, shared_bag long, inside boolean, equal boolean"
    found = None
    blocks = _blocks(sequence_classes(prompts).select(F.col("rep").cast("string").alias("prompt_id"), F.col("joined").alias("text")))
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        each = scratch.kept(each, "token-sequences")
    for block in chain([first], [second] if second is not None else [], blocks):
        part = each.mapInArrow(_worded(spark.sparkContext.broadcast(block), uuid.uuid4().hex, threshold - 5e-7), schema)
        found = part if found is None else found.unionByName(part)
    near = found.withColumn("similarity", scores(*map(F.col, _PAIR_FACTS))).where(F.col("similarity") >= threshold)
    return near.groupBy("sequence", "right_id").agg(F.min("item_id").alias("left_id"), F.first("similarity").alias("similarity")).select("left_id", "right_id", "similarity")

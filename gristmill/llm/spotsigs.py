"""SpotSigs fingerprints, with DataFrame functions only.

Each occurrence of a common word (an anchor) starts a chain of the content words
that follow it, anchors skipped; the hash of anchor and chain is a signature. The
fingerprint is the sorted set of a text's signatures, and likeness is the Jaccard
coefficient of two sets. Sets whose lengths alone put them below a threshold are
never compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Common words of English, French, German and Spanish that serve as anchors by default.
ANCHORS = (
    "the a an and or of to in is are was be by for on it as at that this with from "
    "le la les un une et de du des en est que qui pour par sur dans au avec pas "
    "der die das und ist ein eine zu den von mit auf für im dem nicht sich auch es als "
    "el los las y del que en para con por una se no su al lo"
).split()
#: Content words in a chain, and how many content words apart they stand.
CHAIN, SPACING = 2, 1
#: Documents that are ordered in one task, about; and the quantiles of doc_id between which ids are taken to be evenly spread.
RANGE, QUANTILES = 1024, 64


def words(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def signatures(tokens: Column, anchors: list[str] | tuple[str, ...] = ANCHORS, chain: int = CHAIN, spacing: int = SPACING) -> Column:
    """The sorted set of signature hashes of an array of words.

    The j-th anchor, at position p, is followed by content word number p - j. A
    chain cut short by the end of the text counts with what it has, and one with
    no content word isn't a signature. A text without any signature (no anchor,
    or no content) has its whole word sequence as the only one, and no words
    give the empty set.
    """
    listed = sorted(set(anchors))

    def chains(x: Column) -> Column:
        made = F.transform(
            x["places"],
            lambda p, j: F.when(F.get(x["content"], p - j).isNotNull(), F.xxhash64(F.get(x["words"], p), *[F.get(x["content"], p - j + k * spacing) for k in range(chain)])),
        )
        return F.sort_array(F.array_distinct(F.array_compact(made)))

    def signed(w: Column) -> Column:
        places = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(listed), i)))
        parts = F.struct(w.alias("words"), F.filter(w, lambda x: ~x.isin(listed)).alias("content"), places.alias("places"))
        return _once(_once(parts, chains), lambda found: F.when(F.size(found) > 0, found).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>")))

    return _once(tokens, signed)


def _once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once a row, even where ``then`` uses it inside other functions' lambdas."""
    return F.transform(F.array(value), then)[0]


def fingerprint(sigs: Column) -> Column:
    """A set of signatures as text: 16 hexadecimal digits each, in order."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard coefficient of two sets; 1 for two empty ones. Where the lengths alone keep it below ``at_least``, 0 without a comparison."""
    n, m = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when((n == 0) & (m == 0), 1.0)
        .when((n == 0) | (m == 0) | (F.least(n, m) < at_least * F.greatest(n, m)), 0.0)
        .otherwise(shared / (n + m - shared))
    )


def _below(value: Column, bounds: list[int], first: int = 0) -> Column:
    """``first`` and how many of the ascending bounds the value reaches, by halving."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(value < bounds[half], _below(value, bounds[:half], first)).otherwise(_below(value, bounds[half + 1 :], first + half + 1))


def _ranges(rows: DataFrame, length: int) -> tuple[Column, Column]:
    """(block, part) of a row: the quantiles that its doc_id lies between, and a range of about ``length`` rows, in the order of ids. Without id: block -1 and a part below 0, by the text's hash."""
    steps = F.lit([i / QUANTILES for i in range(QUANTILES + 1)])
    n, with_id, bounds = rows.agg(F.count("*"), F.count("doc_id"), F.percentile_approx("doc_id", steps, F.lit(10_000))).first()
    bounds = sorted(set(bounds or [0]))
    parts = max(1, round(with_id / max(len(bounds) - 1, 1) / length))
    width = [max(1, (b - a) // parts + 1) for a, b in zip(bounds, [*bounds[1:], bounds[-1]], strict=True)]
    block = F.greatest(_below(F.col("doc_id"), bounds) - 1, F.lit(0))
    at = lambda values: F.element_at(F.lit(values).cast("array<bigint>"), (block + 1).cast("int"))
    within = F.greatest(F.least(F.floor((F.col("doc_id") - at(bounds)) / at(width)), F.lit(parts)), F.lit(0))
    unnumbered = -1 - F.pmod(F.xxhash64("text"), F.lit(max(1, round((n - with_id) / length))))
    none = F.col("doc_id").isNull()
    return F.when(none, -1).otherwise(block).cast("long"), F.when(none, unnumbered).otherwise(block.cast("long") * (parts + 1) + within).cast("long")


def with_next(docs: DataFrame, length: int = RANGE) -> DataFrame:
    """(doc_id, text, next_text): every row with the text of the next one by descending doc_id; the last is followed by the first.

    Null texts become empty. Rows of equal doc_id are ordered by text. Rows without
    doc_id come last, in an order of their own. Rows are dealt to tasks by ranges of
    doc_id, about equal in rows however the ids are spread. Each range also
    gets the first row of the range below it, so that no task needs the whole order.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block, part = _ranges(rows, length)
    rows = rows.withColumns({"block": block, "part": part})
    heads = rows.groupBy("block", "part").agg(F.max("doc_id").alias("head"))
    # one short row a range, ordered within each block; and one a block, of which there are at most QUANTILES and two
    tops = heads.groupBy("block").agg(F.max("part").alias("highest"))
    order = Window.orderBy(F.col("block").desc())
    tops = tops.select("block", F.coalesce(F.lead("highest").over(order), F.first("highest").over(order)).alias("onward"))
    linked = heads.select("block", "part", F.lead("part").over(Window.partitionBy("block").orderBy(F.col("part").desc())).alias("below"))
    linked = linked.join(F.broadcast(tops), "block").select("part", F.coalesce("below", "onward").alias("below"))
    heads = heads.select(F.col("part").alias("below"), "head")
    ghosts = rows.join(heads, (F.col("part") == F.col("below")) & F.col("doc_id").eqNullSafe(F.col("head"))).select("below", "text")
    ghosts = ghosts.groupBy("below").agg(F.min("text").alias("text")).join(linked, "below").select(F.lit(None).cast("long").alias("doc_id"), "text", "part", F.lit(1).alias("ghost"))
    dealt = rows.select("doc_id", "text", "part", F.lit(0).alias("ghost")).unionByName(ghosts).repartition("part")
    within = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(within)).where("ghost = 0").select("doc_id", "text", "next_text")


def _signed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed, sets), each a table: (doc_id, key) of every row, the key being a digest of its fingerprint; and (node, key, id, n, sigs) of each distinct one, ``id`` its least doc_id. Signatures are made in one pass."""
    rows = docs.select(F.col("doc_id").cast("long"), signatures(words(F.col("text").cast("string"))).alias("sigs"))
    signed = materialize(rows.select("doc_id", F.sha2(fingerprint(F.col("sigs")), 256).alias("key"), "sigs"), "signatures")
    sets = signed.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("sigs").alias("sigs"))
    return signed.select("doc_id", "key"), materialize(sets.select(F.monotonically_increasing_id().alias("node"), "key", "id", F.size("sigs").alias("n"), "sigs"), "signature-sets")


def _near_nodes(sets: DataFrame, at_least: float) -> DataFrame:
    """(a, b, likeness) of near sets' nodes, each pair once.

    Sets are dealt into length classes whose borders grow by 1 / at_least, so a set
    meets only its own class and the next. Of each set only the first, rarest
    signatures (as many as one of them must be shared by any set near enough) are keys
    of the join, so common signatures make no pairs; those that no other set has come first of all
    and are only counted. Where sets share a key, what is left of both after it
    bounds what they share: the first key that near sets have in common lets them pass. The exact coefficient follows.
    """
    sets = sets.where(F.col("id").isNotNull() & (F.col("n") > 0))
    each = sets.select("node", "n", F.explode("sigs").alias("s"))
    seen = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(seen, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("r"), F.first("n").alias("n"))
    ranked = ranked.withColumn("alone", F.col("n") - F.size("r"))
    prefix = F.slice("r", F.lit(1), F.greatest(F.lit(0), F.col("n") - F.ceil(F.lit(at_least) * F.col("n") - 1e-9) + 1 - F.col("alone")).cast("int"))
    step = F.lit(1.0 / at_least)
    keys = ranked.select("node", "n", "alone", F.posexplode(F.transform(prefix, lambda x: x["s"])).alias("at", "s")).withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(step) + 1e-9))
    keys = keys.select("node", "n", "s", "class", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))  # from the key on
    left = keys.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("rest").alias("rx"), "s", F.col("class").alias("own"), F.explode(F.array("class", F.col("class") + 1)).alias("class"))
    right = keys.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("rest").alias("ry"), "s", "class")
    close = F.least("nx", "ny") >= F.lit(at_least) * F.greatest("nx", "ny") - 1e-9
    enough = F.least("rx", "ry") >= F.lit(at_least / (1 + at_least)) * (F.col("nx") + F.col("ny")) - 1e-6
    once = (F.col("own") < F.col("class")) | (F.col("x") < F.col("y"))
    pairs = left.join(right, ["s", "class"]).where(once & close & enough).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("sigs").alias("sb")), "b")
    return pairs.select("a", "b", likeness(F.col("sa"), F.col("sb"), at_least).alias("likeness")).where(F.col("likeness") >= at_least)


def near_pairs(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of distinct fingerprints of likeness ``at_least``, each pair of texts' least doc_ids once, a <= b. Equal fingerprints are one row first; sets of no signature are left out."""
    _, sets = _signed(docs)
    ids = lambda node, c: sets.select(F.col("node").alias(node), F.col("id").alias(c))
    pairs = _near_nodes(sets, at_least).join(ids("a", "x"), "a").join(ids("b", "y"), "b")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")


def near_classes(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the least doc_id of its fingerprint, and how many other fingerprints are near (``near_pairs``).

    Rows without any signature are one class without links. Without doc_id
    a row gets the class of its fingerprint, null if none of that has an id.
    """
    signed, sets = _signed(docs)
    links = _near_nodes(sets, at_least).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = sets.select("node", "key", F.col("id").alias("class_id")).join(links, "node", "left").select("key", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return signed.join(classes, "key").select("doc_id", "class_id", "n_links")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Every row with its edited text, both fingerprints, and their likeness, and that to the next row's.

    The edited text has the last half of the code points replaced by as many (or
    all) of the next document's first.
    """
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs).select("doc_id", "text", "next_text", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited_text"))
    sigs = rows.select("*", *[signatures(words(F.col(c))).alias(s) for c, s in (("text", "s"), ("edited_text", "e"), ("next_text", "x"))])
    return sigs.select(
        "doc_id", "text", "edited_text", F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("s")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("x")).alias("near_next"),
    )

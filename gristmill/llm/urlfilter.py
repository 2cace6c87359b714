"""URL filters by listed host and path prefixes, with DataFrame functions only.

A rule names a host, which stands for its subdomains too, and a path prefix.
The canonical keys that a URL could match are its host's suffixes joined to its
path's prefixes, of just the label counts and lengths that some rule has. A
blocked Bloom filter of the rules' keys (one 64-bit word a key) passes the few
keys that may be listed; an exact hash join removes the false ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Up to so many words the filter is a literal in the plan; a larger one is joined by its word's number.
LITERAL_WORDS = 1 << 14
#: Keys a word, and bits that a key sets in its word.
KEYS_PER_WORD, BITS = 4, 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column) -> Column:
    """The bits of a key in its word."""
    h, out = F.xxhash64(key, F.lit("bits")), F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _possible(keys: Column, filled: list[int]) -> Column:
    """Those of the keys that the filter's words pass."""
    table = F.lit(filled).cast("array<bigint>")

    def passes(key: Column) -> Column:
        # one binding of the key's bits, which are compared twice
        return F.exists(F.array(_bits(key)), lambda b: F.element_at(table, _word(key, len(filled)) + 1).bitwiseAND(b) == b)

    return F.filter(keys, passes)


def _keys(labels: Column, path: Column, shapes: Column) -> Column:
    """What a url could match: its host's last ``n`` labels with the first ``m`` characters of its path, for each shape (n, m) that it has."""
    fitting = F.filter(shapes, lambda x: (F.size(labels) >= x["n"]) & (F.length(path) >= x["m"]))
    return F.transform(fitting, lambda x: F.concat_ws("\u0001", F.array_join(F.slice(labels, -x["n"], x["n"]), "."), F.substring(path, F.lit(1), x["m"])))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: (host, path, verdict).

    Each row is tried against the filter where it is read, so only rows with a
    possible rule are exchanged: their distinct host and path join the rules
    exactly, and what is decided joins the rows.

    Of several fitting rules the longest wins, and of equally long ones the last
    by text; a rule listed twice with different verdicts blocks. Rules with a
    null host are left out; a null path is empty. Columns named host, path, rule or
    verdict in ``pages`` are replaced. Empty rules leave every verdict at ``default``.
    """
    listed = rules.where("host is not null").select(F.concat(lower_ascii(F.col("host")), F.coalesce("path", F.lit(""))).alias("key"), lower_ascii(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
    exact = listed.groupBy("h", "p").agg(F.first("key").alias("rule"), F.max("verdict").alias("verdict")).withColumn("key", F.concat_ws("\u0001", "h", "p"))
    # label counts and path lengths of the rules: a value in the plan, whose size doesn't depend on how many there are
    shapes = sorted(map(tuple, exact.select(F.size(F.split("h", r"\.")), F.length("p")).distinct().collect()))
    judged = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if not shapes:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    shapes = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in shapes])
    tried = "_" * (1 + max(map(len, judged.columns)))  # no column of the table has that name
    keyed = judged.withColumn(tried, _keys(F.split("host", r"\."), F.col("path"), shapes))
    words = 1
    while words * KEYS_PER_WORD < exact.count():
        words *= 2
    bloom = exact.select(_word(F.col("key"), words).alias("w"), _bits(F.col("key")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("bits"))
    if words <= LITERAL_WORDS:
        filled = dict(map(tuple, bloom.collect()))  # at most LITERAL_WORDS longs
        keyed = keyed.withColumn(tried, _possible(F.col(tried), [filled.get(i, 0) for i in range(words)]))
    possible = keyed.where(F.size(tried) > 0)
    asked = possible.select("host", "path", tried).distinct().select("host", "path", F.explode(tried).alias("key"))
    if words > LITERAL_WORDS:
        asked = asked.withColumns({"w": _word(F.col("key"), words), "b": _bits(F.col("key"))}).join(bloom, "w")
        asked = asked.where(F.col("bits").bitwiseAND(F.col("b")) == F.col("b")).select("host", "path", "key")
    best = F.struct(F.length("rule").alias("n"), F.struct("rule", "verdict").alias("x"))
    decided = asked.join(exact.select("key", "rule", "verdict"), "key").groupBy("host", "path").agg(F.max(best)["x"].alias(tried))
    found = possible.drop(tried).join(decided, ["host", "path"], "left")
    found = found.select(*judged.columns, F.col(tried)["rule"].alias("rule"), F.coalesce(F.col(tried)["verdict"], F.lit(default)).alias("verdict"))
    others = keyed.where(F.size(tried) == 0).select(*judged.columns, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return others.unionByName(found)

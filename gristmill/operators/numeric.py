"""Numeric operators over array columns: sampling arithmetic, losses, attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once


def softmax(logits: Column) -> Column:
    """Softmax of an array; null entries stand for minus infinity and give 0."""
    raised = once(F.struct(logits.alias("v"), F.array_max(logits).alias("top")), lambda s: F.transform(s["v"], lambda x: F.coalesce(F.exp(x - s["top"]), F.lit(0.0))))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, y: a + y)
    return once(raised, lambda e: once(F.struct(e.alias("e"), total(e).alias("sum")), lambda s: F.transform(s["e"], lambda x: x / s["sum"])))


def tempered(logits: Column, temperature: float) -> Column:
    return F.transform(logits, lambda x: x.cast("double") / max(temperature, 1e-6))


def limited(logits: Column, vocabulary: int) -> Column:
    """Entries from ``vocabulary`` on are ruled out."""
    return F.transform(logits, lambda x, i: F.when(i < vocabulary, x))


def penalized(logits: Column, seen: Column, penalty: float) -> Column:
    """Entries of seen indices: positive ones divided by the penalty, others multiplied."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def top_k(logits: Column, k: int) -> Column:
    """Entries below the k-th greatest are ruled out; ties with it stay."""
    kept = F.sort_array(F.filter(logits, lambda x: x.isNotNull()), asc=False)
    cut = F.get(kept, F.least(F.lit(k), F.size(kept)) - 1)
    return F.transform(F.array(F.struct(cut.alias("c"), logits.alias("v"))), lambda s: F.transform(s["v"], lambda x: F.when(x >= s["c"], x)))[0]


def draw(probabilities: Column, uniform: Column) -> Column:
    """The index whose cumulative probability first exceeds ``uniform``."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("found"))
    step = lambda s, p: F.struct((s["sum"] + p).alias("sum"), (s["i"] + 1).alias("i"), F.when((s["found"] < 0) & (s["sum"] + p > uniform), s["i"]).otherwise(s["found"]).alias("found"))
    return F.aggregate(probabilities, start, step, lambda s: F.when(s["found"] < 0, s["i"] - 1).otherwise(s["found"]))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log likelihood of one label; null for an ignored one (below 0)."""
    def loss(s: Column) -> Column:
        total = F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + F.exp(x - s["top"]))
        return F.log(total) + s["top"] - F.get(s["v"], label)

    return F.when(label >= 0, once(F.struct(logits.alias("v"), F.array_max(logits).alias("top")), loss))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def causal_attention(vectors: DataFrame, by: str, position: str, vector: str) -> DataFrame:
    """(by, position, context): softmax of scaled dot products with all positions up to its own, over each group's sequence.

    Groups are sequences of bounded length, as in a model's window.
    """
    q = vectors.select(F.col(by).alias("_g"), F.col(position).alias("_q"), F.col(vector).alias("_a"))
    k = vectors.select(F.col(by).alias("_g"), F.col(position).alias("_k"), F.col(vector).alias("_b"))
    pairs = q.join(k, "_g").where(F.col("_k") <= F.col("_q")).select("_g", "_q", "_k", "_b", (dot(F.col("_a"), F.col("_b")) / F.sqrt(F.size("_a"))).alias("_s"))
    gathered = pairs.groupBy("_g", "_q").agg(F.sort_array(F.collect_list(F.struct("_k", "_s", "_b"))).alias("_r"))
    weights = softmax(F.transform("_r", lambda r: r["_s"]))
    weighted = F.zip_with(weights, F.col("_r"), lambda w, r: F.transform(r["_b"], lambda x: x.cast("double") * w))
    size = F.size(F.get(F.col("_r"), F.lit(0))["_b"])
    zero = F.array_repeat(F.lit(0.0), size)
    context = F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return gathered.select(F.col("_g").alias(by), F.col("_q").alias(position), context.alias("context"))


def layer_norm(v: Column, epsilon: float = 1e-5) -> Column:
    mean_of = lambda x, of: F.aggregate(x, F.lit(0.0), lambda s, y: s + of(y)) / F.size(x)
    centred = once(F.struct(v.alias("v"), mean_of(v, lambda y: y.cast("double")).alias("m")), lambda s: F.transform(s["v"], lambda x: x - s["m"]))
    spread = lambda c: once(F.struct(c.alias("c"), F.sqrt(mean_of(c, lambda y: y * y) + epsilon).alias("d")), lambda s: F.transform(s["c"], lambda x: x / s["d"]))
    return once(centred, spread)


def gelu(x: Column) -> Column:
    """The tanh form."""
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * F.pow(x, F.lit(3.0)))))


def embedded(token: Column, position: Column) -> Column:
    """The sum of a token's and its position's vectors."""
    return F.zip_with(token, position, lambda a, b: a + b)


def parameters(shapes: Column) -> Column:
    """How many numbers a tensor of this shape has; one for a scalar."""
    return F.aggregate(shapes, F.lit(1).cast("long"), lambda n, d: n * d)


def until_stop(ids: Column, stops: list[int], most: int, filler: int) -> Column:
    """(ids, finished, length) of a row of generated ids: each row stops by itself at its first stop id or after ``most`` ids, and is filled up to ``most`` with an inert one."""
    at = F.array_position(F.transform(ids, lambda i: i.isin(stops)), True).cast("int")
    n = F.when(at > 0, F.least(at - 1, F.lit(most))).otherwise(F.least(F.size(ids), F.lit(most)))
    own = F.slice(ids, F.lit(1), n)
    return F.struct(F.concat(own, F.array_repeat(F.lit(filler), F.lit(most) - n)).alias("ids"), ((at > 0) & (at - 1 <= most)).alias("finished"), n.alias("length"))

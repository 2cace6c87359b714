"""Training control: schedules, cadence, early stopping, and timing aggregates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def learning_rate(step: Column, rate: float, warmup: int) -> Column:
    """Linear warm-up, then constant."""
    return F.when(step < warmup, rate * (step + 1) / max(1, warmup)).otherwise(F.lit(rate))


def should_evaluate(step: Column, interval: int, last: int) -> Column:
    return (step % interval == 0) | (step == last - 1)


def schedule(spark, steps: int, rate: float, warmup: int, interval: int) -> DataFrame:
    step = F.col("id")
    return spark.range(steps).select(step.alias("step"), learning_rate(step, rate, warmup).alias("rate"), should_evaluate(step, interval, steps).alias("evaluate"))


def early_stopping(losses: DataFrame, by: str, order: list[str], loss: str, patience: int) -> DataFrame:
    """(by, evaluations, best, stopped_at): a strict improvement restores the patience; at zero training stops (null: it never did).

    The n-th evaluation is an improvement if it is below all before it, so the patience
    left is a count since the last improvement, and no fold over the rows is needed.
    """
    w = Window.partitionBy(by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = losses.where(F.col(loss).isNotNull()).select(by, F.row_number().over(w).alias("n"), F.col(loss).alias("loss"), F.min(loss).over(before).alias("best"), *[F.col(c).alias(f"_{c}") for c in order])
    rows = rows.withColumn("improved", F.col("best").isNull() | (F.col("loss") < F.col("best")))
    ordered = Window.partitionBy(by).orderBy("n")
    since = F.col("n") - F.max(F.when(F.col("improved"), F.col("n"))).over(ordered)
    rows = rows.withColumn("since", since)
    stop = F.min(F.when((F.lit(patience) > 0) & (F.col("since") >= patience), F.col("n")))
    ends = rows.withColumn("stop", stop.over(Window.partitionBy(by)))
    used = ends.where(F.col("stop").isNull() | (F.col("n") <= F.col("stop")))
    return used.groupBy(by).agg(F.count("*").alias("evaluations"), F.min("loss").alias("best"), F.max("stop").cast("long").alias("stopped_at"))


def benchmark(runs: DataFrame, by: list[str]) -> DataFrame:
    """Aggregates of measured runs (index from 1, elapsed, tokens); warm-ups have index 0 and below. Runs that took no time are left out."""
    measured = runs.where("index >= 1 AND elapsed > 0")
    out = measured.groupBy(*by).agg(F.count("*").alias("runs"), F.sum("elapsed").alias("total"), F.avg("elapsed").alias("mean"), F.min("elapsed").alias("least"), F.max("elapsed").alias("most"), F.sum("tokens").alias("tokens"))
    return out.withColumn("tokens_per_second", F.col("tokens") / F.col("total"))


def ready(stages: DataFrame, outputs: DataFrame) -> DataFrame:
    """(stage, ready) of stages (stage, needs, makes): not made yet, and all needed outputs exist."""
    missing = stages.select("stage", "makes", F.explode_outer("needs").alias("output")).join(outputs.select("output", F.lit(True).alias("_is")), "output", "left")
    found = missing.groupBy("stage", "makes").agg(F.bool_and(F.col("output").isNull() | F.col("_is").isNotNull()).alias("ready"))
    made = outputs.select(F.col("output").alias("makes"), F.lit(True).alias("_made"))
    return found.join(made, "makes", "left").select("stage", (F.col("ready") & F.col("_made").isNull()).alias("ready"))


#: Rounds after which a graph of stages is given up: as many levels as it may have.
MOST_LEVELS = 1000


def _rounds(left: DataFrame, edges: DataFrame, forward: bool) -> Iterator[DataFrame]:
    """The stages that leave a graph in each round: those that wait for none of the others (or none of them waits for), until none does; at last what stays."""
    one, other = ("stage", "before") if forward else ("before", "stage")
    for _ in range(MOST_LEVELS):
        held = edges.select(F.col(one).alias("stage")).distinct()
        free = scratch.kept(left.join(held, "stage", "left_anti"), "stages")
        if free.isEmpty():
            break
        yield free
        gone = free.select(F.col("stage").alias(other))
        left, edges = scratch.kept(left.join(free, "stage", "left_anti"), "stages"), scratch.kept(edges.join(gone, other, "left_anti"), "stage-edges")
    else:
        raise ValueError(f"a graph of more than {MOST_LEVELS} levels")
    yield left


def plan_stages(stages: DataFrame, outputs: DataFrame) -> DataFrame:
    """(stage, level, state, blocked_by) of stages (stage, needs, makes), by the outputs (output) that there are.

    A stage's level is one more than the highest of those that make what it needs; without such it is 0. States: ``done`` (what it makes is there), ``ready`` (all it needs is),
    ``waiting`` (some of it is to be made), ``missing input`` (nothing makes it), ``cycle`` (the stage needs its own output, by way of others or not), ``behind a cycle``; the last two have no level.
    ``blocked_by`` lists what it needs that isn't there, in order. Each level is a round of joins, and a round's stages are counted nowhere but in Spark.
    """
    needs = stages.select("stage", F.explode("needs").alias("output")).distinct()
    makers = stages.select(F.col("makes").alias("output"), F.col("stage").alias("before"))
    there = outputs.select("output").distinct().withColumn("_there", F.lit(True))
    open_needs = needs.join(there, "output", "left_anti").join(makers, "output", "left")
    edges = scratch.kept(needs.join(makers, "output").select("stage", "before").distinct(), "stage-edges")
    names = stages.select("stage")
    *levels, stuck = _rounds(names, edges, True)
    found = names.limit(0).withColumn("level", F.lit(0).cast("long"))
    for level, part in enumerate(levels):
        found = found.unionByName(part.select("stage", F.lit(level).cast("long").alias("level")))
    within = edges.join(stuck, "stage").join(stuck.select(F.col("stage").alias("before")), "before").select("stage", "before")
    *_, core = _rounds(stuck, scratch.kept(within, "stage-edges"), False)
    blocked = open_needs.groupBy("stage").agg(F.array_sort(F.collect_set("output")).alias("blocked_by"), F.bool_or(F.col("before").isNull()).alias("_missing"))
    made = stages.join(there, F.col("makes") == F.col("output"), "left").select("stage", F.col("_there").alias("_done"))
    rows = made.join(found, "stage", "left").join(core.withColumn("_cycle", F.lit(True)), "stage", "left").join(blocked, "stage", "left")
    state = F.when(F.col("_done"), "done").when(F.col("_cycle"), "cycle").when(F.col("level").isNull(), "behind a cycle").when(F.col("_missing"), "missing input").when(F.size("blocked_by") > 0, "waiting").otherwise("ready")
    return rows.select("stage", "level", state.alias("state"), F.coalesce("blocked_by", F.array().cast("array<string>")).alias("blocked_by"))

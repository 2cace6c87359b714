"""Chat sessions as folds over ordered events: settings, history, retries, presets; and how resumption picks a checkpoint."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import provenance

#: Presets of generation, and the settings of a second try, whose replies may be so long at least.
PRESETS = {
    "precise": {"temperature": 0.2, "top_k": 5, "max_new_tokens": 80},
    "balanced": {"temperature": 0.3, "top_k": 8, "max_new_tokens": 120},
    "creative": {"temperature": 0.7, "top_k": 20, "max_new_tokens": 160},
}
RETRY = {"temperature": 0.5, "top_k": 10}
RETRY_TOKENS = 120
STATE = "session long, seq long, answer string, temperature double, top_k long, max_new_tokens long, raw boolean, history_enabled boolean, turns long, open boolean"


def _number(text: str, whole: bool) -> float | None:
    try:
        value = float(int(text)) if whole else float(text)
    except ValueError:
        return None
    return value if 0 < value < float("inf") else None


def step(state: dict[str, Any], line: str) -> str:
    """Apply one line to a session's state; what is said about it. Lines after the end change nothing."""
    if not state["open"]:
        return "closed"
    parts = line.split()
    if not parts or not parts[0].startswith("/"):
        if not parts:
            return "blank"
        state["turns"] += 1 if state["history_enabled"] else 0
        return "message"
    name, rest = parts[0].lower(), parts[1:]
    if name in ("/quit", "/exit"):
        state["open"] = False
        return "closed"
    if name == "/help":
        return "help"
    if name == "/reset":
        state["turns"] = 0
        return "cleared"
    if name == "/raw":
        state["raw"] = not state["raw"]
        return "set"
    if name == "/history":
        if not rest:
            return "shown"
        if len(rest) == 1 and rest[0].lower() in ("on", "off"):
            state["history_enabled"], state["turns"] = rest[0].lower() == "on", 0
            return "set"
        return "usage"
    setting = {"/temp": "temperature", "/topk": "top_k", "/max": "max_new_tokens"}.get(name)
    if setting is None:
        return "unknown"
    if len(rest) != 1:
        return "usage"
    value = _number(rest[0], setting != "temperature")
    if value is None:
        return "invalid"
    state[setting] = value if setting == "temperature" else int(value)
    return "set"


def opening(start: dict[str, Any] | None = None) -> dict[str, Any]:
    """The state that a session begins with."""
    return PRESETS["balanced"] | {"raw": False, "history_enabled": True, "turns": 0, "open": True} | (start or {})


def folded(events: DataFrame, start: dict[str, Any] | None = None) -> DataFrame:
    """Events (session, seq, line) with what each was answered and the state after it, in order of seq.

    A session is one task's fold, its feature; sessions are independent. Null lines are blank.
    """
    first = opening(start)

    def fold(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        rows = frames.sort_values("seq")
        state, out = dict(first), []
        for session, seq, line in zip(rows["session"], rows["seq"], rows["line"], strict=True):
            said = step(state, line or "")
            out.append((session, seq, said, *(state[k] for k in first)))
        return pd.DataFrame(out, columns=["session", "seq", "answer", *first])

    return events.select("session", "seq", "line").groupBy("session").applyInPandas(fold, STATE)


def resolved(requests: DataFrame) -> DataFrame:
    """Requests (preset, and temperature, top_k, max_new_tokens that override it) with the settings that hold; an unknown preset gives null."""
    rows = requests
    for name in ("temperature", "top_k", "max_new_tokens"):
        preset = F.lit(None)
        for label, values in PRESETS.items():
            preset = F.when(F.col("preset") == label, F.lit(values[name])).otherwise(preset)
        rows = rows.withColumn(name, F.coalesce(F.col(name), preset))
    return rows


def to_retry(replies: DataFrame) -> DataFrame:
    """Replies (reply, temperature, top_k, max_new_tokens, ...) that are degenerate, with the settings of a second try; an answer that isn't is left out."""
    again = {k: F.lit(v) for k, v in RETRY.items()} | {"max_new_tokens": F.greatest(F.col("max_new_tokens"), F.lit(RETRY_TOKENS))}
    return replies.where(T.is_degenerate(F.coalesce("reply", F.lit("")))).withColumns(again)


def wrapped_json(text: Column) -> Column:
    """A reply as a JSON object of one experimental text."""
    return T.json_object(experimental_json_text=T.json_string(text))


def incompatible(catalog: DataFrame, resume: bool) -> DataFrame:
    """(path, reasons): why classified checkpoints can't be used, for resuming or for loading; none if they can."""
    c = F.col
    reasons = [F.when(c("error").isNotNull(), c("error"))]
    if resume:
        reasons += [F.when(c("kind").isNull() | (c("kind") != "pretrain"), "no pretraining state"), F.when(~c("has_optimizer"), "no optimizer"), F.when(~c("has_config"), "no config"), F.when(c("iter").isNull() | (c("iter") < 0), "no iteration")]
    return catalog.select("path", F.array_join(F.array_compact(F.array(*reasons)), ",").alias("reasons"))


def explicit(classified: DataFrame, path: str, resume: bool) -> DataFrame:
    """The one row of classified checkpoints that a path names, however it is written; none is an error, and so is one that can't be used, which says why."""
    named = classified.where(provenance.normalized_path(F.col("path")) == path.replace("\\", "/").lower())
    found = incompatible(named, resume).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} checkpoint {path}")
    if found[0].reasons:
        raise ValueError(f"checkpoint {path}: {found[0].reasons}")
    return named


def resume(catalog: DataFrame, by: list[str], explicit: str | None = None, allow_inexact: bool = False) -> DataFrame:
    """(by, path, decision) for each run folder: where training goes on.

    ``catalog``: classified checkpoints with exact (complete, matching provenance)
    and tokenizer_verified. Without an explicit path the best exact state is taken;
    a state that is only inexact, or of another tokenizer, is an error and never a silent
    downgrade; with none at all training starts fresh. An explicit path is taken if exact, or
    inexact where that is allowed.
    """
    if allow_inexact and explicit is None:
        raise ValueError("an inexact resume needs an explicit path")
    c = F.col
    states = catalog.where(c("error").isNull() & (c("kind") == "pretrain") & c("has_optimizer") & c("has_config") & (c("iter") >= 0))
    states = states.withColumn("known", F.coalesce("tokenizer_verified", F.lit(False))).withColumn("complete", F.coalesce("exact", F.lit(False)))
    rank = F.struct("iter", provenance.normalized_path(c("path")))
    if explicit is not None:
        named = states.where(provenance.normalized_path(c("path")) == explicit.replace("\\", "/").lower())
        decision = F.when(~c("known"), "error: another tokenizer").when(c("complete"), "exact").when(F.lit(allow_inexact), "inexact").otherwise("error: only inexact")
        return named.select(*by, "path", decision.alias("decision"))
    best = lambda test: F.max_by(F.when(test, c("path")), F.when(test, rank))
    found = states.groupBy(*by).agg(best(c("known") & c("complete")).alias("exact_path"), best(c("known")).alias("partial_path"), F.max_by("path", rank).alias("any_path"))
    folders = catalog.select(*by).distinct().join(found, by, "left")
    decision = F.when(c("exact_path").isNotNull(), "exact").when(c("partial_path").isNotNull(), "error: only inexact").when(c("any_path").isNotNull(), "error: another tokenizer").otherwise("fresh")
    return folders.select(*by, F.coalesce("exact_path", F.when(c("partial_path").isNotNull(), c("partial_path"))).alias("path"), decision.alias("decision"))

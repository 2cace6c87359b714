"""Repair of conversations: each distinct sequence of roles and faults is solved once, and its edits are replayed.

A row's signature is one letter: the initial of its role (``x`` for others), in upper case if its text is truncated, or
``d`` if it has to go. Conversations are cut into segments of at most SEGMENT rows where ranges of ordered rows are
read. Of each distinct signature of a segment, the cheapest edits from every state to every state are found
by memoised recursion; joined back, they chain to the cheapest edits of a whole conversation. Ordered rows are streamed
through a task and never gathered, so one conversation may be of any length; only its edits, a letter a row, are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Rows in a segment at most, and copies of each frequent signature's edits, over which its conversations are dealt out.
SEGMENT, SALTS = 64, 32
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: States after what is kept so far: nothing, a system turn, a user's, an assistant's. What each initial leads to, and what is missing at the end.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MISSING = ("", "II", "I", "")
#: What a new role is called in each state that it leads to.
CALLED = {2: "user", 3: "assistant"}
_NEXT = tuple(min(t for t in to.values() if t > 1) for to in STEP)

_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SEGMENT = [
    *(T.StructField(c, T.LongType()) for c in ("part", "seq")),
    T.StructField("signature", T.StringType()),
    T.StructField("rows", T.ArrayType(_TURN)),
    *(T.StructField(c, T.LongType()) for c in (*_COUNTS, "first_turn", "last_turn", "turns")),
    *(T.StructField(c, T.StringType()) for c in ("first_role", "last_role")),
]
_PLAN = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("edits", T.StringType())])
_PIECE = [*(T.StructField(c, T.LongType()) for c in ("part", "seq")), T.StructField("state", T.IntegerType()), T.StructField("edits", T.StringType()), T.StructField("cost", T.LongType())]
AUDIT = [*(T.StructField(c, T.LongType(), False) for c in ("gaps", *_COUNTS, "cost")), T.StructField("audit", T.StringType(), False), T.StructField("repaired_sha256", T.StringType(), False)]
REPAIRED = [T.StructField("position", T.LongType(), False), T.StructField("role", T.StringType(), False), T.StructField("text", T.StringType(), False), T.StructField("edit", T.StringType(), False)]


@lru_cache(maxsize=1 << 16)
def solved(signature: str, state: int) -> dict[int, tuple[int, str]]:
    """For each state that ``signature`` can lead to from ``state``, the least cost and, of such edits, the least in ASCII; inserts come before the rows that they precede."""
    if not signature:
        return {state: (0, "")}
    row, rest = signature[0], signature[1:]
    best: dict[int, tuple[int, str]] = {}
    for inserts in range(3):
        if inserts:
            state = _NEXT[state]
        edges = [("D", DELETE, state)]
        if row != "d":
            late = TRUNCATED * row.isupper()
            edges.append(("R", REROLE + late, _NEXT[state]))
            if row.lower() in STEP[state]:
                edges.append(("K", KEEP + late, STEP[state][row.lower()]))
        for letter, cost, to in edges:
            for end, (more, edits) in solved(rest, to).items():
                new = (inserts * INSERT + cost + more, "I" * inserts + letter + edits)
                if end not in best or new < best[end]:
                    best[end] = new
    return best


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plans = [[{"begin": s, "end": e, "cost": c, "edits": x} for s in range(4) for e, (c, x) in solved(one.as_py(), s).items()] for one in batch.column(0)]
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plans, kind)], names=["signature", "plans"])


def _arrow(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))


class _Segment:
    """Rows of one conversation in order, as many as there are until it is full."""

    def __init__(self, conv_id, part: int, seq: int):
        self.row = {"conv_id": conv_id, "part": part, "seq": seq, "rows": [], **dict.fromkeys(_COUNTS, 0), "first_turn": None, "last_turn": None, "turns": 0, "first_role": None, "last_role": None}
        self.letters: list[str] = []

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        row, initial = self.row, role[:1]
        if row["last_role"] is None:
            row["first_role"] = initial
        else:
            row["illegal"] += row["last_role"] + initial not in ("su", "ua", "au")
        row["last_role"] = initial
        if turn is not None and turn != row["last_turn"]:
            row["first_turn"] = turn if row["first_turn"] is None else row["first_turn"]
            row["last_turn"] = turn
            row["turns"] += 1
        if fault:
            row[fault] += 1
        letter = initial if initial in ("s", "u", "a") else "x"
        self.letters.append("d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
        if self.letters[-1] != "d":
            row["rows"].append({"role": role, "text": text})

    def done(self) -> dict:
        return self.row | {"signature": "".join(self.letters)}


def _cut(schema: T.StructType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.row["conv_id"] != row["conv_id"]:
                    if now:
                        out.append(now.done())
                    now = _Segment(row["conv_id"], part, 0)
                for k in range(row["n"]):
                    if len(now.letters) == SEGMENT:
                        out.append(now.done())
                        now = _Segment(row["conv_id"], part, now.row["seq"] + 1)
                    seen = k or not row["first"]
                    now.add(row["turn"], row["role"], row["text"], "blank" if row["blank"] else "duplicate" if seen else "truncated" if row["cut"] else None)
                if len(out) >= 500:
                    yield _arrow(out, schema)
                    out = []
        if now:
            out.append(now.done())
        if out:
            yield _arrow(out, schema)

    return work


def _segments(turns: DataFrame, copies: Column) -> DataFrame:
    """Segments of all conversations; a conversation none of whose rows is there has an empty one."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("n"))
    rows = rows.withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in ("turn", "role", "text")})
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("digest", F.md5("text"))
    first = rows.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("at"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    faults = {
        "first": F.col("turn").eqNullSafe(F.col("at.turn")),
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
        "cut": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
    }
    rows = rows.select("conv_id", "turn", "role", "text", "n", *[c.alias(name) for name, c in faults.items()])
    schema = T.StructType([turns.schema["conv_id"], *_SEGMENT])
    rows = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(rows.mapInArrow(_cut(schema), schema), "conversation-segments")


def _with_plans(segments: DataFrame) -> DataFrame:
    """Segments' places with their signature's plans. One signature may be that of most segments, so it is joined in SALTS parts."""
    salted = segments.select("conv_id", "part", "seq", "signature", F.pmod(F.xxhash64("conv_id", "part", "seq"), F.lit(SALTS)).alias("salt"))
    pairs = salted.select("signature", "salt").distinct()
    plans = pairs.select("signature").distinct().mapInArrow(_solve, T.StructType([T.StructField("signature", T.StringType()), T.StructField("plans", T.ArrayType(_PLAN))]))
    return salted.join(pairs.join(plans, "signature"), ["signature", "salt"]).select("conv_id", "part", "seq", "plans")


def _chained(schema: T.StructType):
    """The edits of each segment, and the cost of them all with the first one."""

    def finished(conv_id, alive: dict, places: list, back: list) -> list[dict]:
        cost, _, state = min((c + INSERT * len(MISSING[s]), rank, s) for s, (c, rank) in alive.items())
        edits, out = MISSING[state], []
        for (part, seq), way in zip(reversed(places), reversed(back), strict=True):
            state, found = way[state]
            out.append({"conv_id": conv_id, "part": part, "seq": seq, "state": state, "edits": found + edits, "cost": None})
            edits = ""
        out[-1]["cost"] = cost
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, alive, places, back, out = object(), {}, [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != key:
                    if back:
                        out += finished(key, alive, places, back)
                    key, alive, places, back = row["conv_id"], {0: (0, 0)}, [], []
                # edits that lead to different states never begin with one another, so their order so far decides
                best: dict[int, tuple] = {}
                for p in row["plans"]:
                    if p["begin"] in alive:
                        cost, rank = alive[p["begin"]]
                        new = (cost + p["cost"], rank, p["edits"], p["begin"])
                        if p["end"] not in best or new < best[p["end"]]:
                            best[p["end"]] = new
                order = sorted(best, key=lambda s: best[s][1:3])
                alive = {s: (best[s][0], order.index(s)) for s in best}
                places.append((row["part"], row["seq"]))
                back.append({s: (best[s][3], best[s][2]) for s in best})
                if len(out) >= 2000:
                    yield _arrow(out, schema)
                    out = []
        if back:
            out += finished(key, alive, places, back)
        if out:
            yield _arrow(out, schema)

    return work


def _replay(state: int, edits: str, signature: str, rows: list[dict]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of each turn that stays or is new."""
    letters, held = iter(signature), iter(rows)
    for edit in edits:
        letter = "" if edit == "I" else next(letters)
        turn = next(held) if letter and letter != "d" else {"role": "", "text": ""}
        if edit == "D":
            continue
        state = STEP[state][letter.lower()] if edit == "K" else _NEXT[state]
        yield (turn["role"] if edit == "K" else CALLED[state], turn["text"], edit)


class _Repaired:
    """What becomes of one conversation, segment by segment."""

    def __init__(self, conv_id):
        self.conv_id, self.hash, self.position, self.audit = conv_id, hashlib.sha256(), 0, []
        self.totals = dict.fromkeys((*_COUNTS, "cost"), 0)
        self.first = self.last = self.role = None
        self.turns = 0

    def add(self, piece: dict, segment: dict) -> Iterator[dict]:
        self.audit.append(piece["edits"])
        self.totals["cost"] += piece["cost"] or 0
        for c in _COUNTS:
            self.totals[c] += segment[c]
        if segment["first_role"] is not None:
            if self.role is not None:
                self.totals["illegal"] += self.role + segment["first_role"] not in ("su", "ua", "au")
            self.role = segment["last_role"]
        if segment["turns"]:
            self.turns += segment["turns"] - (segment["first_turn"] == self.last)
            self.first = segment["first_turn"] if self.first is None else self.first
            self.last = segment["last_turn"]
        for role, text, edit in _replay(piece["state"], piece["edits"], segment["signature"], segment["rows"]):
            self.hash.update(f"{chr(10) if self.position else ''}{role}:{text}".encode())
            yield {"conv_id": self.conv_id, "position": self.position, "role": role, "text": text, "edit": edit}
            self.position += 1

    def done(self) -> dict:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.totals, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _replayed(schema: T.StructType, turns: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now and not turns:
                        out.append(now.done())
                    now = _Repaired(row["conv_id"])
                if row["rows"] is None:
                    piece = row
                    continue
                for turn in now.add(piece, row):
                    if turns:
                        out.append(turn)
                if len(out) >= 1000:
                    yield _arrow(out, schema)
                    out = []
        if now and not turns:
            out.append(now.done())
        if out:
            yield _arrow(out, schema)

    return work


def _repaired(turns: DataFrame, copies: Column | None, fields: list[T.StructField], rows: bool) -> DataFrame:
    key = turns.schema["conv_id"]
    segments = _segments(turns, F.lit(1) if copies is None else copies)
    pieces = T.StructType([key, *_PIECE])
    chained = _with_plans(segments).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_chained(pieces), pieces)
    # a segment's edits come just before it
    both = chained.unionByName(segments, allowMissingColumns=True).withColumn("second", F.col("rows").isNotNull())
    schema = T.StructType([key, *fields])
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "second").mapInArrow(_replayed(schema, rows), schema)


def audits(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """For each conv_id of ``turns`` (conv_id, turn, role, text) its faults, the cost and letters of the cheapest edits, and the repaired conversation's digest.

    Rows count ``copies`` times (once by default; 0 leaves the row out, not its conversation), and are taken by turn, nulls first, then role, then
    text, so equal rows are neighbours. Null roles and texts are one space, a null conv_id is a conversation like any other, and a role without
    a first letter is kept by no edit. A conversation without rows has zeros, no edits and the digest of nothing; an empty table has no
    result. Other columns are ignored, whatever their names.
    """
    return _repaired(turns, copies, AUDIT, False)


def repaired_turns(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """The turns of all repaired conversations, with their position and the edit (K, R or I) that each comes from; see ``audits``."""
    return _repaired(turns, copies, REPAIRED, True)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Turns with faults put in by a checksum of conv_id and turn, and how often each row counts."""
    space = F.lit(" ")
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    changed = turns.select(
        "conv_id",
        "turn",
        F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"),
    )
    return changed, F.col("copies")

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from gristmill.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string, rows string, copies int, n int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        yield c, [(t, role, text)] * {0: 0, 3: 2}.get(h, 1)


def faults(rows):
    seen = set()
    for _, role, text in rows:
        last = [x for x in text if BLANK.match(x)]
        yield "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
        seen.add((role, text))


def cheapest(initials, found):
    """The least (cost, audit, kept initials), by trying edits in order of (cost, audit) until one ends well: no states, no recursion."""
    queue = [(0, "", 0, "")]
    while queue:
        cost, audit, i, roles = heapq.heappop(queue)
        if i == len(initials) and GOOD.match(roles):
            return cost, audit
        if not any(GOOD.match(roles + tail) for tail in ("", "a", "ua")):
            continue
        if len(roles) <= len(initials) + 2:
            for r in "ua":
                heapq.heappush(queue, (cost + 3, audit + "I", i, roles + r))
        if i < len(initials):
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, roles))
            if found[i] not in ("blank", "duplicate"):
                late = 3 * (found[i] == "truncated")
                heapq.heappush(queue, (cost + late, audit + "K", i + 1, roles + (initials[i] or "?")))
                for r in "ua":
                    heapq.heappush(queue, (cost + late + 3, audit + "R", i + 1, roles + r))


def repaired(rows, audit):
    out, i = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[i][1:]
        i += edit != "I"
        if edit != "D":
            new = "assistant" if out and out[-1][0][:1] == "u" else "user"
            out.append((role if edit == "K" else new, text))
    return out


def expected(rows):
    whole = defaultdict(list)
    for c, some in damage(rows):
        whole[c] += some
    for c, some in whole.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        found = list(faults(some))
        initials = [r[1][:1] for r in some]
        turns = {r[0] for r in some} - {None}
        cost, audit = cheapest(initials, found)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        text = "\n".join(f"{r}:{t}" for r, t in repaired(some, audit))
        yield c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def some_turns(draw, conversations, longest):
    texts = ["Yes.", "No!", "well", "well ", " ", "", "\x0b", "Ok?\n\t", "é.", None]
    for c in range(conversations):
        turn = 0
        for _ in range(draw.randint(0, longest)):
            turn += draw.choice([0, 1, 1, 1, 2])
            yield c, draw.choice([turn] * 8 + [None]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None]), draw.choice(texts) if draw.random() < 0.5 else f"t{draw.randrange(99)}."


def test_solutions_of_single_signatures():
    draw = random.Random(8)
    for _ in range(400):
        signature = "".join(draw.choice("suaxSUAXd") for _ in range(draw.randint(0, 5)))
        ways = {s: (c + 3 * len(repair.MISSING[s]), e + repair.MISSING[s]) for s, (c, e) in repair.solved(signature, 0).items()}
        found = ["blank" if x == "d" else "truncated" if x.isupper() else "" for x in signature]
        assert min(ways.values()) == cheapest([x.lower() for x in signature], found), signature


@pytest.mark.parametrize("segment", [1, 3, 64])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = list(some_turns(random.Random(segment), 60, 7)) + [(None, 1, "user", "a."), (None, None, None, None), (77, None, "user", "x"), *[(78, 5, "user", "same.")] * 3]
    rows += [(1000 + i, 0, "user", "gone?") for i in range(60)]  # some of these lose their only row
    full = [(*r, "r", 5, 7) for r in rows]
    spark.createDataFrame(full, TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, queries.op13_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    want = sorted(expected(rows), key=str)
    assert got == want
    assert any(r[7] == "" and r[0] and r[0] >= 1000 for r in want)


def test_one_long_conversation_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 5)
    draw = random.Random(2)
    rows = [(1, i, draw.choice(["user", "assistant", "tool"]), f"{draw.randrange(40)}{draw.choice('.. ')}") for i in range(120)]
    initials, found = [r[2][:1] for r in rows], list(faults([r[1:] for r in rows]))
    signature = "".join("d" if f in ("blank", "duplicate") else (i if i in "sua" else "x").upper() if f else (i if i in "sua" else "x") for i, f in zip(initials, found, strict=True))
    ways = [(c + 3 * len(repair.MISSING[s]), e + repair.MISSING[s]) for s, (c, e) in repair.solved(signature, 0).items()]
    got = repair.audits(spark.createDataFrame([(*r, "", 0, 0) for r in rows], TURNS).repartition(7)).first()
    assert (got.cost, got.audit) == min(ways)
    assert got.blank + got.duplicate + got.truncated == sum(map(bool, found)) and got.gaps == 0
    turns = repair.repaired_turns(spark.createDataFrame([(*r, "", 0, 0) for r in rows], TURNS)).orderBy("position").collect()
    assert [(t.role, t.text) for t in turns] == repaired([r[1:] for r in rows], got.audit)
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == got.repaired_sha256


def test_empty_table(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.audits(empty).collect() == [] and repair.repaired_turns(empty).collect() == []

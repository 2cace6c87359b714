import hashlib
import random

import pytest
from pyspark.errors import PySparkException

from gristmill.operators import streams


def made(spark, sizes, text=False):
    draw = random.Random(sum(sizes))
    rows = [(f"k{i:03d}" if text else i * 3 - 20, [draw.randrange(1000) for _ in range(n)]) for i, n in enumerate(sizes)]
    flat = [v for _, ids in rows for v in ids]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, f"key {'string' if text else 'long'}, ids array<int>").repartition(3), flat


SIZES = [1, 5, 300, 2, 2, 1, 40, 7, 1, 1, 1, 90]


@pytest.mark.parametrize("text", [False, True])
def test_chunks_with_halos(spark, text):
    rows, flat = made(spark, SIZES, text)
    stream = streams.placed(rows, "key")
    assert sorted((r.offset, r.ids) for r in stream.collect()) == sorted((sum(SIZES[:i]), flat[sum(SIZES[:i]) : sum(SIZES[: i + 1])]) for i in range(len(SIZES)))
    for size, halo in ((1, 0), (7, 3), (10, 25), (64, 64), (1000, 5)):
        got = {r.chunk: r.ids for r in streams.chunks(stream, size, halo).collect()}
        assert got == {c: flat[c * size : (c + 1) * size + halo] for c in range(-(-len(flat) // size))}


@pytest.mark.parametrize(("block", "stride"), [(8, 1), (8, None), (8, 5), (8, 20), (3, 3), (449, 1), (450, 1), (451, 1), (500, None)])
def test_windows_are_those_of_the_flat_array(spark, block, stride):
    rows, flat = made(spark, SIZES)
    got = {r.start: (r.x, r.y) for r in streams.windows(streams.placed(rows, "key"), block, stride).collect()}
    assert got == {i: (flat[i : i + block], flat[i + 1 : i + block + 1]) for i in range(0, max(0, len(flat) - block), stride or block)}


def test_drawn_windows(spark):
    rows, flat = made(spark, SIZES)
    stream, draws = streams.placed(rows, "key"), spark.range(50).withColumnRenamed("id", "step")
    got = streams.drawn(stream, draws, ["step"], 32, 9).collect()
    assert len(got) == 50 and {r.step for r in got} == set(range(50))
    for r in got:
        start = int(hashlib.sha256(f"9:{r.step}".encode()).hexdigest()[:15], 16) % (len(flat) - 32)
        assert (r.start, r.x, r.y) == (start, flat[start : start + 32], flat[start + 1 : start + 33])
    last = streams.drawn(stream, draws, ["step"], len(flat) - 1, 9).first()
    assert last.start == 0 and last.y[-1] == flat[-1]


def test_what_cannot_be_cut(spark):
    rows, flat = made(spark, SIZES)
    stream = streams.placed(rows, "key")
    assert streams.length(stream, len(flat) - 1) == len(flat)
    with pytest.raises(streams.StreamError):
        streams.length(stream, len(flat))
    with pytest.raises(streams.StreamError):
        streams.drawn(stream, spark.range(1), ["id"], len(flat), 1)
    for bad in (lambda: streams.chunks(stream, 0), lambda: streams.windows(stream, 0), lambda: streams.windows(stream, 4, -1)):
        with pytest.raises(streams.StreamError):
            bad()
    with pytest.raises(PySparkException, match="no ids of document 7"):
        streams.placed(spark.createDataFrame([(7, []), (8, [1])], "key long, ids array<int>"), "key").collect()
    assert streams.windows(streams.placed(rows.limit(0), "key"), 4).collect() == []
    assert streams.array_type(65_535) == "uint16" and streams.array_type(65_536) == "int32"


def test_windows_are_drawn_from_chunks_of_little_halo(spark, monkeypatch):
    """What is shuffled of a stream is little more than its ids."""
    asked, chunks = [], streams.chunks
    monkeypatch.setattr(streams, "chunks", lambda stream, size, halo=0: asked.append((size, halo)) or chunks(stream, size, halo))
    rows, flat = made(spark, [700, 900, 800])
    got = streams.drawn(streams.placed(rows, "key"), spark.range(50), ["id"], 64, 3).collect()
    assert len(got) == 50 and all(r.x == flat[r.start : r.start + 64] and r.y == flat[r.start + 1 : r.start + 65] for r in got)
    assert all(halo >= 64 and size >= 10 * halo for size, halo in asked)


@pytest.mark.parametrize(("block", "stride"), [(8, 1), (8, None), (8, 5), (8, 20), (449, 1), (450, 1), (451, 1)])
def test_totals_are_those_of_the_windows_without_making_them(spark, block, stride, monkeypatch):
    rows, flat = made(spark, SIZES)
    monkeypatch.setattr(streams, "_window", None)
    got = {r.start: (r.total, r.first, r.last) for r in streams.totals(streams.placed(rows, "key"), block, stride).collect()}
    assert got == {i: (sum(flat[i : i + block]), flat[i], flat[i + block]) for i in range(0, max(0, len(flat) - block), stride or block)}


def test_every_start_is_added_up_without_its_window(spark, tmp_path, monkeypatch):
    from gristmill.plans import contracts

    texts = [(0, 0, "user", "a" * 1500), (0, 1, "assistant", "é and b"), (1, 0, "user", "c" * 30)]
    spark.createDataFrame(texts, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    flat = [v for *_, text in texts for v in [1, *(b + 4 for b in text.encode()), 2]]
    monkeypatch.setattr(streams, "_window", None)
    got = sorted(map(tuple, contracts.stream_starts(spark, str(tmp_path)).collect()))
    assert got == [(i, sum(flat[i : i + 32]), flat[i], flat[i + 32]) for i in range(len(flat) - 32)]

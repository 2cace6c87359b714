import hashlib
import io
import os
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException

from gristmill.operators import provenance, streams
from gristmill.sources import artifacts


def stream_of(spark, sizes, top=60_000):
    draw = np.random.default_rng(len(sizes))
    rows = [(i, draw.integers(0, top, n).tolist()) for i, n in enumerate(sizes)]
    flat = np.array([v for _, ids in rows for v in ids])
    return streams.placed(spark.createDataFrame(rows, "key long, ids array<int>").repartition(3), "key"), flat


def read(df):
    return np.array([v for r in df.orderBy("position").collect() for v in r.ids])


def test_round_trip_and_parts_that_numpy_reads(spark, tmp_path):
    stream, flat = stream_of(spark, [40, 1, 500, 7, 90])
    artifacts.write_array(stream, f"{tmp_path}/train", 50_000, 100)
    got = artifacts.read_array(spark, f"file://{tmp_path}/train", 64)
    assert (read(got) == flat).all() and got.rdd.getNumPartitions() > 5
    parts = sorted(f for f in os.listdir(tmp_path / "train") if f.endswith(".npy"))
    plain = np.concatenate([np.load(tmp_path / "train" / f) for f in parts])
    assert plain.dtype == np.uint16 and (plain == flat).all() and len(parts) > 1
    with pytest.raises(artifacts.ArtifactError, match="already"):
        artifacts.write_array(stream, f"{tmp_path}/train", 50_000)


@pytest.mark.parametrize("dtype", ["uint16", "int32", "uint8", "int64"])
def test_files_that_numpy_wrote(spark, tmp_path, dtype):
    flat = np.arange(70_000) % 200
    np.save(tmp_path / "val.npy", flat.astype(dtype))
    np.save(tmp_path / "train.npy", flat[:50].astype(dtype))
    assert (read(artifacts.read_array(spark, f"{tmp_path}/val.npy")) == flat).all()
    train, val = artifacts.read_splits(spark, str(tmp_path), 32)
    assert streams.length(val) == 70_000
    got = {r.start: (r.x, r.y) for r in streams.windows(train, 32, 1).collect()}
    assert got == {i: (flat[i : i + 32].tolist(), flat[i + 1 : i + 33].tolist()) for i in range(18)}
    with pytest.raises(streams.StreamError):
        artifacts.read_splits(spark, str(tmp_path), 50)


def test_arrays_that_are_none(spark, tmp_path):
    np.save(tmp_path / "flat.npy", np.zeros((2, 3), np.int32))
    np.save(tmp_path / "real.npy", np.zeros(3))
    np.save(tmp_path / "wide.npy", np.array([1 << 40]))
    np.save(tmp_path / "none.npy", np.zeros(0, np.int32))
    (tmp_path / "text.npy").write_text("no array")
    (tmp_path / "unfinished").mkdir()
    whole = (tmp_path / "none.npy").read_bytes()
    np.save(tmp_path / "cut.npy", np.arange(100))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-9])
    assert artifacts.read_array(spark, f"{tmp_path}/none.npy").collect() == [] and whole
    for name in ("flat.npy", "real.npy", "wide.npy", "text.npy", "unfinished", "missing.npy", "cut.npy"):
        with pytest.raises(PySparkException):
            artifacts.read_array(spark, f"{tmp_path}/{name}").collect()
    with pytest.raises(artifacts.ArtifactError, match="no val"):
        np.save(tmp_path / "train.npy", np.arange(99))
        artifacts.read_splits(spark, str(tmp_path), 4)


def test_writes_that_fail_leave_nothing_to_read(spark, tmp_path):
    for k, (rows, vocabulary) in enumerate([([([1, 2], 0), ([3], 3)], 10), ([([1, 2], 0), ([3], 1)], 10), ([([70_000], 0)], 10), ([([-1], 0)], 10)]):
        with pytest.raises(PySparkException):
            artifacts.write_array(spark.createDataFrame(rows, "ids array<int>, offset long"), f"{tmp_path}/{k}", vocabulary)
        with pytest.raises(PySparkException):
            artifacts.read_array(spark, f"{tmp_path}/{k}").collect()
    artifacts.write_array(spark.createDataFrame([([70_000], 0)], "ids array<int>, offset long"), f"{tmp_path}/wide", 100_000)
    assert artifacts.read_array(spark, f"{tmp_path}/wide").first().ids == [70_000]


def test_digests(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(700_000, dtype=np.uint16) % 9)
    (tmp_path / "b.npy").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "below").mkdir()
    got = {r.name: r for r in artifacts.digests(spark, str(tmp_path)).collect()}
    assert got.keys() == {"a.npy", "b.npy", "c.txt"}
    for name, r in got.items():
        data = (tmp_path / name).read_bytes()
        assert (r.size_bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert (got["a.npy"].dtype, got["a.npy"].token_count, got["a.npy"].error) == ("uint16", 700_000, None)
    assert got["b.npy"].dtype is None and "not an array" in got["b.npy"].error
    with pytest.raises(PySparkException):
        artifacts.digests(spark, f"{tmp_path}/below").collect()


# checkpoints, made as their usual library makes them


@pytest.fixture
def torch_like(monkeypatch):
    utils, top = types.ModuleType("torch._utils"), types.ModuleType("torch")

    def _rebuild_tensor_v2(*args):
        raise AssertionError("called")

    def _rebuild_parameter(*args):
        raise AssertionError("called")

    for f in (_rebuild_tensor_v2, _rebuild_parameter):
        f.__module__, f.__qualname__ = "torch._utils", f.__name__
        setattr(utils, f.__name__, f)
    for name in ("FloatStorage", "BFloat16Storage"):
        kind = type(name, (), {"__module__": "torch"})
        setattr(top, name, kind)
    monkeypatch.setitem(sys.modules, "torch", top)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)
    from collections import OrderedDict

    class Tensor:
        def __init__(self, shape, kind="FloatStorage", parameter=False):
            self.shape, self.kind, self.parameter = shape, kind, parameter

        def __reduce__(self):
            inner = (utils._rebuild_tensor_v2, (Stored(self.kind), 0, tuple(self.shape), (1,), False, OrderedDict()))
            if not self.parameter:
                return inner
            plain = Tensor(self.shape, self.kind)
            return utils._rebuild_parameter, (plain, True, OrderedDict())

    class Stored:
        def __init__(self, kind):
            self.kind = kind

    class Pickler(pickle.Pickler):
        def persistent_id(self, value):
            return ("storage", getattr(top, value.kind), "0", "cpu", 8) if isinstance(value, Stored) else None

    def save(path, value):
        out = io.BytesIO()
        Pickler(out, 2).dump(value)
        with zipfile.ZipFile(path, "w") as archive:
            archive.writestr("archive/data.pkl", out.getvalue())
            archive.writestr("archive/data/0", b"\0" * 32)

    return types.SimpleNamespace(save=save, Tensor=Tensor)


class Trap:
    def __reduce__(self):
        return os.system, ("touch /tmp/gristmill-trap",)


def test_checkpoint_scan(spark, tmp_path, torch_like):
    from collections import OrderedDict

    T = torch_like.Tensor
    weights = OrderedDict([("token_embedding.weight", T([48, 16])), ("blocks.0.w", T([3], "BFloat16Storage", True)), ("scale", T([]))])
    weights._metadata = OrderedDict()
    config = {"vocab_size": 32, "n_embd": 16, "device": "cpu"}
    torch_like.save(tmp_path / "a.pt", {"checkpoint_version": 1, "checkpoint_kind": "pretrain", "model": weights, "optimizer": {"state": {0: {"m": T([3])}}}, "config": config, "iter": 7, "best_val": 1.5, "resume_state": {"version": 1, "rng_state": {}}})
    torch_like.save(tmp_path / "b.pt", {"model": weights, "iter": True, "extra": Trap()})
    torch_like.save(tmp_path / "c.pt", [1, 2])
    torch_like.save(tmp_path / "d.pt", {"checkpoint_version": 1, "model": {}, "iter": -1})
    (tmp_path / "e.pt").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "f.pt").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "g.pt", "w") as archive:
        archive.writestr("x/data.pkl", b"\x80\x02.")
    (tmp_path / "note.txt").write_text("not looked at")
    catalog = artifacts.checkpoints(spark, str(tmp_path))
    got = {r.path[-4]: r for r in catalog.collect()}
    assert got.keys() == set("abcdefg")
    a = got["a"]
    assert (a.version, a.kind, a.has_model, a.has_optimizer, a.has_config, a.iter, a.best_val, a.resume) == (1, "pretrain", True, True, True, 7, 1.5, ["rng_state", "version"])
    assert a.config == {"vocab_size": "32", "n_embd": "16", "device": '"cpu"'}
    assert [(t.name, t.shape, t.dtype) for t in a.tensors] == [("token_embedding.weight", [48, 16], "float32"), ("blocks.0.w", [3], "bfloat16"), ("scale", [], "float32")]
    assert got["b"].iter is None and got["b"].config is None and len(got["b"].tensors) == 3 and not os.path.exists("/tmp/gristmill-trap")
    assert got["c"].unreadable == "holds a list, no mapping" and all(got[k].unreadable for k in "efg")
    assert artifacts.tensors(catalog).count() == 6
    sizes = {r.path[-4]: (r.vocab_size, r.n_embd, r.corrected) for r in artifacts.inferred(catalog).collect()}
    assert sizes["a"] == (48, 16, ["vocab_size 32 -> 48"]) and sizes["b"] == (48, 16, ["vocab_size none -> 48", "n_embd none -> 16"]) and sizes["d"] == (None, None, [])
    usable = provenance.classify_checkpoints(catalog.where("unreadable IS NULL"))
    kinds = {r.path[-4]: (r.kind, r.error) for r in usable.collect()}
    assert kinds == {"a": ("pretrain", None), "b": ("model_only", None), "d": (None, "incomplete metadata")}
    assert provenance.select_checkpoint(usable, True).first().path.endswith("a.pt")
    with pytest.raises(PySparkException):
        artifacts.checkpoints(spark, f"{tmp_path}/none").collect()

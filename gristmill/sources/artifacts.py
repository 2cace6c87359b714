"""Files of arrays, digests and checkpoints as Spark data sources, in any store that Arrow has a name for.

* ``npy``: one-dimensional integer arrays, read by ranges of items; written as parts with a manifest, which the commit writes last.
* ``digests``: SHA-256, size and, of arrays, type and count of files of any size, a MiB at a time.
* ``checkpoints``: what model checkpoints hold, from their archive's directory and the record of their structure; tensors' data are not read, and nothing that a
  file names is imported or called.
"""

from __future__ import annotations

import hashlib
import io
import json
import pickle
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators import streams

MANIFEST = "_parts.json"
#: Ids of one row and one partition when an array is read, and of a part file when one is written.
ROW_IDS, RANGE_IDS, PART_IDS = 1 << 16, 1 << 22, 1 << 24
#: Bytes read at a time, and bytes of small files that one task takes together.
READ_BYTES, TASK_BYTES = 1 << 20, 1 << 28
#: The most that a checkpoint's structure may take; tensors' data are kept apart from it.
STRUCTURE_BYTES = 1 << 28


class ArtifactError(ValueError):
    """A file that is missing or isn't what it should be."""


def _store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return arrow_fs.LocalFileSystem(), path
    if scheme == "file":
        return arrow_fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return arrow_fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def _files(path: str, suffix: str = "") -> list[arrow_fs.FileInfo]:
    """The file, or the folder's files of that suffix by name; none are an error."""
    store, base = _store(path)
    info = store.get_file_info(base)
    if info.type == arrow_fs.FileType.Directory:
        found = [f for f in store.get_file_info(arrow_fs.FileSelector(base)) if f.type == arrow_fs.FileType.File and f.path.endswith(suffix)]
    else:
        found = [info] if info.type == arrow_fs.FileType.File else []
    if not found:
        raise ArtifactError(f"no files in {path}")
    return sorted(found, key=lambda f: f.path)


# arrays


@dataclass
class Header:
    dtype: str
    count: int
    begin: int


def _header(file) -> Header:
    """The head of an open array file; anything but one dimension of integers is an error."""
    first = io.BytesIO(file.read(1 << 12))
    try:
        version = np.lib.format.read_magic(first)
        shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(first)
    except ValueError as e:
        raise ArtifactError(f"not an array: {e}") from e
    if len(shape) != 1 or dtype.kind not in "iu":
        raise ArtifactError(f"an array of shape {shape} and type {dtype} isn't one of ids")
    return Header(dtype.str, shape[0], first.tell())


@dataclass
class Range(InputPartition):
    path: str
    header: Header
    start: int
    end: int
    position: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, range_ids: int):
        self.path, self.range_ids = path, range_ids

    def partitions(self) -> list[Range]:
        store, base = _store(self.path)
        info = store.get_file_info(base)
        if info.type == arrow_fs.FileType.NotFound:
            raise ArtifactError(f"there is no array at {self.path}")
        names = [base]
        if info.type == arrow_fs.FileType.Directory:
            if store.get_file_info(f"{base}/{MANIFEST}").type != arrow_fs.FileType.File:
                raise ArtifactError(f"the array at {self.path} was never finished")
            with store.open_input_stream(f"{base}/{MANIFEST}", compression=None) as file:
                names = [f"{base}/{name}" for name in json.loads(file.read())["parts"]]
        out, position = [], 0
        for name in names:
            with store.open_input_file(name) as file:
                head = _header(file)
            out += [Range(name, head, a, min(a + self.range_ids, head.count), position + a) for a in range(0, head.count, self.range_ids)]
            position += head.count
        return out or [Range("", Header("<i4", 0, 0), 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        store, _ = _store(self.path)
        dtype = np.dtype(partition.header.dtype)
        with store.open_input_file(partition.path) as file:
            file.seek(partition.header.begin + partition.start * dtype.itemsize)
            for at in range(partition.start, partition.end, ROW_IDS):
                n = min(ROW_IDS, partition.end - at)
                values = np.frombuffer(file.read(n * dtype.itemsize), dtype)
                if len(values) < n:
                    raise ArtifactError(f"{partition.path} ends before its last item")
                if values.max() > 0x7FFFFFFF or values.min() < -0x80000000:
                    raise ArtifactError(f"{partition.path} has ids beyond 32 bits")
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([partition.position + at - partition.start]), ids], names=["position", "ids"])


@dataclass
class Parts(WriterCommitMessage):
    parts: list[tuple[int, int, str]]


class ArrayWriter(DataSourceArrowWriter):
    """Takes rows (position, ids) in order within each partition."""

    def __init__(self, path: str, dtype: str, part_ids: int):
        self.path, self.dtype, self.part_ids = path, np.dtype(dtype), part_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        store, base = _store(self.path)
        parts, held, first, n = [], [], None, 0

        def flush() -> None:
            nonlocal held, first, n
            if n:
                name = f"part-{first:020d}-{uuid.uuid4().hex}.npy"
                store.create_dir(base, recursive=True)
                with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(self.dtype), "fortran_order": False, "shape": (n,)})
                    for values in held:
                        out.write(values.tobytes())
                parts.append((first, n, name))
            held, first, n = [], None, 0

        for batch in iterator:
            for position, ids in zip(batch.column("position").to_pylist(), batch.column("ids"), strict=True):
                plain = ids.values.to_numpy(zero_copy_only=False)
                values = plain.astype(self.dtype)
                if (values != plain).any():
                    raise ArtifactError(f"an id at {position} or after doesn't fit into {self.dtype}")
                if n and position != first + n or n >= self.part_ids:
                    flush()
                first = position if first is None else first
                held.append(values)
                n += len(values)
        flush()
        return Parts(parts)

    def commit(self, messages) -> None:
        store, base = _store(self.path)
        parts = sorted(tuple(p) for m in messages if m for p in m.parts)
        end = 0
        for first, n, _ in parts:
            if first != end:
                raise ArtifactError(f"the array has {'a gap' if first > end else 'ids twice'} at {min(first, end)}")
            end = first + n
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"count": end, "dtype": self.dtype.str, "parts": [name for _, _, name in parts]}).encode())

    def abort(self, messages) -> None:
        """Parts of no manifest are never read."""


class ArraySource(DataSource):
    """Format ``npy``; options: path, range_ids (of a partition when read), and for writing dtype (uint16 by default) and part_ids."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "position long, ids array<int>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], int(self.options.get("range_ids", RANGE_IDS)))

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], self.options.get("dtype", "uint16"), int(self.options.get("part_ids", PART_IDS)))


def write_array(stream: DataFrame, path: str, vocabulary: int, part_ids: int = PART_IDS) -> None:
    """Write a stream (ids, offset) as an array in a new folder: parts of it, each an ``.npy`` file by itself, and their order."""
    stream.sparkSession.dataSource.register(ArraySource)
    store, base = _store(path)
    if store.get_file_info(base).type != arrow_fs.FileType.NotFound:
        raise ArtifactError(f"there is something at {path} already")
    rows = stream.select(F.col("offset").alias("position"), "ids").repartitionByRange("position").sortWithinPartitions("position")
    rows.write.format("npy").option("path", path).option("dtype", streams.array_type(vocabulary)).option("part_ids", part_ids).mode("append").save()


def read_array(spark: SparkSession, path: str, range_ids: int = RANGE_IDS) -> DataFrame:
    """(position, ids) of an array file or folder, some ids a row. A missing one is an error."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("npy").option("path", path).option("range_ids", range_ids).load()


def read_splits(spark: SparkSession, folder: str, block: int, names: tuple[str, str] = ("train", "val")) -> tuple[DataFrame, DataFrame]:
    """Both splits' streams (key, ids, offset) of a folder; each a file or a folder of parts. A missing one is an error, and so is one too short for a window."""
    store, base = _store(folder)
    out = []
    for name in names:
        found = [p for p in (f"{name}.npy", name) if store.get_file_info(f"{base}/{p}").type != arrow_fs.FileType.NotFound]
        if not found:
            raise ArtifactError(f"{folder} has no {name} array")
        rows = read_array(spark, f"{folder}/{found[0]}")
        stream = rows.select(F.col("position").alias("key"), "ids", F.col("position").alias("offset"))
        streams.length(stream, block)
        out.append(stream)
    return out[0], out[1]


# digests


@dataclass
class Some(InputPartition):
    files: list[tuple[str, int, float]]


def _dealt(path: str, suffix: str) -> list[Some]:
    """The files, small ones together."""
    out, size = [Some([])], 0
    for f in _files(path, suffix):
        if out[-1].files and size + f.size > TASK_BYTES:
            out.append(Some([]))
            size = 0
        out[-1].files.append((f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0))
        size += f.size
    return out


class DigestReader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[Some]:
        return _dealt(self.path, self.suffix)

    def read(self, partition: Some) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, size, _ in partition.files:
            digest, dtype, count, error = hashlib.sha256(), None, None, None
            with store.open_input_file(path) as file:
                if path.endswith(".npy"):
                    try:
                        head = _header(file)
                        dtype, count = np.dtype(head.dtype).name, head.count
                    except ArtifactError as e:
                        error = str(e)
                    file.seek(0)
                while part := file.read(READ_BYTES):
                    digest.update(part)
            yield path, path.rpartition("/")[2], size, digest.hexdigest(), dtype, count, error


class DigestSource(DataSource):
    """Format ``digests``; options: path of a file or folder, suffix."""

    @classmethod
    def name(cls) -> str:
        return "digests"

    def schema(self) -> str:
        return "path string, name string, size_bytes long, sha256 string, dtype string, token_count long, error string"

    def reader(self, schema) -> DigestReader:
        return DigestReader(self.options["path"], self.options.get("suffix", ""))


def digests(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """A row for each file: its digest and size, and an array's type and count, or why it isn't one. No files are an error."""
    spark.dataSource.register(DigestSource)
    return spark.read.format("digests").option("path", path).option("suffix", suffix).load()


# checkpoints


class _Dict(dict):
    """A mapping that takes attributes, as ordered ones do."""


class _Tensor:
    def __init__(self, storage, offset, size, *rest):
        self.shape, self.dtype = [int(n) for n in size], _DTYPES.get(storage, str(storage))


class _Named:
    """Stands for anything that a file names; making one does nothing."""

    def __init__(self, *args, **kwargs):
        pass

    def __setstate__(self, state):
        pass

    def __setitem__(self, key, value):
        pass

    def append(self, value):
        pass

    def extend(self, values):
        pass


#: Element types by the storage that holds them.
_DTYPES = {
    "BFloat16Storage": "bfloat16", "BoolStorage": "bool", "ByteStorage": "uint8", "CharStorage": "int8", "DoubleStorage": "float64",
    "FloatStorage": "float32", "HalfStorage": "float16", "IntStorage": "int32", "LongStorage": "int64", "ShortStorage": "int16",
}


class _Structure(pickle.Unpickler):
    """Reads what a pickled mapping is made of. Names give stand-ins, never modules."""

    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "OrderedDict"):
            return _Dict
        if module == "torch._utils" and name.startswith("_rebuild_tensor"):
            return _Tensor
        if module == "torch._utils" and name.startswith("_rebuild_parameter"):
            return lambda data, *rest: data
        return type(name, (_Named,), {})

    def persistent_load(self, pid):
        kind = pid[1] if isinstance(pid, tuple) and len(pid) > 1 else None
        return getattr(kind, "__name__", str(kind))


def structure(file) -> Mapping:
    """The mapping that a checkpoint's archive records, with stand-ins for all but plain values and tensors' shapes."""
    try:
        with zipfile.ZipFile(file) as archive:
            records = [i for i in archive.infolist() if i.filename.rpartition("/")[2] == "data.pkl"]
            if len(records) != 1:
                raise ArtifactError("the archive has no record of its structure")
            if records[0].file_size > STRUCTURE_BYTES:
                raise ArtifactError("the structure is too large")
            found = _Structure(io.BytesIO(archive.read(records[0]))).load()
    except ArtifactError:
        raise
    except Exception as e:  # whatever a broken file does
        raise ArtifactError(f"unreadable: {type(e).__name__}") from e
    if not isinstance(found, Mapping):
        raise ArtifactError(f"holds a {type(found).__name__}, no mapping")
    return found


def _tensors(value, name: str = "") -> Iterator[dict]:
    if isinstance(value, _Tensor):
        yield {"name": name, "shape": value.shape, "dtype": value.dtype}
    elif isinstance(value, Mapping):
        for k, v in value.items():
            yield from _tensors(v, f"{name}.{k}" if name else str(k))


def _integer(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63 else None


class CheckpointReader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[Some]:
        return _dealt(self.path, self.suffix)

    def read(self, partition: Some) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, size, mtime in partition.files:
            try:
                with store.open_input_file(path) as file:
                    found = structure(file)
            except ArtifactError as e:
                yield path, size, mtime, str(e), None, None, False, False, False, None, None, None, [], []
                continue
            config, resume = found.get("config"), found.get("resume_state")
            plain = {str(k): json.dumps(v) for k, v in config.items() if isinstance(v, (str, int, float, bool, type(None)))} if isinstance(config, Mapping) else None
            best = found.get("best_val")
            yield (
                path, size, mtime, None, _integer(found.get("checkpoint_version")), found["checkpoint_kind"] if isinstance(found.get("checkpoint_kind"), str) else None,
                isinstance(found.get("model"), Mapping), isinstance(found.get("optimizer"), Mapping), isinstance(config, Mapping), _integer(found.get("iter")),
                float(best) if isinstance(best, (int, float)) and not isinstance(best, bool) else None, plain, sorted(map(str, resume)) if isinstance(resume, Mapping) else [], list(_tensors(found.get("model", {}))),
            )


class CheckpointSource(DataSource):
    """Format ``checkpoints``; options: path of a file or folder, suffix (.pt by default)."""

    @classmethod
    def name(cls) -> str:
        return "checkpoints"

    def schema(self) -> str:
        return (
            "path string, size_bytes long, mtime double, unreadable string, version long, kind string, has_model boolean, has_optimizer boolean, has_config boolean, iter long, best_val double, "
            "config map<string,string>, resume array<string>, tensors array<struct<name string, shape array<long>, dtype string>>"
        )

    def reader(self, schema) -> CheckpointReader:
        return CheckpointReader(self.options["path"], self.options.get("suffix", ".pt"))


def checkpoints(spark: SparkSession, path: str, suffix: str = ".pt") -> DataFrame:
    """A row for each checkpoint file: its metadata, plain settings as JSON values, and tensors. A corrupt file is a row that says why; no files are an error."""
    spark.dataSource.register(CheckpointSource)
    return spark.read.format("checkpoints").option("path", path).option("suffix", suffix).load()


def tensors(catalog: DataFrame) -> DataFrame:
    """(path, name, shape, dtype) of every tensor of the catalog's models."""
    return catalog.select("path", F.explode("tensors").alias("t")).select("path", "t.*")


#: Fixed value: the tensor whose shape tells a vocabulary's size and a model's width.
EMBEDDING = "token_embedding.weight"


def inferred(catalog: DataFrame) -> DataFrame:
    """``catalog`` with vocab_size and n_embd as the tensors say (else the settings), and ``corrected``: which settings they overrule."""
    shape = F.get(F.filter("tensors", lambda t: t["name"] == EMBEDDING), F.lit(0))["shape"]
    stated = lambda name: F.try_element_at("config", F.lit(name)).try_cast("long")
    sizes: dict[str, Column] = {"vocab_size": F.get(shape, F.lit(0)), "n_embd": F.get(shape, F.lit(1))}
    wrong = [F.when(c.isNotNull() & ~c.eqNullSafe(stated(n)), F.concat(F.lit(f"{n} "), F.coalesce(stated(n).cast("string"), F.lit("none")), F.lit(" -> "), c.cast("string"))) for n, c in sizes.items()]
    return catalog.select("*", *[F.coalesce(c, stated(n)).alias(n) for n, c in sizes.items()], F.array_compact(F.array(*wrong)).alias("corrected"))

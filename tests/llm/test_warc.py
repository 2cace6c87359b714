import gzip
import hashlib

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from gristmill.llm import warc

PAGES = "page_id long, url string, html string, digest string, last long"
BIG = "é" * 900


def rows():
    out = [(1, "http://a/%0A\r\nb", BIG), (5, None, BIG), (3, "u", BIG), (5, "again", BIG), (None, "n", BIG), (7, "s", "small"), (8, "s", "small"), (9, "e", ""), (10, "z", None), (11, "long", "xy" * 300_000), (12, "b", BIG + "\r\n\r\n"), (None, None, None)]
    return [(*r, "d", 0) for r in out]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(), PAGES).repartition(3)
    path = warc.archive(df, f"file://{tmp_path}/w")
    got = warc.read(spark, path).collect()
    full = {(r[0], r[1]): (r[2] or "").encode() for r in rows()}
    assert len(got) == len(full)
    for r in got:
        data = full[r.page_id, r.target_uri]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        again = data == BIG.encode() and r.page_id != 5
        assert (r.warc_type, r.refers_to) == (("revisit", 5) if again else ("response", None))
        assert (r.payload and bytes(r.payload)) == (None if again else data) or data == b""
    # a standard gzip reader reads it too
    for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/w")):
        if f.path.endswith(".gz"):
            assert gzip.open(f.path).read().startswith(b"WARC/1.1\r\n")


def test_predicates_reach_the_reader(spark, tmp_path, monkeypatch):
    path = warc.archive(spark.createDataFrame(rows(), PAGES), f"file://{tmp_path}/w")
    some = warc.read(spark, path, payload=False).where((F.col("warc_type") == "revisit") & F.col("page_id").isin(1, 3, 5))
    plan = some._jdf.queryExecution().executedPlan().toString()
    # Spark itself compares neither column any more
    assert "BatchScan" in plan and "= revisit" not in plan and "IN (1,3,5)" not in plan, plan
    assert "= http" in warc.read(spark, path).where("upper(target_uri) = 'http'")._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.page_id for r in some.collect()) == [1, 3]
    reader = warc.Reader(path, payload=True)
    rest = list(reader.pushFilters([warc.EqualTo(("warc_type",), "revisit"), warc.In(("page_id",), (1,))]))
    assert rest == []
    monkeypatch.setattr(warc.Inflater, "payload", lambda *a: 1 / 0)  # unwanted payloads aren't decoded
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [1]


def test_empty_and_unlisted_files(spark, tmp_path):
    path = warc.archive(spark.createDataFrame([], PAGES), f"file://{tmp_path}/w")
    (tmp_path / "w" / "left-by-a-lost-task.warc.gz").write_bytes(b"junk")
    assert warc.read(spark, path).collect() == []


def test_members_without_a_stated_length(tmp_path):
    row = {"page_id": 1, "url": "u", "html": "x" * 50_000, "digest": hashlib.sha1(b"x" * 50_000).hexdigest(), "payload_bytes": 50_000, "warc_type": "response", "refers_to": None}
    data = [gzip.compress(warc.record_bytes(row | {"page_id": i})) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(data))
    reader = warc.Reader(str(tmp_path), payload=True)
    found = list(reader.read(warc.Range("a.warc.gz", 0, sum(map(len, data)))))
    assert [r[0] for r in found] == [0, 1, 2] and all(len(r[6]) == 50_000 for r in found)

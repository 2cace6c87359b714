import random
import time

import pytest

from gristmill.operators import sessions
from gristmill.streaming import sessions as live

LINES = ["/temp 0.5", "/topk 9", "/max 33", "/raw", "/history off", "/history on", "hello", "", None, "/reset", "/quit", "/preset x", "/temp no", "how are you"]
EVENTS = "session long, seq long, line string"


@pytest.fixture
def store(spark):
    settings = live.STORE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def ran(spark, folder, checkpoint, out, idle=3600):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))

    def kept(batch, number):
        batch.write.mode("append").parquet(str(out))

    query = live.live(stream, idle_seconds=idle).writeStream.outputMode("update").option("checkpointLocation", str(checkpoint)).foreachBatch(kept).trigger(availableNow=True).start()
    assert query.awaitTermination(90)


def test_streamed_sessions_equal_the_fold_over_a_restart(spark, tmp_path, store):
    draw = random.Random(3)
    rows = [(s, i, draw.choice(LINES)) for s in range(6) for i in range(12)]
    folder, checkpoint, out = (tmp_path / n for n in ("in", "state", "out"))
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == part], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        if part:
            ran(spark, folder, checkpoint, out)  # the second run begins from the first one's checkpoint
    want = sorted(map(tuple, sessions.folded(spark.createDataFrame(rows, EVENTS)).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(out)).collect())) == want


def test_idle_sessions_leave_the_state(spark, tmp_path, store):
    folder, checkpoint, out = (tmp_path / n for n in ("in", "state", "out"))
    for k, session in enumerate((1, 2, 1)):
        spark.createDataFrame([(session, k, "/max 7" if k == 0 else "again")], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        ran(spark, folder, checkpoint, out, idle=1)
        time.sleep(1.5)
    got = {r.seq: r.max_new_tokens for r in spark.read.parquet(str(out)).collect()}
    assert got == {0: 7, 1: 120, 2: 120}

"""Streams of documents and of chat commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def distinct_documents(stream: DataFrame, at: str | None = None, within: str = "1 day") -> DataFrame:
    """A stream's documents, the first of each canonical text.

    With the column of times ``at``, copies are told for ``within`` that time, and older texts leave the state. Without, all texts are remembered, which only a stream that ends can afford.
    """
    marked = stream.withColumn("fingerprint", T.digest(T.normalize(F.col("text"))))
    return marked.dropDuplicates(["fingerprint"]) if at is None else marked.withWatermark(at, within).dropDuplicatesWithinWatermark(["fingerprint"])


def run_once(spark: SparkSession, source: str, schema, name: str, checkpoint: str, at: str | None = None, within: str = "1 day") -> DataFrame:
    """All that a folder of Parquet files holds now, as a stream, into a table in memory."""
    query = distinct_documents(spark.readStream.schema(schema).parquet(source), at, within).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def session_settings(events: DataFrame) -> DataFrame:
    """(session, setting, value): the latest value of each setting that a session's commands (session, seq, setting, value) gave."""
    return events.groupBy("session", "setting").agg(F.max_by("value", "seq").alias("value"))

"""Queries that run a stream over the driver's tables to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselog.operators import logs as L
from tesselog.plans.log_queries import CALLS, EVENTS, REPLAY, log_events, raw
from tesselog.session import materialise, shared_dir, table
from tesselog.streaming import live


def _run(df: DataFrame, mode: str) -> DataFrame:
    """Drain a stream; each micro-batch becomes a folder of the result, whose number is ``batch``."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/tesselog/stream-{uuid.uuid4().hex}"
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    job = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    job.awaitTermination()
    if job.exception() is not None:
        raise job.exception()
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/out")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a stream over the events files."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    out = _run(live.tumbling(stream, "1 hour"), "update")
    last = out.groupBy("event_type", "start").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select("event_type", "start", "x.*").select("event_type", F.col("start").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 4).alias("total"))


def stream_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings of each session after all events have streamed past; a call without any later tool event still waits."""
    events = log_events(spark, sf_dir).select(
        "session", "event_index", F.col("ts").try_cast("timestamp").alias("at"), "kind", "tool", "is_error", L.returned_chunks(F.col("output"), F.coalesce("output_kind", F.lit(""))).alias("returned")
    )
    saved = materialise(events, "events")
    stream = spark.readStream.schema(saved.schema).parquet(saved._tesselog_path)
    out = _run(live.live_savings(stream), "update")
    return out.groupBy("session").agg(F.max_by(F.struct("events", "searches", "chunks", "saved"), "batch").alias("x")).select("session", "x.*")


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay totals of each session after all events have streamed past."""
    ev = log_events(spark, sf_dir, narrow_usage=True)
    rows = L.replay(ev).join(ev.select("session", "event_index", F.col("ts").try_cast("timestamp").alias("at")), ["session", "event_index"]).select("session", "event_index", "at", "kind", "replaceable", "actual")
    saved = materialise(rows, "replayed")
    stream = spark.readStream.schema(saved.schema).parquet(saved._tesselog_path)
    out = _run(live.live_replay(stream), "update")
    return out.groupBy("session").agg(F.max_by(F.struct("events", "replaced", "actual", "counterfactual"), "batch").alias("x")).select("session", "x.*")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all log lines, numbered by a stream over them."""
    lines = raw(spark, sf_dir).select("file", F.lit(0).alias("generation"), F.col("line_no").cast("bigint").alias("start"), "value")
    saved = materialise(lines, "lines")
    stream = spark.readStream.schema(saved.schema).parquet(saved._tesselog_path)
    return _run(live.live_events(stream), "append").select("session", "event_index", F.col("line_no").cast("int").alias("line_no"), "kind", "tool", "text")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_savings, stream_replay, stream_events)}
SQL = {
    "stream_replay": f"WITH {EVENTS}, {REPLAY} SELECT session, count(*) AS events, count(*) FILTER (replaced) AS replaced, sum(actual)::BIGINT AS actual, sum(counterfactual)::BIGINT AS counterfactual FROM rp GROUP BY 1",
    "stream_events": f"WITH {EVENTS} SELECT session, event_index, line_no, kind, tool, text FROM ev",
    "stream_tumbling": "SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_savings": f"""WITH {EVENTS}, {CALLS.replace("AS chunks FROM tl", "AS chunks, nk FROM tl")}, c AS (SELECT session, count(*) AS searches, sum(chunks)::BIGINT AS chunks, sum(greatest(0, 7500 - chunks * 300))::BIGINT AS saved FROM calls WHERE nk IS NOT NULL GROUP BY 1)
SELECT session, events, coalesce(searches, 0) AS searches, coalesce(chunks, 0) AS chunks, coalesce(saved, 0) AS saved FROM (SELECT session, count(*) AS events FROM ev GROUP BY 1) LEFT JOIN c USING (session)""",
}

"""Streams that are stopped, go on, and forget."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tesselog.operators import logs as L
from tesselog.sources.tail import TailReader, TailSource
from tesselog.streaming import live

EV = "session string, event_index bigint, at timestamp, kind string, tool string, is_error boolean, returned bigint, replaceable boolean, actual bigint"


def test_a_new_reader_reads_nothing_twice(tmp_path):
    """Offsets of one reader, after a truncation, taken up by another one."""
    log = tmp_path / "a.jsonl"
    log.write_bytes(b"one\ntwo\n")
    first = TailReader(str(tmp_path / "*.jsonl"))
    a = first.latestOffset()
    first.partitions(first.initialOffset(), a)
    log.write_bytes(b"new\n")
    b = first.latestOffset()
    assert [(p.generation, p.start, p.end) for p in first.partitions(a, b)] == [(1, 0, 4)]
    second = TailReader(str(tmp_path / "*.jsonl"))
    c = second.latestOffset()
    assert second.partitions(b, c) == []
    with log.open("ab") as f:
        f.write(b"more\n")
    d = second.latestOffset()
    assert [(p.generation, p.start, p.end) for p in second.partitions(c, d)] == [(1, 4, 9)]
    log.write_bytes(b"other and longer than all before it\n")  # cut and written anew between two readers
    third = TailReader(str(tmp_path / "*.jsonl"))
    e = json.loads(json.dumps(third.latestOffset()))
    assert [(p.generation, p.start) for p in third.partitions(d, e)] == [(2, 0)]


def test_a_stopped_stream_goes_on_without_a_doubled_line(spark, tmp_path):
    log = tmp_path / "logs" / "a.jsonl"
    log.parent.mkdir()
    spark.dataSource.register(TailSource)

    def run():
        lines = spark.readStream.format("log_tail").load(str(tmp_path / "logs" / "*.jsonl"))
        job = live.live_events(lines).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            job.processAllAvailable()
        finally:
            job.stop()

    said = lambda *texts: "".join(json.dumps({"type": "user", "message": {"content": t}}) + "\n" for t in texts)
    log.write_text(said("a", "b") + '{"cut')
    run()
    log.write_text(said("a", "b", "c"))
    run()
    log.write_text(said("z"))  # cut and written anew
    run()
    run()
    with log.open("a") as f:
        f.write(said("y"))
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("generation", "event_index").collect()
    assert [(r.generation, r.event_index, r.text) for r in rows] == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 0, "z"), (1, 1, "y")]
    assert {os.path.basename(r.session) for r in rows} == {"a.jsonl"}


def batches(spark, tmp_path, fold, parts, **options):
    """What ``fold`` gives out batch by batch over the parts, a file each."""
    source = tmp_path / "events"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, EV).coalesce(1).write.mode("append").parquet(str(source))
        for name in os.listdir(source):
            if name.endswith(".parquet") and not name.startswith("part-n"):
                os.rename(source / name, source / f"part-n{i}.parquet")
    out = []
    stream = spark.readStream.schema(EV).option("maxFilesPerTrigger", 1).parquet(str(source))
    job = fold(stream, **options).writeStream.outputMode("update").foreachBatch(lambda df, _: out.append({r.session: r for r in df.collect()})).trigger(availableNow=True).start()
    job.awaitTermination()
    return out


def at(minute):
    import datetime

    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)


def use(i, tool="search_chunks", session="s", minute=0, **f):
    return (session, i, at(minute), "tool_use", tool, None, None, f.get("replaceable", False), 0)


def result(i, returned=2, error=None, session="s", minute=0, actual=100):
    return (session, i, at(minute), "tool_result", None, error, returned, False, actual)


def test_a_search_open_at_the_end_of_a_batch(spark, tmp_path):
    got = batches(spark, tmp_path, live.live_savings, [[use(0), result(1), use(2)], [result(3, 9), use(4), use(5, "Read")], [result(6), use(7), result(8, error=True)]])
    assert [(r.events, r.searches, r.chunks, r.saved) for r in (b["s"] for b in got if "s" in b)] == [(3, 1, 2, 6900), (6, 3, 7, 20400), (9, 4, 7, 27900)]


def test_replay_over_batches_equals_the_whole(spark, tmp_path):
    rows = [use(0, "Read", replaceable=True), use(1, "Task"), result(2, actual=7000), result(3, actual=50), use(4, "Grep", replaceable=True), use(5, "Bash"), result(6, actual=10), result(7, actual=20)]
    got = batches(spark, tmp_path, live.live_replay, [rows[:2], rows[2:5], rows[5:6], rows[6:]])
    last = [b["s"] for b in got if "s" in b][-1]
    assert (last.events, last.replaced, last.actual, last.counterfactual) == (8, 2, 7080, 7080 - 7010 + 3000)


def test_an_idle_session_is_given_out_and_forgotten(spark, tmp_path):
    parts = [[use(0), result(1)], [use(0, session="t", minute=600), result(1, session="t", minute=600)], [use(2, session="t", minute=601)], [use(0, minute=602), result(1, minute=602)]]
    got = batches(spark, tmp_path, live.live_savings, parts, idle="1 hour", late="1 minute")
    mine = [(r.searches, r.ended) for b in got for r in b.values() if r.session == "s"]
    assert mine[0] == (1, False) and (1, True) in mine and mine[-1] == (1, False)


def test_numbers_of_events_equal_the_batch_form(spark, tmp_path):
    value = lambda i: json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": f"t{i}"}, {"type": "tool_use", "name": "Read", "input": {}}][: 1 + i % 2]}})
    lines = spark.createDataFrame([("f", 0, i * 10, value(i)) for i in range(7)] + [("g", 0, 0, "{broken")], "file string, generation int, start bigint, value string")
    want = L.events(lines.select("file", F.col("start").alias("line_no"), "value"))
    lines.coalesce(1).write.parquet(str(tmp_path / "lines"))
    job = live.live_events(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "lines"))).writeStream.format("memory").queryName("numbered").trigger(availableNow=True).start()
    job.awaitTermination()
    key = ["session", "event_index", "line_no", "kind", "text", "tool"]
    assert sorted(map(str, spark.table("numbered").select(key).collect())) == sorted(map(str, want.select(key).collect()))


@pytest.mark.parametrize("fold", [live.live_savings, live.live_replay])
def test_empty_stream(spark, tmp_path, fold):
    assert batches(spark, tmp_path, fold, [[]]) in ([], [{}])

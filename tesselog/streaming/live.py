"""Live forms of the log operators: event-time windows, numbered events, and savings and replay per session with state that ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesselog.operators import logs

LATE = "10 minutes"


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events with ``ts`` as a timestamp (UTC where it has no zone) and, for streams, a watermark."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late and events.isStreaming else out


def tumbling(events: DataFrame, width: str, late: str = LATE) -> DataFrame:
    """event_type, start, n, total of each window; works on batches and streams alike."""
    grouped = timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select("event_type", F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """user_id, start, n of each run of events of a user without a pause of ``gap``."""
    grouped = timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "n")


# -- folds over session events with bounded state ----------------------------------------------------
IDLE, LATEST = "24 hours", "24 hours"
TOTALS = ("events", "searches", "chunks", "saved")


def _stateful(events: DataFrame, output: list[str], carried: list[str], step: Callable[[pd.DataFrame, dict], dict], idle: str, late: str) -> DataFrame:
    """Per session the columns of ``output`` and ``carried``, folded batch by batch by ``step``.

    ``step`` takes the rows of a batch in order and the numbers so far, and
    returns the new ones.  Events carry their time in ``at``; those later than
    ``late`` behind the newest one are dropped.  A session whose last event lies
    ``idle`` behind that is given out once more, with ``ended`` true, and
    forgotten; what comes for it later is counted from nought.
    """
    names = [*output, *carried]
    state = ", ".join(f"{n} bigint" for n in names)
    n, unit = idle.split()
    wait = int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(names, held.get)) if held.exists else dict.fromkeys(names, 0)
        if held.hasTimedOut:
            held.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("event_index", kind="stable")
            known = step(rows, known)
            held.update(tuple(int(known[n]) for n in names))
            last = rows["at"].max()
            held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs(), 0 if pd.isna(last) else int(last.timestamp() * 1000)) + wait)
        yield pd.DataFrame({"session": [key[0]], **{n: [int(known[n])] for n in output}, "ended": [not held.exists]})

    schema = "session string, " + ", ".join(f"{n} bigint" for n in output) + ", ended boolean"
    return events.withWatermark("at", late).groupBy("session").applyInPandasWithState(run, schema, state, "update", GroupStateTimeout.EventTimeTimeout)


def live_savings(events: DataFrame, files: int = 5, file_tokens: int = 1500, chunk_tokens: int = 300, tools: tuple[str, ...] = ("search_chunks", "find_related"), idle: str = IDLE, late: str = LATEST) -> DataFrame:
    """Running savings of each session over a stream of events (session, event_index, at, kind, tool, is_error, returned).

    A search is settled by the tool event behind it: by what it returned if
    that is a result without an error, else by nothing.  The last search of a
    batch stays open in the state (``waits``) until that event comes.
    """

    def step(rows: pd.DataFrame, known: dict) -> dict:
        acts = rows[rows["kind"].isin(("tool_use", "tool_result"))]
        result = (acts["kind"] == "tool_result").to_numpy()
        asks = np.concatenate(([bool(known["waits"])], ~result & acts["tool"].isin(tools).to_numpy()))
        good = result & ~(acts["is_error"] == True).to_numpy()  # noqa: E712 - None counts as no error
        chunks = np.clip(np.where(good, acts["returned"].fillna(0).to_numpy(), 0), 0, files)[asks[:-1]]
        saved = np.maximum(0, files * file_tokens - chunks * chunk_tokens)
        more = dict(zip(TOTALS, (len(rows), len(chunks), chunks.sum(), saved.sum())))
        return {n: known[n] + more[n] for n in TOTALS} | {"waits": asks[-1]}

    return _stateful(events, list(TOTALS), ["waits"], step, idle, late)


def live_replay(events: DataFrame, search_tokens: int = 1500, idle: str = IDLE, late: str = LATEST) -> DataFrame:
    """Running replay totals of each session over a stream of events (session, event_index, at, kind, replaceable, actual).

    A result is replaced if a replaceable call came since the result before
    it; whether one did at the end of a batch is kept in the state.
    """
    output = ["events", "replaced", "actual", "counterfactual"]

    def step(rows: pd.DataFrame, known: dict) -> dict:
        result = (rows["kind"] == "tool_result").to_numpy()
        calls = np.cumsum((rows["replaceable"] == True).to_numpy()) + known["waits"]  # noqa: E712
        at = np.flatnonzero(result)
        upto = np.concatenate(([0], calls[at]))
        swapped = np.diff(upto) > 0
        actual = rows["actual"].fillna(0).to_numpy()
        more = (len(rows), swapped.sum(), actual.sum(), actual.sum() - actual[at][swapped].sum() + search_tokens * swapped.sum())
        waits = (calls[-1] if len(calls) else known["waits"]) > upto[-1]
        return {n: known[n] + m for n, m in zip(output, more)} | {"waits": waits}

    return _stateful(events, output, ["waits"], step, idle, late)


def live_events(lines: DataFrame) -> DataFrame:
    """Events of a stream of log lines (file, generation, start, value), numbered on and on within each file.

    The state of a file is its next number; one that was cut and written anew
    is another generation and begins at 0.
    """
    rows = logs.event_rows(lines.select(F.concat_ws("\0", "file", F.col("generation").cast("string")).alias("file"), F.col("start").alias("line_no"), "value"))
    names = rows.columns
    schema = rows.drop("file", "sub").schema

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        first = held.get[0] if held.exists else 0
        out = pd.concat(list(batches))[names].sort_values(["line_no", "sub"], kind="stable")
        held.update((first + len(out),))
        session, _, generation = key[0].rpartition("\0")
        yield out.drop(columns=["file", "sub"]).assign(session=session, generation=int(generation), event_index=range(first, first + len(out)))

    out = T.StructType([*schema.fields, T.StructField("session", T.StringType()), T.StructField("generation", T.LongType()), T.StructField("event_index", T.LongType())])
    return rows.groupBy("file").applyInPandasWithState(run, out, "next bigint", "append", GroupStateTimeout.NoTimeout)

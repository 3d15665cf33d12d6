import json

import pytest

from tesselog.operators import drift

SCHEMA = "record_id bigint, producer string, file_seq int, line_no int, payload string, received_at timestamp, path string"


def table(spark, *rows):
    return spark.createDataFrame([(i, p, s, 1, x if isinstance(x, (str, type(None))) else json.dumps(x), None, "z") for i, (p, s, x) in enumerate(rows)], SCHEMA)


def report(df):
    return sorted(tuple(r) for r in drift.changes(df).collect())


def test_each_change(spark):
    df = table(
        spark,
        ("p", 1, {"input_tokens": 1, "ts": "x", "flags": ["a"], "gone": 1}),
        ("p", 1, {"late": None, "empty": {}}),
        ("p", 2, '{"cut'),
        ("p", 3, {"usage": {"input_tokens": "1"}, "time": {"at": "x"}, "flags": "a", "tier": "b"}),
        ("q", 1, {"a": 1}),
        ("q", 2, {"a": True}),
    )
    assert report(df) == [
        ("p", 3, "added", "", "tier"),
        ("p", 3, "removed", "gone", ""),
        ("p", 3, "renamed", "input_tokens", "usage.input_tokens"),
        ("p", 3, "renamed", "ts", "time.at"),
        ("p", 3, "retyped", "flags", "flags"),
        ("p", 3, "retyped", "input_tokens", "usage.input_tokens"),
        ("q", 2, "retyped", "a", "a"),
    ]


def test_nulls_empty_and_repeats(spark):
    df = table(spark, (None, 1, {"a": 1}), ("p", None, {"a": 1}), ("p", 1, None), ("p", 1, ""), ("p", 2, "[]"), ("p", 3, {"a": 1}), ("p", 3, {"a": 1}), ("p", 4, {}))
    assert report(df) == [("p", 4, "removed", "a", "")]
    assert report(df.limit(0)) == []


@pytest.mark.parametrize(
    "paths",
    [
        ("input_tokens", "tokensIn", "inputTokens", "tokens_in", "usage.input_tokens", "message.usage.input_tokens"),
        ("output_tokens", "tokensOut", "usage.output_tokens"),
        ("model", "model.name", "modelName", "model_id", "message.model"),
        ("ts", "timestamp", "createdAt", "time.at"),
        ("cost_usd", "costUsd", "billing.usd"),
        ("latencyMs", "latency_ms", "timing.latency_ms"),
        ("retries", "retry_count"),
        ("isError", "is_error", "status.is_error"),
        ("cacheReadTokens", "cache_read_tokens", "usage.cache_read"),
        ("session_id", "sessionId", "session.id"),
        ("stop_reason", "stopReason"),
        ("service_tier", "tier"),
        ("span_id", "trace.span"),
        ("flags", "labels.flags"),
    ],
)
def test_one_quantity(paths):
    assert len({drift.quantity(p) for p in paths}) == 1


def test_lattice_is_a_join():
    shapes = list(drift._SQL)
    for a in shapes:
        for b in shapes:
            assert drift.join_shapes(a, b) == drift.join_shapes(b, a)
            assert drift.join_shapes(a, drift.join_shapes(a, b)) == drift.join_shapes(a, b)


def test_consistent_table(spark):
    df = table(
        spark,
        ("p", 1, {"request_id": "r1", "tokensIn": "5", "isError": "false", "ts": 0, "flags": ["a", "b"]}),
        ("p", 2, {"request_id": "r1", "input_tokens": 6}),
        ("p", 2, {"request_id": "r2", "usage": {"input_tokens": 7}, "is_error": 1, "ts": "2025-01-01T00:00:00Z", "flags": "a, c"}),
        ("p", 2, "broken"),
    )
    out = drift.consistent(df)
    assert dict(out.dtypes)["input"] == "bigint" and dict(out.dtypes)["error"] == "boolean" and dict(out.dtypes)["time"] == "timestamp"
    got = {r.request: (r.input, r.error, r.flag) for r in out.collect()}
    assert got == {"r1": (5, False, ["a", "b"]), "r2": (7, True, ["a", "c"])}
    assert drift.consistent(df.limit(0)).count() == 0


def test_another_quantity_is_no_rename(spark):
    """user_id gives way to user_name: whatever the names share, the values say that one went and one came."""
    old = [("p", 1, {"request_id": f"r{i}", "user_id": i}) for i in range(9)]
    new = [("p", 2, {"request_id": f"r{i}", "user_name": f"bob {i}"}) for i in range(4, 14)]
    assert report(table(spark, *old, *new)) == [("p", 2, "added", "", "user_name"), ("p", 2, "removed", "user_id", "")]
    unlinked = [("p", s, {k: v for k, v in x.items() if k != "request_id"}) for _, s, x in (*old, *new)]
    assert report(table(spark, *unlinked)) == [("p", 2, "added", "", "user_name"), ("p", 2, "removed", "user_id", "")]


@pytest.mark.parametrize("synonyms", [True, False])
def test_values_tell_a_rename_whatever_the_names(spark, synonyms):
    old = [("p", 1, {"request_id": f"r{i}", "alpha": 1000 + 37 * i, "beta": 5000 + 11 * i, "when": f"2025-01-{i + 1:02d}T00:00:00Z"}) for i in range(12)]
    new = [("p", 2, {"request_id": f"r{i}", "x": {"q": str(5000 + 11 * i)}, "gamma": 1000 + 37 * i, "t": 1735689600000 + 86400000 * i}) for i in range(8, 20)]
    df = table(spark, *old, *new)
    got = sorted(tuple(r)[2:] for r in drift.changes(df, synonyms=synonyms).collect())
    assert got == [("renamed", "alpha", "gamma"), ("renamed", "beta", "x.q"), ("renamed", "when", "t"), ("retyped", "beta", "x.q"), ("retyped", "when", "t")]


def test_chance_agreement_is_no_rename(spark):
    """Two flags that both happen to be false in all records seen twice."""
    old = [("p", 1, {"request_id": f"r{i}", "cached": False}) for i in range(4)]
    new = [("p", 2, {"request_id": f"r{i}", "streaming": 0}) for i in range(4)]
    assert report(table(spark, *old, *new)) == [("p", 2, "added", "", "streaming"), ("p", 2, "removed", "cached", "")]


def test_no_value_is_lost(spark):
    df = table(
        spark,
        ("p", 1, {"user": {"id": 7, "name": "bob"}, "input_tokens": 5, "input": {"count": 9}}),
        ("p", 2, {"request_id": "a", "request": {"status": "ok", "count": 3}}),
        ("p", 3, {"user": {"id": 8}, "request": {"count": 4}, "line_no": 6}),
    )
    rows = [r.asDict() for r in drift.consistent(df).orderBy("file_seq").collect()]
    assert (rows[0]["user_id"], rows[0]["user_name"], rows[0]["input_tokens"], rows[0]["input_count"]) == (7, "bob", 5, 9)
    assert (rows[1]["request_id"], rows[1]["request_status"], rows[1]["request_count"]) == ("a", "ok", 3)
    assert (rows[2]["user_id"], rows[2]["request_count"]) == (8, 4) and all(not r["other_fields"] for r in rows)


def test_fields_beyond_the_columns_stay(spark, monkeypatch):
    monkeypatch.setattr(drift, "MAX_COLUMNS", 2)
    df = table(spark, ("p", 1, {"aa": 1, "bb": "x", "cc": [1, 2], "dd": {"ee": True}}))
    (row,) = drift.consistent(df).collect()
    assert (row.aa, row.bb, row.other_fields) == (1, "x", {"cc": "[1, 2]", "dd.ee": "true"})


def test_one_request_many_times(spark):
    """A request reported many times in both files counts as one agreement, which with few values tells too little."""
    old = [("p", 1, {"request_id": "r", "a": "x" * 100_000})] * 50
    new = [("p", 2, {"request_id": "r", "b": "x" * 100_000})] * 50
    assert report(table(spark, *old, *new)) == [("p", 2, "added", "", "b"), ("p", 2, "removed", "a", "")]
    named = [("p", 2, {"request_id": "r", "a_text": "x" * 100_000})] * 50
    assert report(table(spark, *old, *named)) == [("p", 2, "renamed", "a", "a_text")]


def test_one_path_twice_in_a_record(spark):
    (row,) = drift.consistent(table(spark, ("p", 1, '{"a.b": 1, "a": {"b": 2}}'))).collect()
    assert {1, 2} <= {v for k, v in row.asDict().items() if k not in ("record_id", "file_seq", "line_no", "other_fields")}

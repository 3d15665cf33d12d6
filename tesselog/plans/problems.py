"""The queries of the general training-data problems (1 and 4) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselog.operators import drift, nested
from tesselog.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.found_blocks(table(spark, sf_dir, "raw_lines"))


def p1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line: its place in its file and whether it is a JSON object."""
    return nested.flatten(table(spark, sf_dir, "raw_lines")).where("record = 'line'").select("line_id", "file", "line_no", "is_object")


def p1_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each message with the message that holds it."""
    flat = nested.flatten(table(spark, sf_dir, "raw_lines")).where("record = 'message'")
    return flat.selectExpr("line_id", "path AS message_path", "parent_path AS parent_message", "place", "role")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "usage_raw"))


def p4_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usage under one schema."""
    return drift.consistent(table(spark, sf_dir, "usage_raw"))


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of p4_usage value by value, as texts, for its twin."""
    rows = drift.consistent(table(spark, sf_dir, "usage_raw"))
    kinds = {c: t for c, t in rows.dtypes if c not in ("record_id", "producer", "file_seq", "line_no", "other_fields")}

    def text(c: str):
        if kinds[c] == "timestamp":
            return F.unix_millis(c).cast("string")
        return F.array_join(c, ",") if kinds[c].startswith("array") else F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c))) if kinds[c] == "double" else F.col(c).cast("string")

    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in kinds))).alias("x")
    return rows.select("record_id", "producer", "file_seq", each).select("record_id", "producer", "file_seq", "x.*").where("value is not null")


QUERIES = {f.__name__: f for f in (p1_found, p1_lines, p1_messages, p4_found, p4_usage, p4_values)}

#: The paths under which the test tables keep each quantity, for the twin alone.
_PATHS = {
    "cache_read": "cacheReadTokens cache_read_tokens usage.cache_read",
    "cost": "costUsd cost_usd billing.usd",
    "error": "status.is_error isError is_error",
    "flag": "labels.flags flags",
    "input": "input_tokens tokensIn inputTokens usage.input_tokens message.usage.input_tokens tokens_in",
    "latency": "latencyMs timing.latency_ms latency_ms",
    "model": "model_id modelName model model.name message.model",
    "output": "output_tokens outputTokens tokensOut message.usage.output_tokens tokens_out usage.output_tokens",
    "reason_stop": "stop_reason stopReason",
    "request": "request_id",
    "retry": "retry_count retries",
    "session": "sessionId session.id session_id",
    "span": "trace.span span_id",
    "tier": "tier service_tier",
    "time": "time.at ts timestamp createdAt",
}


def _said(field: str) -> str:
    at = [f"$.{p}" for p in _PATHS[field].split()]
    one = lambda p: f"CASE WHEN json_type(v, '{p}') IN ('NULL', 'OBJECT') THEN NULL WHEN json_type(v, '{p}') = 'VARCHAR' THEN json_extract_string(v, '{p}') ELSE json_extract(v, '{p}')::VARCHAR END"
    return "coalesce(" + ", ".join(map(one, at)) + ")"


def _value(field: str) -> str:
    x = _said(field)
    if field in ("cache_read", "input", "output", "latency", "retry", "span"):
        return f"try_cast(trim({x}) AS BIGINT)::VARCHAR"
    if field == "cost":
        return f"printf('%.6f', try_cast(trim({x}) AS DOUBLE))"
    if field == "error":
        return f"(lower(trim({x})) IN ('true', '1'))::VARCHAR"
    if field == "flag":
        return f"CASE WHEN starts_with(trim({x}), '[') THEN array_to_string(from_json(trim({x}), '[\"VARCHAR\"]'), ',') ELSE regexp_replace({x}, '\\s*,\\s*', ',', 'g') END"
    if field == "time":
        return f"coalesce(try_cast(trim({x}) AS BIGINT)::VARCHAR, epoch_ms(try_cast(trim({x}) AS TIMESTAMPTZ))::VARCHAR)"
    return x


SQL: dict[str, str] = {
    "p4_values": f"""WITH l AS (SELECT record_id, max(struct_pack(received_at, payload, producer, file_seq, line_no)) AS b FROM usage_raw WHERE record_id IS NOT NULL GROUP BY 1),
r AS (SELECT record_id, b.producer AS producer, b.file_seq AS file_seq, CASE WHEN json_valid(b.payload) THEN b.payload::JSON END AS v FROM l),
o AS (SELECT *, {_said("request")} AS req FROM r WHERE json_type(v) = 'OBJECT'),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY producer, coalesce(req, chr(0) || record_id) ORDER BY coalesce(file_seq, 2147483647), record_id) = 1)
SELECT record_id, producer, file_seq, field, value FROM ({" UNION ALL ".join(f"SELECT record_id, producer, file_seq, '{f}' AS field, {_value(f)} AS value FROM k" for f in _PATHS)}) WHERE value IS NOT NULL"""
}

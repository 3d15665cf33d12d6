"""Session-log queries over the driver's tables, each with its DuckDB twin.

raw_lines holds the logs (a session is a file), sessions their listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselog.functions import text as T
from tesselog.operators import logs as L
from tesselog.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

SEARCHES = "coalesce(contains(regexp_replace(lower({}), '[^a-z0-9]', '', 'g'), 'searchchunks'), false)"
NOW = "2026-03-01T00:00:00Z"  # the time that stands for the present in queries on recent sessions
TOOLS = "('search_chunks', 'find_related')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line once: copies meet by line_id and a hash, not by their text."""
    lines = table(spark, sf_dir, "raw_lines").select("line_id", "file", "line_no", "value")
    return lines.withColumn("h", F.xxhash64("value")).dropDuplicates(["line_id", "file", "line_no", "h"]).drop("h")


def log_events(spark: SparkSession, sf_dir: str, narrow_usage: bool = False) -> DataFrame:
    return L.events(raw(spark, sf_dir), narrow_usage)


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.session_summary(raw(spark, sf_dir)).where("cwd is not null").select(F.col("file").alias("session"), F.col("cwd").alias("project_root"))


_PATH = "coalesce(" + ", ".join(f"nullif(CASE WHEN json_type(b, '$.input.{k}') = 'VARCHAR' THEN json_extract_string(b, '$.input.{k}') END, '')" for k in L.PATH_KEYS) + ")"


def _str(j: str, path: str) -> str:
    return f"CASE WHEN json_type({j}, '{path}') = 'VARCHAR' THEN json_extract_string({j}, '{path}') END"


def _num(path: str) -> str:
    return f"CASE WHEN json_type(v, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN trunc(json_extract_string(v, '{path}')::DOUBLE)::BIGINT END"


def _usage(way: str) -> str:
    """Tokens of a line: told by itself, else by its usage, else by its message's usage."""
    name = {"in": ("tokensIn", "input_tokens", "inputTokens"), "out": ("tokensOut", "output_tokens", "outputTokens")}[way]
    told = "json_type(v, '$.tokensIn') IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR json_type(v, '$.tokensOut') IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
    pick = lambda at: f"coalesce({_num(f'{at}.{name[1]}')}, {_num(f'{at}.{name[2]}')})"
    return f"CASE WHEN {told} THEN {_num('$.' + name[0])} WHEN json_type(v, '$.usage') IN ('OBJECT', 'ARRAY') THEN {pick('$.usage')} ELSE {pick('$.message.usage')} END"


EVENTS = f"""ln AS (SELECT DISTINCT line_id, file, line_no, value FROM raw_lines),
js AS (SELECT file, line_no, CASE WHEN json_valid(value) THEN value::JSON END AS v FROM ln),
ps AS (SELECT file, line_no, v, coalesce(json_type(v) = 'OBJECT', false) AS obj, {_str('v', '$.type')} AS type, json_type(v, '$.message') AS mt, json_type(v, '$.message.content') AS ct, {_str('v', '$.timestamp')} AS ts FROM js),
fm AS (SELECT *, CASE WHEN NOT obj THEN 'unknown' WHEN type IN ('user', 'assistant') AND mt = 'OBJECT' THEN CASE ct WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' ELSE 'unknown' END
 WHEN type IN ('user', 'assistant') THEN 'unknown' WHEN type IS NOT NULL THEN 'system' ELSE 'unknown' END AS form FROM ps),
bl AS (SELECT file, line_no, generate_subscripts(a, 1) AS i, unnest(a) AS b FROM (SELECT file, line_no, from_json(json_extract(v, '$.message.content'), '["json"]') AS a FROM fm WHERE form = 'array')),
bt AS (SELECT file, line_no, i, b, {_str('b', '$.type')} AS t, json_type(b) AS k FROM bl),
jt AS (SELECT file, line_no, string_agg(CASE WHEN k = 'VARCHAR' THEN json_extract_string(b, '$') WHEN t = 'text' THEN coalesce({_str('b', '$.text')}, '') WHEN t = 'tool_use' THEN '[tool_use:' || coalesce({_str('b', '$.name')}, 'unknown') || ']' ELSE '' END, '' ORDER BY i) AS txt,
 count(*) FILTER (t IN ('tool_use', 'tool_result')) AS calls FROM bt GROUP BY 1, 2),
e0 AS (SELECT file, line_no, 0 AS sub, CASE form WHEN 'string' THEN CASE type WHEN 'user' THEN 'user_message' ELSE 'assistant_message' END WHEN 'array' THEN CASE type WHEN 'user' THEN 'user_message' ELSE 'assistant_message' END ELSE form END AS kind,
 CASE form WHEN 'string' THEN json_extract_string(v, '$.message.content') WHEN 'array' THEN coalesce(txt, '') END AS text, NULL::VARCHAR AS tool, NULL::BOOLEAN AS is_error, NULL::VARCHAR AS output, NULL::VARCHAR AS output_kind, NULL::VARCHAR AS command, NULL::VARCHAR AS path, NULL::VARCHAR AS file_path, NULL::VARCHAR AS query, ts
 FROM fm LEFT JOIN jt USING (file, line_no) WHERE form <> 'array' OR coalesce(txt, '') <> '' OR coalesce(calls, 0) = 0
UNION ALL SELECT bt.file, bt.line_no, i, t, NULL, CASE WHEN t = 'tool_use' THEN {_str('b', '$.name')} END, CASE WHEN t = 'tool_result' THEN CASE json_type(b, '$.is_error') WHEN 'BOOLEAN' THEN (b->>'$.is_error')::BOOLEAN END END,
 CASE WHEN t = 'tool_result' THEN CASE WHEN json_type(b, '$.content') = 'VARCHAR' THEN json_extract_string(b, '$.content') ELSE json_extract(b, '$.content')::VARCHAR END END, CASE WHEN t = 'tool_result' THEN json_type(b, '$.content') END,
 CASE WHEN t = 'tool_use' THEN {_str('b', '$.input.command')} END, CASE WHEN t = 'tool_use' THEN {_PATH} END, CASE WHEN t = 'tool_use' THEN {_str('b', '$.input.file_path')} END, CASE WHEN t = 'tool_use' THEN {_str('b', '$.input.query')} END, fm.ts FROM bt JOIN fm USING (file, line_no) WHERE t IN ('tool_use', 'tool_result')),
ev AS (SELECT e0.file AS session, row_number() OVER (PARTITION BY e0.file ORDER BY e0.line_no, sub) - 1 AS event_index, e0.line_no, kind, text, tool, is_error, output, output_kind, command, path, file_path, query, e0.ts,
 CASE WHEN kind = 'assistant_message' THEN {_usage('in')} END AS tokens_in, CASE WHEN kind = 'assistant_message' THEN {_usage('out')} END AS tokens_out,
 CASE WHEN kind = 'assistant_message' THEN {_num('$.message.usage.input_tokens')} END AS replay_in, CASE WHEN kind = 'assistant_message' THEN {_num('$.message.usage.output_tokens')} END AS replay_out,
 CASE WHEN kind = 'assistant_message' THEN coalesce(nullif({_str('fm.v', '$.model')}, ''), nullif({_str('fm.v', '$.message.model')}, '')) END AS model FROM e0 JOIN fm ON fm.file = e0.file AND fm.line_no = e0.line_no)"""

W = "PARTITION BY session ORDER BY event_index"
PRIOR = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SO_FAR = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"WITH {EVENTS} SELECT session, event_index, line_no, kind, text, tool, is_error, ts, query, path FROM ev")
def normalized_events(spark, sf_dir):
    return log_events(spark, sf_dir).select("session", "event_index", "line_no", "kind", "text", "tool", "is_error", "ts", "query", "path")


@query(
    f"WITH {EVENTS} SELECT session, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("user_message", "assistant_message", "tool_use", "tool_result", "system", "unknown"))
    + f", coalesce(bool_or(tool IN {TOOLS}), false) AS any_search FROM ev GROUP BY 1"
)
def event_kind_counts(spark, sf_dir):
    return L.kind_counts(log_events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT session FROM ev GROUP BY 1 HAVING NOT coalesce(bool_or(tool IN {TOOLS}), false)")
def sessions_without_search(spark, sf_dir):
    return L.kind_counts(log_events(spark, sf_dir)).where("not any_search").select("session")


@query(
    f"""WITH ln AS (SELECT DISTINCT line_id, file, line_no, value FROM raw_lines), js AS (SELECT file, line_no, CASE WHEN json_valid(value) THEN value::JSON END AS v FROM ln),
f AS (SELECT file, line_no, nullif({_str('v', '$.timestamp')}, '') AS ts, nullif({_str('v', '$.cwd')}, '') AS cwd, nullif({_str('v', '$.gitBranch')}, '') AS branch FROM js)
SELECT file, count(*) AS n_lines, arg_min(ts, line_no) FILTER (ts IS NOT NULL) AS first_ts, arg_max(ts, line_no) FILTER (ts IS NOT NULL) AS last_ts, arg_min(cwd, line_no) FILTER (cwd IS NOT NULL) AS cwd, arg_min(branch, line_no) FILTER (branch IS NOT NULL) AS branch FROM f GROUP BY 1"""
)
def session_summary(spark, sf_dir):
    return L.session_summary(raw(spark, sf_dir))


_RETURNED = """CASE output_kind WHEN 'ARRAY' THEN json_array_length(output::JSON) WHEN 'OBJECT' THEN CASE WHEN json_type(output::JSON, '$.chunks') = 'ARRAY' THEN json_array_length(output::JSON, '$.chunks') ELSE 1 END
 WHEN 'VARCHAR' THEN greatest(1, len(regexp_extract_all(output, '(?m)^## '))) ELSE 1 END"""
CALLS = f"""tl AS (SELECT *, lead(kind) OVER ({W}) AS nk, lead(is_error) OVER ({W}) AS ne, lead({_RETURNED}) OVER ({W}) AS nr FROM ev WHERE kind IN ('tool_use', 'tool_result')),
calls AS (SELECT session, event_index, least(5, greatest(0, CASE WHEN nk = 'tool_result' AND NOT coalesce(ne, false) THEN nr ELSE 0 END))::BIGINT AS chunks FROM tl WHERE kind = 'tool_use' AND tool IN {TOOLS})"""


@query(f"WITH {EVENTS}, {CALLS} SELECT session, event_index, chunks, greatest(0, 7500 - chunks * 300)::BIGINT AS saved FROM calls")
def search_calls(spark, sf_dir):
    return L.search_calls(log_events(spark, sf_dir))


COSTS = """costs AS (SELECT session, event_index, ev.model, coalesce(tokens_in, 0) AS tokens_in, coalesce(tokens_out, 0) AS tokens_out,
 (greatest(coalesce(tokens_in, 0), 0) * usd_in_mtok + greatest(coalesce(tokens_out, 0), 0) * usd_out_mtok) / 1000000.0::DOUBLE AS usd FROM ev LEFT JOIN model_prices p ON p.model = ev.model
 WHERE kind = 'assistant_message' AND (tokens_in IS NOT NULL OR tokens_out IS NOT NULL))"""


@query(f"WITH {EVENTS}, {COSTS} SELECT session, event_index, model, tokens_in, tokens_out, round(usd, 9) AS usd FROM costs")
def turn_costs(spark, sf_dir):
    return L.turn_costs(log_events(spark, sf_dir), table(spark, sf_dir, "model_prices")).withColumn("usd", F.round("usd", 9))


SAVINGS = f"""{CALLS}, {COSTS}, c AS (SELECT session, count(*) AS searches, sum(chunks)::BIGINT AS chunks, sum(greatest(0, 7500 - chunks * 300))::BIGINT AS saved FROM calls GROUP BY 1),
u AS (SELECT session, coalesce(sum(CASE WHEN kind = 'assistant_message' THEN CASE WHEN tokens_in IS NOT NULL OR tokens_out IS NOT NULL THEN coalesce(tokens_in, 0) + coalesce(tokens_out, 0) ELSE ceil(length(coalesce(text, '')) / 4.0)::BIGINT END END), 0)::BIGINT AS used FROM ev GROUP BY 1),
p AS (SELECT session, sum(usd) AS usd, sum(usd) FILTER (tokens_in + tokens_out > 0) / sum(tokens_in + tokens_out) FILTER (usd IS NOT NULL AND tokens_in + tokens_out > 0) * 1000000.0::DOUBLE AS rate FROM costs GROUP BY 1),
a AS (SELECT u.session, coalesce(searches, 0) AS searches, coalesce(chunks, 0) AS chunks, coalesce(saved, 0) AS saved, used, coalesce(usd, 0.0::DOUBLE) AS usd, rate, coalesce(saved, 0) * rate / 1000000.0::DOUBLE AS ds FROM u LEFT JOIN c USING (session) LEFT JOIN p USING (session)),
sv AS (SELECT session, searches, chunks, saved AS tokens_saved, used AS tokens_consumed, round(CASE WHEN saved + used > 0 THEN saved::DOUBLE / (saved + used) ELSE 0 END, 6) AS percent_saved, round(usd, 6) AS dollars_consumed, round(rate, 6) AS usd_per_mtok, round(ds, 6) AS dollars_saved,
 round(CASE WHEN ds + usd > 0 THEN ds / (ds + usd) END, 6) AS percent_dollars FROM a)"""


def _savings(spark, sf_dir):
    return L.savings(log_events(spark, sf_dir), table(spark, sf_dir, "model_prices"))


@query(f"WITH {EVENTS}, {SAVINGS} SELECT * FROM sv")
def savings(spark, sf_dir):
    return _savings(spark, sf_dir)


@query(f"WITH {EVENTS}, {SAVINGS} SELECT session, tokens_saved, tokens_consumed FROM sv ORDER BY tokens_saved DESC, session LIMIT 10")
def top_sessions(spark, sf_dir):
    return _savings(spark, sf_dir).orderBy(F.desc("tokens_saved"), "session").limit(10).select("session", "tokens_saved", "tokens_consumed")


_COMMAND = " OR ".join(f"regexp_matches(command, '{p}')" for p in (r"(?i)^\s*(grep|rg|ag)\b", r"(?i)^\s*(find|fd)\b", r"(?i)^\s*(cat|head|tail|less|more)\b", r"(?i)^\s*sed\s+-n\b"))
REPLAY = f"""rp0 AS (SELECT *, coalesce(kind = 'tool_use' AND (tool IN ('Read', 'Grep', 'Glob') OR tool = 'Bash' AND ({_COMMAND})), false) AS use, coalesce(sum(CASE WHEN kind = 'tool_result' THEN 1 ELSE 0 END) OVER {PRIOR}, 0) AS grp FROM ev),
rp1 AS (SELECT *, kind = 'tool_result' AND coalesce(bool_or(use) OVER (PARTITION BY session, grp ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS replaced,
 CASE kind WHEN 'assistant_message' THEN CASE WHEN replay_in IS NOT NULL OR replay_out IS NOT NULL THEN coalesce(replay_in, 0) + coalesce(replay_out, 0) ELSE ceil(length(coalesce(text, '')) / 4.0)::BIGINT END
 WHEN 'user_message' THEN ceil(length(coalesce(text, '')) / 4.0)::BIGINT WHEN 'tool_result' THEN ceil(length(coalesce(output, '')) / 4.0)::BIGINT ELSE 0 END AS actual FROM rp0),
rp AS (SELECT session, event_index, kind, use AS replaceable, replaced, actual::BIGINT AS actual, (CASE WHEN replaced THEN 1500 ELSE actual END)::BIGINT AS counterfactual, text FROM rp1)"""
_SNIP = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"WITH {EVENTS}, {REPLAY} SELECT session, event_index, kind, replaceable, replaced, actual, counterfactual, CASE WHEN length({_SNIP}) > 80 THEN substring({_SNIP}, 1, 79) || '…' ELSE {_SNIP} END AS snippet FROM rp")
def replay(spark, sf_dir):
    return L.replay(log_events(spark, sf_dir, narrow_usage=True))


@query(
    f"""WITH {EVENTS}, {REPLAY}, t AS (SELECT session, count(*) AS events, count(*) FILTER (replaced) AS replaced, sum(actual)::BIGINT AS actual, sum(counterfactual)::BIGINT AS counterfactual FROM rp GROUP BY ROLLUP (session))
SELECT *, actual - counterfactual AS saved, round(CASE WHEN actual > 0 THEN (actual - counterfactual)::DOUBLE / actual ELSE 0 END, 6) AS percent FROM t"""
)
def replay_totals(spark, sf_dir):
    return L.replay_totals(L.replay(log_events(spark, sf_dir, narrow_usage=True)))


def _unwrap_sql(x: str) -> str:
    inner = f"coalesce(json_extract_string({x}, '$.content[0].text'), json_extract_string({x}, '$[0].text'), CASE WHEN starts_with(ltrim({x}), '\"') THEN json_extract_string({x}, '$') END, {x})"
    return f"CASE WHEN json_valid({x}) THEN {inner} ELSE {x} END"


def _unwrapped(source: str, name: str) -> str:
    """CTEs that end in ``name``: the rows of ``source`` with payload, the output unwrapped three times, and body, its array of results."""
    return f"""{name}1 AS (SELECT *, {_unwrap_sql('output')} AS u1 FROM {source}), {name}2 AS (SELECT *, {_unwrap_sql('u1')} AS u2 FROM {name}1), {name}3 AS (SELECT *, {_unwrap_sql('u2')} AS payload FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload::JSON) = 'ARRAY' THEN payload::JSON ELSE coalesce(json_extract(payload::JSON, '$.results'), json_extract(payload::JSON, '$.hits')) END END AS b0 FROM {name}3),
{name} AS (SELECT * EXCLUDE (u1, u2, b0), CASE WHEN json_type(b0) = 'ARRAY' THEN b0 END AS body FROM {name}4)"""


_TEXTS = "list_sum(list_transform(from_json(output, '[\"json\"]'), lambda x: CASE json_type(x) WHEN 'VARCHAR' THEN length(json_extract_string(x, '$')) WHEN 'OBJECT' THEN CASE WHEN json_type(x, '$.text') = 'VARCHAR' THEN length(json_extract_string(x, '$.text')) ELSE 0 END ELSE 0 END))"
_SIZE = f"CASE output_kind WHEN 'VARCHAR' THEN length(output) WHEN 'OBJECT' THEN length(output) WHEN 'ARRAY' THEN coalesce({_TEXTS}, 0) ELSE 0 END"
TURNS = f"""tt0 AS (SELECT *, sum(CASE WHEN kind = 'user_message' THEN 1 ELSE 0 END) OVER {SO_FAR} AS turn FROM ev),
tt1 AS (SELECT *, sum(CASE kind WHEN 'tool_use' THEN 1 WHEN 'tool_result' THEN -1 ELSE 0 END) OVER (PARTITION BY session, turn ORDER BY event_index ROWS UNBOUNDED PRECEDING) AS s,
 last_value(CASE WHEN kind = 'tool_use' THEN tool END IGNORE NULLS) OVER (PARTITION BY session, turn ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ot, min(turn) OVER (PARTITION BY session) AS ft FROM tt0),
{_unwrapped("tt1", "tu")},
fs AS (SELECT session, turn, tool, min(event_index) AS i FROM tt0 WHERE kind = 'tool_use' AND tool IS NOT NULL GROUP BY 1, 2, 3), fl AS (SELECT session, turn, string_agg(tool, ',' ORDER BY i) AS tools FROM fs GROUP BY 1, 2),
g AS (SELECT session, turn, count(*) AS events, min(event_index) AS first_event, arg_min(coalesce(ts, '~'), event_index) AS st, arg_max(ts, event_index) FILTER (ts IS NOT NULL) AS ended_at, coalesce(bool_or(is_error), false) AS has_error,
 arg_max(s, event_index) - least(0, min(s)) > 0 AS interrupted, count(*) FILTER (kind = 'tool_use' AND {SEARCHES.format("tool")}) AS searches,
 sum(CASE WHEN kind = 'tool_result' AND {SEARCHES.format("ot")} THEN coalesce(json_array_length(body), 0) ELSE 0 END)::BIGINT AS search_chunks,
 sum(CASE WHEN kind = 'tool_result' AND ot = 'Read' THEN {_SIZE} ELSE 0 END)::BIGINT AS read_bytes, sum(CASE WHEN kind = 'tool_result' AND ot = 'Bash' THEN {_SIZE} ELSE 0 END)::BIGINT AS bash_bytes, min(ft) AS ft FROM tu GROUP BY 1, 2),
turns AS (SELECT session, events, first_event, nullif(st, '~') AS started_at, ended_at, has_error, interrupted, coalesce(tools, '') AS tools, searches, search_chunks, read_bytes, bash_bytes,
 (CASE WHEN turn = 0 THEN 0 WHEN ft = 0 THEN turn + 1 ELSE turn END)::BIGINT AS turn_no, searches = 0 AND read_bytes + bash_bytes >= 5000 AS missed, CASE WHEN interrupted THEN 'interrupted' WHEN has_error THEN 'errored' ELSE 'ok' END AS outcome FROM g LEFT JOIN fl USING (session, turn))"""


@query(f"WITH {EVENTS}, {TURNS} SELECT * FROM turns")
def turns(spark, sf_dir):
    return L.turns(log_events(spark, sf_dir))


@query(
    f"""WITH {EVENTS}, {SAVINGS}, {TURNS}
SELECT session, turn_no, round(epoch(try_cast(ended_at AS TIMESTAMP)) - epoch(try_cast(started_at AS TIMESTAMP)), 3) AS seconds,
CASE WHEN tokens_saved > 0 AND chunks > 0 AND search_chunks > 0 THEN floor(tokens_saved * least(1.0::DOUBLE, search_chunks::DOUBLE / chunks) + 0.5)::BIGINT END AS saved FROM turns JOIN sv USING (session)"""
)
def turn_savings(spark, sf_dir):
    ev = log_events(spark, sf_dir)
    return L.turn_savings(L.turns(ev), L.savings(ev, table(spark, sf_dir, "model_prices")))


_MS = "(epoch_ms(try_cast(ended_at AS TIMESTAMP)) - epoch_ms(try_cast(started_at AS TIMESTAMP)))"


@query(
    f"""WITH {EVENTS}, {TURNS}, f AS (SELECT session, turn_no, {_MS} AS ms, read_bytes + bash_bytes AS bytes FROM turns), h AS (SELECT *, floor(ms / 1000.0::DOUBLE + 0.5)::BIGINT AS s, floor(bytes / 4.0::DOUBLE + 0.5)::BIGINT AS t FROM f)
SELECT session, turn_no, CASE WHEN ms IS NULL OR ms < 0 THEN '' WHEN ms < 1000 THEN ms || 'ms' WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS lasted,
CASE WHEN t >= 10000 THEN format('{{:.0f}}k', t / 1000.0::DOUBLE) WHEN t >= 1000 THEN format('{{:.1f}}k', t / 1000.0::DOUBLE) ELSE t::VARCHAR END AS context,
CASE WHEN bytes < 1000 THEN bytes::VARCHAR WHEN bytes < 1000000 THEN format('{{:.1f}}k', bytes / 1000.0::DOUBLE) ELSE format('{{:.2f}}M', bytes / 1000000.0::DOUBLE) END AS size,
substring(regexp_extract(session, '([^/]+)/*$', 1), 1, 8) AS short FROM h"""
)
def turn_badges(spark, sf_dir):
    t = L.turns(log_events(spark, sf_dir))
    ms = F.unix_millis(F.col("ended_at").try_cast("timestamp")) - F.unix_millis(F.col("started_at").try_cast("timestamp"))
    size = F.col("read_bytes") + F.col("bash_bytes")
    return t.select("session", "turn_no", T.duration(ms).alias("lasted"), T.token_badge(size / 4).alias("context"), T.human_count(size).alias("size"), T.short_id(T.basename(F.col("session"))).alias("short"))


PAIRS = f"""k0 AS (SELECT session, event_index, kind, tool, output, output_kind, sum(CASE kind WHEN 'tool_use' THEN 1 ELSE -1 END) OVER {SO_FAR} AS s FROM ev WHERE kind = 'tool_result' OR kind = 'tool_use' AND tool IS NOT NULL),
k1 AS (SELECT *, least(0, min(s) OVER {SO_FAR}) AS low, coalesce(least(0, min(s) OVER {PRIOR}), 0) AS was FROM k0),
k2 AS (SELECT *, CASE WHEN kind = 'tool_use' THEN s - low WHEN s < was THEN 0 ELSE s - low + 1 END AS level FROM k1),
k3 AS (SELECT *, last_value(CASE WHEN kind = 'tool_use' THEN event_index END IGNORE NULLS) OVER (PARTITION BY session, level ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS use_index FROM k2),
pairs AS (SELECT k3.session, k3.event_index AS result_index, use_index, u.tool, k3.output, k3.output_kind FROM k3 LEFT JOIN ev u ON u.session = k3.session AND u.event_index = use_index WHERE k3.kind = 'tool_result' AND level > 0)"""


@query(f"WITH {EVENTS}, {PAIRS} SELECT session, result_index, use_index, tool FROM pairs")
def tool_pairs(spark, sf_dir):
    return L.tool_pairs(log_events(spark, sf_dir)).drop("output", "output_kind")


HITS = f"""{PAIRS}, nr AS (SELECT session, event_index, last_value(CASE WHEN kind = 'tool_use' AND {SEARCHES.format("tool")} THEN event_index END IGNORE NULLS) OVER {PRIOR} AS near FROM ev), {_unwrapped("pairs", "hu")},
bd AS (SELECT p.session, result_index, coalesce(near, result_index) AS search_index, body FROM hu p JOIN nr ON nr.session = p.session AND nr.event_index = result_index WHERE {SEARCHES.format("tool")}),
h0 AS (SELECT session, result_index, search_index, generate_subscripts(a, 1) - 1 AS chunk_index, unnest(a) AS h FROM (SELECT *, from_json(body, '["json"]') AS a FROM bd WHERE body IS NOT NULL)),
hits AS (SELECT session, result_index, search_index, chunk_index, {_str('h', '$.filePath')} AS file_path FROM h0 WHERE json_type(h, '$.filePath') = 'VARCHAR')"""


@query(f"WITH {EVENTS}, {HITS} SELECT session, result_index, search_index, chunk_index, file_path FROM hits")
def search_hits(spark, sf_dir):
    return L.search_hits(log_events(spark, sf_dir)).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


_SEG = "list_filter(string_split(replace({}, chr(92), '/'), '/'), lambda s: s <> '')"


def _linked(hits: str, used: str) -> str:
    """Rows of ``used`` (session, event_index, target) with the hit they follow from; an access without one is kept."""
    return f"""u AS (SELECT session, event_index, target, {_SEG.format('target')} AS us FROM {used}),
x AS (SELECT u.session, u.event_index, search_index, chunk_index, file_path, target = file_path AS exact, result_index, us, {_SEG.format('file_path')} AS hs FROM u JOIN {hits} h ON h.session = u.session AND result_index < u.event_index),
y AS (SELECT *, least(len(us), len(hs)) AS n FROM x),
z AS (SELECT session, event_index, search_index, chunk_index, file_path FROM (SELECT *, row_number() OVER (PARTITION BY session, event_index ORDER BY exact DESC, result_index DESC, chunk_index DESC) AS rn FROM y
WHERE exact OR us = hs OR n >= 2 AND us[len(us) - n + 1 : len(us)] = hs[len(hs) - n + 1 : len(hs)]) WHERE rn = 1)
SELECT u.session, u.event_index, target, search_index, chunk_index, file_path FROM u LEFT JOIN z USING (session, event_index)"""


@query(f"WITH {EVENTS}, {HITS}, ac AS (SELECT session, event_index, path AS target FROM ev WHERE kind = 'tool_use' AND tool IN ('Read', 'Edit', 'MultiEdit', 'Write', 'NotebookEdit') AND path <> ''), {_linked('hits', 'ac')}")
def search_provenance(spark, sf_dir):
    """Every access to a file with the search it follows from, null where there is none."""
    ev = log_events(spark, sf_dir)
    used = L.accesses(ev)
    return used.join(L.provenance(ev), ["session", "event_index"], "left").withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query(
    f"""WITH {EVENTS}, {HITS} SELECT session, result_index, json_array_length(body)::BIGINT AS results, CASE WHEN json_type(CASE WHEN json_valid(payload) THEN payload::JSON END, '$.latencyMs') IS NOT NULL THEN try_cast(json_extract_string(payload, '$.latencyMs') AS DOUBLE) END AS latency
FROM hu WHERE {SEARCHES.format("tool")}"""
)
def search_results(spark, sf_dir):
    """How many results each answer to a search holds, and the latency it tells."""
    pairs = L.tool_pairs(log_events(spark, sf_dir)).where(L.names_search(F.col("tool")))
    return pairs.select("session", "result_index", L.result_count(F.col("output")).alias("results"), L.latency(F.col("output")).alias("latency"))


@query(
    f"""WITH {EVENTS}, iu AS (SELECT file AS session, line_no, json_extract(b, '$.input') AS inp, row_number() OVER (PARTITION BY file, line_no ORDER BY i) AS k FROM bt WHERE t = 'tool_use'),
eu AS (SELECT session, event_index, line_no, tool, row_number() OVER (PARTITION BY session, line_no ORDER BY event_index) AS k FROM ev WHERE kind = 'tool_use'),
q AS (SELECT session, event_index, {_str('inp', '$.query')} AS q, CASE WHEN json_type(inp, '$.hybrid') = 'BOOLEAN' AND json_extract_string(inp, '$.hybrid') = 'false' THEN 'bm25' ELSE 'hybrid' END AS mode,
 coalesce(CASE WHEN json_type(inp, '$.top') IN ('UBIGINT', 'BIGINT') THEN json_extract_string(inp, '$.top') END, '10') AS top FROM eu JOIN iu USING (session, line_no, k) WHERE {SEARCHES.format("tool")})
SELECT session, event_index, '"' || CASE WHEN length(q) > 60 THEN substring(q, 1, 59) || '…' ELSE q END || '"  ·  ' || mode || '  ·  top=' || top AS label FROM q"""
)
def search_labels(spark, sf_dir):
    calls = log_events(spark, sf_dir).where((F.col("kind") == "tool_use") & L.names_search(F.col("tool")))
    return calls.select("session", "event_index", L.search_label(F.col("input")).alias("label"))


@query(
    f"""WITH {EVENTS}, {REPLAY}, n AS (SELECT session, event_index, kind, replaceable, lead(kind) OVER ({W}) AS nk, lead(event_index) OVER ({W}) AS ni, lead(actual) OVER ({W}) AS na, lead(counterfactual) OVER ({W}) AS nc FROM rp),
m AS (SELECT *, coalesce(nk = 'tool_result' AND ni = event_index + 1, false) AS met FROM n WHERE kind = 'tool_use' AND replaceable)
SELECT m.session, m.event_index, tool, CASE WHEN met THEN na ELSE 0 END AS actual, CASE WHEN met THEN nc ELSE 0 END AS counterfactual FROM m JOIN ev ON ev.session = m.session AND ev.event_index = m.event_index"""
)
def replay_pairs(spark, sf_dir):
    ev = log_events(spark, sf_dir, narrow_usage=True)
    return L.use_rows(ev, L.replay(ev))


def _projects_sql(grouped: bool) -> str:
    root = "CASE WHEN coalesce(project_root, '') <> '' THEN project_root ELSE project END"
    key = root if grouped else f"CASE WHEN project_root_source = 'inferred-prefix' THEN project ELSE {root} END"
    inferred = "count(*) FILTER (project_root_source = 'inferred-prefix')" if grouped else "0::BIGINT"
    return f"""SELECT project, sessions, worktrees, live, inferred, regexp_extract(project, '([^/\\\\]*)[/\\\\]*$', 1) AS name FROM (SELECT {key} AS project, count(*) AS sessions, count(DISTINCT s.project) AS worktrees,
coalesce(bool_or(epoch(TIMESTAMP '2026-03-01 00:00:00') - epoch(try_cast(updated_at AS TIMESTAMP)) < 300), false) AS live, {inferred} AS inferred FROM sessions s GROUP BY 1)"""


@query(_projects_sql(True))
def project_rollup(spark, sf_dir):
    return L.projects(table(spark, sf_dir, "sessions"), NOW)


@query(_projects_sql(False))
def project_rollup_split(spark, sf_dir):
    return L.projects(table(spark, sf_dir, "sessions"), NOW, group_inferred=False)


@query(
    """WITH c AS (SELECT DISTINCT path AS cwd FROM sessions WHERE path IS NOT NULL), r AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM sessions UNION SELECT DISTINCT replace(path, '.jsonl', '') FROM sessions WHERE is_worktree),
m AS (SELECT cwd, arg_max(root, length(root)) AS root FROM c JOIN r ON root <> '' AND length(cwd) > length(root) AND starts_with(cwd, root) AND substring(cwd, length(root) + 1, 1) IN ('-', '/', '_') GROUP BY 1) SELECT cwd, root FROM c LEFT JOIN m USING (cwd)"""
)
def prefix_roots(spark, sf_dir):
    s = table(spark, sf_dir, "sessions")
    known = s.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("root")).union(s.where("is_worktree").select(F.replace("path", F.lit(".jsonl"), F.lit(""))))
    return L.prefix_roots(s.where("path is not null").select(F.col("path").alias("cwd")), known)


_SENTENCE = r"regexp_extract(f, '^[^.?!]{1,200}[.?!]?')"
TRUTH = f"""sm AS (SELECT file AS session, arg_min(cwd, line_no) FILTER (cwd IS NOT NULL) AS root FROM (SELECT file, line_no, nullif({_str('v', '$.cwd')}, '') AS cwd FROM js) GROUP BY 1),
a0 AS (SELECT *, (kind = 'tool_use' AND {SEARCHES.format('tool')}) AS call, coalesce(kind = 'user_message' AND regexp_replace(text, '\\s+', '', 'g') <> '' AND NOT starts_with(regexp_replace(text, '^\\s+', ''), '['), false) AS said, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM ev),
a1 AS (SELECT *, sum(CASE WHEN call OR said THEN 1 ELSE 0 END) OVER {SO_FAR} AS win, trim(substring(CASE WHEN {_SENTENCE} = '' THEN f ELSE {_SENTENCE} END, 1, 200)) AS q FROM a0),
a2 AS (SELECT *, CASE WHEN call THEN nullif(trim(coalesce(query, '')), '') WHEN said AND length(q) >= 6 THEN q END AS qq FROM a1 WHERE win > 0),
fl AS (SELECT a2.session, win, event_index, substring(file_path, length(regexp_replace(root, '/+$', '')) + 2) AS rel FROM a2 JOIN sm USING (session) WHERE kind = 'tool_use' AND tool IN ('Read', 'Edit', 'Write', 'MultiEdit', 'NotebookEdit')
 AND starts_with(file_path, regexp_replace(root, '/+$', '') || '/') AND length(file_path) > length(regexp_replace(root, '/+$', '')) + 1),
ff AS (SELECT session, win, rel, min(event_index) AS i FROM fl GROUP BY 1, 2, 3), fg AS (SELECT session, win, list(rel ORDER BY i) AS files FROM ff GROUP BY 1, 2),
truth AS (SELECT session, event_index, CASE WHEN call THEN 'search_call' ELSE 'user_message' END AS source, qq AS query, coalesce(files, []) AS files FROM a2 LEFT JOIN fg USING (session, win) WHERE (call OR said) AND qq IS NOT NULL)"""


@query(f"WITH {EVENTS}, {TRUTH} SELECT session, event_index, source, query, array_to_string(files, ',') AS files FROM truth")
def ground_truth(spark, sf_dir):
    return L.ground_truth(log_events(spark, sf_dir), roots(spark, sf_dir)).withColumn("files", F.array_join("files", ","))


MERGED = f"""{TRUTH}, j AS (SELECT truth.*, root FROM truth JOIN sm USING (session) WHERE root IS NOT NULL), o AS (SELECT root, lower(query) AS k, unnest(files) AS x, session, event_index FROM j),
o1 AS (SELECT root, k, x, min((session, event_index)) AS at FROM o GROUP BY 1, 2, 3), fx AS (SELECT root, k, count(x) AS files FROM o1 GROUP BY 1, 2),
merged AS (SELECT j.root AS project_root, arg_min(query, (session, event_index)) AS query, min(source) AS source, count(DISTINCT session) AS sessions, coalesce(any_value(fx.files), 0) AS files, min((session, event_index)) AS first
 FROM j LEFT JOIN fx ON fx.root = j.root AND fx.k = lower(query) GROUP BY j.root, lower(query))"""


@query(f"WITH {EVENTS}, {MERGED} SELECT project_root, query, source, sessions, files FROM merged")
def merged_ground_truth(spark, sf_dir):
    r = roots(spark, sf_dir)
    return L.merged_truth(L.ground_truth(log_events(spark, sf_dir), r), r).select("project_root", "query", "source", "sessions", F.size("files").cast("bigint").alias("files"))


_ENTITY = rf"(regexp_matches(query, '[A-Z][a-z]+[A-Z][a-z]') OR regexp_matches(query, '\b[a-z]+_[a-z_]+\b') OR regexp_matches(query, '\b[A-Za-z][A-Za-z0-9]*\.[A-Za-z][A-Za-z0-9]+') OR regexp_matches(query, '(?i)\b({T.CODE_WORDS})\b'))"


@query(
    f"""WITH {EVENTS}, {MERGED}, k AS (SELECT * FROM merged WHERE source = 'search_call' OR files > 0 OR {_ENTITY})
SELECT project_root, query, source, files, row_number() OVER (PARTITION BY project_root ORDER BY CASE source WHEN 'search_call' THEN 0 ELSE 1 END, CASE WHEN files > 0 THEN 0 ELSE 1 END, first)::BIGINT AS place FROM k QUALIFY place <= 10"""
)
def retained_queries(spark, sf_dir):
    r = roots(spark, sf_dir)
    kept = L.retained_queries(L.merged_truth(L.ground_truth(log_events(spark, sf_dir), r), r))
    return kept.select("project_root", "query", "source", F.size("files").cast("bigint").alias("files"), F.col("place").cast("bigint").alias("place"))


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(
    rf"""WITH {EVENTS}, c AS (SELECT session, event_index, 0 AS r, trim(query) AS q FROM ev WHERE kind = 'tool_use' AND {SEARCHES.format("tool")} AND query <> '' UNION ALL
SELECT session, event_index, 1, q FROM (SELECT session, event_index, f, trim(substring(CASE WHEN {_SENTENCE} = '' THEN f ELSE {_SENTENCE} END, 1, 200)) AS q FROM (SELECT session, event_index, {_FLAT} AS f FROM ev WHERE kind = 'user_message')) WHERE f <> '' AND NOT starts_with(f, '[') AND length(q) >= 6),
d AS (SELECT session, arg_min(q, (r, event_index)) AS query, min((r, event_index)) AS asked FROM c GROUP BY session, lower(q)) SELECT session, query, row_number() OVER (PARTITION BY session ORDER BY asked) AS place FROM d"""
)
def asked_queries(spark, sf_dir):
    return L.asked_queries(log_events(spark, sf_dir))


@query("SELECT id, project, updated_at FROM sessions WHERE try_cast(updated_at AS TIMESTAMP) >= TIMESTAMP '2026-01-30 00:00:00'")
def recent_sessions(spark, sf_dir):
    return L.recent(table(spark, sf_dir, "sessions"), "updated_at", NOW, 30).select("id", "project", "updated_at")


@query("SELECT id, updated_at, row_number() OVER (ORDER BY coalesce(updated_at, '') DESC, id, event_count) AS place FROM (SELECT DISTINCT * FROM sessions) ORDER BY place LIMIT 20")
def session_listing(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "sessions").distinct().orderBy(F.coalesce("updated_at", F.lit("")).desc(), "id", "event_count").limit(20)
    order = Window.orderBy(F.coalesce("updated_at", F.lit("")).desc(), "id", "event_count")
    return rows.select("id", "updated_at", F.row_number().over(order).cast("bigint").alias("place"))


@query(f"WITH {EVENTS} SELECT session, event_index, kind FROM ev QUALIFY row_number() OVER (PARTITION BY session ORDER BY event_index DESC) <= 5")
def last_events(spark, sf_dir):
    return L.last_events(log_events(spark, sf_dir), 5).select("session", "event_index", "kind")


@query(f"WITH {EVENTS} SELECT session, event_index FROM ev WHERE contains(lower(coalesce(text, '')), 'vector') OR contains(lower(coalesce(tool, '')), 'vector')")
def matching_events(spark, sf_dir):
    return L.matching_events(log_events(spark, sf_dir), " Vector ").select("session", "event_index")


@query("SELECT id, project FROM sessions WHERE starts_with(lower(id), 'ab')")
def sessions_by_prefix(spark, sf_dir):
    return table(spark, sf_dir, "sessions").where(F.lower("id").startswith("ab")).select("id", "project")


# -- event-time windows over the events stream, in batch form ----------------------------------------
@query("SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, sf_dir):
    from tesselog.streaming import live

    return live.tumbling(table(spark, sf_dir, "events"), "1 hour").select("event_type", F.col("start").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 4).alias("total"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM (SELECT user_id, ts, max(new) OVER (PARTITION BY user_id, ts) AS new, row_number() OVER (PARTITION BY user_id, ts) AS r FROM o) WHERE r = 1)
SELECT user_id, min(s.ts) AS start, count(*) AS n FROM s JOIN events USING (user_id, ts) GROUP BY user_id, sid"""
)
def session_windows(spark, sf_dir):
    from tesselog.streaming import live

    return live.sessions(table(spark, sf_dir, "events"), "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")

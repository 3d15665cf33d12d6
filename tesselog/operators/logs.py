"""Session logs: normalised events and the folds over them, as windows.

Events carry (session, event_index); every fold partitions by the session and
orders by the index, so one shuffle serves a chain of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselog.functions import text as T

SEARCH_TOOLS = ("search_chunks", "find_related")
#: What a tool's name must hold, without case and punctuation, to be a search where its spelling plays no role.
SEARCH_NAMES = ("searchchunks",)
#: Tools that read or change one file.
CONSUMERS = ("Read", "Edit", "MultiEdit", "Write", "NotebookEdit")
FILE_TOOLS = CONSUMERS
HEAVY_BYTES = 5000
#: Keys of a call's input that may name its file, in order.
PATH_KEYS = ("file_path", "filePath", "path", "file", "target_file_path")


@dataclass(frozen=True)
class Savings:
    """What a search stands for: files read without it, tokens of a file and of a returned chunk."""

    files: int = 5
    file_tokens: int = 1500
    chunk_tokens: int = 300
    tools: tuple[str, ...] = SEARCH_TOOLS


@dataclass(frozen=True)
class Replay:
    """Which calls a search could have replaced, and what it would have cost."""

    files: int = 5
    chunk_tokens: int = 300
    #: Tools and shell commands that a search can stand for.
    tools: tuple[str, ...] = ("Read", "Grep", "Glob")
    commands: tuple[str, ...] = (r"(?i)^\s*(grep|rg|ag)(?!\w)", r"(?i)^\s*(find|fd)(?!\w)", r"(?i)^\s*(cat|head|tail|less|more)(?!\w)", r"(?i)^\s*sed\s+-n(?!\w)")


def _string(v: Column, path: str) -> Column:
    """A member if it is a JSON string, else null."""
    part = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(v, path, "string"))


def _is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _number(v: Column, path: str) -> Column:
    """A member if it is a JSON number, else null."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "bigint"))


def _usage(v: Column, narrow: bool) -> tuple[Column, Column]:
    """Tokens in and out: the line's own tokensIn and tokensOut, else of its usage, else of its message's usage (alone, in snake case, if ``narrow``)."""
    told = [_number(v, f"$.message.usage.{k}_tokens") for k in ("input", "output")]
    if narrow:
        return told[0], told[1]
    direct = [_number(v, f"$.tokens{k}") for k in ("In", "Out")]
    top = [F.coalesce(_number(v, f"$.usage.{k}_tokens"), _number(v, f"$.usage.{k}Tokens")) for k in ("input", "output")]
    inner = [F.coalesce(t, _number(v, f"$.message.usage.{k}Tokens")) for t, k in zip(told, ("input", "output"))]
    whole = F.try_variant_get(v, "$.usage", "variant")
    has_direct = direct[0].isNotNull() | direct[1].isNotNull()
    pick = lambda i: F.when(has_direct, direct[i]).when(_is_object(whole) | _is_array(whole), top[i]).otherwise(inner[i])
    return pick(0), pick(1)


def event_rows(lines: DataFrame, narrow_usage: bool = False) -> DataFrame:
    """Events of raw lines (file, line_no, value): file, line_no, sub (place in the line), kind, text, tool, is_error, input, output, ..., usage, model.

    A user or assistant line with a message gives one message event (its text
    blocks joined, calls as placeholders) and one event for each call and
    result; other typed lines are system events; what can't be read is kept as
    unknown.  input and output are JSON texts (strings as they are).  Usage and
    model are read in all their spellings; ``narrow_usage`` reads usage as the
    replay does, from message.usage.input_tokens and output_tokens alone.
    """
    v = F.col("v")
    read = lines.select("file", "line_no", F.try_parse_json("value").alias("v"))
    kind = _string(v, "$.type")
    message = F.try_variant_get(v, "$.message", "variant")
    content = F.try_variant_get(v, "$.message.content", "variant")
    tokens_in, tokens_out = _usage(v, narrow_usage)
    parsed = read.select(
        "file",
        "line_no",
        F.when(_is_object(v), F.when(kind.isin("user", "assistant") & _is_object(message), F.when(F.schema_of_variant(content) == "STRING", "string").when(_is_array(content), "array").otherwise("unknown"))
        .when(kind.isin("user", "assistant"), "unknown").when(kind.isNotNull(), "system").otherwise("unknown")).otherwise("unknown").alias("form"),
        F.when(_is_object(v), kind).alias("kind"),
        F.when(_is_object(v), _string(v, "$.timestamp")).alias("ts"),
        F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(v, "$.message.content", "string")).alias("plain"),
        F.when(_is_array(content), F.try_variant_get(v, "$.message.content", "array<variant>")).alias("blocks"),
        tokens_in.alias("tokens_in"),
        tokens_out.alias("tokens_out"),
        F.coalesce(*(F.nullif(_string(v, p), F.lit("")) for p in ("$.model", "$.message.model"))).alias("model"),
    )
    block = lambda b: F.struct(
        _string(b, "$.type").alias("type"),
        _string(b, "$.name").alias("name"),
        F.when(F.schema_of_variant(b) == "STRING", b.cast("string")).otherwise(_string(b, "$.text")).alias("text"),
        _json(F.try_variant_get(b, "$.input", "variant")).alias("input"),
        _json(F.try_variant_get(b, "$.content", "variant")).alias("output"),
        F.schema_of_variant(F.try_variant_get(b, "$.content", "variant")).alias("output_kind"),
        F.try_variant_get(b, "$.is_error", "boolean").alias("is_error"),
        _string(b, "$.input.command").alias("command"),
        F.coalesce(*(F.nullif(_string(b, f"$.input.{k}"), F.lit("")) for k in PATH_KEYS)).alias("path"),
        _string(b, "$.input.file_path").alias("file_path"),
        _string(b, "$.input.query").alias("query"),
        (F.schema_of_variant(b) == "STRING").alias("bare"),
    )
    flat = parsed.withColumn("blocks", F.transform("blocks", block))
    piece = lambda b: F.when(b["bare"] | (b["type"] == "text"), F.coalesce(b["text"], F.lit(""))).when(b["type"] == "tool_use", F.concat(F.lit("[tool_use:"), F.coalesce(b["name"], F.lit("unknown")), F.lit("]"))).otherwise("")
    joined = F.array_join(F.transform("blocks", piece), "")
    none = F.lit(None)
    names = ("kind", "text", "tool", "is_error", "input", "output", "output_kind", "command", "path", "file_path", "query")
    types = ("string", "string", "string", "boolean", "string", "string", "string", "string", "string", "string", "string")
    make = lambda *c: F.struct(*(x.cast(t).alias(n) for x, n, t in zip(c, names, types)))
    who = F.when(F.col("kind") == "user", "user_message").otherwise("assistant_message")
    said = lambda t: make(who, t, *[none] * 9)
    calls = F.transform(
        F.filter("blocks", lambda b: b["type"].isin("tool_use", "tool_result")),
        lambda b: F.when(b["type"] == "tool_use", make(b["type"], none, b["name"], none, b["input"], none, none, b["command"], b["path"], b["file_path"], b["query"])).otherwise(
            make(b["type"], none, none, b["is_error"], none, b["output"], b["output_kind"], none, none, none, none)
        ),
    )
    blocks = F.concat(F.when((joined != "") | (F.size(calls) == 0), F.array(said(joined))).otherwise(F.array().cast(calls_type(names, types))), calls)
    made = F.when(F.col("form") == "string", F.array(said(F.col("plain")))).when(F.col("form") == "array", blocks).otherwise(F.array(make(F.col("form"), *[none] * 10)))
    out = flat.select("file", "line_no", "ts", "tokens_in", "tokens_out", "model", F.posexplode(made).alias("sub", "e"))
    mine = lambda c: F.when(F.col("e.kind") == "assistant_message", F.col(c)).alias(c)
    return out.select("file", "line_no", "sub", *(F.col(f"e.{n}").alias(n) for n in names), "ts", mine("tokens_in"), mine("tokens_out"), mine("model"))


def events(lines: DataFrame, narrow_usage: bool = False) -> DataFrame:
    """``event_rows`` numbered from 0 in each file: session, event_index, line_no, kind, ..."""
    rows = event_rows(lines, narrow_usage)
    order = Window.partitionBy("file").orderBy("line_no", "sub")
    number = (F.row_number().over(order) - 1).cast("bigint").alias("event_index")
    return rows.select(F.col("file").alias("session"), number, *(c for c in rows.columns if c not in ("file", "sub")))


def calls_type(names, types) -> str:
    return "array<struct<" + ",".join(f"{n}:{t}" for n, t in zip(names, types)) + ">>"


def _json(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.to_json(v))


def _order():
    return Window.partitionBy("session").orderBy("event_index")


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def _up_to():
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def is_search(tool: Column, tools: tuple[str, ...] = SEARCH_TOOLS) -> Column:
    return F.coalesce(tool.isin(*tools), F.lit(False))


def names_search(tool: Column, names: tuple[str, ...] = SEARCH_NAMES) -> Column:
    """Whether a tool's name, without case and punctuation, holds one of ``names``; so prefixes and separators of clients play no role."""
    bare = F.regexp_replace(F.lower(tool), "[^a-z0-9]", "")
    hit = F.lit(False)
    for n in names:
        hit = hit | F.contains(bare, F.lit(n))
    return F.coalesce(hit, F.lit(False))


def kind_counts(ev: DataFrame) -> DataFrame:
    """session, total, and the number of events of each kind."""
    kinds = ("user_message", "assistant_message", "tool_use", "tool_result", "system", "unknown")
    return ev.groupBy("session").agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.max(is_search(F.col("tool"))).alias("any_search"))


def session_summary(lines: DataFrame) -> DataFrame:
    """file, n_lines, first_ts, last_ts (by line, not by value), cwd, branch (first that isn't empty)."""
    v = F.col("v")
    read = lines.select("file", "line_no", F.try_parse_json("value").alias("v"))
    fields = read.select("file", "line_no", *(F.when(_is_object(v), F.nullif(_string(v, p), F.lit(""))).alias(n) for n, p in (("ts", "$.timestamp"), ("cwd", "$.cwd"), ("branch", "$.gitBranch"))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    return fields.groupBy("file").agg(
        F.count("*").alias("n_lines"), first("ts").alias("first_ts"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("last_ts"), first("cwd").alias("cwd"), first("branch").alias("branch")
    )


def returned_chunks(output: Column, kind: Column) -> Column:
    """How many chunks a search output holds: array items, ``chunks`` items, ``## `` lines, else 1."""
    heads = F.regexp_count(output, F.lit(r"(?m)^## "))
    inner = F.json_array_length(F.get_json_object(output, "$.chunks"))
    return (
        F.when(kind.startswith("ARRAY"), F.json_array_length(output))
        .when(kind.startswith("OBJECT"), F.coalesce(inner, F.lit(1)))
        .when(kind == "STRING", F.when(heads > 0, heads).otherwise(1))
        .otherwise(1)
        .cast("bigint")
    )


def output_size(output: Column, kind: Column) -> Column:
    """Characters of an output: of a string, of all strings and ``text`` members of an array, of an object's JSON, else 0."""
    parts = F.try_variant_get(F.try_parse_json(output), "$", "array<variant>")
    said = F.transform(parts, lambda b: F.length(F.when(F.schema_of_variant(b) == "STRING", b.cast("string")).otherwise(_string(b, "$.text"))))
    total = F.aggregate(said, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    size = F.when(kind.startswith("ARRAY"), total).when((kind == "STRING") | kind.startswith("OBJECT"), F.length(output))
    return F.coalesce(size, F.lit(0))


def search_calls(ev: DataFrame, options: Savings = Savings()) -> DataFrame:
    """session, event_index, chunks, saved of each search call: paired with the next tool event if that is a result."""
    tools = ev.where(F.col("kind").isin("tool_use", "tool_result"))
    ahead = lambda c: F.lead(c).over(_order())
    paired = tools.withColumns({"next_kind": ahead("kind"), "next_error": ahead("is_error"), "next_output": ahead("output"), "next_form": ahead("output_kind")})
    calls = paired.where((F.col("kind") == "tool_use") & is_search(F.col("tool"), options.tools))
    got = F.when((F.col("next_kind") == "tool_result") & ~F.coalesce("next_error", F.lit(False)), returned_chunks(F.col("next_output"), F.coalesce("next_form", F.lit("")))).otherwise(0)
    chunks = F.least(F.lit(options.files), F.greatest(F.lit(0), got)).cast("bigint")
    saved = F.greatest(F.lit(0), options.files * options.file_tokens - chunks * options.chunk_tokens)
    return calls.select("session", "event_index", chunks.alias("chunks"), saved.cast("bigint").alias("saved"))


def turn_costs(ev: DataFrame, prices: DataFrame) -> DataFrame:
    """session, event_index, model, tokens_in, tokens_out, usd of each assistant message with usage; usd null for unlisted models."""
    turns = ev.where("kind = 'assistant_message' and (tokens_in is not null or tokens_out is not null)")
    turns = turns.select("session", "event_index", "model", F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"), F.coalesce("tokens_out", F.lit(0)).alias("tokens_out"))
    usd = (F.greatest("tokens_in", F.lit(0)) * F.col("usd_in_mtok") + F.greatest("tokens_out", F.lit(0)) * F.col("usd_out_mtok")) / 1e6
    return turns.join(prices.select("model", "usd_in_mtok", "usd_out_mtok"), "model", "left").select("session", "event_index", "model", "tokens_in", "tokens_out", usd.alias("usd"))


def savings(ev: DataFrame, prices: DataFrame, options: Savings = Savings()) -> DataFrame:
    """Per session: searches, chunks, tokens saved and consumed, percent, dollars by the blended rate of the priced turns."""
    calls = search_calls(ev, options).groupBy("session").agg(F.count("*").alias("searches"), F.sum("chunks").alias("chunks"), F.sum("saved").alias("tokens_saved"))
    spent = F.when(F.col("tokens_in").isNotNull() | F.col("tokens_out").isNotNull(), F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).otherwise(T.approx_tokens(F.col("text")))
    used = ev.groupBy("session").agg(F.coalesce(F.sum(F.when(F.col("kind") == "assistant_message", spent)), F.lit(0)).alias("tokens_consumed"))
    tokens = F.greatest("tokens_in", F.lit(0)) + F.greatest("tokens_out", F.lit(0))
    priced = F.col("usd").isNotNull() & (tokens > 0)
    cost = turn_costs(ev, prices).groupBy("session").agg(
        F.sum("usd").alias("usd"), F.sum(F.when(priced, F.col("usd"))).alias("p_usd"), F.sum(F.when(priced, tokens)).alias("p_tokens")
    )
    all_ = used.join(calls, "session", "left").join(cost, "session", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("searches", "chunks", "tokens_saved")})
    rate = F.col("p_usd") / F.col("p_tokens") * 1e6
    saved_usd = F.col("tokens_saved") * rate / 1e6
    total = F.col("tokens_saved") + F.col("tokens_consumed")
    spent_usd = F.coalesce("usd", F.lit(0.0))
    return all_.select(
        "session",
        "searches",
        "chunks",
        "tokens_saved",
        "tokens_consumed",
        F.round(F.when(total > 0, F.col("tokens_saved") / total).otherwise(0.0), 6).alias("percent_saved"),
        F.round(spent_usd, 6).alias("dollars_consumed"),
        F.round(rate, 6).alias("usd_per_mtok"),
        F.round(saved_usd, 6).alias("dollars_saved"),
        F.round(F.when(saved_usd + spent_usd > 0, saved_usd / (saved_usd + spent_usd)), 6).alias("percent_dollars"),
    )


def replaceable(options: Replay = Replay()) -> Column:
    """Whether a call could have been a search."""
    command = F.lit(False)
    for p in options.commands:
        command = command | F.col("command").rlike(p)
    return F.coalesce(F.col("tool").isin(*options.tools) | (F.col("tool") == "Bash") & command, F.lit(False))


def replay(ev: DataFrame, options: Replay = Replay()) -> DataFrame:
    """session, event_index, kind, replaceable, actual, counterfactual, snippet of each event.

    A result is replaced if any replaceable call came since the result before
    it: a search's chunks instead of its tokens.
    """
    use = (F.col("kind") == "tool_use") & replaceable(options)
    with_group = ev.withColumns({"use": use, "grp": F.count_if(F.col("kind") == "tool_result").over(_before())})
    since = F.max("use").over(Window.partitionBy("session", "grp").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1))
    usage = F.when(F.col("tokens_in").isNotNull() | F.col("tokens_out").isNotNull(), F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0)))
    actual = (
        F.when(F.col("kind") == "assistant_message", F.coalesce(usage, T.approx_tokens(F.col("text"))))
        .when(F.col("kind") == "user_message", T.approx_tokens(F.col("text")))
        .when(F.col("kind") == "tool_result", T.approx_tokens(F.coalesce("text", "output")))
        .otherwise(0)
        .cast("bigint")
    )
    swapped = (F.col("kind") == "tool_result") & F.coalesce(since, F.lit(False))
    counter = F.when(swapped, options.files * options.chunk_tokens).otherwise(actual).cast("bigint")
    return with_group.select("session", "event_index", "kind", F.col("use").alias("replaceable"), swapped.alias("replaced"), actual.alias("actual"), counter.alias("counterfactual"), T.snippet(F.col("text")).alias("snippet"))


def replay_totals(rows: DataFrame) -> DataFrame:
    """Totals of each session and, with session null, of all."""
    out = rows.rollup("session").agg(F.count("*").alias("events"), F.count_if("replaced").alias("replaced"), F.sum("actual").alias("actual"), F.sum("counterfactual").alias("counterfactual"))
    saved = F.col("actual") - F.col("counterfactual")
    return out.withColumns({"saved": saved, "percent": F.round(F.when(F.col("actual") > 0, saved / F.col("actual")).otherwise(0.0), 6)})


def with_turns(ev: DataFrame) -> DataFrame:
    """Events with ``turn`` (0 for what comes before the first user message)."""
    return ev.withColumn("turn", F.count_if(F.col("kind") == "user_message").over(_up_to()))


def turns(ev: DataFrame, search_names: tuple[str, ...] = SEARCH_NAMES) -> DataFrame:
    """One row for each turn: number, times, flags, tools in order of first use, and metrics; search_chunks are the hits its searches returned.

    Numbers go 1, 2, ...; after a turn 0 the next is 2.  A turn is interrupted
    if more calls than results are open at its end, results without an open
    call not counted.
    """
    step = F.when(F.col("kind") == "tool_use", 1).when(F.col("kind") == "tool_result", -1).otherwise(0)
    inside = Window.partitionBy("session", "turn").orderBy("event_index")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = with_turns(ev).withColumn("s", F.sum(step).over(so_far))
    last_tool = F.last(F.when(F.col("kind") == "tool_use", F.col("tool")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"of_tool": last_tool, "first_turn": F.min("turn").over(Window.partitionBy("session"))})
    result = F.col("kind") == "tool_result"
    size = output_size(F.col("output"), F.col("output_kind"))
    use = F.col("kind") == "tool_use"
    out = rows.groupBy("session", "turn").agg(
        F.count("*").alias("events"),
        F.min("event_index").alias("first_event"),
        F.min_by("ts", "event_index").alias("started_at"),
        F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("event_index"))).alias("ended_at"),
        F.coalesce(F.max("is_error"), F.lit(False)).alias("has_error"),
        (F.max_by("s", "event_index") - F.least(F.lit(0), F.min("s")) > 0).alias("interrupted"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(use & F.col("tool").isNotNull(), F.struct("event_index", "tool")))), lambda x: x["tool"])).alias("tools"),
        F.count_if(use & names_search(F.col("tool"), search_names)).alias("searches"),
        F.sum(F.when(result & names_search(F.col("of_tool"), search_names), F.coalesce(result_count(F.col("output")), F.lit(0))).otherwise(0)).cast("bigint").alias("search_chunks"),
        F.sum(F.when(result & (F.col("of_tool") == "Read"), size).otherwise(0)).alias("read_bytes"),
        F.sum(F.when(result & (F.col("of_tool") == "Bash"), size).otherwise(0)).alias("bash_bytes"),
        F.min("first_turn").alias("first_turn"),
    )
    number = F.when(F.col("turn") == 0, 0).when(F.col("first_turn") == 0, F.col("turn") + 1).otherwise(F.col("turn"))
    heavy = (F.col("searches") == 0) & (F.col("read_bytes") + F.col("bash_bytes") >= HEAVY_BYTES)
    outcome = F.when(F.col("interrupted"), "interrupted").when(F.col("has_error"), "errored").otherwise("ok")
    return out.withColumns({"turn_no": number.cast("bigint"), "missed": heavy, "outcome": outcome, "tools": F.array_join("tools", ",")}).drop("first_turn", "turn")


def turn_savings(turn_rows: DataFrame, session_savings: DataFrame) -> DataFrame:
    """session, turn_no, seconds, saved: each turn's length, and its part of the session's saved tokens.

    The part is the turn's returned chunks over those of the session, at most
    all; null if the turn or the session returned none or nothing was saved.
    """
    both = turn_rows.join(session_savings.select("session", "chunks", "tokens_saved"), "session")
    part = F.when((F.col("tokens_saved") > 0) & (F.col("chunks") > 0) & (F.col("search_chunks") > 0), F.floor(F.col("tokens_saved") * F.least(F.lit(1.0), F.col("search_chunks") / F.col("chunks")) + 0.5))
    seconds = F.col("ended_at").try_cast("timestamp").cast("double") - F.col("started_at").try_cast("timestamp").cast("double")
    return both.select("session", "turn_no", F.round(seconds, 3).alias("seconds"), part.cast("bigint").alias("saved"))


def replay_view(rows: DataFrame, most: int = 500, rare: float = 0.05) -> DataFrame:
    """The first ``most`` rows of each session's replay; only replaceable and replaced ones where these are rare."""
    shown = F.col("replaceable") | F.col("replaced")
    share = F.avg(shown.cast("double")).over(Window.partitionBy("session"))
    kept = rows.withColumn("share", share).where(shown | (F.col("share") == 0) | (F.col("share") >= rare)).drop("share")
    return kept.withColumn("rn", F.row_number().over(_order())).where(F.col("rn") <= most).drop("rn")


def tool_pairs(ev: DataFrame) -> DataFrame:
    """session, result_index, use_index, tool: each result with the latest call still open, over the whole session.

    The open calls form a stack whose height is a running sum above its running
    minimum; a result belongs to the last call pushed at the height it pops.
    """
    tools = ev.where("kind = 'tool_result' or (kind = 'tool_use' and tool is not null)")
    push = F.col("kind") == "tool_use"
    up_to = Window.partitionBy("session").orderBy("event_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = tools.withColumn("s", F.sum(F.when(push, 1).otherwise(-1)).over(up_to))
    run = run.withColumn("low", F.least(F.lit(0), F.min("s").over(up_to)))
    run = run.withColumn("height", F.when(push, F.col("s") - F.col("low")).otherwise(F.col("s") - F.col("low") + 1))
    # a result that meets an empty stack lowers the minimum itself
    before = Window.partitionBy("session").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    empty = ~push & (F.col("s") < F.coalesce(F.least(F.lit(0), F.min("s").over(before)), F.lit(0)))
    run = run.withColumn("level", F.when(empty, 0).otherwise(F.col("height")))
    same = Window.partitionBy("session", "level").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    partner = F.last(F.when(push, F.struct("event_index", "tool")), ignorenulls=True).over(same)
    return run.withColumn("p", partner).where((F.col("kind") == "tool_result") & (F.col("level") > 0)).select("session", F.col("event_index").alias("result_index"), F.col("p.event_index").alias("use_index"), F.col("p.tool").alias("tool"), "output", "output_kind")


def search_payload(output: Column) -> Column:
    """The JSON value that a search output holds, unwrapped up to three times from texts and text envelopes."""
    for _ in range(3):
        inner = F.coalesce(F.get_json_object(output, "$.content[0].text"), F.get_json_object(output, "$[0].text"), F.when(F.ltrim(output).startswith('"'), F.get_json_object(output, "$")))
        output = F.coalesce(inner, output)
    return output


def search_results(output: Column) -> Column:
    """The JSON array of results in a search output (its results, its hits, or the bare array); null if there is none."""
    payload = search_payload(output)
    listed = F.coalesce(F.get_json_object(payload, "$.results"), F.get_json_object(payload, "$.hits"), payload)
    return F.when(F.ltrim(listed).startswith("["), listed)


def result_count(output: Column) -> Column:
    """How many results a search output holds; null if it can't be read."""
    return F.json_array_length(search_results(output)).cast("bigint")


def latency(output: Column) -> Column:
    """The latencyMs that a search output tells, null if there is none."""
    return F.get_json_object(search_payload(output), "$.latencyMs").try_cast("double")


def search_label(call_input: Column) -> Column:
    """One line on a search call from its input: the query of at most 60 characters, the mode, the number of results asked for; null without a query."""
    v = F.try_parse_json(call_input)
    query = _string(v, "$.query")
    short = F.when(F.length(query) > 60, F.concat(F.substring(query, 1, 59), F.lit("…"))).otherwise(query)
    plain = F.coalesce(F.try_variant_get(v, "$.hybrid", "boolean") == F.lit(False), F.lit(False)) & (F.schema_of_variant(F.try_variant_get(v, "$.hybrid", "variant")) == "BOOLEAN")
    top = F.coalesce(_number(v, "$.top"), F.lit(10)).cast("string")
    return F.when(query.isNotNull(), F.concat(F.lit('"'), short, F.lit('"  ·  '), F.when(plain, "bm25").otherwise("hybrid"), F.lit("  ·  top="), top))


def _hits(output: Column) -> Column:
    return F.from_json(search_results(output), "array<struct<filePath:string,startLine:bigint>>")


def search_hits(ev: DataFrame, search_names: tuple[str, ...] = SEARCH_NAMES) -> DataFrame:
    """session, result_index, search_index, chunk_index, file_path of each hit in the results of searches."""
    narrow = ev.select("session", "event_index", "kind", "tool")
    searches = narrow.withColumn("near", F.last(F.when((F.col("kind") == "tool_use") & names_search(F.col("tool"), search_names), F.col("event_index")), ignorenulls=True).over(_before()))
    near = searches.where("kind = 'tool_result'").select("session", F.col("event_index").alias("result_index"), "near")
    results = tool_pairs(ev).where(names_search(F.col("tool"), search_names)).join(near, ["session", "result_index"])
    out = results.select("session", "result_index", F.coalesce("near", "result_index").alias("search_index"), F.posexplode(_hits(F.col("output"))).alias("chunk_index", "h"))
    return out.where("h.filePath is not null").select("session", "result_index", "search_index", "chunk_index", F.col("h.filePath").alias("file_path"))


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")


def accesses(ev: DataFrame) -> DataFrame:
    """session, event_index, target: the calls that read or change a file."""
    return ev.where((F.col("kind") == "tool_use") & F.col("tool").isin(*CONSUMERS) & (F.col("path") != "")).select("session", "event_index", F.col("path").alias("target"))


def link_accesses(hits: DataFrame, used: DataFrame) -> DataFrame:
    """session, event_index, search_index, chunk_index, file_path: the hit of ``search_hits`` that each access (session, event_index, target) follows from.

    The latest earlier hit of exactly the same path wins, else the latest whose
    path agrees in at least two segments from the end.  Accesses meet hits by
    session and the last segment of the path, an equi join.
    """
    h = hits.withColumns({"h_seg": _segments(F.col("file_path"))}).withColumn("base", F.try_element_at("h_seg", F.lit(-1)))
    u = used.withColumn("u_seg", _segments(F.col("target"))).withColumn("base", F.try_element_at("u_seg", F.lit(-1)))
    n = F.least(F.size("u_seg"), F.size("h_seg"))
    tail = lambda c: F.slice(c, F.size(c) - n + 1, n)
    exact = F.col("target") == F.col("file_path")
    same = exact | ((n >= 2) & (tail("u_seg") == tail("h_seg"))) | (F.array_join("u_seg", "/") == F.array_join("h_seg", "/"))
    both = u.join(h, ["session", "base"]).where((F.col("result_index") < F.col("event_index")) & same)
    best = Window.partitionBy("session", "event_index").orderBy(F.desc(exact), F.desc("result_index"), F.desc("chunk_index"))
    return both.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("session", "event_index", "search_index", "chunk_index", "file_path")


def provenance(ev: DataFrame, search_names: tuple[str, ...] = SEARCH_NAMES) -> DataFrame:
    """``link_accesses`` of the searches and accesses of the same events."""
    return link_accesses(search_hits(ev, search_names), accesses(ev))


def use_rows(ev: DataFrame, replayed: DataFrame) -> DataFrame:
    """session, event_index, tool, actual, counterfactual of each replaceable call, with the cost of the result right behind it, 0 where there is none."""
    rows = replayed.join(ev.select("session", "event_index", "tool"), ["session", "event_index"])
    ahead = lambda c: F.coalesce(F.when((F.lead("kind").over(_order()) == "tool_result") & (F.lead("event_index").over(_order()) == F.col("event_index") + 1), F.lead(c).over(_order())), F.lit(0))
    paired = rows.withColumns({"a": ahead("actual"), "c": ahead("counterfactual")})
    return paired.where("kind = 'tool_use' and replaceable").select("session", "event_index", "tool", F.col("a").cast("bigint").alias("actual"), F.col("c").cast("bigint").alias("counterfactual"))


def projects(sessions: DataFrame, now: str, group_inferred: bool = True) -> DataFrame:
    """project, sessions, worktrees, live, inferred: a row for each effective project root, live ones and large ones first."""
    inferred = F.coalesce(F.col("project_root_source") == "inferred-prefix", F.lit(False))
    root = F.when(F.coalesce("project_root", F.lit("")) != "", F.col("project_root")).otherwise(F.col("project"))
    key = root if group_inferred else F.when(inferred, F.col("project")).otherwise(root)
    age = F.lit(now).cast("timestamp").cast("double") - F.col("updated_at").try_cast("timestamp").cast("double")
    live = F.coalesce(age < 300, F.lit(False))
    out = sessions.groupBy(key.alias("project")).agg(
        F.count("*").alias("sessions"), F.count_distinct("project").alias("worktrees"), F.max(live).alias("live"), (F.count_if(inferred) if group_inferred else F.lit(0)).cast("bigint").alias("inferred")
    )
    return out.withColumn("name", F.regexp_extract("project", r"([^/\\]*)[/\\]*$", 1)).orderBy(F.desc("live"), F.desc("sessions"), "name", "project")


def prefix_roots(cwds: DataFrame, roots: DataFrame) -> DataFrame:
    """cwd, root: the longest root that is a strict prefix of cwd before one of - / _; null if there is none.

    Each cwd offers its prefixes that end before such a character, and these
    meet the roots in an equi join: no pair is tried in vain.
    """
    ends = F.filter(F.sequence(F.lit(1), F.length("cwd")), lambda i: F.substring("cwd", i, F.lit(1)).isin("-", "/", "_") & (i > 1))
    offers = cwds.where("cwd <> ''").select("cwd", F.explode(F.transform(ends, lambda i: F.substring("cwd", F.lit(1), i - 1))).alias("root"))
    best = offers.join(roots.where("root <> ''").select("root").distinct(), "root").groupBy("cwd").agg(F.max_by("root", F.length("root")).alias("root"))
    return cwds.select("cwd").distinct().join(best, "cwd", "left")


def ground_truth(ev: DataFrame, roots: DataFrame, search_names: tuple[str, ...] = SEARCH_NAMES) -> DataFrame:
    """session, event_index, source, query, files: each query with the files its session touched before the next one.

    roots has session, project_root; files are relative to it, first-seen
    order.  A query too short to be used still ends the one before it.
    """
    call = (F.col("kind") == "tool_use") & names_search(F.col("tool"), search_names)
    said = (F.col("kind") == "user_message") & (F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")) != "") & ~F.regexp_replace("text", r"^\s+", "").startswith("[")
    asks = call | F.coalesce(said, F.lit(False))
    rows = ev.withColumns({"asks": asks, "win": F.count_if(asks).over(_up_to())}).where("win > 0")
    query = F.when(call, F.nullif(F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"^\s+|\s+$", "")), F.lit(""))).otherwise(T.first_sentence(F.col("text")))
    root = F.regexp_replace("project_root", "/+$", "")
    inside = F.col("file_path").startswith(F.concat(root, F.lit("/"))) & (F.length("file_path") > F.length(root) + 1)
    rel = F.when((F.col("kind") == "tool_use") & F.col("tool").isin(*FILE_TOOLS) & inside, F.substring(F.col("file_path"), F.length(root) + 2, F.length("file_path")))
    rows = rows.join(roots, "session", "left").select("session", "event_index", "win", "asks", F.when(F.col("asks"), query).alias("query"), F.when(call, "search_call").otherwise("user_message").alias("source"), rel.alias("rel"))
    out = rows.groupBy("session", "win").agg(
        F.min(F.when(F.col("asks"), F.col("event_index"))).alias("event_index"),
        F.max(F.when(F.col("asks"), F.col("source"))).alias("source"),
        F.max("query").alias("query"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("rel").isNotNull(), F.struct("event_index", "rel")))), lambda x: x["rel"])).alias("files"),
    )
    return out.where("query is not null").drop("win")


def merged_truth(truth: DataFrame, roots: DataFrame) -> DataFrame:
    """project_root, query (first spelling), source, sessions, files, first_session, first_index: queries of one project that differ by case only, merged.

    Files are folded to their first place before they are listed, so a popular
    query gathers its distinct files, not all its askings.
    """
    rows = truth.join(roots, "session").withColumn("key", F.lower("query"))
    order = F.struct("session", "event_index")
    seen = rows.select("project_root", "key", "session", "event_index", F.posexplode("files").alias("i", "file"))
    firsts = seen.groupBy("project_root", "key", "file").agg(F.min(F.struct("session", "event_index", "i")).alias("at"))
    files = firsts.groupBy("project_root", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "file"))), lambda x: x["file"]).alias("files"))
    out = rows.groupBy("project_root", "key").agg(F.min(F.struct(order.alias("o"), "query")).alias("m"), F.min("source").alias("source"), F.count_distinct("session").alias("sessions"))
    none = F.array().cast("array<string>")
    return out.join(files, ["project_root", "key"], "left").select(
        "project_root", F.col("m.query").alias("query"), "source", "sessions", F.coalesce("files", none).alias("files"), F.col("m.o.session").alias("first_session"), F.col("m.o.event_index").alias("first_index")
    )


def retained_queries(merged: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` best queries of each project from ``merged_truth``, with their place.

    Search calls come first, then queries that have files, in order of their
    first asking; of the messages those stay that have files or look like a
    question on code.
    """
    rows = merged.where((F.col("source") == "search_call") | (F.size("files") > 0) | T.entity_shaped(F.col("query")))
    order = Window.partitionBy("project_root").orderBy((F.col("source") != "search_call").cast("int"), (F.size("files") == 0).cast("int"), "first_session", "first_index")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def asked_queries(ev: DataFrame, search_names: tuple[str, ...] = SEARCH_NAMES) -> DataFrame:
    """session, query, place: the distinct queries of each session, those of search calls before first sentences of messages, whatever the case, first spelling kept."""
    call = (F.col("kind") == "tool_use") & names_search(F.col("tool"), search_names) & (F.col("query") != "")
    query = F.when(call, F.regexp_replace("query", r"^\s+|\s+$", "")).when(F.col("kind") == "user_message", T.first_sentence(F.col("text")))
    rows = ev.select("session", "event_index", F.when(call, 0).otherwise(1).alias("rank"), query.alias("query")).where("query is not null")
    first = rows.groupBy("session", F.lower("query").alias("key")).agg(F.min(F.struct("rank", "event_index", "query")).alias("m"))
    place = F.row_number().over(Window.partitionBy("session").orderBy("m.rank", "m.event_index"))
    return first.select("session", F.col("m.query").alias("query"), place.cast("bigint").alias("place"))


def recent(rows: DataFrame, when: str, now: str, days: int) -> DataFrame:
    """Rows of the last days before ``now``; rows without a time are out."""
    return rows.where(F.col(when).try_cast("timestamp") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def last_events(ev: DataFrame, n: int = 1000) -> DataFrame:
    """The last n events of each session."""
    back = Window.partitionBy("session").orderBy(F.desc("event_index"))
    return ev.withColumn("rn", F.row_number().over(back)).where(F.col("rn") <= n).drop("rn")


def matching_events(ev: DataFrame, needle: str) -> DataFrame:
    """Events whose text or tool holds the needle, whatever the case; all for a blank one."""
    want = needle.strip().lower()
    if not want:
        return ev
    return ev.where(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(want)) | F.contains(F.lower(F.coalesce("tool", F.lit(""))), F.lit(want)))


def session_by_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """The one session whose id begins with ``prefix`` in any case; none or several are an error."""
    found = sessions.where(F.lower("id").startswith(prefix.lower()))
    n = len(found.select("id").distinct().limit(2).collect())
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} session begins with {prefix!r}")
    return found


def used_searches(links: DataFrame) -> DataFrame:
    """session, search_index, consumers, used_chunks: what came of each search, from rows of ``provenance``."""
    return links.groupBy("session", "search_index").agg(F.sort_array(F.collect_list("event_index")).alias("consumers"), F.sort_array(F.collect_set("chunk_index")).alias("used_chunks"))


def nearest_used_search(ev: DataFrame, links: DataFrame) -> DataFrame:
    """session, event_index, search_index: for each result the latest earlier search that something came of."""
    used = links.select("session", F.col("search_index").alias("event_index")).distinct().withColumn("used", F.lit(True))
    rows = ev.select("session", "event_index", "kind").join(used, ["session", "event_index"], "left")
    near = F.last(F.when(F.col("used"), F.col("event_index")), ignorenulls=True).over(_before())
    return rows.withColumn("search_index", near).where("kind = 'tool_result' and search_index is not null").select("session", "event_index", "search_index")

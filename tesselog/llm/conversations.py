"""Conversations rebuilt from message rows.

Which messages belong together is found as connected components: messages with
the same identifier are linked to the first of them, replies and quotes to what
they answer or quote (where such columns exist), and alternating large-star and
small-star joins shrink every component to a star around its smallest message.
Messages without an identifier get the one of their component.

Validity is decided by aggregates wherever order plays no role; the order is
then only needed for the conversations still in question.  Their messages are
partitioned by ranges of (conversation, time, message_id) of about
``BUCKET_ROWS`` each, ordered range by range and stitched by the ranges'
summaries, so that no window holds one hot conversation whole, however its
messages cluster in time.

Defined cases: of rows of one message_id the one received last counts (of those
the one with the largest other fields); a null message_id belongs nowhere; a
message without an identifier and without links belongs nowhere; a component
without any identifier is called ``thread-<smallest message_id>``; one with
several has the smallest.  Role, ts and content may be null or unreadable: the
first two break the conversation, the last is blank.  Texts are never shuffled
past the first step, which keeps only whether they are blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselog.session import materialise, release

BUCKET_ROWS = 50_000

#: The spellings of the speakers, lower-case, words separated by one space.
SPEAKERS = {
    "user": ("user", "human", "usr", "customer", "client", "person", "end user", "me"),
    "assistant": ("assistant", "ai", "model", "bot", "agent", "chatbot", "llm", "gpt", "chatgpt", "ai assistant"),
    "system": ("system", "sys", "developer", "system prompt", "instruction", "instructions"),
    "tool": ("tool", "function", "tool result", "tool call", "function call", "function result", "tool output", "plugin"),
}


def speaker(role: Column) -> Column:
    """user, assistant, system or tool; null where the role can't be read."""
    text = F.trim(F.regexp_replace(F.lower(role), r"[^\p{L}]+", " "))
    out = F.lit(None).cast("string")
    for name, spellings in SPEAKERS.items():
        out = F.when(text.isin(*spellings), name).otherwise(out)
    return out


def instant(ts: Column) -> Column:
    """Microseconds since 1970 of a time in ISO form (UTC without a zone) or of milliseconds in digits; null if it can't be read."""
    text = F.trim(F.regexp_replace(ts, r"^\s+|\s+$", ""))
    millis = F.when(text.rlike(r"^\d{1,15}$"), text.try_cast("bigint") * 1000)
    zoned = text.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$")
    full = F.regexp_replace(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))), r"([+-]\d\d)(\d\d)$", "$1:$2")
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d"), F.upper(full).try_cast("timestamp"))
    return F.coalesce(millis, F.unix_micros(iso))


def identifier(session_id: Column) -> Column:
    """Bare lower-case id, null if nothing is left."""
    text = F.lower(F.regexp_replace(session_id, r"^[\s\p{Z}{}]+|[\s\p{Z}{}]+$", ""))
    return F.when(~text.isin("", "null", "none", "nan", "n/a", "undefined"), text)


def visible(content: Column) -> Column:
    """Whether there is a character that shows; white space, controls, zero-width and filler characters don't."""
    return F.coalesce(content.rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}\u2800\u3164\u115F\u1160\uFFA0\u034F\uFE00-\uFE0F]"), F.lit(False))


def latest(messages: DataFrame) -> DataFrame:
    """message_id, sid, speaker, at, shows (and reply_to, quote_of if there): one row for each message."""
    links = [c for c in ("reply_to", "quote_of") if c in messages.columns]
    fields = [
        "received_at",
        identifier(F.col("session_id")).alias("sid"),
        speaker(F.col("role")).alias("speaker"),
        instant(F.col("ts")).alias("at"),
        visible(F.col("content")).alias("shows"),
        *(F.col(c).try_cast("bigint").alias(c) for c in links),
    ]
    best = messages.where("message_id is not null").select("message_id", F.struct(*fields).alias("b")).groupBy("message_id").agg(F.max("b").alias("b"))
    return best.select("message_id", *(f"b.{c}" for c in ("sid", "speaker", "at", "shows", *links)))


def _shrink(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over distinct edges (a, b), a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, root: the smallest node of each component over edges (a, b), for all nodes that have an edge to another.

    Large-star and small-star alternate until nothing changes; each step is
    written to the shared folder.  Minima are found by partial aggregation and
    joined back on the node, so a hub's neighbours are never gathered in one
    row.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    before = _mark(edges)
    for _ in range(max_rounds):
        large = materialise(_shrink(edges, True), "large")
        small = materialise(_shrink(large, False), "small")
        release(edges, large)
        edges = small
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components haven't settled in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _with_conversation(rows: DataFrame) -> DataFrame:
    """``rows`` with the root of their component as ``conv``; rows that belong nowhere are gone."""
    firsts = rows.where("sid is not null").groupBy("sid").agg(F.min("message_id").alias("b"))
    edges = rows.join(firsts, "sid").select(F.col("message_id").alias("a"), "b")
    for c in ("reply_to", "quote_of"):
        if c in rows.columns:
            known = rows.select(F.col("message_id").alias("b"))
            edges = edges.unionByName(rows.where(F.col(c).isNotNull()).select(F.col("message_id").alias("a"), F.col(c).alias("b")).join(known, "b").select("a", "b"))
    found = components(edges)
    joined = rows.join(found, rows["message_id"] == found["node"], "left").where("sid is not null or root is not null")
    return joined.select("message_id", "sid", "speaker", "at", "shows", F.coalesce("root", "message_id").alias("conv"))


def conversations(messages: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """session_id, turn_no, message_id, speaker of every message of the kept conversations."""
    rows = materialise(_with_conversation(materialise(latest(messages), "messages")), "linked")
    place = F.struct("at", "message_id")
    first = F.min(F.when(F.col("speaker") != "system", F.struct("at", "message_id", "speaker")))
    stats = rows.groupBy("conv").agg(
        F.coalesce(F.min("sid"), F.concat(F.lit("thread-"), F.min("conv").cast("string"))).alias("session_id"),
        F.count("*").alias("n"),
        F.max(F.col("speaker").isNull() | F.col("at").isNull()).alias("broken"),
        first["speaker"].alias("opens"),
        F.max((F.col("speaker") == "user") & F.col("shows")).alias("asks"),
    )
    open_ = materialise(stats.where("not broken and opens = 'user' and asks").select("conv", "session_id", "n"), "open")
    ranges = max(1, -(-(open_.agg(F.sum("n")).first()[0] or 0) // bucket_rows))
    event = F.when(F.col("speaker") == "user", "u").when((F.col("speaker") == "assistant") & F.col("shows"), "a")
    kept = rows.join(open_, "conv").select("conv", "session_id", "message_id", "speaker", "at", event.alias("event"))
    kept = materialise(kept.repartitionByRange(ranges, "conv", "at", "message_id").withColumn("bucket", F.spark_partition_id()), "kept")
    order = Window.partitionBy("conv", "bucket").orderBy("at", "message_id")
    earlier = F.last("event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ordered = materialise(kept.withColumns({"rn": F.row_number().over(order), "unanswered": (F.col("event") == "u") & F.coalesce(earlier == "u", F.lit(False))}), "ordered")
    # each bucket as one row: what it begins and ends with, and whether all is answered inside
    real = F.when(F.col("event").isNotNull(), place)
    parts = ordered.groupBy("conv", "session_id", "bucket").agg(
        F.count("*").alias("n"),
        F.min_by("event", real).alias("head"),
        F.max_by("event", real).alias("tail"),
        F.max(F.coalesce("unanswered", F.lit(False))).alias("bad"),
    )
    line = Window.partitionBy("conv").orderBy("bucket")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    stitched = parts.withColumns({"skip": F.coalesce(F.sum("n").over(past), F.lit(0)), "prior": F.last("tail", ignorenulls=True).over(past)})
    stitched = stitched.withColumn("bad", F.col("bad") | F.coalesce((F.col("prior") == "u") & (F.col("head") == "u"), F.lit(False)))
    ends = F.last("tail", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    good = stitched.withColumns({"any_bad": F.max("bad").over(whole), "ends": ends}).where("not any_bad and ends = 'a'").select("conv", "bucket", "skip")
    return ordered.join(good, ["conv", "bucket"]).select("session_id", (F.col("rn") + F.col("skip")).cast("bigint").alias("turn_no"), "message_id", "speaker")

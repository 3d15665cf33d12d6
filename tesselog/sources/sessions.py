"""Session log files as rows, numbered from 1 in each file, and the sources that sessions can come from."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselog.operators import logs


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """file (folder/session.jsonl), line_no, value of all lines under root; a last empty line is dropped, others are kept.

    Files are read in splits, whatever their size.  The rows of a split come in
    order, so a line's number is its place in its split and the lines of the
    splits before it, of which there are few.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    rows = text.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    splits = rows.groupBy("p", "b").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(splits.select("p", "b", "first", before.alias("before")), ["p", "b"])
    return numbered.select(F.regexp_extract("p", r"([^/]+/[^/]+)$", 1).alias("file"), (F.col("i") - F.col("first") + F.col("before") + 1).cast("int").alias("line_no"), "value")


class SessionSource(Protocol):
    """Where sessions come from: ``sessions`` lists them, ``events`` reads those of the given ids (all if none are given)."""

    def sessions(self) -> DataFrame: ...

    def events(self, ids: DataFrame | None = None) -> DataFrame: ...


class LogFolder:
    """The session source over a folder of log files."""

    def __init__(self, spark: SparkSession, root: str):
        self.lines = read_logs(spark, root)

    def sessions(self) -> DataFrame:
        return with_inferred_roots(list_sessions(self.lines))

    def events(self, ids: DataFrame | None = None) -> DataFrame:
        lines = self.lines
        if ids is not None:
            lines = lines.withColumn("id", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)).join(ids.select("id").distinct(), "id", "left_semi").drop("id")
        return logs.events(lines)


class LogTable:
    """The session source over a table of lines (file, line_no, value)."""

    def __init__(self, lines: DataFrame):
        self.lines = lines

    sessions = LogFolder.sessions
    events = LogFolder.events


def list_sessions(lines: DataFrame) -> DataFrame:
    """id, project, project_root, started_at, updated_at, event_count of each file, latest first.

    The root is the working directory of the log, else the decoded folder name.
    """
    decoded = F.regexp_replace(F.replace(F.split("file", "/")[0], F.lit("-"), F.lit("/")), "^/", "")
    out = logs.session_summary(lines).select(
        F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("id"),
        F.coalesce("cwd", decoded).alias("project"),
        F.coalesce("cwd", decoded).alias("project_root"),
        "branch",
        F.when(F.col("cwd").isNull(), "decoded").otherwise("cwd").alias("project_root_source"),
        F.col("first_ts").alias("started_at"),
        F.col("last_ts").alias("updated_at"),
        F.col("n_lines").alias("event_count"),
    )
    return out.orderBy(F.coalesce("updated_at", F.lit("")).desc(), "id")


def with_inferred_roots(sessions: DataFrame) -> DataFrame:
    """Decoded roots replaced by the longest verified root that is their prefix."""
    verified = sessions.where("project_root_source = 'cwd'").select(F.col("project_root").alias("root"))
    found = logs.prefix_roots(sessions.where("project_root_source = 'decoded'").select(F.col("project").alias("cwd")), verified)
    joined = sessions.join(found.where("root is not null"), sessions["project"] == found["cwd"], "left")
    return joined.withColumns({"project_root": F.coalesce("root", "project_root"), "project_root_source": F.when(F.col("root").isNotNull(), "inferred-prefix").otherwise(F.col("project_root_source"))}).drop("cwd", "root")

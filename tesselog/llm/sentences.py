"""Runs of several consecutive sentences that more than one document holds, and texts without their repetitions.

Sliding sentence spans: every run of ``run`` consecutive sentences (of
``least`` characters or more together) is hashed, hashes are joined globally,
and sentences covered by a repeated run that isn't its first are removed.  All
of it stays in the JVM; what is shuffled are hashes and places, never a text.

A hash that a third of all documents hold is folded per task before the
shuffle; on the way back it is the probe side of a join with unique keys, which
adaptive execution splits.  No pair of documents is formed.

A sentence ends behind its stops and the white space after them, or behind a
line feed; the sentences of a text joined give the text.

Defined cases: null and empty texts have no sentences; a text with fewer
sentences than a run holds none; the first run of a hash is the one of the
smallest doc_id, there the earliest; runs that one document alone holds aren't
repeated; texts under one doc_id belong to one document, each with its own
sentences; a null doc_id takes no part; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselog.session import materialise

RUN, LEAST = 3, 100
#: What ends a sentence.
STOPS = ".!?。！？…\n"
PATTERN = rf"[^{STOPS}]*[{STOPS}]+[ \t\r\n]*|[^{STOPS}]+"


def sentences(text: Column) -> Column:
    """The sentences of a text in order; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _key() -> Column:
    return F.xxhash64("doc_id", "text").alias("key")


def runs(docs: DataFrame, run: int = RUN, least: int = LEAST) -> DataFrame:
    """hash, doc_id, key, i, sizes: every run of ``run`` sentences from sentence i (from 0), with the lengths of its sentences."""
    split = docs.where("doc_id is not null and text <> ''").select("doc_id", _key(), sentences(F.col("text")).alias("s"))
    starts = F.when(F.size("s") >= run, F.sequence(F.lit(0), F.size("s") - run))
    each = split.select("doc_id", "key", F.explode(F.transform(starts, lambda i: F.struct(i.alias("i"), F.slice("s", i + 1, F.lit(run)).alias("part")))).alias("r"))
    part = F.col("r.part")
    sizes = F.transform(part, F.length)
    rows = each.select(F.xxhash64(F.concat_ws("", part)).alias("hash"), "doc_id", "key", F.col("r.i").alias("i"), sizes.alias("sizes"))
    return rows.where(F.aggregate("sizes", F.lit(0), lambda s, x: s + x) >= least)


def repeated(docs: DataFrame, run: int = RUN, least: int = LEAST) -> DataFrame:
    """doc_id, key, i, size, again: the sentences in runs that more than one document holds; again where one of these runs isn't the first of its hash."""
    every = materialise(runs(docs, run, least), "runs")
    first = F.min(F.struct("doc_id", "i", "key")).alias("first")
    shared = every.groupBy("hash").agg(first, F.max("doc_id").alias("last")).where("first.doc_id <> last").select("hash", "first")
    found = every.join(shared, "hash")
    again = F.struct("doc_id", "i", "key") != F.col("first")
    each = found.select("doc_id", "key", "i", again.alias("again"), F.posexplode("sizes").alias("j", "size"))
    return each.groupBy("doc_id", "key", (F.col("i") + F.col("j")).alias("i")).agg(F.max("size").alias("size"), F.max("again").alias("again"))


def without_repeats(docs: DataFrame, run: int = RUN, least: int = LEAST) -> DataFrame:
    """doc_id, n_sentences, shared_sentences, removed_sentences, shared_chars, removed_chars, text: each text without the sentences of non-first repeated runs."""
    marks = repeated(docs, run, least).groupBy("doc_id", "key").agg(
        F.count("*").alias("shared"),
        F.sum("size").alias("shared_chars"),
        F.sum(F.when(F.col("again"), F.col("size")).otherwise(0)).alias("removed_chars"),
        F.collect_set(F.when(F.col("again"), F.col("i"))).alias("gone"),
    )
    texts = docs.where("doc_id is not null").select("doc_id", _key(), "text")
    both = texts.join(marks, ["doc_id", "key"], "left").withColumn("s", F.coalesce(sentences(F.col("text")), F.array().cast("array<string>")))
    kept = F.array_join(F.filter("s", lambda x, i: ~F.array_contains("gone", i)), "")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return both.select(
        "doc_id",
        number(F.size("s")).alias("n_sentences"),
        number(F.col("shared")).alias("shared_sentences"),
        number(F.when(F.col("gone").isNotNull(), F.size("gone"))).alias("removed_sentences"),
        number(F.col("shared_chars")).alias("shared_chars"),
        number(F.col("removed_chars")).alias("removed_chars"),
        F.when(F.size(F.coalesce("gone", F.array().cast("array<int>"))) > 0, kept).otherwise(F.col("text")).alias("text"),
    )

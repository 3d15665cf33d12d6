"""Evaluation: what a search costs and finds beside reading what a grep finds, and how retrievers compare.

Tasks are queries with the files that answer them: tasks(query_id, repo, text)
and relevant(query_id, item).  A retriever is a function of a batch of tasks
and k that gives ranked rows (query_id, chunk_id, rank); items are files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselog.operators import retrieval as R
from tesselog.session import materialise

Adapter = Callable[[DataFrame, int], DataFrame]

CHARS_PER_TOKEN, TOP, RECALL_AT, FILES_READ, GREP_LINES = 4, 5, 3, 3, 100


def _tokens(chars: Column) -> Column:
    return F.floor(F.coalesce(chars, F.lit(0)) / CHARS_PER_TOKEN + 0.5).cast("bigint")


def ranked_items(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, item, rank: files in order of their first chunk, each once, numbered on."""
    first = hits.join(chunks.select("chunk_id", F.col("path").alias("item")), "chunk_id").groupBy("query_id", "item").agg(F.min("rank").alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).drop("at")


def search_side(hits: DataFrame, chunks: DataFrame, tasks: DataFrame, relevant: DataFrame, top: int = TOP, at: int = RECALL_AT) -> DataFrame:
    """query_id, tokens, turns, found: one search that returns the contents of ``top`` chunks; found if a relevant file is among the first ``at`` of them."""
    rows = hits.where(F.col("rank") <= top).join(chunks.select("chunk_id", F.col("path").alias("item"), F.length("content").alias("chars")), "chunk_id")
    good = relevant.select("query_id", "item").distinct().withColumn("good", F.lit(True))
    per = rows.join(good, ["query_id", "item"], "left").groupBy("query_id").agg(F.sum("chars").alias("chars"), F.max(F.coalesce("good", F.lit(False)) & (F.col("rank") <= at)).alias("found"))
    return tasks.select("query_id").join(per, "query_id", "left").select("query_id", _tokens(F.col("chars")).alias("tokens"), F.lit(1).cast("bigint").alias("turns"), F.coalesce("found", F.lit(False)).alias("found"))


def reading_side(lines: DataFrame, files: DataFrame, tasks: DataFrame, relevant: DataFrame, most: int = FILES_READ) -> DataFrame:
    """query_id, tokens, turns, found, grep_hits: one grep whose output is read with the first ``most`` files it names (lines from ``retrieval.grep``)."""
    hit = F.length("path") + F.length(F.col("line_no").cast("string")) + F.col("chars") + 3
    cost = lines.groupBy("query_id").agg(F.sum(hit).alias("grep_chars"), F.count("*").alias("grep_hits"))
    first = lines.groupBy("query_id", "path").agg(F.min("rank").alias("at"))
    read = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).where(F.col("place") <= most)
    good = relevant.select("query_id", F.col("item").alias("path")).distinct().withColumn("good", F.lit(True))
    sized = read.join(files.select("path", F.length("content").alias("size")), "path").join(good, ["query_id", "path"], "left")
    per = sized.groupBy("query_id").agg(F.sum("size").alias("read_chars"), F.count("*").alias("files"), F.max(F.coalesce("good", F.lit(False))).alias("found"))
    out = tasks.select("query_id").join(cost, "query_id", "left").join(per, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("query_id", _tokens(zero("grep_chars") + zero("read_chars")).alias("tokens"), (1 + zero("files")).cast("bigint").alias("turns"), F.coalesce("found", F.lit(False)).alias("found"), zero("grep_hits").alias("grep_hits"))


def task_results(tasks: DataFrame, search: DataFrame, reading: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, repo, both sides' tokens, turns and finds, saved and the percentage saved of each task."""
    side = lambda df, name: df.select("query_id", *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "query_id"))
    both = tasks.select("query_id", "repo").join(side(search, "search"), "query_id").join(side(reading, "reading"), "query_id")
    saved = F.col("reading_tokens") - F.col("search_tokens")
    return both.withColumns({"saved": saved, "percent": F.round(F.when(F.col("reading_tokens") > 0, saved / F.col("reading_tokens") * 100).otherwise(0.0), digits)})


def task_report(results: DataFrame, iterations: int = 2000, digits: int = 6) -> DataFrame:
    """metric, value, p05, p50, p95: totals (without bounds), and means, the median and recalls with their resampled bounds."""
    place = (F.row_number().over(Window.partitionBy("name").orderBy("query_id")) - 1).cast("bigint")
    flags = {"percent": F.col("percent"), "search_found": F.col("search_found").cast("double"), "reading_found": F.col("reading_found").cast("double")}
    samples = results.select("query_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in flags.items()))).alias("x"))
    samples = samples.select("query_id", "x.*").withColumn("pos", place).select("name", "pos", "value")
    means = R.bootstrap(samples, F.avg, iterations, digits).select(F.concat(F.lit("mean_"), "name").alias("metric"), "value", "p05", "p50", "p95")
    median = R.bootstrap(samples.where("name = 'percent'"), F.median, iterations, digits).select(F.lit("median_percent").alias("metric"), "value", "p05", "p50", "p95")
    totals = results.agg(
        F.count("*").alias("tasks"),
        *(F.sum(c).alias(c) for c in ("search_tokens", "reading_tokens", "saved")),
        F.avg("search_turns").alias("mean_search_turns"),
        F.avg("reading_turns").alias("mean_reading_turns"),
    )
    none = F.lit(None).cast("double")
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.round(F.coalesce(F.col(c), F.lit(0)).cast("double"), digits).alias("value")) for c in totals.columns))
    listed = totals.select(F.explode(rows).alias("x")).select("x.metric", "x.value", none.alias("p05"), none.alias("p50"), none.alias("p95"))
    return listed.unionByName(means).unionByName(median)


def ndcg_report(ranked: DataFrame, tasks: DataFrame, relevant: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """repo, mean_ndcg, scored, skipped of each repo and, with repo null, of all tasks; tasks without a relevant item are skipped."""
    per = R.metrics(ranked, relevant, k, 12).select("query_id", "ndcg")
    rows = tasks.select("query_id", "repo").join(per, "query_id", "left")
    out = rows.rollup("repo").agg(F.round(F.coalesce(F.avg("ndcg"), F.lit(0.0)), digits).alias("mean_ndcg"), F.count("ndcg").alias("scored"), F.count_if(F.col("ndcg").isNull()).alias("skipped"), F.grouping("repo").alias("g"))
    return out.where("g = 1 or repo is not null").drop("g")


def model_scores(models: dict[str, Adapter], tasks: DataFrame, chunks: DataFrame, relevant: DataFrame, reading: DataFrame, top: int = TOP) -> DataFrame:
    """model, query_id, repo, saved (percent), recall, mrr of each task and retriever, all without ranking signals.

    Hits and rows of a retriever are written before the next one starts, so no
    plan holds more than one of them.
    """
    out = None
    for name, adapter in models.items():
        hits = materialise(adapter(tasks, top), "hits")
        cost = task_results(tasks, search_side(hits, chunks, tasks, relevant, top), reading)
        found = R.metrics(ranked_items(hits, chunks), relevant, top)
        rows = cost.join(found, "query_id", "left").select(F.lit(name).alias("model"), "query_id", "repo", F.col("percent").alias("saved"), "recall", "mrr")
        rows = materialise(rows, "model_rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def model_bench(scores: DataFrame, iterations: int = 2000, digits: int = 6) -> DataFrame:
    """repo, model, scored, and mean, median, p05, p50, p95 of saved, recall and mrr (recall and mrr of the tasks that have relevant items)."""
    each = scores.select("repo", "model", "query_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("saved", "recall", "mrr")))).alias("x"))
    each = each.select("repo", "model", "query_id", "x.*").where("value is not null").withColumn("name", F.concat_ws("\0", "repo", "model", "metric"))
    place = (F.row_number().over(Window.partitionBy("name").orderBy("query_id")) - 1).cast("bigint")
    ci = R.bootstrap(each.withColumn("pos", place).select("name", "pos", "value"), F.avg, iterations, digits).withColumnRenamed("value", "mean")
    middle = each.groupBy("name", "repo", "model", "metric").agg(F.round(F.median("value"), digits).alias("median"), F.count("*").alias("n"))
    rows = middle.join(ci, "name").select("repo", "model", "metric", F.struct("n", "mean", "median", "p05", "p50", "p95").alias("s"))
    wide = rows.groupBy("repo", "model").pivot("metric", ["saved", "recall", "mrr"]).agg(F.first("s"))
    fields = ("mean", "median", "p05", "p50", "p95")
    return wide.select("repo", "model", F.coalesce("recall.n", F.lit(0)).alias("scored"), *(F.col(f"{m}.{f}").alias(f"{m}_{f}") for m in ("saved", "recall", "mrr") for f in fields))


def recommend(bench: DataFrame, baseline: str) -> DataFrame:
    """repo, best, baseline, by, verdict: the model of the largest median recall, or, where no task could be scored, of the largest lower bound of what it saves.

    verdict is best (the baseline itself wins), tie (the bounds overlap) or better.
    """
    have = F.max(F.col("scored") > 0).over(Window.partitionBy("repo"))
    rows = bench.withColumn("have", have).withColumn("key", F.when(F.col("have"), F.coalesce("recall_median", F.lit(0.0))).otherwise(F.col("saved_p05")))
    order = Window.partitionBy("repo").orderBy(F.desc("key"), (F.col("model") != baseline).cast("int"), "model")
    bounds = lambda p: F.when(F.col("have"), F.coalesce(f"recall_{p}", F.lit(0.0))).otherwise(F.col(f"saved_{p}"))
    ranked = rows.select("repo", "model", "have", F.row_number().over(order).alias("place"), F.struct("model", bounds("p05").alias("p05"), bounds("p95").alias("p95")).alias("m"))
    per = ranked.groupBy("repo").agg(
        F.max("have").alias("have"), F.max(F.when(F.col("place") == 1, F.col("m"))).alias("a"), F.coalesce(F.max(F.when(F.col("model") == baseline, F.col("m"))), F.max(F.when(F.col("place") == 2, F.col("m")))).alias("b")
    )
    overlap = (F.col("a.p05") < F.col("b.p95")) & (F.col("b.p05") < F.col("a.p95"))
    verdict = F.when(F.col("a.model") == F.col("b.model"), "best").when(overlap, "tie").otherwise("better")
    return per.where("b is not null").select("repo", F.col("a.model").alias("best"), F.col("b.model").alias("baseline"), F.when(F.col("have"), "recall").otherwise("saved").alias("by"), verdict.alias("verdict"))


def perf_totals(runs: DataFrame) -> DataFrame:
    """chunks, build_ms, peak_heap_mib over all repos of a run."""
    return runs.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("build_ms"), F.lit(0)).alias("build_ms"), F.round(F.coalesce(F.sum(F.round("peak_heap_mib", 1)), F.lit(0.0)), 1).alias("peak_heap_mib"))


def severity_counts(checks: DataFrame) -> DataFrame:
    """ok, warn, fail: how many checks (severity) ended each way."""
    return checks.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("ok", "warn", "fail")))


def in_display_order(models: DataFrame) -> DataFrame:
    """A catalog (kind, cold_start_min, ...): word search first, then the fastest to start."""
    return models.orderBy((F.col("kind") != "bm25").cast("int"), "cold_start_min", "name")

import math

import pytest
from pyspark.sql import functions as F

from tesselog.operators import evaluation as E
from tesselog.operators import retrieval as R

CHUNKS = [(1, "r/a.py", "x" * 40), (2, "r/b.py", "y" * 20), (3, "r/a.py", "z" * 10), (4, "r/c.py", "w" * 30), (5, "r/d.py", "v" * 6)]


@pytest.fixture
def world(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id bigint, path string, content string")
    tasks = spark.createDataFrame([(10, "r", "first"), (11, "r", "second"), (12, "q", "none")], "query_id bigint, repo string, text string")
    relevant = spark.createDataFrame([(10, "r/c.py"), (10, "r/x.py"), (11, "r/b.py"), (11, "r/b.py")], "query_id bigint, item string")
    hits = spark.createDataFrame([(10, 1, 1), (10, 3, 2), (10, 2, 3), (10, 4, 4), (10, 5, 5), (11, 2, 1)], "query_id bigint, chunk_id bigint, rank int")
    return chunks, tasks, relevant, hits


def test_search_side_counts_chunks(world):
    """The relevant file stands at the fourth chunk, so it isn't found among three, though it is the third file."""
    chunks, tasks, relevant, hits = world
    got = {r.query_id: tuple(r)[1:] for r in E.search_side(hits, chunks, tasks, relevant).collect()}
    assert got == {10: (27, 1, False), 11: (5, 1, True), 12: (0, 1, False)}
    assert {r.query_id for r in E.search_side(hits, chunks, tasks, relevant, at=4).where("found").collect()} == {10, 11}


def test_reading_side(spark, world):
    _, tasks, relevant, _ = world
    files = spark.createDataFrame([(f"r/{c}.py", "l" * 100) for c in "abcd"], "path string, content string")
    lines = spark.createDataFrame([(10, "r/a.py", 1, 7, 1), (10, "r/a.py", 12, 5, 2), (10, "r/b.py", 1, 3, 3), (10, "r/c.py", 1, 3, 4), (10, "r/d.py", 1, 3, 5), (11, "r/d.py", 1, 0, 1)], "query_id bigint, path string, line_no int, chars int, rank int")
    got = {r.query_id: tuple(r)[1:] for r in E.reading_side(lines, files, tasks, relevant).collect()}
    grep = sum(len("r/a.py") + len(str(no)) + n + 3 for no, n in ((1, 7), (12, 5), (1, 3), (1, 3), (1, 3)))
    assert got[10] == (math.floor((grep + 300) / 4 + 0.5), 4, True, 5)
    assert got[11] == (math.floor((10 + 100) / 4 + 0.5), 2, False, 1) and got[12] == (0, 1, False, 0)


def test_results_and_report(spark, world):
    _, tasks, _, _ = world
    side = "query_id bigint, tokens bigint, turns bigint, found boolean"
    search = spark.createDataFrame([(10, 25, 1, True), (11, 50, 1, False), (12, 7, 1, False)], side)
    reading = spark.createDataFrame([(10, 100, 4, False), (11, 40, 3, True), (12, 0, 1, False)], side)
    results = E.task_results(tasks, search, reading)
    assert {r.query_id: (r.saved, r.percent) for r in results.collect()} == {10: (75, 75.0), 11: (-10, -25.0), 12: (-7, 0.0)}
    report = {r.metric: r for r in E.task_report(results).collect()}
    assert {m: report[m].value for m in ("tasks", "search_tokens", "reading_tokens", "saved", "mean_search_turns", "median_percent")} == {"tasks": 3, "search_tokens": 82, "reading_tokens": 140, "saved": 58, "mean_search_turns": 1.0, "median_percent": 0.0}
    assert abs(report["mean_percent"].value - 50 / 3) < 1e-5 and report["mean_percent"].p05 <= report["mean_percent"].p50 <= report["mean_percent"].p95
    assert (report["mean_search_found"].p05, report["mean_search_found"].p95) == (0.0, round(2 / 3, 6))
    none = {r.metric: r.value for r in E.task_report(results.limit(0)).collect()}
    assert none["tasks"] == 0 and none["saved"] == 0


def test_ndcg_by_repo_and_overall(spark, world):
    chunks, tasks, relevant, hits = world
    ranked = E.ranked_items(hits, chunks)
    assert [(r.item, r["rank"]) for r in ranked.where("query_id = 10").orderBy("rank").collect()] == [("r/a.py", 1), ("r/b.py", 2), ("r/c.py", 3), ("r/d.py", 4)]
    first = (1 / math.log2(4)) / (1 + 1 / math.log2(3))
    got = {r.repo: tuple(r)[1:] for r in E.ndcg_report(ranked, tasks, relevant).collect()}
    assert got == {"r": (round((first + 1) / 2, 6), 2, 0), "q": (0.0, 0, 1), None: (round((first + 1) / 2, 6), 2, 1)}


def test_any_statistic_can_be_resampled(spark):
    samples = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 5, 2, 8, 3])] + [("b", 0, 4.0)], "name string, pos bigint, value double")
    got = {r.name: r for r in R.bootstrap(samples, F.median, 200).collect()}
    assert got["a"].value == 3.0 and got["a"].p05 <= got["a"].p50 <= got["a"].p95 and {got["a"].p05, got["a"].p95} <= {1.0, 2.0, 3.0, 5.0, 8.0}
    assert tuple(got["b"])[1:] == (4.0, 4.0, 4.0, 4.0)
    largest = R.bootstrap(samples, lambda c: F.max(c), 50).where("name = 'a'").first()
    assert largest.value == 8.0


def bench(spark, rows):
    names = "repo string, model string, scored bigint, recall_median double, recall_p05 double, recall_p95 double, saved_p05 double, saved_p95 double"
    return {r.repo: tuple(r)[1:] for r in E.recommend(spark.createDataFrame(rows, names), "base").collect()}


def test_recommendation(spark):
    got = bench(
        spark,
        [
            ("clear", "base", 5, 0.2, 0.1, 0.3, 0.0, 0.0), ("clear", "new", 5, 0.8, 0.6, 0.9, 0.0, 0.0),
            ("tie", "base", 5, 0.5, 0.3, 0.7, 0.0, 0.0), ("tie", "new", 5, 0.6, 0.4, 0.8, 0.0, 0.0),
            ("same", "base", 5, 0.5, 0.3, 0.7, 0.0, 0.0), ("same", "new", 5, 0.5, 0.4, 0.8, 0.0, 0.0),
            ("unscored", "base", 0, None, None, None, 10.0, 20.0), ("unscored", "new", 0, None, None, None, 30.0, 40.0),
        ],
    )
    assert got == {"clear": ("new", "base", "recall", "better"), "tie": ("new", "base", "recall", "tie"), "same": ("base", "base", "recall", "best"), "unscored": ("new", "base", "saved", "better")}


def test_corpora_of_their_own(spark):
    """With ``by`` each value has its own statistics and its own hits."""
    chunks = spark.createDataFrame([(1, "a", "red blue"), (2, "a", "red"), (3, "b", "red red green"), (4, "b", "grey")], "chunk_id bigint, repo string, content string")
    queries = spark.createDataFrame([(7, "a", "red"), (8, "b", "red")], "query_id bigint, repo string, text string")
    both = {(r.query_id, r.chunk_id): r.score for r in R.bm25(R.index_terms(chunks, by="repo"), queries, by="repo").collect()}
    assert set(both) == {(7, 1), (7, 2), (8, 3)}
    alone = {(r.query_id, r.chunk_id): r.score for r in R.bm25(R.index_terms(chunks.where("repo = 'b'")), queries.where("repo = 'b'")).collect()}
    assert both[(8, 3)] == alone[(8, 3)]
    files = chunks.select("repo", F.concat("repo", F.lit("/"), F.col("chunk_id").cast("string")).alias("path"), "content")
    assert {(r.query_id, r.path, r.chars) for r in R.grep(files, queries, by="repo").collect()} == {(7, "a/1", 8), (7, "a/2", 3), (8, "b/3", 13)}


def test_small_folds(spark):
    runs = spark.createDataFrame([(10, 5.5, 0.26), (20, 4.5, 0.33)], "chunks bigint, build_ms double, peak_heap_mib double")
    assert tuple(E.perf_totals(runs).first()) == (30, 10.0, 0.6) and tuple(E.perf_totals(runs.limit(0)).first()) == (0, 0.0, 0.0)
    checks = spark.createDataFrame([("ok",), ("warn",), ("ok",)], "severity string")
    assert tuple(E.severity_counts(checks).first()) == (2, 1, 0)
    models = spark.createDataFrame([("slow", "embed", 9.0), ("bm25", "bm25", 50.0), ("fast", "embed", 0.5)], "name string, kind string, cold_start_min double")
    assert [r.name for r in E.in_display_order(models).collect()] == ["bm25", "fast", "slow"]

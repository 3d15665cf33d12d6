"""Queries that share their terms with every chunk: what is shuffled grows with the tables, not with their pairs."""

import os

import pytest
from pyspark.sql import functions as F

from tesselog.operators import retrieval as R
from tesselog.plans import retrieval_queries as Q
from tesselog.plans.evaluation_queries import Setting
from tesselog.session import materialise, once
from tesselog.sources import documents as D

N = 400
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """(chunks, terms, queries): every query has words of its own and one that all chunks hold."""
    i = F.col("id")
    chunks = spark.range(N).select(i.alias("chunk_id"), F.lit("r").alias("repo"), F.concat(F.lit("f"), i.cast("string")).alias("file_path"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.concat(F.lit("alpha beta w"), i.cast("string")).alias("content"))
    queries = spark.range(N).select(i.alias("query_id"), F.concat(F.lit("alpha q"), i.cast("string")).alias("text"))
    return chunks, R.index_terms(chunks), queries


def shuffled(spark, df):
    """Rows of ``df`` and how many rows were shuffled to get them (N * N pairs are 160 000)."""
    status = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: sum(s.shuffleWriteRecords() for s in _list(spark, status))
    before = stages()
    rows = df().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return rows, stages() - before


def _list(spark, status):
    found = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def vectors(rows):
    """id, v: a vector for each row, by its first column."""
    return rows.select(F.col(rows.columns[0]).alias("id"), F.array(F.cos(F.col(rows.columns[0])), F.sin(F.col(rows.columns[0]))).alias("v"))


CASES = {
    "bm25_topk": lambda c, t, q: R.bm25(t, q, 2),  # F8
    "result_envelopes": lambda c, t, q: D.result_envelope(R.bm25(t, q, 2), q, "bm25", 2),  # F3
    "chunk_provenance, chunk_use, nearest_chunk_use": lambda c, t, q: R.bm25(t, c.select(F.col("chunk_id").alias("query_id"), F.col("content").alias("text")), 2),  # F4, F9, F13
    "hybrid_search": lambda c, t, q: R.hybrid(t, q, vectors(c), vectors(q).withColumnsRenamed({"id": "query_id", "v": "q"}), 2, 3),  # F5
    "related_by_words": lambda c, t, q: R.related(c, t, c.select(F.col("chunk_id").alias("query_id"), "repo", "file_path", "start_line", "end_line"), 2),  # F6
    "signals": lambda c, t, q: R.apply_signals(R.bm25(t, q, 3), c, q, 2),  # F7
    "rerank": lambda c, t, q: R.rerank(R.bm25(t, q, 3), c, q, 2),  # F10
    "cross_encoder_rerank": lambda c, t, q: R.rerank(R.bm25(t, q, 3), c, q, 2, relevance=D.cross_encoder(lambda qs, ds: [1.0] * len(qs))),  # F12
    "retrieval_metrics": lambda c, t, q: R.metrics(R.bm25(t, q, 2).withColumnRenamed("chunk_id", "item"), q.select("query_id", F.col("query_id").alias("item")), 2),  # F14
}


@pytest.mark.parametrize("name", CASES)
def test_no_pairs_are_shuffled(spark, tables, name):
    rows, moved = shuffled(spark, lambda: CASES[name](*tables))
    assert len(rows) >= N and moved < N * N / 4


@pytest.mark.parametrize("search", ["words", "scores"])
def test_rows_of_a_search_do_not_grow_with_its_tasks(spark, monkeypatch, search):
    """F3 to F7, F9, F12 to F14: of 40 partitions 2 rows of each query are kept, not 2 of each query and partition; a task for each core reads them."""
    i = F.col("id")
    rows = spark.range(0, N, 1, 40)
    kept = []
    monkeypatch.setattr(R, "materialise", lambda df, name="t": kept.append((name, materialise(df, name))) or kept[-1][1])
    queries = rows.select(i.alias("query_id"), F.concat(F.lit("alpha q"), i.cast("string")).alias("text"))
    if search == "words":
        terms = R.index_terms(rows.select(i.alias("chunk_id"), F.concat(F.lit("alpha beta w"), i.cast("string")).alias("content")))
        found = R.bm25(terms, queries, 2).collect()
    else:
        found = R.cosine(vectors(rows), vectors(rows).withColumnsRenamed({"id": "query_id", "v": "q"}), 2).collect()
    assert len(found) == 2 * N
    assert sum(t.count() for name, t in kept if name == search) == 2 * N
    assert R.streams(rows).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("statistic", [F.avg, F.median])
def test_draws_are_not_shuffled(spark, statistic):
    """1 000 values and 100 iterations are 100 000 draws."""
    samples = spark.range(1000).select(F.lit("a").alias("name"), F.col("id").alias("pos"), F.when(F.col("id") > 3, F.col("id") * 0.5).alias("value"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a sample that is too large
    try:
        (row,), moved = shuffled(spark, lambda: R.bootstrap(samples, statistic, 100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved < 5000
    (other,) = R.bootstrap(samples, lambda c: statistic(c), 100).collect()  # row by row
    assert tuple(row) == tuple(other)


def test_rows_of_single_keys_are_not_shuffled(spark):
    """F3 to F7, F9, F10, F12 to F14: their contents pass ``once`` where they were read; the count shuffles each key."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("content"))
    rows = materialise(rows.union(rows.where("k < 3")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        found, moved = shuffled(spark, lambda: once(rows, "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == n and moved < 1.5 * n


@pytest.mark.parametrize("most", [10, 3])
@pytest.mark.parametrize("name", ["signals", "rerank"])
def test_contents_without_a_hit_are_not_shuffled(spark, monkeypatch, name, most):
    """of 20 000 contents 10 are moved to the hits on them, if their ids may be sent to the tasks; the rows are the same if not."""
    i, n = F.col("id"), 20_000
    chunks = materialise(spark.range(n).select(i.alias("chunk_id"), F.concat(F.lit("src/f"), i.cast("string")).alias("file_path"), F.concat(F.lit("alpha w"), i.cast("string")).alias("content")))
    queries = spark.range(5).select(i.alias("query_id"), F.lit("alpha w").alias("text"))
    hits = spark.range(10).select((i % 5).alias("query_id"), (i * 100).alias("chunk_id"), F.lit(1.0).alias("score"), (F.floor(i / 5) + 1).cast("int").alias("rank"))
    monkeypatch.setattr(R, "HIT_IDS", most, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for hits that are too many
    try:
        rows, moved = shuffled(spark, lambda: {"signals": R.apply_signals, "rerank": R.rerank}[name](hits, chunks, queries, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.query_id, r.chunk_id, r.rank) for r in rows) == [(q, q * 100 + 500 * j, j + 1) for q in range(5) for j in range(2)]
    assert (moved < 1000) == (most == 10)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_vectors_of_chunks_are_written_once(spark):
    """the query set and each block of it read them without shuffling them again, at the size they are stored in."""
    found = Q.chunk_vectors(spark, DIR)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "array<float>" in plan
    assert found.schema["v"].dataType.simpleString() == "array<double>"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_terms_of_tasks_are_weighed_once(spark, monkeypatch):
    """both word searches of an evaluation share the weights, and give what each gives by itself."""
    written = []
    monkeypatch.setattr(R, "materialise", lambda df, name="t": written.append(name) or materialise(df, name))
    s = Setting(spark, DIR)
    models = s.models()
    found = {name: sorted(models[name](s.tasks, 5).collect()) for name in ("bm25", "flat")}
    assert written.count("weights") == 1
    terms = s.terms()
    assert found == {name: sorted(R.bm25(terms, s.tasks, 5, R.Bm25(b=b), by="repo").collect()) for name, b in (("bm25", 0.75), ("flat", 0.0))}


def test_no_pairs_of_queries_and_relevant_items(spark, tmp_path):
    """30 queries to each of which 3 000 of 3 110 chunks are relevant are rated without their 90 000 pairs."""
    i, n = F.col("id"), 3110
    name = F.when(i <= 3000, F.lit("alpha")).when(i >= 3100, F.lit("beta"))
    rows = spark.range(1, n + 1).select(i.alias("chunk_id"), F.when(i % 3 > 0, F.concat(F.lit("alpha w"), (i % 7).cast("string"))).alias("content"), name.alias("symbol_name"))
    materialise(rows, "chunks").write.parquet(f"{tmp_path}/chunks.parquet")
    found, moved = shuffled(spark, lambda: Q.retrieval_metrics(spark, str(tmp_path)))
    assert moved < 40_000
    chunks = spark.read.parquet(f"{tmp_path}/chunks.parquet")
    queries = Q.symbol_queries(chunks)
    ranked = R.bm25(R.index_terms(chunks), queries, 10).withColumnRenamed("chunk_id", "item")
    listed = R.metrics(ranked, queries.join(chunks.select(F.col("symbol_name").alias("text"), F.col("chunk_id").alias("item")), "text"), 10)
    assert sorted(found) == sorted(listed.collect()) and len(found) == 31
    assert {(r.recall > 0, r.mrr, r.ndcg) for r in found} == {(True, 1.0, 1.0), (False, 0.0, 0.0)}

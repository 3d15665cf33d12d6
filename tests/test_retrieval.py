import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselog.functions import vectors as V
from tesselog.operators import index_store as S
from tesselog.operators import retrieval as R
from tesselog.session import once

CHUNKS = [(0, "a.py", "alpha alpha beta"), (1, "b.py", "gamma delta"), (2, "c.py", "alpha gamma delta"), (3, "d.py", None)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id bigint, file_path string, content string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def test_bm25_by_hand(spark, chunks):
    got = R.bm25(R.index_terms(chunks), asked(spark, "alpha", "nothing", "Alpha alpha"), 10).collect()
    idf, avg = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1), 8 / 3
    want = {c: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)) for c, tf, dl in ((0, 2, 3), (2, 1, 3))}
    for q in (0, 2):
        assert {r.chunk_id: r.score for r in got if r.query_id == q} == pytest.approx(want, abs=1e-6)
    assert not [r for r in got if r.query_id == 1]
    assert want[0] == pytest.approx(0.6243, abs=1e-3) and want[2] == pytest.approx(0.4471, abs=1e-3)


def test_ties_go_by_id(spark):
    same = spark.createDataFrame([(7, "x", "t u"), (2, "y", "t u"), (5, "z", "t u")], "chunk_id bigint, file_path string, content string")
    assert [r.chunk_id for r in R.bm25(R.index_terms(same), asked(spark, "t"), 10).orderBy("rank").collect()] == [2, 5, 7]
    assert R.bm25(R.index_terms(same.limit(0)), asked(spark, "t"), 10).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id bigint, chunk_id bigint, rank int")
    b = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (1, 12, 3)], "query_id bigint, chunk_id bigint, rank int")
    got = {r.chunk_id: r.score for r in R.fuse([a, b]).collect()}
    assert got == pytest.approx({10: 2 / 61, 11: 1 / 62, 12: 1 / 62 + 1 / 63}, abs=1e-8)


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "id bigint, v array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id bigint, q array<float>")
    got = R.cosine(v, q, 3).orderBy("query_id", "rank").collect()
    assert [(r.id, r.score) for r in got if r.query_id == 9] == [(1, 1.0), (2, 0.0), (3, -1.0)]
    assert [r.id for r in got if r.query_id == 8] == [1, 2, 3]


def test_signals_one_by_one(spark):
    chunks = spark.createDataFrame(
        [(1, "src/a.ts", "function parseUser() {}"), (2, "src/test/b.ts", "parse"), (3, "src/c.ts", "x"), (4, "src/c.ts", "y"), (5, "src/c.ts", "z")], "chunk_id bigint, file_path string, content string"
    )
    hits = spark.createDataFrame([(0, i, 1.0, i) for i in range(1, 6)] + [(0, 99, 1.0, 6)], "query_id bigint, chunk_id bigint, score double, rank int")
    rows = {r.chunk_id: r for r in R.factors(hits, chunks, asked(spark, "parseUser")).collect()}
    assert rows[1].f_definition == 1.25 and rows[2].f_definition == 1.0
    assert rows[1].f_stem == pytest.approx(1.06) and rows[2].f_stem == pytest.approx(1.03) and rows[3].f_stem == 1.0
    assert rows[2].f_path == 0.5 and rows[3].f_multi == pytest.approx(1.1) and rows[1].f_multi == 1.0 and 99 not in rows
    off = R.Signals(False, False, False, False)
    assert {r.chunk_id: r.score for r in R.apply_signals(hits, chunks, asked(spark, "parseUser"), 10, off).collect()} == {i: 1.0 for i in range(1, 6)}
    zero = hits.withColumn("score", F.lit(0.0)).withColumn("rank", (10 - F.col("chunk_id")).cast("int"))
    assert [r.chunk_id for r in R.apply_signals(zero, chunks, asked(spark, "q"), 10).orderBy("rank").collect()] == [5, 4, 3, 2, 1]


def test_rerank_and_related(spark, chunks):
    hits = R.bm25(R.index_terms(chunks), asked(spark, "alpha gamma"), 10)
    got = R.rerank(hits, chunks, asked(spark, "alpha gamma"), 2).orderBy("rank").collect()
    assert got[0].chunk_id == 2 and got[0].score == pytest.approx(20 + 1 / math.log2(17), abs=1e-6)
    files = spark.createDataFrame([(1, "r", "a", 1, 5, "alpha beta"), (2, "r", "b", 1, 5, "alpha"), (3, "r", "a", 6, 9, "beta beta")], "chunk_id bigint, repo string, file_path string, start_line int, end_line int, content string")
    regions = spark.createDataFrame([(1, "r", "a", 2, 7), (2, "r", "a", 50, 60)], "query_id bigint, repo string, file_path string, start_line int, end_line int")
    got = R.related(files, R.index_terms(files), regions, 5).collect()
    assert {r.query_id for r in got} == {1} and {r.chunk_id for r in got} == {2, 3}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3), (2, "y", 1)], "query_id bigint, item string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "z"), (2, "y"), (3, "q")], "query_id bigint, item string")
    got = {r.query_id: (r.recall, r.mrr, r.ndcg) for r in R.metrics(ranked, relevant, 3).collect()}
    assert got[1] == pytest.approx((0.5, 0.5, (1 / math.log2(3)) / (1 + 1 / math.log2(3))), abs=1e-6)
    assert got[2] == (1.0, 1.0, 1.0) and got[3] == (0.0, 0.0, 0.0)


def mulberry(seed):
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield (t ^ t >> 14) / 2**32


def test_generator_draws_are_independent_of_order(spark):
    got = [r[0] for r in spark.range(500).orderBy("id").select(R.random_index(F.col("id"), 1_000_000)).collect()]
    g = mulberry(0xB7C8D9E1)
    assert got == [int(next(g) * 1_000_000) for _ in range(500)]


def test_bootstrap(spark):
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((1, 2, 3, 4, 10))], "name string, pos bigint, value double")
    r = R.bootstrap_mean(s, 200).first()
    assert r.mean == 4.0 and r.p05 <= r.p50 <= r.p95
    again = R.bootstrap_mean(s.repartition(3), 200).first()
    assert (r.p05, r.p50, r.p95) == (again.p05, again.p50, again.p95)


def test_gate_and_turns(spark):
    old = spark.createDataFrame([("a", 100, 10.0), ("b", 1, 1.0)], "name string, chunks bigint, ms double")
    new = spark.createDataFrame([("a", 102, 10.5), ("c", 9, 9.0)], "name string, chunks bigint, ms double")
    assert [(r.name, r.metric) for r in R.regressions(old, new, {"chunks": (0.01, 0), "ms": (0.5, 1)}).collect()] == [("a", "chunks")]
    tasks = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("a", 3)], "g string, id int")
    assert [(r.g, r.id) for r in R.round_robin(tasks, "g", "id", 3).collect()] == [("a", 1), ("b", 1), ("a", 2)]


def test_grep(spark):
    files = spark.createDataFrame([("a", "xx parseUser\nno\nparseUser"), ("b", "parseuser"), ("c", None)], "path string, content string")
    assert [(r.path, r.line_no) for r in R.grep(files, asked(spark, "parseUser")).orderBy("rank").collect()] == [("a", 1), ("a", 3)]
    cost = S.grep_cost(R.grep(files, asked(spark, "parseUser")), files).first()
    assert (cost.files, cost.full_tokens, cost.window_tokens) == (1, 6, 6)


def test_diff_reuse_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("n", None)], "p string, m bigint")
    new = spark.createDataFrame([("b", 2), ("c", 1), ("n", None)], "p string, m bigint")
    assert {(r.p, r.change) for r in S.diff(old, new, ["p"], "m").collect()} == {("a", "removed"), ("b", "modified"), ("c", "added")}
    assert S.diff(new, new, ["p"], "m").count() == 0
    plan = S.reuse(spark.createDataFrame([(1, "x"), (2, "y")], "chunk_id bigint, content string"), spark.createDataFrame([("x", [1.0])], "content string, v array<float>"))
    assert {r.chunk_id: r.v for r in plan.collect()} == {1: [1.0], 2: None}
    store = S.IndexStore(spark, f"file://{tmp_path}/s")
    assert store.load("repo", "sha:1") is None
    store.save("repo", "sha:1", {"files": old})
    assert store.load("repo", "sha:1")["files"].count() == 3 and store.load("repo", "sha:2") is None
    store.evict("repo")
    assert store.load("repo", "sha:1") is None


def test_symbol_like_takes_contents_of_any_length(spark, tmp_path):
    from tesselog.plans import retrieval_queries as Q

    rows = [("aName", "x" * 100), (None, "long " * 40), (None, "short_one"), ("aName", None)]
    spark.createDataFrame(rows, "symbol_name string, content string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {r.text: r.symbol_like for r in Q.symbol_like(spark, str(tmp_path)).collect()}
    assert got == {"aName": True, "x" * 100: True, "long " * 40: False, "short_one": True}


def test_means_of_term_vectors(spark):
    """In every task, by a join, and from the terms themselves: the same means."""
    rows = [(1, ["a", "b", "a"]), (2, ["c"]), (3, []), (4, None), (5, ["none"]), (6, ["a", "none"]), (7, ["b"] * 3000)]
    terms = spark.createDataFrame(rows, "chunk_id bigint, terms array<string>")
    known = {t: v for t, v in zip("abc", V.hashed_matrix(list("abc"), 12))}
    table = spark.createDataFrame([(t, v.tolist()) for t, v in known.items()], "term string, v array<double>")

    def mean(ts):
        total = sum(known[t] for t in ts if t in known)
        return total / np.linalg.norm(total)

    want = {i: mean(ts) for i, ts in rows if ts and any(t in known for t in ts)}

    def check(df):
        got = {r.chunk_id: np.array(r.v) for r in df.collect()}
        assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)

    check(S.static_embedding(terms, table, 12))
    before = S.TABLE_BYTES
    try:
        S.TABLE_BYTES = 0
        check(S.static_embedding(terms, table, 12))
    finally:
        S.TABLE_BYTES = before
    alone = S.embed_terms(terms.where("chunk_id in (2, 7)"), S.hashed_lookup(12), 12)
    assert all(np.allclose(r.v, want[r.chunk_id]) for r in alone.collect())
    assert S.embed_terms(terms.limit(0), S.hashed_lookup(12), 12).count() == 0


def test_hashed_matrix_equals_the_column(spark):
    texts = ["", "a", "ä b", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.v for r in df.select("t", V.hashed_vector(df.t, 20).alias("v")).collect()}
    assert np.allclose([got[t] for t in texts], V.hashed_matrix(texts, 20))


def test_scaled_and_unit(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([0.6, 0.8],)], "v array<float>")
    assert [[round(x, 6) for x in r[0]] for r in df.select(V.unit(df.v)).collect()] == [[0.6, 0.8], [0.0, 0.0], [0.6, 0.8]]
    assert [[round(x, 6) for x in r[0]] for r in df.select(V.scaled(df.v)).collect()] == [[0.6, 0.8], [0.0, 0.0], [0.6, 0.8]]


def test_cosine_in_blocks_of_queries_and_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[50:80] = v[0]  # ties go by id
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>").repartition(5)
    asked = rows.where("id % 10 = 0").selectExpr("id AS query_id", "v AS q")
    want = {(q, int(i)): r for q in range(0, 300, 10) for r, i in enumerate(np.lexsort((np.arange(300), -np.round(v @ v[q], 5)))[:7], 1)}
    for size in (4096, 4):
        monkeypatch.setattr(R, "QUERY_BLOCK", size)
        monkeypatch.setattr(R.blocks_of, "__defaults__", (size,))
        assert {(r.query_id, r.id): r["rank"] for r in R.cosine(rows, asked, 7).collect()} == want
    assert not {(r.query_id, r.id) for r in R.cosine(rows, asked, 7, exclude_self=True).where("query_id = id").collect()}
    assert R.cosine(rows, asked.limit(0), 7).count() == 0


def test_grep_equals_a_loop(spark):
    rng = random.Random(2)
    words = "alpha beta gamma_x delta.y Epsilon zeta".split()
    files = [(f"f{i:03d}", None if i == 7 else "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(30)))) for i in range(60)]
    queries = [(1, "alpha"), (2, "gamma_x or delta.y"), (3, "the of"), (4, "missing"), (5, "Epsilon")]
    asked = {1: ["alpha"], 2: ["gamma_x", "delta.y"], 4: ["missing"], 5: ["Epsilon"]}
    want = {}
    for q, ws in asked.items():
        found = [(p, i) for p, c in files if c is not None for i, line in enumerate(c.split("\n"), 1) if any(w in line for w in ws)]
        want |= {(q, p, i): r for r, (p, i) in enumerate(sorted(found)[:25], 1)}
    got = R.grep(spark.createDataFrame(files, "path string, content string").repartition(3), spark.createDataFrame(queries, "query_id bigint, text string"), 25)
    assert {(r.query_id, r.path, r.line_no): r["rank"] for r in got.collect()} == want


def test_one_row_for_each_key(spark):
    rows = [(1, "a", 1), (1, "b", 3), (1, "c", 3), (2, "x", None), (2, "x", None), (3, None, 5), (None, "n", 1)]
    df = spark.createDataFrame(rows, "k bigint, v string, at int")
    assert sorted((r.k, r.v, r.at) for r in once(df, "k", "at").collect()) == [(1, "c", 3), (2, "x", None), (3, None, 5)]
    assert once(df.limit(0), "k").count() == 0


def test_states_of_many_files(spark):
    files = spark.createDataFrame([("r", f"p{i}", i) for i in range(500)] + [("q", "p", 1)], "repo string, path string, mtime bigint")
    state = lambda df: {r.repo: r.state for r in S.state_ids(df, "repo", "path", "mtime").collect()}
    first = state(files)
    assert state(files.repartition(7)) == first and first["r"] != first["q"] and all(s.startswith("mtime:") and len(s) == 70 for s in first.values())
    assert state(files.where("path <> 'p77'"))["r"] != first["r"] and state(files.withColumn("mtime", F.when(F.col("path") == "p9", 0).otherwise(F.col("mtime"))))["r"] != first["r"]

import numpy as np
import pyarrow as pa
import pytest

from tesselog.llm import neighbours as N

SCHEMA = "vec_id bigint, dim int, embedding array<float>, file_path string, a int, file string, p int"


def frame(spark, rows):
    return spark.createDataFrame([(i, 64, None if v is None else [None if x is None else float(x) for x in v], "f", 1, "x", 2) for i, v in rows], SCHEMA)


def brute(rows, k=5, least=0.9):
    good = {i: np.asarray(v, np.float32).astype(np.float64) for i, v in rows if i is not None and v is not None and len(v) == 64 and None not in list(v) and np.isfinite(np.asarray(v, float)).all() and np.any(v)}
    ids = sorted(good)
    u = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kk = min(k, len(ids) - 1)
    kth = -np.sort(-s, axis=1)[:, kk - 1] - N.TIE if len(ids) > k else np.full(len(ids), -2.0)
    ok = (s >= least) & ((s >= kth[:, None]) | (s >= kth[None, :]))
    return {(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(ok, 1)))}


def clustered(seed, clusters, each, noise=0.03):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return [(i, (centres[i % clusters] + noise * rng.normal(size=64)) * rng.uniform(0.2, 5)) for i in range(clusters * each)]


@pytest.mark.parametrize("settings", [{}, {"file_rows": 40}, {"file_rows": 10, "pivots": 32}])
def test_recall(spark, settings):
    rows = clustered(1, 60, 12)
    want = brute(rows)
    got = {tuple(r) for r in N.close_pairs(frame(spark, rows), **settings).collect()}
    least = 0.9 if settings else 0.98  # files smaller than the clusters still reach what is asked for
    assert len(want) > 1000 and len(got & want) / len(want) >= least and len(got & want) / len(got) >= least


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=64)
    w = v + 0.02 * rng.normal(size=64)
    rows = [(i, v) for i in range(8)] + [(20, w), (21, -v), (30, None), (31, np.zeros(64)), (32, [*v[:-1], float("nan")]), (33, v[:40]), (34, [*v[:-1], None]), (35, []), (None, v), (20, w), (40, v * 3)]
    assert {tuple(r) for r in N.close_pairs(frame(spark, rows)).collect()} == brute(rows)


@pytest.mark.parametrize("settings", [{}, {"file_rows": 40}])
def test_rescaled_copies(spark, settings):
    """More copies of one direction than candidates, all of other lengths, beside another such group."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=64)
    w = v + 0.1 * rng.normal(size=64)
    rows = [(i, (v if i % 3 else w) * rng.uniform(0.004, 250)) for i in range(450)]
    assert {tuple(r) for r in N.close_pairs(frame(spark, rows), **settings).collect()} == brute(rows)


def test_several_directions_in_one_cell(spark):
    rng = np.random.default_rng(11)
    v = np.round(rng.normal(size=64) * 16) / 2**7
    v = v / np.linalg.norm(v)
    near = [v + 2e-6 * j * np.eye(64)[j] for j in range(7)]
    rows = [(i, near[i % 7] * 2.0 ** (i // 7 % 9 - 4) * (1 + i)) for i in range(140)]
    got = {r.vec_id: r["head"] for r in N.copies(N.clean(frame(spark, rows))).collect()}
    assert len(got) == 140 and all(got[i] % 7 == i % 7 for i in got) and len(set(got.values())) < 40


def test_ties_at_the_last_candidate():
    """Of equal orders all are reranked, though they are more than the candidates."""
    rng = np.random.default_rng(13)
    unit = rng.normal(size=64) + 0.2 * rng.normal(size=(150, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    rows = pa.table({"vec_id": np.arange(150), "unit": list(unit.astype(np.float32)), "pivots": [np.arange(8, dtype=np.int16)] * 150})
    got = {r["a"]: {x["b"] for x in r["near"]} for r in N._search(5, 100, 64, 0.1)(rows).to_pylist()}
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    assert got == {i: set(np.argsort(-cos[i])[:5].tolist()) for i in range(150)}


def test_small_and_empty(spark):
    assert N.close_pairs(frame(spark, [])).count() == 0
    assert N.close_pairs(frame(spark, [(1, np.ones(64))])).count() == 0
    assert [tuple(r) for r in N.close_pairs(frame(spark, [(2, np.ones(64)), (1, 2 * np.ones(64))])).collect()] == [(1, 2)]


def recall(spark, rows, **settings):
    """Share of the five most similar of each of 300 vectors that the index finds, at the settings it finds itself."""
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near, _ = N.nearest(frame(spark, rows), **settings)
    got = {(r.a, r.b) for r in near.collect()}
    asked = np.random.default_rng(3).choice(len(x), 300, replace=False)
    cos = x[asked] @ x.T
    cos[np.arange(300), asked] = -2
    return np.mean([[(int(i), int(j)) in got for j in np.argsort(-c)[:5]] for i, c in zip(asked, cos)])


@pytest.mark.parametrize("clusters, each, noise", [(1, 6000, 0.06), (10, 600, 0.03), (1, 3000, 0.03), (3, 2000, 0.06)])
def test_recall_of_round_regions(spark, clusters, each, noise):
    assert recall(spark, clustered(5, clusters, each, noise)) >= 0.93


def test_recall_without_structure(spark):
    v = np.random.default_rng(8).normal(size=(6000, 64))
    assert recall(spark, list(enumerate(v))) >= 0.93


def test_one_hot_region_in_split_files(spark):
    """All vectors in one narrow round region whose files must be split: nothing is wrong or doubled."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    rows = [(i, base + 0.3 * rng.normal(size=64)) for i in range(600)]
    got = [tuple(r) for r in N.close_pairs(frame(spark, rows), pivots=64, posted=4, file_rows=100).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and len(set(got) & want) / len(want) >= 0.4


def test_split_files_lose_no_pair(spark):
    """All that share a file meet, whether or not the file is overfull."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    rows = frame(spark, [(i, base + 0.3 * rng.normal(size=64)) for i in range(600)])
    whole, split = ({tuple(r) for r in N.close_pairs(rows, pivots=16, posted=4, candidates=600, file_rows=n).collect()} for n in (10_000, 100))
    assert len(whole) > 1000 and split == whole


def test_a_large_class_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    rng = np.random.default_rng(2)
    v = rng.normal(size=64)
    rows = [(i, v * (1 + i % 3)) for i in range(60)] + [(100 + i, v + 0.02 * rng.normal(size=64)) for i in range(5)]
    got = [tuple(r) for r in N.close_pairs(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    pairs, members = N.close_classes(frame(spark, rows))
    assert pairs.count() <= 15 and {(r["head"], r.n) for r in members.collect()} == {(0, 60), *((100 + i, 1) for i in range(5))}


def test_exact_way(spark):
    rows = clustered(4, 20, 15)
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = N.clean(frame(spark, rows)).select("vec_id", "embedding").repartition(5)
    got = {(r.a, r.b) for r in N.exact_nearest(df, df.where("vec_id % 10 = 0").toArrow()).collect()}
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    assert got == {(i, int(j)) for i in range(0, 300, 10) for j in np.argsort(-cos[i])[:5]}


def test_footrule():
    a = np.array([[0, 1, 2], [2, 0, 5], [7, 8, 9]])
    m = 3

    def slow(x, y):
        place = lambda o, p: list(o).index(p) if p in o else m
        return sum(abs(place(x, p) - place(y, p)) for p in {*x, *y})

    gain = N.Footrule(a).gain(0, 3)
    assert all(m * (m + 1) - 2 * gain[i, j] == slow(a[i], a[j]) for i in range(3) for j in range(3) if i != j)
    assert (N.Footrule(a).gain(1, 3) == gain[1:]).all()

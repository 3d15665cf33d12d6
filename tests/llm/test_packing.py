import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselog.llm import packing as P


def slow_pack(sizes, capacity):
    """Sum-of-squares by trying every gap, ties to the smallest gap, a new container last."""
    gaps, count = [], {}
    total = lambda c: sum(n * n for g, n in c.items() if 0 < g < capacity)
    for s in sorted(sizes, reverse=True):
        if s == 0:
            continue
        best = None
        for g in [*sorted(g for g in set(gaps) if g >= s), capacity]:
            if g == capacity and s == capacity:
                best = (0, g)
                break
            c = dict(count)
            if g < capacity:
                c[g] -= 1
            c[g - s] = c.get(g - s, 0) + 1
            if best is None or total(c) < best[0]:
                best = (total(c), g)
        g = best[1]
        if g < capacity:
            gaps.remove(g)
            count[g] -= 1
        gaps.append(g - s)
        count[g - s] = count.get(g - s, 0) + 1
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=40))
def test_equals_slow_version(sizes):
    boxes, places = P.pack_sizes(np.array(sizes, np.int64), 20)
    assert (boxes.max() + 1 if any(sizes) else 0) == slow_pack(sizes, 20)
    check(list(zip(boxes, places, sizes)), 20)


def check(rows, capacity):
    by: dict = {}
    for box, place, size in rows:
        if size:
            by.setdefault(box, []).append((place, size))
    for items in by.values():
        at = 0
        for place, size in sorted(items):
            assert place >= at
            at = place + size
        assert at <= capacity


def test_frame(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in np.minimum(rng.pareto(1.2, 3000) * 60, 9000)] + [2048, 4096, 4097, 0, None]
    df = spark.createDataFrame([(i, s, 9, 9) for i, s in enumerate(sizes)] + [(7, 5, 9, 9), (None, 6, 9, 9)], "doc_id bigint, n_tokens bigint, shard int, place int")
    got = P.pack_counts(df, shard_items=800).collect()
    total = sum(s or 0 for s in sizes) + 11
    check([(r.container_id, r.place, r.n_tokens) for r in got], 2048)
    assert sum(r.n_tokens for r in got) == total
    assert {r.doc_id for r in got} == {*range(len(sizes)), None}
    assert all(r.n_tokens == 2048 for r in got if r.doc_id is not None and r.first_token + 2048 < (sizes[r.doc_id] or 0))
    used = len({r.container_id for r in got if r.n_tokens})
    assert used <= math.ceil(total / 2048) * 1.02 + 5
    assert P.pack_counts(df.limit(0)).count() == 0


def test_one_shard_wastes_next_to_nothing():
    rng = np.random.default_rng(1)
    sizes = np.minimum((rng.lognormal(5, 1, 8000)).astype(np.int64), 2048)
    boxes, _ = P.pack_sizes(sizes, 2048)
    assert boxes.max() + 1 <= math.ceil(sizes.sum() / 2048) + 2


def test_texts(spark):
    import os

    from tesselog.llm.encoding import default_vocabulary

    if not os.path.exists(default_vocabulary()):
        pytest.skip("no vocabulary file here")
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "x y " * 3000)], "doc_id bigint, text string")
    got = {(r.doc_id, r.piece_no): r.n_tokens for r in P.pack(df).collect()}
    assert got[(1, 0)] == 3 and got[(2, 0)] == 0 and got[(3, 0)] == 0 and got[(4, 0)] == 2048 and sum(n for (d, _), n in got.items() if d == 4) > 4096

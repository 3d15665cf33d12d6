import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselog.llm import spans as S

SCHEMA = "doc_id bigint, text string, hash string, at int, marks int, cut int"


def by_hand(docs, least):
    where: dict = {}
    for d, t in docs:
        if d is not None and t is not None:
            for i in range(len(t) - least + 1):
                where.setdefault(t[i : i + least], set()).add(d)
    out = set()
    starts: dict = {}
    for d, t in docs:
        if d is not None and t is not None:
            starts.setdefault(d, set()).update(i for i in range(len(t) - least + 1) if len(where[t[i : i + least]]) > 1)
    for d, at in starts.items():
        run = None
        for i in sorted(at):
            if run and i <= run[1]:
                run[1] = i + least
            else:
                if run:
                    out.add((d, *run))
                run = [i, i + least]
        if run:
            out.add((d, *run))
    return out


def found(spark, docs, **k):
    return {tuple(r) for r in S.shared_spans(spark.createDataFrame([(d, t, "h", 1, 2, 3) for d, t in docs], SCHEMA), **k).collect()}


def prose(rng, n):
    words = "the tool result window cache é中 query; index. merges? filter token\n span".split(" ")
    out = ""
    while len(out) < n:
        out += rng.choice(words) + rng.choice([" ", " ", " ", ". ", ""])
    return out[:n]


def corpus(seed, n, plants):
    rng = random.Random(seed)
    docs = [prose(rng, rng.randint(0, 1500)) for _ in range(n)]
    for _ in range(plants):
        a, b = rng.sample(range(n), 2)
        if len(docs[a]) > 250:
            i = rng.randint(0, len(docs[a]) - 200)
            piece = docs[a][i : i + rng.choice([199, 200, 201, 260, 700])]
            j = rng.randint(0, len(docs[b]))
            docs[b] = docs[b][:j] + piece + docs[b][j:]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed, 60, 50)
    want = by_hand(docs, 200)
    assert len(want) > 20 and found(spark, docs) == want


def test_odd_texts(spark):
    rng = random.Random(9)
    x, y = prose(rng, 400), prose(rng, 230)
    docs = [
        (1, x), (2, "😀" * 37 + x + "tail"), (3, None), (4, ""), (5, " " * 500), (6, " " * 350), (7, y + "|" + y), (8, "a" * 5000), (9, "a" * 199),
        (None, x), (10, x[:199]), (11, "b" * 3 + "a" * 250), (12, y[5:205]), (13, x), (14, x), (15, "q" * 20000 + y),
    ]
    assert found(spark, docs) == by_hand(docs, 200)


def test_texts_under_one_id(spark):
    rng = random.Random(3)
    x, y = prose(rng, 400), prose(rng, 300)
    assert found(spark, [(1, x), (1, x + y), (2, y)]) == by_hand([(1, x), (1, x + y), (2, y)], 200)
    assert found(spark, [(1, x), (1, x)]) == set()


def test_a_third_of_all_documents(spark):
    rng = random.Random(5)
    licence, short = prose(rng, 320), prose(rng, 150)
    docs = [(i, prose(rng, 150) + (licence if i % 3 == 0 else short if i % 3 == 1 else "") + prose(rng, 150)) for i in range(120)]
    assert found(spark, docs) == by_hand(docs, 200)


def test_empty_and_bad_settings(spark):
    assert found(spark, []) == set()
    with pytest.raises(ValueError):
        found(spark, [], least=100)


def test_share(spark):
    rng = random.Random(8)
    x = prose(rng, 300)
    df = spark.createDataFrame([(1, x), (2, x + "y" * 300), (3, None), (4, "z")], "doc_id bigint, text string")
    assert {r.doc_id: (r.n_chars, r.shared_chars, r.share) for r in S.shared_share(df).collect()} == {1: (300, 300, 1.0), 2: (600, 300, 0.5), 3: (0, 0, 0.0), 4: (1, 0, 0.0)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 300), st.integers(0, 300))
def test_equal_passages_are_cut_alike(seed, before, after):
    rng = random.Random(seed)
    x = prose(rng, 200)
    left, right = prose(rng, before) + x + prose(rng, after), prose(rng, after) + x + prose(rng, before)
    marks = []
    for text, at in ((left, before), (right, after)):
        block = S.Block([text])
        found_ = S.Cuts(block)
        low = found_.low[at + S._BACK]
        inside = [int(c) - at for c in found_.at if at + S._BACK <= c <= at + 200 - S.SPAN and found_.rank[c] == low]
        assert inside
        marks.append(inside)
        assert (block.hashes(np.array([at]), 200) == S.Block([x]).hashes(np.array([0]), 200)).all()
    assert marks[0] == marks[1]

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselog.llm import splitting as S


def by_hand(c):
    out, s = [], 0
    if len(c) <= 1600:
        return out
    while len(c) - s > 1600:
        window = range(s + 1600, s + 800, -1)

        def blank(e):
            return c[e - 1] == "\n" and all(z in " \t\r" for z in c[c.rfind("\n", 0, e - 1) + 1 : e - 1])

        e = next((e for e in window if blank(e)), None) or next((e for e in window if c[e - 1] == "\n"), None) or next((e for e in window if c[e - 1] in " \t"), None) or s + 1600
        out.append((s, e))
        s = next((p for p in range(e - 160, e) if c[p - 1] == "\n"), e - 160)
    return [*out, (s, len(c))]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**31), st.integers(1500, 9000), st.sampled_from([0.0, 0.001, 0.01, 0.1]), st.sampled_from([0.0, 0.002, 0.1]))
def test_equals_rule(seed, n, feeds, spaces):
    rng = np.random.default_rng(seed)
    text = "".join(rng.choice(["x", "é", "😀", "\n", "\r", " ", "\t"], n, p=[(1 - feeds - spaces) * 0.9, (1 - feeds - spaces) * 0.05, (1 - feeds - spaces) * 0.05, feeds * 0.9, feeds * 0.1, spaces * 0.8, spaces * 0.2]))
    if seed % 3 == 0:
        text = text.replace("x\n", "\n \r\n")
    assert S.cut(text) == by_hand(text)


@pytest.mark.parametrize("text", ["\n" * 5000, " " * 5000, "a" * 1601, "\r\n" * 2000, "a\n \n" * 1000])
def test_odd_texts(text):
    assert S.cut(text) == by_hand(text)


def test_cohesion_cuts_where_the_topic_changes():
    one = "".join(f"parser token grammar syntax node {i}\n" for i in range(34))
    two = "".join(f"river mountain forest valley cloud {i}\n" for i in range(60))
    (a, b), *rest = S.cut(one + two, S.cohesion_depths)
    assert abs(b - len(one)) <= 80 and rest[-1][1] == len(one + two)


def test_frame(spark):
    long = ("word " * 30 + "\n") * 40
    schema = "chunk_id bigint, file_path string, start_line int, end_line int, content string, piece_no string, known int"
    rows = [(1, "a", 10, None, long, "x", 1), (1, "a", 10, None, long, "x", 1), (2, None, None, 3, long, None, None), (3, "c", 1, 1, None, None, None), (4, "d", 1, 1, "", None, None), (5, "e", 1, 1, "a" * 1600, None, None), (None, "f", 1, 1, long, None, None), (6, "g", 7, 7, "z" * 200_000, None, None)]
    got = S.split_oversized(spark.createDataFrame(rows, schema)).collect()
    assert {r.chunk_id for r in got} == {1, 2, 6}
    mine = sorted((r.piece_no, r.start_char, r.end_char, r.start_line, r.end_line) for r in got if r.chunk_id == 1)
    assert [(a, b) for _, a, b, _, _ in mine] == by_hand(long)
    assert all(l0 == 10 + long.count("\n", 0, a) and l1 == 10 + long.count("\n", 0, b - 1) for _, a, b, l0, l1 in mine)
    assert all(len(r.content) <= 1600 for r in got) and {r.file_path for r in got if r.chunk_id == 2} == {None}
    assert min(r.start_line for r in got if r.chunk_id == 2) == 1
    assert S.split_oversized(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        S.split_oversized(spark.createDataFrame([], schema), overlap=900)


def test_valleys_reach_to_the_nearest_peaks():
    """A known series: each depth is measured from the nearest peak on either side, not from the largest value of the text."""
    alike = np.array([0.9, 0.2, 0.6, 0.5, 0.7, 0.1, 0.3, 0.3, 0.0, 0.4])
    want = [0.0, 0.7 + 0.4, 0.0, 0.1 + 0.2, 0.0, 0.6 + 0.2, 0.0, 0.0, 0.3 + 0.4, 0.0]
    assert np.allclose(S.valleys(alike), want)


def test_similarities_in_strides(monkeypatch):
    rng = np.random.default_rng(3)
    units, bins = np.sort(rng.integers(0, 90, 700)), rng.integers(0, 40, 700)
    whole = S.similarities(units, bins, 90)
    monkeypatch.setattr(S, "_STRIDE", 7)
    assert np.allclose(whole, S.similarities(units, bins, 90))
    counts = np.zeros((90, 512))
    np.add.at(counts, (units, bins), 1)
    for gap in (1, 5, 44, 89):
        x, y = counts[max(0, gap - 6) : gap].sum(0), counts[gap : gap + 6].sum(0)
        assert abs(whole[gap - 1] - x @ y / np.sqrt((x @ x) * (y @ y))) < 1e-6


def test_cohesion_within_one_line():
    """A text without line feeds is cut at the sentence where the topic changes."""
    one = "".join(f"The parser reads a token of the grammar {i}. " for i in range(26))
    two = "".join(f"Rivers cross the mountain forest {i}. " for i in range(40))
    (a, b), *rest = S.cut(one + two, S.cohesion_depths)
    assert abs(b - len(one)) <= 100 and (one + two)[b - 2 : b] == ". "


@pytest.mark.parametrize("text", ["\n" * 5000, " " * 5000, "a" * 1601, "a.b" * 900, "İ. " * 2000, "x\n" * 3000])
def test_cohesion_of_odd_texts(text):
    pieces = S.cut(text, S.cohesion_depths)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b - a <= 1600 for a, b in pieces)

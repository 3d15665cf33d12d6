import base64
import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselog.llm import encoding as E

needs_vocabulary = pytest.mark.skipif(not os.path.exists(E.default_vocabulary()), reason="no vocabulary file here")
pytestmark = needs_vocabulary


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(E.default_vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "\n\n\t ", "a" * 5000, " " * 3000, "<|endoftext|>", "héllo wörld 123456 中文字符 😀😀 é", "don't we'll I'm", "​　x ", "AbcDEFghi_jkl-mno.pqr(stu)" * 50, "=" * 999, "\x00\x01\x7f"]


def test_equals_the_tokenizer(known):
    got = E.TrieEncoder(E.default_vocabulary()).encode_batch(TEXTS)
    assert got == [known.encode_ordinary(t or "") for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="abcdeinorst AE'0_.\n", max_size=80), max_size=6))
def test_property(texts):
    enc = E.encoder(E.default_vocabulary())
    ranks = {b: i for i, b in enc.bytes.items()}
    want = tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={}) if not hasattr(test_property, "enc") else test_property.enc
    test_property.enc = want
    assert enc.encode_batch(texts) == [want.encode_ordinary(t) for t in texts]
    assert enc.count_batch(texts) == [len(want.encode_ordinary(t)) for t in texts]


def test_forgetting_changes_nothing(known, monkeypatch):
    monkeypatch.setattr(E, "KNOWN_WORDS", 5)
    enc = E.TrieEncoder(E.default_vocabulary())
    texts = [f"word{i} other{i % 3} xyz{i}" for i in range(40)]
    got = [enc.encode_batch(texts[i : i + 7]) for i in range(0, 40, 7)]
    assert [x for b in got for x in b] == [known.encode_ordinary(t) for t in texts]


def test_frame(spark, known):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(1, "again", "x"), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in E.encode(df).collect()))
    assert got == sorted((i is None, i or 0, known.encode_ordinary(t or "")) for i, t, _ in rows)
    assert E.encode(df.limit(0)).count() == 0
    counts = {(r.doc_id, r.n_tokens) for r in E.count_tokens(df).collect()}
    assert (0, 0) in counts and (None, 2) in counts

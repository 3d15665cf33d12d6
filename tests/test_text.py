import hashlib

import pytest
from pyspark.sql import functions as F

from tesselog.functions import text as T
from tesselog.functions import vectors as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


WORDS = {
    "snake_case_name": ["snake", "case", "name"],
    "kebab-case": ["kebab", "case"],
    "camelCase": ["camel", "case"],
    "HTTPServer": ["http", "server"],
    "parseJSON": ["parse", "json"],
    "v2Beta utf8": ["v2", "beta", "utf8"],
    "a + b != c": ["a", "b", "c"],
    "": [],
    "_-.": [],
}


@pytest.mark.parametrize("text,want", WORDS.items())
def test_words(spark, text, want):
    assert one(spark, text, T.words) == want


def test_dotted_first_and_linear_time(spark):
    assert one(spark, "see os.path.join now", T.tokens) == ["os.path.join", "see", "os", "path", "join", "now"]
    assert one(spark, "x" * 300_000 + "." + "y" * 300_000, T.dotted)[0].startswith("xxx")
    assert one(spark, "A" * 300_000, lambda c: F.size(T.tokens(c))) == 1


@pytest.mark.parametrize("path,want", [("a/b.TS", "typescript"), ("x.tar.py", "python"), (".bashrc", None), ("Makefile", None), ("a\\b.rs", "rust"), (None, None), ("a.unknown", None)])
def test_language(spark, path, want):
    assert one(spark, path, T.language) == want


@pytest.mark.parametrize("q,want", [("foo", True), ("get user", False), ("getUser name", True), ("a_b c", True), ("one two three_x", False), ("", False), ("  ", False), ("HTTPServer x", True)])
def test_symbol_like(spark, q, want):
    assert one(spark, q, T.symbol_like) is want


def test_keywords(spark):
    assert one(spark, "how does the HttpClient retry on user.email with max_retries", T.keywords) == ["HttpClient", "max_retries", "user.email"]
    assert one(spark, "Retry retry RETRY", T.keywords) == ["Retry"]
    assert one(spark, "the of", T.keywords) == []


@pytest.mark.parametrize("path,want", [("src/test/a.ts", 0.5), ("tests/a.ts", 1.0), ("a/legacy/x.d.ts", 0.6 * 0.6), ("a/b_test.go", 0.5), ("x/legacy/test/a", 0.3), ("x/demo/a", 0.7)])
def test_path_factor(spark, path, want):
    assert one(spark, path, lambda c: F.round(T.path_factor(c), 6)) == pytest.approx(want)


@pytest.mark.parametrize("n,size,overlap", [(1, 50, 5), (50, 50, 5), (51, 50, 5), (129, 10, 3), (7, 3, 0)])
def test_windows_cover_all_lines(spark, n, size, overlap):
    got = one(spark, "\n".join(f"l{i}" for i in range(n)) + "\n", lambda c: T.windows(c, size, overlap))
    want, at = [], 1
    while True:
        end = min(at + size - 1, n)
        want.append((at, end))
        if end == n:
            break
        at += size - overlap
    assert [(w.start_line, w.end_line) for w in got] == want
    assert got[0].content.split("\n")[0] == "l0"


def test_blank_texts_have_no_windows(spark):
    assert one(spark, " \n\t\n", T.windows) is None
    with pytest.raises(ValueError):
        T.windows(F.lit("x"), 5, 5)


def test_sentences_snippets_counts(spark):
    assert one(spark, "  fix the\n parser. Then go", T.first_sentence) == "fix the parser."
    assert one(spark, "[system] no", T.first_sentence) is None
    assert one(spark, "short", T.first_sentence) is None
    assert len(one(spark, "x" * 500, T.first_sentence)) == 200
    assert one(spark, "a" * 100, T.snippet) == "a" * 79 + "…"
    assert one(spark, "abcde", T.approx_tokens) == 2
    assert [one(spark, n, T.human_count, "bigint") for n in (12, 12400, 1230000)] == ["12", "12.4k", "1.23M"]
    assert one(spark, "org/bge-small-en-v1.5", T.instruction_prefixes).query.startswith("Represent")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(V.dot("a", "b").alias("d"), V.norm("a").alias("n"), V.unit(F.col("a")).alias("u"), V.usable(F.col("a"), 2).alias("ok")).first()
    assert (r.d, r.n, r.ok) == (3.0, 5.0, True) and r.u == pytest.approx([0.6, 0.8])
    v = one(spark, "hello", lambda c: V.hashed_vector(c, 20))
    assert len(v) == 20 and sum(x * x for x in v) == pytest.approx(1)
    assert v == one(spark, "hello", lambda c: V.hashed_vector(c, 20)) != one(spark, "other", lambda c: V.hashed_vector(c, 20))


def test_hashed_vector_equals_hashlib_in_all_blocks(spark):
    """The default 64 numbers are eight counter blocks of SHA-256; 20 end within one."""
    for dim in (64, 20):
        raw = b"".join(hashlib.sha256(f"mock:hello:{i}".encode()).digest() for i in range(8))
        want = [int.from_bytes(raw[i * 4 : i * 4 + 4], "big", signed=True) / 2**31 for i in range(dim)]
        n = sum(x * x for x in want) ** 0.5
        assert one(spark, "hello", lambda c: V.hashed_vector(c, dim)) == pytest.approx([x / n for x in want], abs=1e-12)  # noqa: B023


def test_formats(spark):
    assert [one(spark, n, T.human_count, "double") for n in (950.0, 1500.0, 1234567.0, -5000.0)] == ["950", "1.5k", "1.23M", "-5.0k"]
    assert [one(spark, n, T.token_badge, "double") for n in (846.5, 1249.0, 12400.0)] == ["847", "1.2k", "12k"]
    assert [one(spark, n, T.duration, "bigint") for n in (840, 47_000, 138_000, -1, None, 59_600)] == ["840ms", "47s", "2m 18s", "", "", "1m 0s"]
    assert [one(spark, n, T.percent, "double") for n in (0.577, 1.0, float("nan"), None)] == ["57.7%", "100.0%", "0%", "0%"]
    assert [one(spark, n, T.basename, "string") for n in ("/a/b", "a\\b\\", "x", "/", "")] == ["b", "b", "x", "/", ""]
    assert [one(spark, None, f, "double") for f in (T.human_count, T.token_badge)] == [None, None]
    assert one(spark, "0123456789", T.short_id, "string") == "01234567"
    assert one(spark, "a\r\nb" + "c" * 200, T.wire_snippet, "string") == "a↵b" + "c" * 116 + "…"


def test_text_files(spark):
    paths = {"a/b.py": True, "README.MD": True, "node_modules/x.js": False, "a/.git/x.md": False, ".json": False, "a.bin": False, "noext": False, "src/x.d.ts": True}
    assert {p: one(spark, p, T.is_text_file, "string") for p in paths} == paths

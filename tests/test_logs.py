import json
import random

import pytest

from tesselog.operators import logs as L

EV = "session string, event_index bigint, kind string, text string, tool string, is_error boolean, output string, output_kind string, command string, path string, file_path string, query string, ts string, tokens_in bigint, tokens_out bigint, model string"


def events(spark, rows):
    """rows: (session, kind, {field: value}); the index counts up within each session."""
    names, at, out = [x.split()[0] for x in EV.split(", ")], {}, []
    for session, kind, fields in rows:
        i = at[session] = at.get(session, -1) + 1
        fields = {"file_path": fields["path"], **fields} if "path" in fields else fields
        out.append(tuple({"session": session, "event_index": i, "kind": kind, **fields}.get(n) for n in names))
    return spark.createDataFrame(out, EV)


def use(tool, **f):
    return ("s", "tool_use", {"tool": tool, **f})


def result(output="x", kind="STRING", **f):
    return ("s", "tool_result", {"output": output, "output_kind": kind, **f})


def test_normaliser(spark):
    m = lambda role, content, **k: json.dumps({"type": role, "sessionId": "s", "timestamp": "t", "message": {"content": content, **k}})
    lines = [
        json.dumps({"type": "mode"}),
        m("user", "hello"),
        m("assistant", [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "Read", "input": {"file_path": "/x/y"}}], usage={"input_tokens": 3, "output_tokens": 4}, model="m"),
        m("assistant", [{"type": "thinking", "thinking": "z"}]),
        m("user", [{"type": "tool_result", "content": [1, 2], "is_error": True}]),
        "{broken",
        "",
        json.dumps({"type": "user", "message": 5}),
        json.dumps([1]),
        json.dumps({"snapshot": 1}),
        m("user", {"type": "text"}),
    ]
    df = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)] + [("f", 99, None)], "file string, line_no int, value string")
    got = [(r.kind, r.text, r.tool, r.is_error, r.tokens_in, r.model) for r in L.events(df).orderBy("event_index").collect()]
    assert got == [
        ("system", None, None, None, None, None),
        ("user_message", "hello", None, None, None, None),
        ("assistant_message", "a[tool_use:Read]", None, None, 3, "m"),
        ("tool_use", None, "Read", None, None, None),
        ("assistant_message", "", None, None, None, None),
        ("tool_result", None, None, True, None, None),
        *[("unknown", None, None, None, None, None)] * 7,
    ]


def test_spellings_of_usage_and_model(spark):
    said = lambda inner=None, **k: json.dumps({"type": "assistant", "message": {"content": "x", "usage": inner, "model": "inner"}} | k)
    snake, camel = {"input_tokens": 1, "output_tokens": 2}, {"inputTokens": 3, "outputTokens": 4}
    cases = [
        (said(snake, tokensIn=7), (7, None, "inner"), (1, 2)),
        (said(snake, tokensIn="7", model="top"), (1, 2, "top"), (1, 2)),
        (said(snake, usage=camel, model=""), (3, 4, "inner"), (1, 2)),
        (said(snake, usage={}), (None, None, "inner"), (1, 2)),
        (said(snake, usage=None, model=5), (1, 2, "inner"), (1, 2)),
        (said(camel), (3, 4, "inner"), (None, None)),
        (said(snake | camel), (1, 2, "inner"), (1, 2)),
        (said(), (None, None, "inner"), (None, None)),
    ]
    df = spark.createDataFrame([("f", i, x) for i, (x, _, _) in enumerate(cases)], "file string, line_no int, value string")
    wide, narrow = (L.events(df, n).orderBy("event_index").collect() for n in (False, True))
    assert [(r.tokens_in, r.tokens_out, r.model) for r in wide] == [w for _, w, _ in cases]
    assert [(r.tokens_in, r.tokens_out) for r in narrow] == [n for _, _, n in cases]


SEARCH = "search_chunks"


@pytest.mark.parametrize(
    "rows,saved",
    [
        ([use(SEARCH), result("## a\n## b\n## c")], 6600),
        ([use(SEARCH), result('["a","b"]', "ARRAY<STRING>")], 6900),
        ([use(SEARCH), result('{"chunks":[1,2,3,4]}', "OBJECT<chunks: ARRAY<BIGINT>>")], 6300),
        ([use(SEARCH), result("plain")], 7200),
        ([use(SEARCH), result(json.dumps(list(range(50))), "ARRAY<BIGINT>")], 6000),
        ([use(SEARCH)], 7500),
        ([use(SEARCH), use("Read"), result("## a")], 7500),
        ([use(SEARCH), result("## a", is_error=True)], 7500),
    ],
)
def test_savings_of_a_call(spark, rows, saved):
    assert [r.saved for r in L.search_calls(events(spark, rows)).collect()] == [saved]


def test_savings_rollup(spark):
    prices = spark.createDataFrame([("m", 2.0, 10.0)], "model string, usd_in_mtok double, usd_out_mtok double")
    rows = [use(SEARCH), result("## a"), ("s", "assistant_message", {"text": "abc", "tokens_in": 1_000_000, "tokens_out": 0, "model": "m"}), ("s", "assistant_message", {"text": "abcde"}), ("t", "user_message", {"text": "x"})]
    got = {r.session: r for r in L.savings(events(spark, rows), prices).collect()}
    assert (got["s"].tokens_saved, got["s"].tokens_consumed, got["s"].dollars_consumed, got["s"].usd_per_mtok) == (7200, 1_000_002, 2.0, 2.0)
    assert got["t"].tokens_saved == 0 and got["t"].dollars_saved is None and got["t"].percent_saved == 0.0


def test_replay(spark):
    rows = [use("Read"), use("Bash", command="rg foo"), result("x" * 16000), result("y" * 8000), use("Bash", command="make"), result("z" * 100), use("Grep"), result("q" * 100)]
    r = L.replay(events(spark, rows)).orderBy("event_index").collect()
    assert [x.replaced for x in r] == [False, False, True, False, False, False, False, True]
    total = [x for x in L.replay_totals(L.replay(events(spark, rows))).collect() if x.session is None][0]
    assert total.saved == 4000 - 1500 + 25 - 1500


def folds(kinds):
    """Interrupted flag, and the partner of each result over a stack of named calls, as plain loops."""
    open_, stack, pairs = 0, [], {}
    for i, (k, tool) in enumerate(kinds):
        if k == "tool_use":
            open_ += 1
            if tool:
                stack.append(i)
        elif k == "tool_result":
            open_ = max(0, open_ - 1)
            if stack:
                pairs[i] = stack.pop()
    return open_ > 0, pairs


def test_folds_equal_loops(spark):
    rng = random.Random(3)
    cases = [[(k := rng.choice(["tool_use", "tool_result", "assistant_message"]), rng.choice(["A", "B", None]) if k == "tool_use" else None) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    ev = events(spark, [(f"s{n}", k, {"tool": t}) for n, case in enumerate(cases) for k, t in case])
    flags = {r.session: r.interrupted for r in L.turns(ev).collect()}
    pairs: dict = {}
    for r in L.tool_pairs(ev).collect():
        pairs.setdefault(r.session, {})[r.result_index] = r.use_index
    for n, case in enumerate(cases):
        interrupted, want = folds(case)
        assert flags[f"s{n}"] == interrupted
        assert pairs.get(f"s{n}", {}) == want


def test_turn_numbers_and_metrics(spark):
    rows = [("s", "system", {}), ("s", "user_message", {"text": "a", "ts": "1"}), use("Read"), result("x" * 6000), ("s", "user_message", {"text": "b", "ts": "5"}), use("Bash"), use(SEARCH), ("t", "user_message", {}), ("t", "user_message", {})]
    got = L.turns(events(spark, rows)).orderBy("session", "turn_no").collect()
    assert [(r.session, r.turn_no) for r in got] == [("s", 0), ("s", 2), ("s", 3), ("t", 1), ("t", 2)]
    assert got[1].missed and got[1].read_bytes == 6000 and not got[1].interrupted and got[1].outcome == "ok"
    assert got[2].interrupted and got[2].tools == f"Bash,{SEARCH}" and got[2].searches == 1 and not got[2].missed


def hits(*paths):
    return result(json.dumps({"results": [{"filePath": p, "startLine": 1} for p in paths]}), "OBJECT<>")


def test_sizes_of_outputs(spark):
    """An array counts its strings and texts, an object its JSON, what is neither nothing."""
    user = ("s", "user_message", {})
    blocks = json.dumps(["ab\n", {"type": "text", "text": "cdé"}, {"type": "image", "source": "x" * 9000}, {"text": 5}, ["no"], None, 7])
    cases = [(blocks, "ARRAY<VARIANT>"), ("[]", "ARRAY<VOID>"), ('{"text":"ab"}', "OBJECT<text: STRING>"), ('["ab"]', "STRING"), ("null", "VOID"), ("12", "BIGINT"), (None, None)]
    rows = [x for output, kind in cases for x in (user, use("Read"), result(output, kind), use("Bash"), result(output, kind))]
    got = L.turns(events(spark, rows)).orderBy("turn_no").collect()
    assert [r.read_bytes for r in got] == [r.bash_bytes for r in got] == [6, 0, 13, 6, 0, 0, 0]
    assert not any(r.missed for r in got)


def test_turn_savings_by_chunks(spark):
    """The saved tokens go to turns by the chunks they returned, over the session's, at most all; none for a turn that returned none."""
    user = ("s", "user_message", {"ts": "2026-01-01T00:00:00Z"})
    hit = lambda n: hits(*"abcdefghi"[:n])
    ev = events(spark, [user, use(SEARCH), hit(3), user, use(SEARCH), hit(1), use(SEARCH), user, use(SEARCH), result("nothing"), user, use("Read"), hit(2)])
    totals = spark.createDataFrame([("s", 4, 7, 1000)], "session string, searches bigint, chunks bigint, tokens_saved bigint")
    saved = lambda t: [r.saved for r in L.turn_savings(L.turns(ev), t).orderBy("turn_no").collect()]
    assert saved(totals) == [429, 143, None, None]
    assert saved(totals.selectExpr("session", "searches", "2L AS chunks", "tokens_saved")) == [1000, 500, None, None]
    assert saved(totals.selectExpr("session", "searches", "0L AS chunks", "tokens_saved")) == [None] * 4
    assert saved(totals.selectExpr("session", "searches", "chunks", "0L AS tokens_saved")) == [None] * 4


def test_provenance(spark):
    rows = [
        use("Read", path="src/a.ts"),  # before any search
        use(SEARCH),
        hits("src/a.ts", "lib/b.ts"),
        use("Read", path="/work/lib/b.ts"),
        result(),
        use(SEARCH),
        hits("src/a.ts", "b.ts"),
        use("Edit", path="src/a.ts"),
        use("Write", path="/other/b.ts"),
        use("Grep", path="src/a.ts"),
        use("Read", path="/"),
    ]
    got = {r.event_index: (r.search_index, r.chunk_index) for r in L.provenance(events(spark, rows)).collect()}
    assert got == {3: (1, 1), 7: (5, 0)}
    links = L.provenance(events(spark, rows))
    assert {r.search_index: (r.consumers, r.used_chunks) for r in L.used_searches(links).collect()} == {1: ([3], [1]), 5: ([7], [0])}
    assert {r.event_index: r.search_index for r in L.nearest_used_search(events(spark, rows), links).collect()} == {2: 1, 4: 1, 6: 5}


def test_session_by_prefix(spark):
    s = spark.createDataFrame([("abc",), ("ABD",), ("x",)], "id string")
    assert L.session_by_prefix(s, "X").count() == 1
    for prefix in ("ab", "zz"):
        with pytest.raises(ValueError):
            L.session_by_prefix(s, prefix)


def test_prefix_roots(spark):
    cwds = spark.createDataFrame([("/w/app-fix",), ("/w/app",), ("/w/apple",), ("/w/app/sub/x",), ("",), (None,)], "cwd string")
    roots = spark.createDataFrame([("/w/app",), ("/w/app/sub",), ("/w",), ("",), (None,)], "root string")
    got = {r.cwd: r.root for r in L.prefix_roots(cwds, roots).collect()}
    assert got["/w/app-fix"] == "/w/app" and got["/w/app"] == "/w" and got["/w/apple"] == "/w" and got["/w/app/sub/x"] == "/w/app/sub" and got[""] is None


def test_projects(spark):
    s = spark.createDataFrame(
        [("a", "/r", "git", "2026-02-28T23:58:00Z"), ("b", "/r", "inferred-prefix", "2020-01-01T00:00:00Z"), ("c", "", "decoded", None), (None, None, None, "bad")],
        "project string, project_root string, project_root_source string, updated_at string",
    )
    got = [(r.project, r.sessions, r.worktrees, r.live, r.inferred) for r in L.projects(s, "2026-03-01T00:00:00Z").collect()]
    assert got[0] == ("/r", 2, 2, True, 1) and ("c", 1, 1, False, 0) in got
    assert ("b", 1, 1, False, 0) in [(r.project, r.sessions, r.worktrees, r.live, r.inferred) for r in L.projects(s, "2026-03-01T00:00:00Z", False).collect()]


def test_ground_truth(spark):
    rows = [
        ("s", "user_message", {"text": "fix the parser now. Then"}),
        use("Read", path="/p/a.py"),
        use("Edit", path="/p/a.py"),
        use("Read", path="/elsewhere/b.py"),
        ("s", "user_message", {"text": "[marker]"}),
        use("Write", path="/p/c.py"),
        ("s", "user_message", {"text": "ok"}),
        use("Read", path="/p/lost.py"),
        use(SEARCH, query=" Fix The Parser Now. "),
        use("Read", path="/p/d.py"),
    ]
    roots = spark.createDataFrame([("s", "/p/")], "session string, project_root string")
    truth = L.ground_truth(events(spark, rows), roots)
    assert [(r.event_index, r.source, r.query, r.files) for r in truth.orderBy("event_index").collect()] == [(0, "user_message", "fix the parser now.", ["a.py", "c.py"]), (8, "search_call", "Fix The Parser Now.", ["d.py"])]
    merged = L.merged_truth(truth, roots).collect()
    assert [(r.query, r.source, r.sessions, r.files) for r in merged] == [("fix the parser now.", "search_call", 1, ["a.py", "c.py", "d.py"])]


def user(text="go", **f):
    return ("s", "user_message", {"text": text, **f})


@pytest.mark.parametrize(
    "output,kind,size",
    [
        ("x" * 4990, "STRING", 4990),
        (json.dumps([{"type": "text", "text": "x" * 4990}]), "ARRAY<OBJECT<text: STRING>>", 4990),
        (json.dumps(["ab", {"text": "cde"}, {"text": 5}, 7, None]), "ARRAY<VARIANT>", 5),
        ('{"a":1}', "OBJECT<a: BIGINT>", 7),
        ("null", "VOID", 0),
        (None, None, 0),
        ("5", "BIGINT", 0),
    ],
)
def test_size_of_a_result(spark, output, kind, size):
    (turn,) = L.turns(events(spark, [user(), use("Read"), result(output, kind)])).collect()
    assert (turn.read_bytes, turn.bash_bytes, turn.missed) == (size, 0, False)


def test_heavy_context_is_the_sum_of_reads_and_commands(spark):
    heavy = [user(), use("Read"), result("r" * 3000), use("Bash"), result("b" * 2000)]
    assert [t.missed for t in L.turns(events(spark, heavy)).collect()] == [True]
    assert [t.missed for t in L.turns(events(spark, [*heavy[:-1], result("b" * 1999)])).collect()] == [False]
    assert [t.missed for t in L.turns(events(spark, [*heavy, use(SEARCH)])).collect()] == [False]
    split = [user(), use("Read"), result("r" * 3000), user(), use("Bash"), result("b" * 2000)]
    assert [t.missed for t in L.turns(events(spark, split)).collect()] == [False, False]


def test_search_names_without_case_and_punctuation(spark):
    names = ["search_chunks", "mcp__tool__search-chunks", "Search.Chunks", "searchChunks", "find_related", "search", "chunks_search", "", None]
    df = spark.createDataFrame([(n,) for n in names], "tool string")
    assert [r[0] for r in df.select(L.names_search(df.tool)).collect()] == [True] * 4 + [False] * 5
    assert [r[0] for r in df.select(L.names_search(df.tool, ("findrelated", "search"))).collect()] == [True] * 7 + [False] * 2
    turn = L.turns(events(spark, [user(), use("mcp__x__search_chunks"), hits("a", "b")])).collect()[0]
    assert (turn.searches, turn.search_chunks) == (1, 2)


@pytest.mark.parametrize(
    "output,count,latency",
    [
        ('{"results":[1,2],"latencyMs":12.5}', 2, 12.5),
        ('{"hits":[{"filePath":"a"}]}', 1, None),
        (json.dumps('{"results":[1]}'), 1, None),
        (json.dumps({"content": [{"type": "text", "text": '{"results":[1,2,3],"latencyMs":4}'}]}), 3, 4.0),
        (json.dumps({"content": [{"text": json.dumps({"content": [{"text": '{"results":[]}'}]})}]}), 0, None),
        ('{"other":1}', None, None),
        ("plain", None, None),
        (None, None, None),
    ],
)
def test_search_outputs(spark, output, count, latency):
    df = spark.createDataFrame([(output,)], "o string")
    assert tuple(df.select(L.result_count(df.o), L.latency(df.o)).first()) == (count, latency)


def test_search_labels(spark):
    cases = [
        ({"query": "auth"}, '"auth"  ·  hybrid  ·  top=10'),
        ({"query": "q" * 61, "hybrid": False, "top": 5}, '"' + "q" * 59 + '…"  ·  bm25  ·  top=5'),
        ({"query": "x", "hybrid": "false", "top": "3"}, '"x"  ·  hybrid  ·  top=10'),
        ({"query": 5}, None),
        ([], None),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, v string")
    assert [r[1] for r in df.select("i", L.search_label(df.v)).orderBy("i").collect()] == [w for _, w in cases]


def test_pairs_for_display(spark):
    rows = [use("Read"), result("x" * 400), use("Grep"), ("s", "system", {}), result("y" * 40), use("Glob"), use("Task"), result("z")]
    ev = events(spark, rows)
    assert [tuple(r)[1:] for r in L.use_rows(ev, L.replay(ev)).orderBy("event_index").collect()] == [(0, "Read", 100, 1500), (2, "Grep", 0, 0), (5, "Glob", 0, 0)]


def test_queries_of_a_session(spark):
    rows = [user("Fix the parser. Then rest"), use(SEARCH, query="  Token limit "), user("[marker] nothing"), user("token LIMIT"), use("mcp.search_chunks", query="token limit"), user("ok"), use(SEARCH, query="")]
    assert [(r.query, r.place) for r in L.asked_queries(events(spark, rows)).orderBy("place").collect()] == [("Token limit", 1), ("Fix the parser.", 2)]


def test_which_queries_are_kept(spark):
    rows = [
        user("go on with it please"),  # vague, no files: out
        user("now the second thing"),
        use("Read", path="/p/a.py"),
        user("where is ParserError raised"),
        use(SEARCH, query="vague words"),
        use(SEARCH, query="limits"),
        use("NotebookEdit", path="/p/n.ipynb"),
    ]
    roots = spark.createDataFrame([("s", "/p")], "session string, project_root string")
    merged = L.merged_truth(L.ground_truth(events(spark, rows), roots), roots)
    kept = [(r.query, r.place) for r in L.retained_queries(merged, 3).orderBy("place").collect()]
    assert kept == [("limits", 1), ("vague words", 2), ("now the second thing", 3)]
    assert {r.query for r in L.retained_queries(merged).collect()} == {"limits", "vague words", "now the second thing", "where is ParserError raised"}


def test_empty_inputs(spark):
    ev = events(spark, [use("x")]).limit(0)
    for f in (L.kind_counts, L.search_calls, L.replay, L.turns, L.tool_pairs, L.search_hits, L.provenance):
        assert f(ev).count() == 0
    assert L.last_events(events(spark, [use("a"), use("b"), use("c")]), 2).count() == 2
    assert L.matching_events(events(spark, [use("ReadFile"), ("s", "user_message", {"text": "READ me"})]), "read ").count() == 2

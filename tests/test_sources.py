import http.server
import json
import os
import struct
import subprocess
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselog.operators import code_chunks as C
from tesselog.sources import documents as D
from tesselog.sources import repo_files as R
from tesselog.sources import sessions as S
from tesselog.sources.tail import TailReader, TailSource


@pytest.mark.parametrize(
    "rules,path,want",
    [
        ("*.log", "a/b.log", True),
        ("/a.txt", "a.txt", True),
        ("/a.txt", "b/a.txt", False),
        ("build/", "build/x/y", True),
        ("build/", "build", False),
        ("*.log\n!keep.log", "keep.log", False),
        ("build/\n!build/keep", "build/keep", True),
        ("a/**/z", "a/b/c/z", True),
        ("a/**/z", "a/z", True),
        ("doc/*.md", "doc/x/y.md", False),
        ("# no\n\n[ab].c", "a.c", True),
        ("[!ab].c", "a.c", False),
        ("\\#x", "#x", True),
        ("", "anything", False),
    ],
)
def test_ignore_rules(rules, path, want):
    assert R.IgnoreRules({"": rules}).ignored(path) is want


def test_inner_rules_win():
    rules = R.IgnoreRules({"": "*.log", "sub": "!x.log\n*.tmp"})
    assert not rules.ignored("sub/x.log") and rules.ignored("x.log") and rules.ignored("sub/deep/y.tmp") and rules.ignored(".git/config")


@pytest.fixture
def tree(tmp_path):
    def put(name, data):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    put(".gitignore", b"out/\n*.log\n")
    put("a.py", b"import os\n\n# says one\n# thing\n@staticmethod\ndef f():\n    return 1\n\n\nclass K:\n    x = 1\n    def g(self):\n        pass\n")
    put("sub/b.txt", b"one\ntwo\n")
    put("sub/c.log", b"x")
    put("out/d.py", b"x")
    put("bin", b"a\0b")
    put("big", b"x" * 2_000_000)
    put(".git/config", b"x")
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    return tmp_path


def test_walk(spark, tree):
    got = {r.path: r.reason for r in R.list_files(spark, str(tree)).collect()}
    assert got == {".gitignore": None, "a.py": None, "sub/b.txt": None, "sub/c.log": "gitignore", "out": "gitignore", "bin": "binary", "big": "too-large", ".git": "gitignore", "sub/loop": "symlink-loop"}
    assert {r.path for r in R.text_files(R.list_files(spark, str(tree), respect_ignore=False)).collect()} >= {"out/d.py", "sub/c.log", ".git/config"}
    looped = {r.path: r.reason for r in R.walk(spark, str(tree), follow_links=True).collect()}
    assert [p for p, r in looped.items() if r == "symlink-loop"]


def test_code_chunks_cover_every_line(spark, tree):
    files = R.text_files(R.list_files(spark, str(tree)))
    got = C.chunk_files(files).where("path = 'a.py'").orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.node_type, r.symbol_name) for r in got] == [(1, 2, None, None), (3, 7, "function_definition", "f"), (8, 11, None, None), (12, 13, "function_definition", "g")]


@pytest.mark.parametrize("text,language", [("", "python"), ("\n \n", None), ("def broken(:\n", "python"), ("x = 1\n" * 120, "python"), ("def f():\n" + "    x = 1\n" * 320, "python"), ("a\n" * 60, "go")])
def test_code_chunks_of_odd_files(text, language):
    chunks = C.chunks_of(text, language)
    lines = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")
    covered = {i for a, b, *_ in chunks for i in range(a, b + 1)}
    assert {i for i, x in enumerate(lines, 1) if x.strip()} <= covered
    assert all(b - a < C.MAX_LINES for a, b, *_ in chunks)


def test_url_problem(spark):
    urls = {"https://github.com/a/b": None, "http://127.0.0.1/x": "private host", "git@github.com:a/b.git": None, "file:///etc": "scheme", "https://[::1]/x": "private host", "ssh://git@10.0.0.1/x": "private host", "nonsense": "scheme"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.p for r in df.select("u", R.url_problem(F.col("u")).alias("p")).collect()} == urls
    assert df.where(R.url_problem(F.col("u"), allow_private=True) == "private host").count() == 0


def test_logs_and_listing(spark, tmp_path):
    folder = tmp_path / "-work-app-fix"
    folder.mkdir()
    line = lambda ts, **k: json.dumps({"type": "user", "timestamp": ts, "message": {"content": "x"}, **k})
    (folder / "s1.jsonl").write_text(line("2025-01-02") + "\r\n\n" + "bad\r" + line("2025-01-01"))
    other = tmp_path / "-work-app"
    other.mkdir()
    (other / "s2.jsonl").write_text(line("2025-02-01", cwd="work/app") + "\n")
    lines = S.read_logs(spark, str(tmp_path))
    assert [r.value for r in lines.where("file like '%s1.jsonl'").orderBy("line_no").collect()] == [line("2025-01-02"), "", "bad", line("2025-01-01")]
    listed = S.list_sessions(lines)
    got = [(r.id, r.project, r.started_at, r.updated_at, r.event_count) for r in listed.collect()]
    assert got == [("s2", "work/app", "2025-02-01", "2025-02-01", 1), ("s1", "work/app/fix", "2025-01-02", "2025-01-01", 4)]
    assert {r.id: (r.project_root, r.project_root_source) for r in S.with_inferred_roots(listed).collect()}["s1"] == ("work/app", "inferred-prefix")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Files cut into many splits keep the numbers of their lines, whatever the endings."""
    want = {}
    for name, end in (("a", "\n"), ("b", "\r\n"), ("c", "\n")):
        lines = [f"{name}{i}" + "x" * (i * 7 % 50) for i in range(400)] + ["", "last"]
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / f"{name}.jsonl").write_bytes(end.join(lines).encode() + (b"" if name == "c" else end.encode()))
        want |= {(f"p/{name}.jsonl", i): x for i, x in enumerate(lines, 1)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        rows = S.read_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.file, r.line_no): r.value for r in rows} == want and len(rows) == len(want)


def test_session_sources(spark, tmp_path):
    line = lambda text: json.dumps({"type": "user", "cwd": "/w", "timestamp": "2025-01-01", "message": {"content": text}})
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.jsonl").write_text(line("a") + "\n" + line("b") + "\n")
    (tmp_path / "p" / "two.jsonl").write_text(line("c") + "\n")
    folder = S.LogFolder(spark, str(tmp_path))
    table = S.LogTable(folder.lines)
    for source in (folder, table):
        assert sorted(r.id for r in source.sessions().collect()) == ["one", "two"]
        assert sorted(r.text for r in source.events().collect()) == ["a", "b", "c"]
        one = source.events(source.sessions().where("id = 'one'")).orderBy("event_index").collect()
        assert [(r.event_index, r.text) for r in one] == [(0, "a"), (1, "b")]


def test_tail_reader(tmp_path):
    log = tmp_path / "a.jsonl"
    log.write_bytes(b"one\r\ntwo\npart")
    reader = TailReader(str(tmp_path / "*.jsonl"))
    read = lambda a, b: [(r[1], r[3]) for p in reader.partitions(a, b) for r in reader.read(p)]
    start = reader.initialOffset()
    first = reader.latestOffset()
    assert read(start, first) == [(0, "one"), (0, "two")]
    log.write_bytes(b"one\r\ntwo\npartial\n")
    second = reader.latestOffset()
    assert read(first, second) == [(0, "partial")] and read(second, reader.latestOffset()) == []
    log.write_bytes(b"new\n")
    third = reader.latestOffset()
    assert read(second, third) == [(1, "new")]
    assert read(start, first | {}) is not None


def test_tail_stream(spark, tmp_path):
    log = tmp_path / "a.jsonl"
    log.write_text("1\n2\n")
    spark.dataSource.register(TailSource)
    job = spark.readStream.format("log_tail").load(str(tmp_path / "*.jsonl")).writeStream.format("memory").queryName("tailed").start()
    try:
        job.processAllAvailable()
        with log.open("a") as f:
            f.write("3\n4")
        job.processAllAvailable()
        assert [r.value for r in spark.table("tailed").orderBy("start").collect()] == ["1", "2", "3"]
    finally:
        job.stop()


def test_tensors_history_envelope_embedder(spark, tmp_path):
    a = np.arange(6, dtype="<f4").reshape(2, 3)
    header = json.dumps({"__metadata__": {}, "emb": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "b": {"dtype": "I8", "shape": [1], "data_offsets": [24, 25]}}).encode()
    data = struct.pack("<Q", len(header)) + header + a.tobytes() + b"\0"
    assert (D.embedding_tensor(D.tensors(data)) == a).all()
    with pytest.raises(ValueError):
        D.tensors(struct.pack("<Q", 10**9) + b"{}")
    run = spark.createDataFrame([(1, "x", "2025-01-01T00:00:00Z", [])], D.HISTORY_SCHEMA)
    D.save_history(run, f"file://{tmp_path}/h", "2025-01-01T00:00:00Z")
    D.save_history(run.withColumn("formatVersion", F.lit(9)), f"file://{tmp_path}/h", "2025-01-02T00:00:00Z")
    assert [r.id for r in D.load_history(spark, f"file://{tmp_path}/h").collect()] == ["x"]
    res = spark.createDataFrame([(1, 5, 2.0, 1)], "query_id bigint, chunk_id bigint, score double, rank int")
    out = {r.query_id: json.loads(r.envelope) for r in D.result_envelope(res, spark.createDataFrame([(1, "a"), (2, "b")], "query_id bigint, text string"), "bm25", 5).collect()}
    assert out[1]["resultCount"] == 1 and out[2]["results"] == []
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id bigint, text string")
    assert {r.id: r.v for r in D.embed_remote(df, "id", "text", lambda ts: [[float(len(t)), 0.0] for t in ts], 2).collect()} == {1: [1.0, 0.0], 2: [0.0, 0.0]}
    with pytest.raises(Exception, match="another number or size"):
        D.embed_remote(df, "id", "text", lambda ts: [[1.0]] * len(ts), 2).collect()


class Embedder(http.server.BaseHTTPRequestHandler):
    """Answers /many with all vectors in reverse order, /one with one vector a request, and else with what the path says."""

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        code, answer = 200, {}
        if self.path == "/many":
            answer = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
        elif self.path == "/one":
            code, answer = (400, {}) if "input" in body else (200, {"embedding": [float(len(body["prompt"])), 1.0]})
        elif self.path == "/slow":
            time.sleep(2)
        elif self.path == "/broken":
            code = 500
        data = json.dumps(answer).encode()
        try:
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)
        except OSError:
            pass

    def log_message(self, *args):
        pass


def test_http_embedder(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Embedder)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = lambda path, **k: D.http_client(f"http://127.0.0.1:{server.server_port}/{path}", "m", **k)
    try:
        for path in ("many", "one"):
            assert at(path, batch=2)(["a", "bbb", "cc"]) == [[1.0, 1.0], [3.0, 1.0], [2.0, 1.0]]
        for path in ("empty", "broken"):
            with pytest.raises(D.WireError):
                at(path)(["a"])
        with pytest.raises(D.WireError):
            at("slow", timeout=0.2)(["a"])
        df = spark.createDataFrame([(1, "aaa")], "id bigint, text string")
        (row,) = D.embed_remote(df, "id", "text", at("many"), 2).collect()
        assert np.allclose(row.v, np.array([3, 1]) / np.sqrt(10))
    finally:
        server.shutdown()


def test_clone_and_cache(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True).stdout.decode().strip()
    (tmp_path / "r").mkdir()
    git("init", "-q", "-b", "main")
    for text in ("one", "two"):
        (tmp_path / "r" / "a.txt").write_text(text)
        git("add", "."), git("commit", "-qm", text)
    first = git("rev-parse", "HEAD~1")
    for _ in range(2):
        R.clone(spark, str(tmp_path / "r"), str(tmp_path / "c"), first, allow_local=True)
        assert (tmp_path / "c" / "a.txt").read_text() == "one"
    for url in (str(tmp_path / "r"), "file:///x", "https://127.0.0.1/x", "--upload-pack=x", "ext::sh -c x"):
        with pytest.raises(ValueError):
            R.clone(spark, url, str(tmp_path / "d"))
    asked = []
    for _ in range(2):
        path = D.fetch_to_cache("m/x.bin", str(tmp_path / "cache"), lambda name: asked.append(name) or b"data")
    assert open(path, "rb").read() == b"data" and asked == ["m/x.bin"]
    with pytest.raises(OSError):
        D.fetch_to_cache("m/y.bin", str(tmp_path / "cache"), lambda name: (_ for _ in ()).throw(OSError("gone")))
    assert not os.path.exists(tmp_path / "cache" / "m" / "y.bin")

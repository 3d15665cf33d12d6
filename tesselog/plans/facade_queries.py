"""Queries that go through files, stores and streams: what a table holds is written to the shared folder, read back by the sources, and compared with the table.

The folder must be one that all executors share by one local path, as the sources of trees and logs read local files.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselog.engine import SearchIndex
from tesselog.functions import text as T
from tesselog.functions import vectors as V
from tesselog.operators import logs as L
from tesselog.operators import retrieval as R
from tesselog.operators.index_store import IndexStore
from tesselog.plans import log_queries as LQ
from tesselog.plans import retrieval_queries as Q
from tesselog.session import materialise, once, shared_dir, table
from tesselog.sources import documents, repo_files, sessions
from tesselog.sources.tail import TailSource

QUERIES: dict = {}
SQL: dict[str, str] = {}
MAX_BYTES = 4000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder as a local path."""
    base = shared_dir(spark)
    if not base.startswith(("file:", "/")):
        raise ValueError(f"a shared folder with a local path is needed, not {base}")
    out = "/" + base.removeprefix("file:").lstrip("/") + f"/tesselog/{name}-{uuid.uuid4().hex}"
    os.makedirs(out)
    return out


def _write(root: str):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(content.encode("utf-8", "surrogatepass"))
            yield batch[["path"]]

    return run


def write_files(rows: DataFrame, root: str) -> None:
    """Each row (path, content) as a file below root."""
    rows.select("path", "content").mapInPandas(_write(root), "path string").write.format("noop").mode("overwrite").save()


# -- source trees ----------------------------------------------------------------------------------
_PATH = "repo || '/' || chunk_id || '-' || regexp_extract(file_path, '([^/]*)$', 1)"
TREE = rf"""tree AS (SELECT {_PATH} AS path, content, octet_length(encode(content)) AS size, CASE WHEN ends_with(file_path, '.java') AND chunk_id % 10 <> 0 OR repo LIKE '%a' THEN 'gitignore' WHEN octet_length(encode(content)) > {MAX_BYTES} THEN 'too-large' WHEN chunk_id % 7 = 0 THEN 'binary' END AS reason
FROM (SELECT DISTINCT * FROM chunks) WHERE repo IS NOT NULL AND file_path IS NOT NULL AND content IS NOT NULL)"""


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """The chunks as files of a tree with ignore rules, large ones and binary ones."""
    root = _folder(spark, "tree")
    rows = once(table(spark, sf_dir, "chunks"), "chunk_id").where("repo is not null and file_path is not null and content is not null")
    path = F.concat("repo", F.lit("/"), F.col("chunk_id").cast("string"), F.lit("-"), F.regexp_extract("file_path", "([^/]*)$", 1))
    binary = (F.octet_length("content") > 0) & (F.col("chunk_id") % 7 == 0) & (F.octet_length("content") <= MAX_BYTES)
    content = F.when(binary, F.concat(F.lit("\0"), F.expr("substring(content, 2)"))).otherwise(F.col("content"))
    write_files(rows.select(path.alias("path"), content.alias("content")), root)
    with open(os.path.join(root, ".gitignore"), "w", encoding="utf-8") as f:
        f.write("# rules\n*.java\n!*0-*.java\n*a/\n")
    return root


@query(
    f"WITH {TREE} SELECT path, CASE WHEN reason = 'binary' AND size = 0 THEN NULL ELSE reason END AS reason FROM tree WHERE reason IS DISTINCT FROM 'gitignore' OR split_part(path, '/', 1) NOT LIKE '%a' UNION ALL SELECT DISTINCT split_part(path, '/', 1), 'gitignore' FROM tree WHERE split_part(path, '/', 1) LIKE '%a'"
    " UNION ALL SELECT '.gitignore', NULL"
)
def walked_files(spark, sf_dir):
    """Every file of the tree with the reason it is passed over for; an ignored folder stands for all that it holds."""
    return repo_files.list_files(spark, _tree(spark, sf_dir), MAX_BYTES).select("path", "reason")


_HELD = r"len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '[^ \t\r\n\f\x0b]')))::BIGINT"
_INDEXED = f"SELECT path, content FROM tree WHERE reason IS NULL UNION ALL SELECT '.gitignore', '# rules' || chr(10) || '*.java' || chr(10) || '!*0-*.java' || chr(10) || '*a/' || chr(10)"


def _covered(index: SearchIndex) -> DataFrame:
    pieces = index.chunks.select("path", F.explode(F.sequence("start_line", "end_line")).alias("no"), "content", "start_line")
    line = F.get(F.split("content", "\n", -1), (F.col("no") - F.col("start_line")).cast("int"))
    return pieces.where(line.rlike(r"[^ \t\r\n\f\x0b]")).select("path", "no").distinct().groupBy("path").agg(F.count("*").alias("lines"))


@query(f"WITH {TREE}, f AS ({_INDEXED}) SELECT path, {_HELD} AS lines, true AS cache_hit FROM f WHERE {_HELD} > 0")
def indexed_tree(spark, sf_dir):
    """The lines that the chunks of an index cover, of one that was built, kept, and loaded again."""
    root, store = _tree(spark, sf_dir), IndexStore(spark, "file://" + _folder(spark, "cache"))
    SearchIndex.build(spark, root, store=store, max_bytes=MAX_BYTES)
    again = SearchIndex.build(spark, root, store=store, max_bytes=MAX_BYTES)
    return _covered(again).withColumn("cache_hit", F.lit(again.cache_hit))


@query(
    f"""WITH {TREE}, f AS ({_INDEXED}), d AS (SELECT path, content, CASE WHEN path = '.gitignore' THEN -1 ELSE split_part(split_part(path, '/', 2), '-', 1)::BIGINT END AS id FROM f),
n AS (SELECT path, CASE WHEN id >= 0 AND id % 4 = 1 THEN content || chr(10) || 'one more line' ELSE content END AS content FROM d WHERE id < 0 OR id % 4 <> 2 UNION ALL SELECT 'added/new.txt', 'new')
SELECT path, {_HELD} AS lines, (SELECT count(*) FROM d WHERE id >= 0 AND id % 4 = 1) AS modified, (SELECT count(*) FROM d WHERE id >= 0 AND id % 4 = 2) AS removed, 1::BIGINT AS added FROM n WHERE {_HELD} > 0"""
)
def refreshed_tree(spark, sf_dir):
    """The lines of an index after some files were changed, some removed and one added, and the numbers that the refresh tells."""
    root = _tree(spark, sf_dir)
    index = SearchIndex.build(spark, root, max_bytes=MAX_BYTES)
    files = index.files.where("path <> '.gitignore'").withColumn("id", F.split(F.split("path", "/")[1], "-")[0].cast("bigint"))
    write_files(repo_files.read_files(files.where("id % 4 = 1").withColumn("size", F.lit(0).cast("bigint")), root).withColumn("content", F.concat("content", F.lit("\none more line"))), root)

    def drop(batches):
        for batch in batches:
            for path in batch["path"]:
                os.unlink(os.path.join(root, path))
            yield batch

    files.where("id % 4 = 2").select("path").mapInPandas(drop, "path string").write.format("noop").mode("overwrite").save()
    write_files(spark.createDataFrame([("added/new.txt", "new")], "path string, content string"), root)
    after, told = index.refresh()
    return _covered(after).select("path", "lines", F.lit(told.modified).cast("bigint").alias("modified"), F.lit(told.removed).cast("bigint").alias("removed"), F.lit(told.added).cast("bigint").alias("added"))


# -- session logs as files -----------------------------------------------------------------------------
_LINE = r"regexp_replace(coalesce(value, ''), '[\r\n]', ' ', 'g')"
_LOG = f"lg AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no, line_id) AS no, {_LINE} AS value FROM (SELECT DISTINCT line_id, file, line_no, value FROM raw_lines) WHERE file IS NOT NULL)"


def _logs(spark: SparkSession, sf_dir: str) -> str:
    root = _folder(spark, "logs")
    lines = LQ.raw(spark, sf_dir).where("file is not null").withColumn("value", F.regexp_replace(F.coalesce("value", F.lit("")), "[\r\n]", " "))
    whole = lines.groupBy(F.col("file").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line_id", "value"))), lambda x: F.concat(x["value"], F.lit("\n"))), "").alias("content"))
    write_files(whole, root)
    return root


@query(f"WITH {_LOG} SELECT file, no::INT AS line_no, md5(value) AS digest FROM lg")
def read_log_files(spark, sf_dir):
    """The lines of the logs, written as files and read again in splits."""
    rows = sessions.read_logs(spark, "file://" + _logs(spark, sf_dir))
    return rows.select("file", "line_no", F.md5("value").alias("digest"))


@query(f"WITH {_LOG} SELECT file, count(*) AS lines, count(DISTINCT value) AS kinds, sum(length(value))::BIGINT AS chars FROM lg GROUP BY 1")
def tailed_logs(spark, sf_dir):
    """The lines of the logs as an append-tailing stream emits them, half of each file before the other."""
    root, source = _folder(spark, "tail"), _logs(spark, sf_dir)
    whole = spark.read.text("file://" + source, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1).alias("path"), F.col("value").alias("content"))
    whole = materialise(whole, "whole")
    spark.dataSource.register(TailSource)
    out = f"file://{root}-out"
    lines = spark.readStream.format("log_tail").load(f"{root}/*/*.jsonl")
    job = lines.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").start()
    try:
        for share in (2, 1):
            write_files(whole.withColumn("content", F.expr(f"substring(content, 1, int(length(content) / {share}))")), root)
            job.processAllAvailable()
    finally:
        job.stop()
    rows = spark.read.schema("file string, generation int, start bigint, value string").parquet(f"{out}/rows")
    return rows.groupBy(F.regexp_extract("file", r"([^/]+/[^/]+)$", 1).alias("file")).agg(F.count("*").alias("lines"), F.count_distinct("value").alias("kinds"), F.sum(F.length("value")).alias("chars"))


_STR = LQ._str
LISTED = f"""ls AS (SELECT file, line_no, CASE WHEN json_valid(value) THEN value::JSON END AS v FROM (SELECT DISTINCT line_id, file, line_no, value FROM raw_lines)),
lf AS (SELECT file, line_no, nullif({_STR('v', '$.timestamp')}, '') AS ts, nullif({_STR('v', '$.cwd')}, '') AS cwd, nullif({_STR('v', '$.gitBranch')}, '') AS branch FROM ls),
la AS (SELECT file, count(*) AS n, arg_min(ts, line_no) FILTER (ts IS NOT NULL) AS a, arg_max(ts, line_no) FILTER (ts IS NOT NULL) AS z, arg_min(cwd, line_no) FILTER (cwd IS NOT NULL) AS cwd, arg_min(branch, line_no) FILTER (branch IS NOT NULL) AS branch FROM lf GROUP BY 1),
listed AS (SELECT regexp_extract(file, '([^/]+)[.]jsonl$', 1) AS id, coalesce(cwd, regexp_replace(replace(split_part(file, '/', 1), '-', '/'), '^/', '')) AS project, branch, CASE WHEN cwd IS NULL THEN 'decoded' ELSE 'cwd' END AS src, a AS started_at, z AS updated_at, n AS event_count FROM la)"""


@query(f"WITH {LISTED} SELECT id, project, branch, src AS source, started_at, updated_at, event_count FROM listed")
def listed_sessions(spark, sf_dir):
    """Sessions as the logs tell them; a log without a working directory is named by its folder."""
    rows = sessions.list_sessions(LQ.raw(spark, sf_dir))
    return rows.select("id", "project", "branch", F.col("project_root_source").alias("source"), "started_at", "updated_at", "event_count")


@query(
    f"""WITH {LISTED}, r AS (SELECT DISTINCT project AS root FROM listed WHERE src = 'cwd'), d AS (SELECT DISTINCT project AS cwd FROM listed WHERE src = 'decoded'),
m AS (SELECT cwd, arg_max(root, length(root)) AS root FROM d JOIN r ON root <> '' AND length(cwd) > length(root) AND starts_with(cwd, root) AND substring(cwd, length(root) + 1, 1) IN ('-', '/', '_') GROUP BY 1)
SELECT id, coalesce(CASE WHEN src = 'decoded' THEN root END, project) AS project_root, CASE WHEN src = 'decoded' AND root IS NOT NULL THEN 'inferred-prefix' ELSE src END AS source FROM listed LEFT JOIN m ON cwd = project"""
)
def session_roots(spark, sf_dir):
    """The root of each session; decoded ones by the longest root that some log verifies."""
    rows = sessions.LogTable(LQ.raw(spark, sf_dir)).sessions()
    return rows.select("id", "project_root", F.col("project_root_source").alias("source"))


# -- replay view, provenance over searches for chunks ---------------------------------------------------
@query(
    f"""WITH {LQ.EVENTS}, {LQ.REPLAY}, s AS (SELECT *, replaceable OR replaced AS shown, avg(CASE WHEN replaceable OR replaced THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY session) AS share FROM rp),
k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY event_index) AS rn FROM s WHERE shown OR share = 0 OR share >= 0.05) SELECT session, event_index, replaceable, replaced FROM k WHERE rn <= 500"""
)
def replay_view(spark, sf_dir):
    return L.replay_view(L.replay(LQ.log_events(spark, sf_dir, narrow_usage=True))).select("session", "event_index", "replaceable", "replaced")


_SESSION = f"""WITH {Q.CORPUS}, {Q.TERMS}, {Q.POSTS}, asked AS (SELECT chunk_id AS query_id, content AS text FROM chunk WHERE chunk_id % 100 = 0 AND content IS NOT NULL), {Q.bm25_sql(10)},
o AS (SELECT query_id, repo, file_path, 3 * (row_number() OVER (PARTITION BY repo ORDER BY query_id) - 1) AS base FROM asked JOIN chunk ON chunk_id = query_id WHERE repo IS NOT NULL AND file_path IS NOT NULL),
hits AS (SELECT o.repo AS session, base + 1 AS result_index, base AS search_index, rank - 1 AS chunk_index, c.file_path FROM bm JOIN o USING (query_id) JOIN chunk c ON c.chunk_id = bm.chunk_id WHERE c.file_path IS NOT NULL),
ac AS (SELECT repo AS session, base + 2 AS event_index, CASE WHEN query_id % 200 = 0 THEN '/work/' || file_path ELSE file_path END AS target FROM o),
pv AS ({LQ._linked('hits', 'ac').replace('SELECT u.session', 'SELECT u.session', 1)})"""
_SESSION = _SESSION.replace("pv AS (u AS", "u AS").replace("\nSELECT u.session, u.event_index, target, search_index, chunk_index, file_path FROM u LEFT JOIN z USING (session, event_index))", ", pv AS (SELECT u.session, u.event_index, target, search_index, chunk_index, file_path FROM u LEFT JOIN z USING (session, event_index))")


def _chunk_session(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, accesses, events): a session for each repo in which every hundredth chunk is searched by its content and its file read."""
    from pyspark.sql import Window

    chunks = Q.corpus(spark, sf_dir)
    asked = materialise(chunks.where("chunk_id % 100 = 0 and content is not null").select(F.col("chunk_id").alias("query_id"), F.col("content").alias("text")), "asked")
    chunks = materialise(chunks.select("chunk_id", "repo", "file_path"), "corpus")
    number = 3 * (F.row_number().over(Window.partitionBy("repo").orderBy("query_id")) - 1)
    order = chunks.where("repo is not null and file_path is not null").join(asked.select(F.col("query_id").alias("chunk_id"), "query_id"), "chunk_id").select("query_id", F.col("repo").alias("session"), "file_path", number.cast("bigint").alias("base"))
    order = materialise(order, "order")
    found = R.bm25(Q.index(spark, sf_dir), asked, 10).join(order.drop("file_path"), "query_id").join(chunks.where("file_path is not null").select("chunk_id", "file_path"), "chunk_id")
    hits = materialise(found.select("session", (F.col("base") + 1).alias("result_index"), F.col("base").alias("search_index"), (F.col("rank") - 1).cast("bigint").alias("chunk_index"), "file_path"), "hits")
    target = F.when(F.col("query_id") % 200 == 0, F.concat(F.lit("/work/"), "file_path")).otherwise(F.col("file_path"))
    used = order.select("session", (F.col("base") + 2).alias("event_index"), target.alias("target"))
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(("tool_use", "tool_result", "tool_use"))))).alias("x")
    events = order.select("session", "base", kinds).select("session", (F.col("base") + F.col("x.i")).alias("event_index"), "x.kind")
    return hits, used, events


@query(f"{_SESSION} SELECT * FROM pv")
def chunk_provenance(spark, sf_dir):
    """Which search for a chunk led to each file that was read."""
    hits, used, _ = _chunk_session(spark, sf_dir)
    return used.join(L.link_accesses(hits, used), ["session", "event_index"], "left")


@query(f"{_SESSION} SELECT session, search_index, array_to_string(list_sort(list(event_index)), ',') AS consumers, array_to_string(list_sort(list_distinct(list(chunk_index))), ',') AS used_chunks FROM pv WHERE search_index IS NOT NULL GROUP BY 1, 2")
def chunk_use(spark, sf_dir):
    """What came of each search for a chunk."""
    hits, used, _ = _chunk_session(spark, sf_dir)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return L.used_searches(L.link_accesses(hits, used)).select("session", "search_index", text("consumers"), text("used_chunks"))


@query(
    f"""{_SESSION}, us AS (SELECT DISTINCT session, search_index FROM pv WHERE search_index IS NOT NULL), rs AS (SELECT DISTINCT repo AS session, base + 1 AS event_index FROM o)
SELECT rs.session, rs.event_index, max(search_index) AS search_index FROM rs JOIN us ON us.session = rs.session AND us.search_index < rs.event_index GROUP BY 1, 2"""
)
def nearest_chunk_use(spark, sf_dir):
    """For each answer the latest search before it that something came of."""
    hits, used, events = _chunk_session(spark, sf_dir)
    return L.nearest_used_search(events, L.link_accesses(hits, used))


# -- small functions over whole columns ------------------------------------------------------------------
@query(
    """WITH n AS (SELECT model FROM model_prices UNION SELECT unnest(['nomic-embed-text-v1.5', 'BGE-small-en-v1.5', 'intfloat/e5-base', 'my-e5-x', 'bge-m3', 'e5']))
SELECT model, CASE WHEN contains(lower(model), 'nomic') THEN 'search_query: ' WHEN regexp_matches(lower(model), 'bge-(small|base|large)-en') THEN 'Represent this sentence for searching relevant passages: ' WHEN regexp_matches(lower(model), '(^|[/-])e5-') THEN 'query: ' ELSE '' END AS q,
CASE WHEN contains(lower(model), 'nomic') THEN 'search_document: ' WHEN regexp_matches(lower(model), 'bge-(small|base|large)-en') THEN '' WHEN regexp_matches(lower(model), '(^|[/-])e5-') THEN 'passage: ' ELSE '' END AS d FROM n"""
)
def model_prefixes(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in ("nomic-embed-text-v1.5", "BGE-small-en-v1.5", "intfloat/e5-base", "my-e5-x", "bge-m3", "e5")], "model string")
    every = table(spark, sf_dir, "model_prices").select("model").union(names).distinct()
    p = T.instruction_prefixes(F.col("model"))
    return every.select("model", p["query"].alias("q"), p["doc"].alias("d"))


@query(
    f"""WITH {Q.VECTORS.split(', vec AS')[0].split(chr(10) + 'vec AS')[0].rstrip(', ' + chr(10))}, n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS n FROM ok_v)
SELECT vec_id, i - 1 AS dim, round(CASE WHEN n <= 1e-6 OR abs(n - 1) <= 1e-3 THEN embedding[i]::DOUBLE ELSE (embedding[i]::DOUBLE / n)::FLOAT::DOUBLE END, 4) + 0.0 AS value FROM n, generate_series(1, 64) g(i)"""
)
def unit_vectors(spark, sf_dir):
    rows = once(table(spark, sf_dir, "cached_index").select("vec_id", "embedding", "created_at"), "vec_id", "created_at").where(V.usable(F.col("embedding"), 64))
    return rows.select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("dim", "value")).select("vec_id", F.col("dim").cast("bigint").alias("dim"), (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"))


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10))[1:5], lambda x: '    ' || x), chr(10))) AS preview, md5(CASE WHEN length(regexp_replace(text, '\\r?\\n', '↵', 'g')) > 120 THEN substring(regexp_replace(text, '\\r?\\n', '↵', 'g'), 1, 119) || '…' ELSE regexp_replace(text, '\\r?\\n', '↵', 'g') END) AS wire FROM documents WHERE text IS NOT NULL".replace("\\\\", "\\"))
def previews(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(T.preview(F.col("text"))).alias("preview"), F.md5(T.wire_snippet(F.col("text"))).alias("wire"))


# -- stores of results and injected models ------------------------------------------------------------------
@query("SELECT 'run' AS id, repo, count(*)::INT AS queries FROM (SELECT DISTINCT * FROM chunks) WHERE repo IS NOT NULL AND symbol_name IS NOT NULL GROUP BY 2")
def bench_history(spark, sf_dir):
    """A run's document, saved beside one of another version, and loaded again."""
    root = "file://" + _folder(spark, "history")
    per = once(table(spark, sf_dir, "chunks").select("chunk_id", "repo", "symbol_name"), "chunk_id").where("repo is not null and symbol_name is not null").groupBy("repo").agg(F.count("*").cast("int").alias("queries"))
    none = F.array().cast("array<struct<model:string,recall:double,mrr:double,tokensSaved:double,ci:struct<p05:double,p50:double,p95:double>>>")
    doc = per.agg(F.collect_list(F.struct("repo", "queries", none.alias("models"))).alias("repos"))
    doc = doc.select(F.lit(documents.HISTORY_VERSION).alias("formatVersion"), F.lit("run").alias("id"), F.lit("2026-01-01T00:00:00Z").alias("startedAt"), "repos")
    documents.save_history(doc, root, "2026-01-01T00:00:00Z")
    documents.save_history(doc.withColumn("formatVersion", F.lit(documents.HISTORY_VERSION + 1)), root, "2026-01-02T00:00:00Z")
    return documents.load_history(spark, root).select("id", F.explode("repos").alias("r")).select("id", "r.repo", "r.queries")


@query(f"{Q._BASE}, {Q.bm25_sql(5)} SELECT query_id, text AS query, count(chunk_id)::INT AS results, coalesce(string_agg(chunk_id::VARCHAR, ',' ORDER BY rank), '') AS ids FROM asked LEFT JOIN bm USING (query_id) GROUP BY 1, 2")
def result_envelopes(spark, sf_dir):
    """The results of each search as one JSON document, read back."""
    asked = Q.symbol_queries(Q.corpus(spark, sf_dir))
    docs = documents.result_envelope(R.bm25(Q.index(spark, sf_dir), asked, 5), asked, "bm25", 5)
    parsed = F.from_json("envelope", "query string, mode string, top int, resultCount int, results array<struct<chunk_id:bigint>>")
    return docs.select("query_id", parsed.alias("e")).select("query_id", "e.query", F.col("e.resultCount").alias("results"), F.array_join(F.transform("e.results", lambda r: r["chunk_id"].cast("string")), ",").alias("ids"))


@query(SQL_MOCK := Q.SQL["mock_embedding"].replace("round(r[i] / n, 6)", "round((r[i] / n)::FLOAT::DOUBLE, 5)"))
def remote_embedding(spark, sf_dir):
    """Vectors of symbols from an embedder that is called in batches."""
    names = table(spark, sf_dir, "chunks").where("symbol_name is not null").select(F.col("symbol_name").alias("text")).distinct()
    got = documents.embed_remote(names.withColumn("id", F.col("text")), "id", "text", lambda texts: V.hashed_matrix(texts, 64).tolist(), 64)
    return got.select(F.col("id").alias("text"), F.posexplode("v").alias("dim", "value")).select("text", F.col("dim").cast("bigint").alias("dim"), (F.round(F.col("value").cast("double"), 5) + 0.0).alias("value"))


@query(f"{Q._BASE}, {Q.bm25_sql(50)}, s AS (SELECT query_id, bm.chunk_id, round(1.0::DOUBLE / (1 + abs(length(text) - length(coalesce(content, '')))), 6) AS score FROM bm JOIN chunk USING (chunk_id) JOIN asked USING (query_id)) SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10")
def cross_encoder_rerank(spark, sf_dir):
    """Hits reranked by a scorer that is called in batches of pairs."""
    chunks = Q.corpus(spark, sf_dir)
    asked = Q.symbol_queries(chunks)
    scorer = documents.cross_encoder(lambda qs, ds: [1.0 / (1 + abs(len(q) - len(d))) for q, d in zip(qs, ds)])
    return R.rerank(R.bm25(Q.index(spark, sf_dir), asked, 50), chunks, asked, 10, relevance=scorer)

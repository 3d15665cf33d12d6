"""Evaluation queries over the driver's tables, each with its DuckDB twin.

Tasks are the symbols of every chunk whose id is divisible by 100; the files of
the same repo in which a chunk of that symbol stands are relevant.  A file is
the contents of its chunks in order of their lines.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselog.functions import text as T
from tesselog.operators import evaluation as E
from tesselog.operators import retrieval as R
from tesselog.plans import retrieval_queries as Q
from tesselog.session import materialise, once, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


class Setting:
    """The tables of an evaluation; what several steps read is written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        scan = table(spark, sf_dir, "chunks").select("chunk_id", "repo", "file_path", "start_line", "symbol_name", "content")
        path = F.concat_ws("/", "repo", "file_path").alias("path")
        rows = spread(once(scan, "chunk_id"), scan).where("repo is not null and file_path is not null").select("chunk_id", "repo", path, "start_line", "symbol_name", "content")
        self.chunks = materialise(rows, "chunks")
        asked = self.chunks.where("chunk_id % 100 = 0 and symbol_name is not null")
        self.tasks = materialise(asked.select(F.col("chunk_id").alias("query_id"), "repo", F.col("symbol_name").alias("text")), "tasks")
        relevant = self.tasks.join(self.chunks.select("repo", F.col("symbol_name").alias("text"), F.col("path").alias("item")), ["repo", "text"]).where(T.is_text_file(F.col("item"))).select("query_id", "item").distinct()
        self.relevant = materialise(relevant, "relevant")

    def terms(self) -> DataFrame:
        return materialise(R.index_terms(self.chunks, by="repo"), "terms")

    def files(self) -> DataFrame:
        """path, repo, content of the text files."""
        parts = self.chunks.where(T.is_text_file(F.col("path")) & F.col("content").isNotNull()).groupBy("path", "repo").agg(F.sort_array(F.collect_list(F.struct("start_line", "chunk_id", "content"))).alias("c"))
        return materialise(parts.select("path", "repo", F.array_join(F.transform("c", lambda x: x["content"]), "\n").alias("content")), "files")

    def reading(self) -> DataFrame:
        files = self.files()
        lines = R.grep(files, self.tasks, E.GREP_LINES, by="repo")
        return materialise(E.reading_side(lines, files, self.tasks, self.relevant), "reading")

    def models(self) -> dict[str, E.Adapter]:
        terms = self.terms()
        vectors = Q.chunk_vectors(self.spark, self.sf_dir)
        weights = cache(lambda tasks: R.weigh(terms, tasks, "repo"))  # the same for every configuration

        def words(config: R.Bm25 = R.Bm25()):
            return lambda tasks, k: R.bm25(terms, tasks, k, config, by="repo", weights=weights(tasks))

        def vector(tasks: DataFrame, k: int) -> DataFrame:
            asked = vectors.join(tasks.select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
            return R.cosine(vectors, asked, k).withColumnRenamed("id", "chunk_id")

        return {"bm25": words(), "flat": words(R.Bm25(b=0.0)), "vector": vector}


def _bm25_sql(k: int, b: float, name: str) -> str:
    return f"""{name}_s AS (SELECT repo, count(*) AS n, avg(len(terms)) AS avgdl FROM tm GROUP BY 1), {name}_df AS (SELECT repo, term, count(*) AS df FROM ps GROUP BY 1, 2),
{name}_h AS (SELECT query_id, ps.chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - {b} + {b} * dl / avgdl))), 6) AS score FROM tq JOIN ps USING (repo, term) JOIN {name}_df USING (repo, term) JOIN {name}_s USING (repo) GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_h WHERE score > 0) WHERE rank <= {k})"""


_TEXT = f"(NOT regexp_matches(path, '(^|/)(node_modules|[.]git)(/|$)') AND regexp_extract(lower(regexp_extract(path, '([^/]*)$', 1)), '^.+[.]([^.]*)$', 1) IN ({', '.join(repr(x) for x in T.TEXT_EXTENSIONS)}))"
BASE = f"""ch AS (SELECT DISTINCT chunk_id, repo, repo || '/' || file_path AS path, start_line, symbol_name, content FROM chunks WHERE repo IS NOT NULL AND file_path IS NOT NULL),
tk AS (SELECT chunk_id AS query_id, repo, symbol_name AS text FROM ch WHERE chunk_id % 100 = 0 AND symbol_name IS NOT NULL),
rl AS (SELECT DISTINCT query_id, path AS item FROM tk JOIN ch ON ch.repo = tk.repo AND ch.symbol_name = tk.text WHERE {_TEXT}),
tm AS (SELECT chunk_id, repo, {Q.tokens_sql('content')} AS terms FROM ch WHERE content IS NOT NULL),
ps AS (SELECT repo, term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT repo, chunk_id, len(terms) AS dl, unnest(terms) AS term FROM tm) GROUP BY 1, 2, 3),
tq AS (SELECT DISTINCT query_id, repo, term FROM (SELECT query_id, repo, unnest({Q.tokens_sql('text')}) AS term FROM tk)), {_bm25_sql(10, 0.75, 'bm')}, {_bm25_sql(10, 0.0, 'fl')}"""


def _items(hits: str, k: int) -> str:
    return f"(SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY a) AS rank FROM (SELECT query_id, path AS item, min(rank) AS a FROM {hits} JOIN ch USING (chunk_id) WHERE rank <= {k} GROUP BY 1, 2))"


def _metrics_sql(hits: str, k: int) -> str:
    return f"""(SELECT query_id, round(sum(CASE WHEN rank IS NOT NULL THEN 1 ELSE 0 END) / count(*), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS mrr,
 round(sum(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE / log2(rank + 1.0) ELSE 0 END) / list_sum(list_transform(generate_series(1, least({k}, count(*))), lambda i: 1.0::DOUBLE / log2(i + 1.0))), 12) AS ndcg
 FROM rl LEFT JOIN {_items(hits, k)} x USING (query_id, item) GROUP BY 1)"""


@query(
    f"""WITH {BASE}, s AS (SELECT repo, ndcg FROM tk LEFT JOIN {_metrics_sql('bm', 10)} m USING (query_id))
SELECT repo, round(coalesce(avg(ndcg), 0), 6) AS mean_ndcg, count(ndcg) AS scored, count(*) FILTER (ndcg IS NULL) AS skipped FROM s GROUP BY ROLLUP (repo)"""
)
def ndcg_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean NDCG of word search over each repo's own index, by repo and overall."""
    s = Setting(spark, sf_dir)
    hits = R.bm25(s.terms(), s.tasks, 10, by="repo")
    return E.ndcg_report(E.ranked_items(hits, s.chunks), s.tasks, s.relevant)


_KEYS = Q.KEYWORDS.replace("FROM kq", "FROM (SELECT query_id, text FROM tk)")
READING = f"""{_KEYS}, pt AS (SELECT query_id, repo, string_agg(replace(w, '.', '\\.'), '|' ORDER BY place) AS pattern FROM kw JOIN tk USING (query_id) GROUP BY 1, 2),
fl_ AS (SELECT path, repo, string_agg(content, chr(10) ORDER BY start_line, chunk_id) AS content FROM ch WHERE content IS NOT NULL AND {_TEXT} GROUP BY 1, 2),
ln_ AS (SELECT path, repo, generate_subscripts(p, 1) AS line_no, unnest(p) AS line FROM (SELECT path, repo, string_split(content, chr(10)) AS p FROM fl_)),
gh AS (SELECT query_id, path, line_no, length(line) AS chars, row_number() OVER (PARTITION BY query_id ORDER BY path, line_no) AS rank FROM ln_ JOIN pt ON pt.repo = ln_.repo AND regexp_matches(line, pattern) QUALIFY rank <= 100),
gc AS (SELECT query_id, sum(length(path) + length(line_no::VARCHAR) + chars + 3) AS grep_chars, count(*) AS grep_hits FROM gh GROUP BY 1),
gf AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM gh GROUP BY 1, 2 QUALIFY place <= 3),
gr AS (SELECT gf.query_id, sum(length(content)) AS read_chars, count(*) AS files, bool_or(rl.item IS NOT NULL) AS found FROM gf JOIN fl_ USING (path) LEFT JOIN rl ON rl.query_id = gf.query_id AND rl.item = path GROUP BY 1),
rd AS (SELECT query_id, floor((coalesce(grep_chars, 0) + coalesce(read_chars, 0)) / 4.0::DOUBLE + 0.5)::BIGINT AS tokens, 1 + coalesce(files, 0) AS turns, coalesce(found, false) AS found, coalesce(grep_hits, 0) AS grep_hits FROM tk LEFT JOIN gc USING (query_id) LEFT JOIN gr USING (query_id))"""


def _search_sql(hits: str) -> str:
    return f"""(SELECT tk.query_id, floor(coalesce(chars, 0) / 4.0::DOUBLE + 0.5)::BIGINT AS tokens, 1::BIGINT AS turns, coalesce(found, false) AS found FROM tk LEFT JOIN
(SELECT h.query_id, sum(length(content)) AS chars, bool_or(item IS NOT NULL AND rank <= 3) AS found FROM {hits} h JOIN ch USING (chunk_id) LEFT JOIN rl ON rl.query_id = h.query_id AND rl.item = path WHERE rank <= 5 GROUP BY 1) x USING (query_id))"""


def _results_sql(hits: str) -> str:
    return f"""(SELECT query_id, repo, s.tokens AS search_tokens, s.turns AS search_turns, s.found AS search_found, rd.tokens AS reading_tokens, rd.turns AS reading_turns, rd.found AS reading_found, rd.grep_hits AS reading_grep_hits,
rd.tokens - s.tokens AS saved, round(CASE WHEN rd.tokens > 0 THEN (rd.tokens - s.tokens) / rd.tokens::DOUBLE * 100 ELSE 0 END, 6) AS percent FROM tk JOIN {_search_sql(hits)} s USING (query_id) JOIN rd USING (query_id))"""


def _results(s: Setting) -> DataFrame:
    hits = R.bm25(s.terms(), s.tasks, E.TOP, by="repo")
    return E.task_results(s.tasks, E.search_side(hits, s.chunks, s.tasks, s.relevant), s.reading())


@query(f"WITH {BASE}, {READING} SELECT * FROM {_results_sql('bm')}")
def task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each task costs and finds by one search and by one grep and the files it names."""
    return _results(Setting(spark, sf_dir))


_BOOT = Q._RNG + """, means AS (SELECT name, it, round({stat}, 9) AS m FROM picks JOIN sample USING (name, pos) GROUP BY 1, 2), r AS (SELECT name, m, row_number() OVER (PARTITION BY name ORDER BY m, it) AS rn FROM means),
ci AS (SELECT name, round(max(CASE WHEN rn = 101 THEN m END), 6) AS p05, round(max(CASE WHEN rn = 1001 THEN m END), 6) AS p50, round(max(CASE WHEN rn = 1901 THEN m END), 6) AS p95 FROM r GROUP BY 1)"""
_DRAWS = "draws AS (SELECT name, n, it, j FROM (SELECT name, count(*) AS n, unnest(generate_series(0, 1999)) AS it FROM sample GROUP BY 1), LATERAL (SELECT unnest(generate_series(0, n - 1)) AS j))"


def _boot(rows: str, stat: str, value: str) -> str:
    """metric, value, p05, p50, p95 of the samples of ``rows`` (name, pos, value)."""
    return f"(WITH sample AS ({rows}), {_DRAWS}, {_BOOT.format(stat=stat)} SELECT name, round(({value}), 6) AS value, p05, p50, p95 FROM (SELECT name, {stat} AS st FROM sample GROUP BY 1) JOIN ci USING (name))"


_SAMPLES = " UNION ALL ".join(f"SELECT '{n}' AS name, row_number() OVER (ORDER BY query_id) - 1 AS pos, {c}::DOUBLE AS value FROM tr" for n, c in (("percent", "percent"), ("search_found", "search_found::INT"), ("reading_found", "reading_found::INT")))


@query(
    f"""WITH {BASE}, {READING}, tr AS (SELECT * FROM {_results_sql('bm')}), t AS (SELECT unnest(['tasks', 'search_tokens', 'reading_tokens', 'saved', 'mean_search_turns', 'mean_reading_turns']) AS metric,
 unnest([count(*)::DOUBLE, coalesce(sum(search_tokens), 0)::DOUBLE, coalesce(sum(reading_tokens), 0)::DOUBLE, coalesce(sum(saved), 0)::DOUBLE, round(coalesce(avg(search_turns), 0), 6), round(coalesce(avg(reading_turns), 0), 6)]) AS value FROM tr)
SELECT metric, value, NULL::DOUBLE AS p05, NULL::DOUBLE AS p50, NULL::DOUBLE AS p95 FROM t UNION ALL SELECT 'mean_' || name, value, p05, p50, p95 FROM {_boot(_SAMPLES, 'avg(value)', 'st')}
UNION ALL SELECT 'median_percent', value, p05, p50, p95 FROM {_boot(_SAMPLES.split(' UNION ALL ')[0], 'quantile_cont(value, 0.5)', 'st')}"""
)
def task_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all tasks, with resampled bounds of the means."""
    return E.task_report(materialise(_results(Setting(spark, sf_dir)), "results"))


def _model_sql(name: str, hits: str) -> str:
    return f"SELECT '{name}' AS model, r.query_id, repo, percent AS saved, recall, mrr FROM {_results_sql(hits)} r LEFT JOIN {_metrics_sql(hits, 5)} m ON m.query_id = r.query_id"


_VECTOR_HITS = """vh AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.id AS query_id, x.id AS chunk_id, round(list_inner_product(q.v, x.v), 5) AS score
 FROM cvec q JOIN tk ON tk.query_id = q.id, cvec x) QUALIFY rank <= 5)"""
_CVEC = Q._CHUNK_VECTORS.split(",\ncs AS")[0]
MODELS = f"{BASE}, {READING}, {Q.VECTORS}, {_CVEC}, {_VECTOR_HITS}, ms AS ({_model_sql('bm25', 'bm')} UNION ALL {_model_sql('flat', 'fl')} UNION ALL {_model_sql('vector', 'vh')})"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Setting(spark, sf_dir)
    return E.model_scores(s.models(), s.tasks, s.chunks, s.relevant, s.reading())


@query(f"WITH {MODELS} SELECT * FROM ms")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What word search, word search without lengths, and vectors save and find for each task."""
    return _scores(spark, sf_dir)


_EACH = " UNION ALL ".join(f"SELECT repo || chr(1) || model || chr(1) || '{m}' AS name, row_number() OVER (PARTITION BY repo, model ORDER BY query_id) - 1 AS pos, {m} AS value FROM ms WHERE {m} IS NOT NULL" for m in ("saved", "recall", "mrr"))
_FIELDS = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {f} END) AS {m}_{f}" for m in ("saved", "recall", "mrr") for f in ("mean", "median", "p05", "p50", "p95"))
BENCH = f"""{MODELS}, bs AS (SELECT string_split(name, chr(1))[1] AS repo, string_split(name, chr(1))[2] AS model, string_split(name, chr(1))[3] AS metric, name, value AS mean, p05, p50, p95 FROM {_boot(_EACH, 'avg(value)', 'st')}),
md AS (SELECT name, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM ({_EACH}) GROUP BY 1),
bench AS (SELECT repo, model, coalesce(max(CASE WHEN metric = 'recall' THEN n END), 0) AS scored, {_FIELDS} FROM bs JOIN md USING (name) GROUP BY 1, 2)"""


@query(f"WITH {BENCH} SELECT * FROM bench")
def model_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the three retrievers do in each repo, with resampled bounds."""
    return E.model_bench(_scores(spark, sf_dir))


@query(
    f"""WITH {BENCH}, h AS (SELECT *, bool_or(scored > 0) OVER (PARTITION BY repo) AS have FROM bench), k AS (SELECT repo, model, have, CASE WHEN have THEN coalesce(recall_median, 0) ELSE saved_p05 END AS key, CASE WHEN have THEN coalesce(recall_p05, 0) ELSE saved_p05 END AS lo, CASE WHEN have THEN coalesce(recall_p95, 0) ELSE saved_p95 END AS hi FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY key DESC, CASE WHEN model = 'bm25' THEN 0 ELSE 1 END, model) AS place FROM k)
SELECT a.repo, a.model AS best, b.model AS baseline, CASE WHEN a.have THEN 'recall' ELSE 'saved' END AS by, CASE WHEN a.model = b.model THEN 'best' WHEN a.lo < b.hi AND b.lo < a.hi THEN 'tie' ELSE 'better' END AS verdict FROM o a JOIN o b ON a.repo = b.repo AND a.place = 1 AND b.model = 'bm25'"""
)
def recommended_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which retriever to use in each repo."""
    return E.recommend(materialise(E.model_bench(_scores(spark, sf_dir)), "bench"), "bm25")

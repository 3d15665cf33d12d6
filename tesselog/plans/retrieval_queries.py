"""Retrieval and evaluation queries over the driver's tables, each with its DuckDB twin.

Chunks are the corpus.  The query set of searches is every chunk whose id is
divisible by 100 (its symbol or vector), against all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselog.functions import text as T
from tesselog.functions import vectors as V
from tesselog.operators import code_chunks, index_store
from tesselog.operators import retrieval as R
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


# -- inputs -----------------------------------------------------------------------------------
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "chunks"), "chunk_id")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of the corpus, written once as an index is."""
    scan = table(spark, sf_dir, "chunks").select("chunk_id", "content")
    return materialise(R.index_terms(spread(once(scan, "chunk_id"), scan)), "index")


def symbol_queries(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_id % 100 = 0 and symbol_name is not null").select(F.col("chunk_id").alias("query_id"), F.col("symbol_name").alias("text"))


def _usable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "cached_index").select("vec_id", "chunk_id", "embedding", "created_at"), "vec_id", "created_at").where(V.usable(F.col("embedding"), 64))


def index_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usable_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "chunk_id", V.scaled(F.col("embedding")).alias("v"))


CORPUS = "chunk AS (SELECT DISTINCT * FROM chunks)"


def words_sql(x: str) -> str:
    inner = rf"regexp_replace(regexp_replace({x}, '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '([\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g')"
    return rf"list_transform(regexp_extract_all({inner}, '([\p{{L}}\p{{N}}]+)', 1), lambda w: lower(w))"


def dotted_sql(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)+)', 1), lambda w: lower(w))"


def tokens_sql(x: str) -> str:
    return f"list_concat({dotted_sql(x)}, {words_sql(x)})"


TERMS = f"terms AS (SELECT chunk_id, {tokens_sql('content')} AS terms FROM chunk WHERE content IS NOT NULL)"
POSTS = (
    "doclen AS (SELECT chunk_id, len(terms) AS dl FROM terms), posts AS (SELECT term, chunk_id, count(*) AS tf FROM"
    " (SELECT chunk_id, unnest(terms) AS term FROM terms) GROUP BY 1, 2)"
)
ASKED = "asked AS (SELECT chunk_id AS query_id, symbol_name AS text FROM chunk WHERE chunk_id % 100 = 0 AND symbol_name IS NOT NULL)"


def bm25_sql(k: int, k1: float = 1.2, b: float = 0.75, asked: str = "asked", name: str = "bm") -> str:
    return f"""{name}_q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({tokens_sql('text')}) AS term FROM {asked})),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM doclen),
{name}_df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
{name}_h AS (SELECT query_id, p.chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
 FROM {name}_q q JOIN posts p USING (term) JOIN {name}_df USING (term) JOIN doclen d ON d.chunk_id = p.chunk_id, {name}_s GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_h WHERE score > 0) WHERE rank <= {k})"""


VECTORS = """raw_v AS (SELECT DISTINCT vec_id, chunk_id, embedding FROM cached_index WHERE embedding IS NOT NULL AND len(embedding) = 64),
ok_v AS (SELECT * FROM raw_v WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
vec AS (SELECT vec_id AS id, chunk_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM ok_v)"""


# -- scans, chunking, tokens ------------------------------------------------------------------
@query(
    r"""SELECT language, count(*) AS n FROM (SELECT CASE lower(regexp_extract(regexp_extract(file_path, '([^/\\]*)$', 1), '^.+\.([^.]*)$', 1)) """
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())
    + " END AS language FROM chunks) GROUP BY 1"
)
def language_detect(spark, sf_dir):
    return table(spark, sf_dir, "chunks").groupBy(T.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))


@query(
    r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE regexp_matches(text, '\S')),
l AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS l FROM d),
w AS (SELECT doc_id, l, unnest(generate_series(0, greatest(len(l) - 6, 0), 45)) AS s FROM l)
SELECT doc_id, s + 1 AS start_line, least(s + 50, len(l)) AS end_line, md5(array_to_string(l[s + 1 : s + 50], chr(10))) AS digest FROM w"""
)
def chunk_lines(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(T.windows(F.col("text"))).alias("w"))
    return docs.select("doc_id", F.col("w.start_line").cast("bigint").alias("start_line"), F.col("w.end_line").cast("bigint").alias("end_line"), F.md5("w.content").alias("digest"))


@query(f"WITH {CORPUS}, {TERMS}, {POSTS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posts GROUP BY 1")
def term_statistics(spark, sf_dir):
    return R.document_frequency(R.postings(index(spark, sf_dir)))


@query(f"WITH {CORPUS}, {TERMS}, {POSTS} SELECT p.term, p.chunk_id, tf, dl::BIGINT AS dl FROM posts p JOIN doclen USING (chunk_id)")
def postings(spark, sf_dir):
    return R.postings(index(spark, sf_dir))


@query(f"WITH {CORPUS}, {TERMS} SELECT count(*) AS n, round(avg(len(terms)), 6) AS avgdl FROM terms")
def corpus_stats(spark, sf_dir):
    return R.corpus_stats(index(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT name, count(*) AS n FROM (SELECT unnest({dotted_sql('text')}) AS name FROM documents) GROUP BY 1")
def dotted_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.dotted(F.col("text"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query(
    r"""WITH q AS (SELECT DISTINCT symbol_name AS text FROM chunks WHERE symbol_name IS NOT NULL UNION SELECT DISTINCT content FROM chunks WHERE content IS NOT NULL),
p AS (SELECT text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM q)
SELECT text, t <> '' AND (len(string_split(t, ' ')) = 1 OR (len(string_split(t, ' ')) < 3 AND regexp_matches(t, '_|-|[a-z0-9][A-Z]|[A-Z]+[A-Z][a-z]'))) AS symbol_like FROM p"""
)
def symbol_like(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    texts = chunks.where("symbol_name is not null").select(F.col("symbol_name").alias("text")).union(chunks.where("content is not null").select("content")).distinct()
    return texts.select("text", T.symbol_like(F.col("text")).alias("symbol_like"))


FIRST_SENTENCE = r"""said AS (SELECT DISTINCT message_id, received_at, trim(regexp_replace(content, '\s+', ' ', 'g')) AS f FROM messages WHERE lower(trim(role)) IN ('user', 'human') AND content IS NOT NULL),
sentence AS (SELECT message_id, received_at, trim(substring(CASE WHEN regexp_extract(f, '^[^.?!]{1,200}[.?!]?') = '' THEN f ELSE regexp_extract(f, '^[^.?!]{1,200}[.?!]?') END, 1, 200)) AS q, f FROM said),
sent AS (SELECT message_id, received_at, CASE WHEN f <> '' AND NOT starts_with(f, '[') AND length(q) >= 6 THEN q END AS query FROM sentence)"""


def _sentences(spark, sf_dir):
    m = table(spark, sf_dir, "messages").where("lower(trim(role)) in ('user', 'human') and content is not null")
    return m.select("message_id", "received_at", T.first_sentence(F.col("content")).alias("query")).distinct()


@query(f"WITH {FIRST_SENTENCE} SELECT message_id, query FROM (SELECT DISTINCT * FROM sent)")
def query_extraction(spark, sf_dir):
    return _sentences(spark, sf_dir).select("message_id", "query")


@query(
    rf"""WITH {FIRST_SENTENCE} SELECT message_id, regexp_matches(query, '[A-Z][a-z]+[A-Z][a-z]') OR regexp_matches(query, '\b[a-z]+_[a-z_]+\b') OR
regexp_matches(query, '\b[A-Za-z][A-Za-z0-9]*\.[A-Za-z][A-Za-z0-9]+') OR regexp_matches(query, '(?i)\b({T.CODE_WORDS})\b') AS entity FROM (SELECT DISTINCT * FROM sent) WHERE query IS NOT NULL"""
)
def entity_shaped(spark, sf_dir):
    return _sentences(spark, sf_dir).where("query is not null").select("message_id", T.entity_shaped(F.col("query")).alias("entity"))


_SCORE = "length(w) + CASE WHEN regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]') THEN 5 ELSE 0 END + CASE WHEN contains(w, '_') THEN 4 ELSE 0 END + CASE WHEN contains(w, '.') THEN 4 ELSE 0 END - CASE WHEN regexp_matches(w, '^[a-z]{1,4}$') THEN 2 ELSE 0 END"
KEYWORDS = f"""kw0 AS (SELECT query_id, generate_subscripts(p, 1) AS i, unnest(p) AS w FROM (SELECT query_id, regexp_split_to_array(text, '[^A-Za-z0-9_.]+') AS p FROM kq)),
kw1 AS (SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY {_SCORE} DESC, i) AS r FROM kw0 WHERE length(w) >= 3 AND lower(w) NOT IN ({", ".join(repr(w) for w in T.STOP_WORDS)})),
kw2 AS (SELECT query_id, arg_min(w, r) AS w, min(r) AS r FROM kw1 GROUP BY query_id, lower(w)),
kw AS (SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY r) AS place FROM kw2 QUALIFY place <= 3)"""


@query(f"WITH {FIRST_SENTENCE}, kq AS (SELECT query AS query_id, query AS text FROM sent WHERE query IS NOT NULL GROUP BY 1), {KEYWORDS} SELECT query_id AS query, string_agg(w, '|' ORDER BY place) AS keywords FROM kw GROUP BY 1")
def keyword_extraction(spark, sf_dir):
    asked = _sentences(spark, sf_dir).where("query is not null").select("query").distinct()
    return asked.select("query", F.array_join(T.keywords(F.col("query")), "|").alias("keywords")).where("keywords <> ''")


# -- ranking -------------------------------------------------------------------------------------
_BASE = f"WITH {CORPUS}, {TERMS}, {POSTS}, {ASKED}"


@query(f"{_BASE}, {bm25_sql(10)} SELECT * FROM bm")
def bm25_topk(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    return R.bm25(index(spark, sf_dir), symbol_queries(chunks), 10)


@query(f"{_BASE}, {bm25_sql(10, 1.2, 0)} SELECT * FROM bm")
def bm25_without_length(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    return R.bm25(index(spark, sf_dir), symbol_queries(chunks), 10, R.Bm25(b=0.0))


@query(f"{_BASE}, {bm25_sql(10, 0, 0.75)} SELECT * FROM bm")
def bm25_binary(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    return R.bm25(index(spark, sf_dir), symbol_queries(chunks), 10, R.Bm25(k1=0.0))


def cosine_sql(k: int, name: str = "cs") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
(SELECT q.id AS query_id, x.id, round(list_inner_product(q.v, x.v), 5) AS score FROM vec q, vec x WHERE q.id % 100 = 0)) WHERE rank <= {k})"""


@query(f"WITH {VECTORS}, {cosine_sql(10)} SELECT * FROM cs")
def cosine_topk(spark, sf_dir):
    v = index_vectors(spark, sf_dir)
    return R.cosine(v.select("id", "v"), v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 10)


#: One vector for each chunk (the smallest vec_id), keyed by the chunk.
_CHUNK_VECTORS = """cvec AS (SELECT chunk_id AS id, arg_min(v, vec.id) AS v FROM vec WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
cs AS (SELECT * FROM (SELECT query_id, id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
(SELECT q.id AS query_id, x.id, round(list_inner_product(q.v, x.v), 5) AS score FROM cvec q, cvec x WHERE q.id % 100 = 0)) WHERE rank <= 50)"""


def chunk_vectors(spark, sf_dir):
    """Written once as they are stored, half the size of what is searched, for the query set and each block of it to read."""
    v = _usable_vectors(spark, sf_dir).where("chunk_id is not null").groupBy(F.col("chunk_id").alias("id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return materialise(v, "chunk_vectors").select("id", V.scaled(F.col("embedding")).alias("v"))


@query(
    f"""{_BASE}, {bm25_sql(50)}, {VECTORS}, {_CHUNK_VECTORS}, f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM
(SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT query_id, chunk_id, rank FROM cs) GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, 'hybrid' AS source FROM f) WHERE rank <= 10"""
)
def hybrid_search(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    v = chunk_vectors(spark, sf_dir)
    return R.hybrid(index(spark, sf_dir), symbol_queries(chunks), v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 10)


def _contains_any(x: str, marks) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"


PATH_FACTOR = "(CASE WHEN ends_with(lower(file_path), '.d.ts') THEN 0.6::DOUBLE ELSE 1 END" + "".join(
    f" * CASE WHEN {_contains_any('lower(file_path)', marks)} THEN {factor}::DOUBLE ELSE 1 END" for marks, factor in T.PATH_CLASSES
) + ")"


@query(f"SELECT file_path, round({PATH_FACTOR}, 6) AS factor FROM (SELECT DISTINCT file_path FROM chunks WHERE file_path IS NOT NULL)")
def path_factor(spark, sf_dir):
    return table(spark, sf_dir, "chunks").where("file_path is not null").select("file_path").distinct().select("file_path", F.round(T.path_factor(F.col("file_path")), 6).alias("factor"))


@query(
    rf"""{_BASE}, {bm25_sql(50)},
r AS (SELECT bm.query_id, bm.chunk_id, bm.score, bm.rank, file_path, coalesce(content, '') AS content, {words_sql('text')} AS qt,
 (text <> '' AND (len(string_split(text, ' ')) = 1 OR (len(string_split(text, ' ')) < 3 AND regexp_matches(text, '_|-|[a-z0-9][A-Z]|[A-Z]+[A-Z][a-z]')))) AS sym,
 {words_sql("coalesce(content, '')")} AS ct FROM bm JOIN chunk USING (chunk_id) JOIN asked USING (query_id)),
x AS (SELECT *, CASE WHEN sym AND {_contains_any('lower(content)', T.DEFINITION_WORDS)} AND list_has_any(ct, qt) THEN 1.25::DOUBLE ELSE 1 END AS f_definition,
 CASE WHEN count(*) OVER (PARTITION BY query_id, file_path) >= 2 THEN least(1.25::DOUBLE, 1 + 0.05::DOUBLE * (count(*) OVER (PARTITION BY query_id, file_path) - 1)) ELSE 1 END AS f_multi,
 coalesce({PATH_FACTOR}, 1) AS f_path, least(1.3::DOUBLE, 1 + 0.03::DOUBLE * len(list_filter(qt, lambda t: list_contains(ct, t)))) AS f_stem FROM r),
y AS (SELECT query_id, chunk_id, rank, round(score * f_definition * f_multi * f_path * f_stem, 6) AS score FROM x)
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE WHEN score = 0 THEN rank ELSE chunk_id END) AS rank FROM y) WHERE rank <= 10"""
)
def signals(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    asked = symbol_queries(chunks)
    return R.apply_signals(R.bm25(index(spark, sf_dir), asked, 50), chunks, asked, 10)


@query(
    f"""{_BASE}, {bm25_sql(50)}, s AS (SELECT bm.query_id, bm.chunk_id, round(10.0::DOUBLE * len(list_filter(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9_]+')), lambda w: w <> ''),
 lambda w: contains(lower(coalesce(content, '')), w))) + 1.0::DOUBLE / log2(greatest(8, length(coalesce(content, '')))), 6) AS score FROM bm JOIN chunk USING (chunk_id) JOIN asked USING (query_id))
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"""
)
def rerank(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    asked = symbol_queries(chunks)
    return R.rerank(R.bm25(index(spark, sf_dir), asked, 50), chunks, asked, 10)


def _regions(chunks):
    return chunks.where("chunk_id % 100 = 0 and file_path is not null").selectExpr("chunk_id AS query_id", "repo", "file_path", "start_line", "start_line + 2 AS end_line")


_SEEDS = """region AS (SELECT chunk_id AS query_id, repo, file_path, start_line AS r0, start_line + 2 AS r1 FROM chunk WHERE chunk_id % 100 = 0 AND file_path IS NOT NULL),
seed AS (SELECT query_id, arg_min(c.chunk_id, (start_line, c.chunk_id)) AS seed FROM region r JOIN chunk c ON c.repo = r.repo AND c.file_path = r.file_path AND start_line <= r1 AND coalesce(end_line, start_line) >= r0 GROUP BY 1)"""


@query(
    f"""WITH {CORPUS}, {TERMS}, {POSTS}, {_SEEDS}, asked AS (SELECT query_id, content AS text FROM seed JOIN chunk ON chunk_id = seed WHERE content IS NOT NULL), {bm25_sql(6)}
SELECT * FROM (SELECT bm.query_id, chunk_id, score, row_number() OVER (PARTITION BY bm.query_id ORDER BY score DESC, chunk_id) AS rank FROM bm LEFT JOIN seed ON seed.query_id = bm.query_id AND seed.seed = bm.chunk_id WHERE seed.seed IS NULL) WHERE rank <= 5"""
)
def related_by_words(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    return R.related(chunks, index(spark, sf_dir), _regions(chunks), 5)


@query(
    f"""WITH {CORPUS}, {VECTORS}, {_SEEDS}, cvec AS (SELECT chunk_id AS id, arg_min(v, vec.id) AS v FROM vec WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
h AS (SELECT query_id, seed, x.id AS chunk_id, round(list_inner_product(q.v, x.v), 5) AS score FROM seed JOIN cvec q ON q.id = seed, cvec x),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM h QUALIFY r <= 6)
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM t WHERE chunk_id <> seed) WHERE rank <= 5"""
)
def related_by_vector(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    return R.related(chunks, index(spark, sf_dir), _regions(chunks), 5, chunk_vectors(spark, sf_dir))


# -- embeddings -------------------------------------------------------------------------------
_MOCK = """list_transform(flatten(list_transform(generate_series(0, 7), lambda i: list_transform(generate_series(0, 7), lambda j:
 ('0x' || substring(sha256('mock:' || {x} || ':' || i), (j * 8 + 1)::INT, 8))::BIGINT))), lambda n: (CASE WHEN n >= 2147483648 THEN n - 4294967296 ELSE n END)::DOUBLE / 2147483648.0::DOUBLE)"""
_TERM_VECTORS = f"""tv AS (SELECT term, list_transform(r, lambda x: x / n) AS v FROM (SELECT term, r, sqrt(list_sum(list_transform(r, lambda y: y * y))) AS n FROM (SELECT term, {_MOCK.format(x="term")} AS r FROM (SELECT DISTINCT unnest(terms) AS term FROM terms))))"""


@query(
    f"""SELECT text, i - 1 AS dim, round(r[i] / n, 6) + 0.0 AS value FROM (SELECT text, r, sqrt(list_sum(list_transform(r, lambda y: y * y))) AS n FROM (SELECT text, {_MOCK.format(x='text')} AS r FROM
(SELECT DISTINCT symbol_name AS text FROM chunks WHERE symbol_name IS NOT NULL))), generate_series(1, 64) g(i)"""
)
def mock_embedding(spark, sf_dir):
    names = table(spark, sf_dir, "chunks").where("symbol_name is not null").select(F.col("symbol_name").alias("text")).distinct()
    return names.select("text", F.posexplode(V.hashed_vector(F.col("text"), 64)).alias("dim", "value")).select("text", F.col("dim").cast("bigint").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


@query(
    f"""WITH {CORPUS}, {TERMS}, {_TERM_VECTORS}, e AS (SELECT chunk_id, term, count(*) AS c FROM (SELECT chunk_id, unnest(terms) AS term FROM terms) GROUP BY 1, 2),
m AS (SELECT chunk_id, i, sum(c * tv.v[i]) AS m FROM e JOIN tv USING (term), generate_series(1, 64) g(i) GROUP BY 1, 2), n AS (SELECT chunk_id, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
SELECT chunk_id, i - 1 AS dim, round(m / n, 5) + 0.0 AS value FROM m JOIN n USING (chunk_id)"""
)
def static_embedding(spark, sf_dir):
    """The mean of the vectors of its terms for each chunk; the vectors are made of the terms, as no table is at hand."""
    found = index_store.embed_terms(index(spark, sf_dir), index_store.hashed_lookup(64), 64)
    return found.select("chunk_id", F.posexplode("v").alias("dim", "value")).select("chunk_id", F.col("dim").cast("bigint").alias("dim"), (F.round("value", 5) + 0.0).alias("value"))


# -- index state -------------------------------------------------------------------------------
@query(
    """WITH old AS (SELECT repo, file_path, max(start_line)::BIGINT AS m FROM cached_index WHERE file_path IS NOT NULL GROUP BY 1, 2), new AS (SELECT repo, file_path, max(start_line)::BIGINT AS m FROM chunks WHERE file_path IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(old.repo, new.repo) AS repo, coalesce(old.file_path, new.file_path) AS file_path, CASE WHEN old.m IS NULL THEN 'added' WHEN new.m IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM old FULL JOIN new ON old.repo = new.repo AND old.file_path = new.file_path WHERE old.m IS NULL OR new.m IS NULL OR old.m <> new.m"""
)
def refresh_diff(spark, sf_dir):
    state = lambda t: table(spark, sf_dir, t).where("file_path is not null").groupBy("repo", "file_path").agg(F.max("start_line").cast("bigint").alias("mtime"))
    return index_store.diff(state("cached_index"), state("chunks"), ["repo", "file_path"], "mtime")


@query(
    f"""WITH {CORPUS}, old AS (SELECT DISTINCT sha256(content) AS sig FROM chunk WHERE content IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM cached_index WHERE embedding IS NOT NULL))
SELECT repo, count(*) AS chunks, count(old.sig) AS reused, count(*) - count(old.sig) AS to_embed FROM chunk LEFT JOIN old ON sha256(content) = sig WHERE content IS NOT NULL GROUP BY 1"""
)
def signature_reuse(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    cached = table(spark, sf_dir, "cached_index").where("embedding is not null and chunk_id is not null").groupBy("chunk_id").agg(F.max("embedding").alias("v"))
    old = chunks.join(cached, "chunk_id").select("content", "v")
    plan = index_store.reuse(chunks.select("chunk_id", "repo", "content"), old)
    return plan.groupBy("repo").agg(F.count("*").alias("chunks"), F.count("v").alias("reused"), F.count_if(F.col("v").isNull()).alias("to_embed"))


@query(
    """WITH f AS (SELECT repo, file_path, max(start_line)::BIGINT AS m FROM chunks WHERE file_path IS NOT NULL GROUP BY 1, 2),
p AS (SELECT repo, substring(sha256(file_path), 1, 2) AS part, sha256(string_agg(file_path || ':' || m || chr(10), '' ORDER BY file_path)) AS t FROM f GROUP BY 1, 2)
SELECT repo, 'mtime:' || sha256(string_agg(t, '' ORDER BY part)) AS state FROM p GROUP BY 1"""
)
def state_id(spark, sf_dir):
    files = table(spark, sf_dir, "chunks").where("file_path is not null").groupBy("repo", "file_path").agg(F.max("start_line").cast("bigint").alias("mtime"))
    return index_store.state_ids(files, "repo", "file_path", "mtime")


# -- evaluation --------------------------------------------------------------------------------
_RELEVANT = "rel AS (SELECT DISTINCT a.query_id, c.chunk_id AS item FROM asked a JOIN chunk c ON c.symbol_name = a.text)"


@query(
    f"""{_BASE}, {bm25_sql(10)}, {_RELEVANT}, j AS (SELECT query_id, item, rank FROM rel LEFT JOIN bm ON bm.query_id = rel.query_id AND bm.chunk_id = rel.item),
s AS (SELECT query_id, count(*) AS n, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS hits, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1.0) ELSE 0 END) AS dcg FROM j GROUP BY 1)
SELECT query_id, round(hits / n, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(dcg / list_sum(list_transform(generate_series(1, least(10, n)), lambda i: 1.0::DOUBLE / log2(i + 1.0))), 6) AS ndcg FROM s""".replace("SELECT query_id, item, rank FROM rel", "SELECT rel.query_id, rel.item, rank FROM rel")
)
def retrieval_metrics(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    asked = symbol_queries(chunks)
    return R.label_metrics(R.bm25(index(spark, sf_dir), asked, 10), asked, chunks.select("chunk_id", F.col("symbol_name").alias("label")), 10)


@query(
    """SELECT project_root_source AS source, count(event_count) AS n, round(avg(event_count), 6) AS mean, round(quantile_cont(event_count, 0.5), 6) AS median, round(quantile_cont(event_count, 0.25), 6) AS p25, round(quantile_cont(event_count, 0.95), 6) AS p95
FROM sessions GROUP BY 1"""
)
def percentiles(spark, sf_dir):
    return R.summary(table(spark, sf_dir, "sessions").withColumnRenamed("project_root_source", "source"), "source", "event_count")


_RNG = """s0 AS (SELECT name, it, j, n, ((3083393505 + (((it * n + j) + 1)::HUGEINT * 1831565813)) % 4294967296)::UBIGINT AS a FROM draws),
s1 AS (SELECT *, ((xor(a, a >> 15)::HUGEINT * (a | 1)::HUGEINT) % 4294967296)::UBIGINT AS t FROM s0),
s2 AS (SELECT *, xor(t, ((t::HUGEINT + ((xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % 4294967296)) % 4294967296)::UBIGINT) AS u FROM s1),
picks AS (SELECT name, it, floor(xor(u, u >> 14)::DOUBLE / 4294967296.0::DOUBLE * n)::BIGINT AS pos FROM s2)"""


@query(
    f"""WITH sample AS (SELECT 'input' AS name, row_number() OVER (ORDER BY model) - 1 AS pos, usd_in_mtok AS value FROM model_prices UNION ALL SELECT 'output', row_number() OVER (ORDER BY model) - 1, usd_out_mtok FROM model_prices),
draws AS (SELECT name, n, it, j FROM (SELECT name, count(*) AS n FROM sample GROUP BY 1), generate_series(0, 1999) a(it), generate_series(0, 9) b(j)), {_RNG},
means AS (SELECT name, it, round(sum(value) / 10, 9) AS m FROM picks JOIN sample USING (name, pos) GROUP BY 1, 2),
r AS (SELECT name, m, row_number() OVER (PARTITION BY name ORDER BY m, it) AS rn FROM means)
SELECT name, (SELECT round(avg(value), 6) FROM sample s WHERE s.name = r.name) AS mean, round(max(CASE WHEN rn = 101 THEN m END), 6) AS p05, round(max(CASE WHEN rn = 1001 THEN m END), 6) AS p50, round(max(CASE WHEN rn = 1901 THEN m END), 6) AS p95 FROM r GROUP BY 1"""
)
def bootstrap_ci(spark, sf_dir):
    prices = table(spark, sf_dir, "model_prices")
    both = prices.select("model", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in (("input", "usd_in_mtok"), ("output", "usd_out_mtok"))))).alias("x")).select("model", "x.*")
    from pyspark.sql import Window

    samples = both.withColumn("pos", F.row_number().over(Window.partitionBy("name").orderBy("model")) - 1).select("name", F.col("pos").cast("bigint").alias("pos"), "value")
    return R.bootstrap_mean(samples)


@query(
    f"""WITH {CORPUS}, b AS (SELECT repo AS name, count(*) AS chunks, sum(length(content)) AS chars FROM chunk WHERE kind = 'tree-sitter' GROUP BY 1), c AS (SELECT repo AS name, count(*) AS chunks, sum(length(content)) AS chars FROM chunk GROUP BY 1),
j AS (SELECT b.name, unnest(['chunks', 'chars']) AS metric, unnest([b.chunks, b.chars])::DOUBLE AS before, unnest([c.chunks, c.chars])::DOUBLE AS now, unnest([b.chunks + greatest(b.chunks * 0.01::DOUBLE, 0), b.chars + greatest(b.chars * 0.5::DOUBLE, 100)])::DOUBLE AS allowed FROM b JOIN c USING (name))
SELECT name, metric, before, now, round(allowed, 6) AS allowed FROM j WHERE now > allowed"""
)
def regression_gate(spark, sf_dir):
    chunks = corpus(spark, sf_dir).withColumnRenamed("repo", "name")
    size = lambda df: df.groupBy("name").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
    return R.regressions(size(chunks.where("kind = 'tree-sitter'")), size(chunks), {"chunks": (0.01, 0.0), "chars": (0.5, 100.0)}).withColumn("allowed", F.round("allowed", 6))


@query(f"WITH {CORPUS} SELECT repo, chunk_id, turn FROM (SELECT repo, chunk_id, row_number() OVER (PARTITION BY repo ORDER BY chunk_id) AS turn FROM chunk WHERE symbol_name IS NOT NULL) ORDER BY turn, repo LIMIT 20")
def task_round_robin(spark, sf_dir):
    return R.round_robin(corpus(spark, sf_dir).where("symbol_name is not null").select("repo", "chunk_id"), "repo", "chunk_id", 20)


_GREP = f"""kq AS (SELECT chunk_id AS query_id, symbol_name AS text FROM chunk WHERE chunk_id % 100 = 0 AND symbol_name IS NOT NULL), {KEYWORDS},
pat AS (SELECT query_id, string_agg(replace(w, '.', '\\.'), '|' ORDER BY place) AS pattern FROM kw GROUP BY 1),
ln AS (SELECT path, generate_subscripts(p, 1) AS line_no, unnest(p) AS line FROM (SELECT 'c/' || chunk_id AS path, string_split(content, chr(10)) AS p FROM chunk WHERE content IS NOT NULL)),
hit AS (SELECT query_id, path, line_no, row_number() OVER (PARTITION BY query_id ORDER BY path, line_no) AS rank FROM ln, pat WHERE regexp_matches(line, pattern) QUALIFY rank <= 100)"""


def _grep(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    files = chunks.select(F.concat(F.lit("c/"), F.col("chunk_id").cast("string")).alias("path"), "content")
    return files, R.grep(files, symbol_queries(chunks), 100)


@query(f"WITH {CORPUS}, {_GREP} SELECT query_id, path, line_no::BIGINT AS line_no, rank FROM hit")
def grep_hits(spark, sf_dir):
    return _grep(spark, sf_dir)[1].select("query_id", "path", F.col("line_no").cast("bigint").alias("line_no"), "rank")


@query(
    f"""WITH {CORPUS}, {_GREP}, f AS (SELECT query_id, path, min(rank) AS r, arg_min(line_no, rank) AS line_no FROM hit GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS place FROM f QUALIFY place <= 3)
SELECT query_id, count(*) AS files, sum(floor(octet_length(encode(content)) / 4.0 + 0.5))::BIGINT AS full_tokens,
sum(floor(octet_length(encode(array_to_string(string_split(content, chr(10))[greatest(t.line_no - 15, 1) : greatest(t.line_no - 15, 1) + 29], chr(10)))) / 4.0 + 0.5))::BIGINT AS window_tokens
FROM t JOIN chunk ON 'c/' || chunk_id = path GROUP BY 1"""
)
def grep_token_cost(spark, sf_dir):
    files, hits = _grep(spark, sf_dir)
    return index_store.grep_cost(hits, files, 3, 15)


@query(
    f"WITH {CORPUS} SELECT language, count(DISTINCT repo || '/' || file_path) AS files, count(*) AS chunks, round(avg(CASE WHEN kind = 'tree-sitter' THEN 1.0::DOUBLE ELSE 0 END), 6) AS by_syntax, round(avg(CASE WHEN symbol_name IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS named FROM chunk GROUP BY 1"
)
def chunk_coverage(spark, sf_dir):
    return code_chunks.coverage(corpus(spark, sf_dir).withColumn("path", F.concat("repo", F.lit("/"), "file_path")))


def _source_files(spark, sf_dir):
    """Each distinct content as a file of its own."""
    c = table(spark, sf_dir, "chunks").where("chunk_id is not null and content is not null").groupBy("chunk_id").agg(F.max(F.struct("file_path", "content")).alias("x"))
    return spread(c.select(F.concat(F.col("chunk_id").cast("string"), F.lit("/"), F.coalesce("x.file_path", F.lit(""))).alias("path"), "x.content"))


@query(
    r"""WITH c AS (SELECT chunk_id, max(struct_pack(f := file_path, c := content)) AS x FROM chunks WHERE chunk_id IS NOT NULL AND content IS NOT NULL GROUP BY 1)
SELECT chunk_id || '/' || coalesce(x.f, '') AS path, len(list_filter(string_split(x.c, chr(10)), lambda l: regexp_matches(l, '[^ \t\r\n\f\x0b]')))::BIGINT AS lines FROM c WHERE regexp_matches(x.c, '[^ \t\r\n\f\x0b]')"""
)
def chunked_lines(spark, sf_dir):
    """How many lines that hold something the chunks of each file cover; the twin counts the lines of the files."""
    pieces = code_chunks.chunk_files(_source_files(spark, sf_dir)).select("path", F.explode(F.sequence("start_line", "end_line")).alias("no"), "content", "start_line")
    line = F.get(F.split("content", "\n", -1), (F.col("no") - F.col("start_line")).cast("int"))
    held = pieces.where(line.rlike(r"[^ \t\r\n\f\x0b]")).select("path", "no").distinct()
    return held.groupBy("path").agg(F.count("*").alias("lines"))


def file_chunks(spark, sf_dir):
    """Definitions and line windows of every content, cut by the grammar of its path's language."""
    return code_chunks.chunk_files(_source_files(spark, sf_dir)).select("path", "language", "start_line", "end_line", "kind", "node_type", "symbol_name", F.md5("content").alias("digest"))


QUERIES["file_chunks"] = file_chunks

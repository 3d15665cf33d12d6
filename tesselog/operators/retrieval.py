"""Ranked retrieval: an inverted index with BM25, vectors, fusion, ranking signals, reranking and related chunks.

A batch of queries is the unit: queries(query_id, text) against
chunks(chunk_id, file_path, content).  The queries go to the tasks that read
the chunks, in blocks; of what a query finds only k rows for each task are
shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselog.functions import text as T
from tesselog.session import materialise, ship


@dataclass(frozen=True)
class Bm25:
    """Parameters of the ranking."""

    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Signals:
    """Which factors of ``apply_signals`` are on."""

    definition: bool = True
    multi_chunk: bool = True
    path: bool = True
    stems: bool = True


DEFINITION_FACTOR, PER_CHUNK, CHUNK_CAP, PER_STEM, STEM_CAP = 1.25, 0.05, 1.25, 0.03, 1.3
RRF_K = 60


def index_terms(chunks: DataFrame, keep_dotted: bool = True, by: str | None = None) -> DataFrame:
    """chunk_id, terms, dl (and ``by``) of chunks that have a content."""
    keep = [by] if by else []
    terms = chunks.where("chunk_id is not null and content is not null").select("chunk_id", *keep, T.tokens(F.col("content"), keep_dotted).alias("terms"))
    return terms.withColumn("dl", F.size("terms").cast("bigint"))


def _each(terms: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """chunk_id, dl, term: one row per occurrence; the outer explode keeps Spark from tokenising once more for a filter."""
    return terms.select("chunk_id", *(keep or []), "dl", F.explode_outer("terms").alias("term")).where("term is not null")


def postings(terms: DataFrame) -> DataFrame:
    """term, chunk_id, tf, dl."""
    return _each(terms).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def document_frequency(posts: DataFrame) -> DataFrame:
    """term, df, cf: in how many chunks a term stands, and how often."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return terms.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def top_k(hits: DataFrame, k: int, by: str = "score", tie: str = "chunk_id", group: str = "query_id") -> DataFrame:
    """The k best rows of each group with their rank from 1; equal scores in order of ``tie``."""
    order = Window.partitionBy(group).orderBy(F.desc(by), tie)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Asked:
    """Queries of one corpus as weights of their terms: those of many queries as a matrix, the others as lists of who asks for them."""

    def __init__(self, asked: pa.Table, rows: np.ndarray):
        self.rows, self.n = rows, len(rows)
        part = asked.take(pa.array(rows)).combine_chunks()
        self.avgdl = part.column("avgdl")[0].as_py()
        lists = part.column("terms").chunk(0)
        coded = lists.flatten().dictionary_encode()
        self.vocabulary = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(self.n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        idf = part.column("idf").chunk(0).flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(code, minlength=len(self.vocabulary))
        often = np.argsort(-counts, kind="stable")[:_DENSE]
        often = often[counts[often] * 16 >= self.n]
        self.place = np.full(len(counts), -1)
        self.place[often] = np.arange(len(often))
        at = self.place[code]
        self.matrix = np.zeros((len(often), self.n))
        self.matrix[at[at >= 0], owner[at >= 0]] = idf[at >= 0]
        by_term = np.argsort(code, kind="stable")
        self.owner, self.idf = owner[by_term], idf[by_term]
        self.starts, self.counts = np.cumsum(counts) - counts, counts

    def scores(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, height: int) -> np.ndarray:
        """height x n: the sums over the entries (row, code of a term, weight in that row)."""
        at = self.place[code]
        dense, rare = at >= 0, at < 0
        wide = np.zeros((height, len(self.matrix)))
        wide[row[dense], at[dense]] = weight[dense]
        out = wide @ self.matrix
        counts = self.counts[code[rare]]
        if counts.any():
            index = np.arange(counts.sum()) + np.repeat(self.starts[code[rare]] - (np.cumsum(counts) - counts), counts)
            cell = np.repeat(row[rare] * self.n, counts) + self.owner[index]
            out += np.bincount(cell, np.repeat(weight[rare], counts) * self.idf[index], minlength=out.size).reshape(out.shape)
        return out


def _best_words(asked: pa.Table, k: int, config: Bm25, digits: int):
    names = asked.column("query_id").combine_chunks()
    unit = 10.0**digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes = np.array(asked.column("group").to_pylist(), object)
        corpora = {g: _Asked(asked, np.flatnonzero(homes == g)) for g in sorted(set(homes))}
        floor, floor_id = np.zeros(len(names)), None
        held: tuple = ()
        fresh: list[tuple] = []

        def settle() -> None:
            """Keep the k best of each query, larger scores and smaller ids first, and what others have to pass."""
            nonlocal held, floor_id
            at, ids, score = (np.concatenate(x) for x in zip(*([held] if held else []), *fresh))
            fresh.clear()
            order = np.lexsort((ids, -score, at))
            at, ids, score = at[order], ids[order], score[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < k
            held = at, ids, score = at[keep], ids[keep], score[keep]
            last = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == k - 1)
            floor_id = np.zeros(len(floor), ids.dtype) if floor_id is None else floor_id.astype(ids.dtype)
            floor[at[last]], floor_id[at[last]] = score[last], ids[last]

        for batch in batches:
            for home, corpus in corpora.items():
                part = batch.filter(pc.equal(batch.column("group"), home))
                ids = part.column("chunk_id").to_numpy(zero_copy_only=False)
                ids = ids.astype(str) if ids.dtype == object else ids
                lists, dl = part.column("terms"), part.column("dl").to_numpy(zero_copy_only=False)
                code = pc.fill_null(pc.index_in(lists.flatten(), value_set=corpus.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[code >= 0]
                entry, tf = np.unique(row * len(corpus.vocabulary) + code[code >= 0], return_counts=True)
                row, code = np.divmod(entry, len(corpus.vocabulary))
                weight = tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * dl[row] / corpus.avgdl))
                step = max(1, _CELLS // 2 // corpus.n)
                for first in range(0, len(ids), step):
                    a, b = np.searchsorted(row, (first, first + step))
                    if a == b:
                        continue
                    sums = corpus.scores(row[a:b] - first, code[a:b], weight[a:b], min(step, len(ids) - first))
                    of, q = np.nonzero(sums > np.maximum(floor[corpus.rows] - 2 / unit, 0))
                    at, here, score = corpus.rows[q], ids[first + of], np.floor(sums[of, q] * unit + 0.5) / unit
                    better = score > floor[at]
                    if floor_id is not None:
                        better |= (score > 0) & (score == floor[at]) & (here < floor_id[at])
                    fresh.append((at[better], here[better], score[better]))
                    if sum(len(x[0]) for x in fresh) >= max(1 << 18, len(held[0]) if held else 0):
                        settle()
        if fresh:
            settle()
        if held:
            at, ids, score = held
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(ids.tolist() if ids.dtype.kind == "U" else ids), pa.array(score)], names=["query_id", "chunk_id", "score"])

    return run


def _grouped(rows: DataFrame, by: str | None, *columns) -> DataFrame:
    return rows.select(columns[0], (F.col(by).cast("string") if by else F.lit("")).alias("group"), *columns[1:])


def weigh(terms: DataFrame, queries: DataFrame, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``bm25`` asks for, whatever its configuration: (query_id, same) of the queries, and the weights of the terms of each ``same``."""
    ship(terms.sparkSession)
    chunks = _grouped(terms, by, "chunk_id", "dl", "terms")
    words = F.array_sort(F.array_distinct(T.tokens(F.col("text"), True))).alias("terms")
    asked = _grouped(queries, by, "query_id", words).where("group is not null and size(terms) > 0")
    asked = materialise(asked.withColumn("same", F.sha2(F.to_json(F.struct("group", "terms")), 256)), "asked")
    wanted = materialise(asked.dropDuplicates(["same"]).select("same", "group", F.explode("terms").alias("term")), "wanted")
    # which chunks hold a term is counted before anything is shuffled: a task gives out each term once
    df = streams(chunks).select("group", F.explode_outer(F.array_distinct("terms")).alias("term")).where("term is not null").groupBy("group", "term").agg(F.count("*").alias("df"))
    stats = chunks.groupBy("group").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    known = wanted.join(df, ["group", "term"]).join(stats, "group").select(F.col("same").alias("query_id"), "group", "avgdl", F.struct("term", idf.alias("idf")).alias("x"))
    weights = known.groupBy("query_id", "group").agg(F.first("avgdl").alias("avgdl"), F.collect_list("x").alias("x"))
    return asked.select("query_id", "same"), materialise(weights.select("query_id", "group", "avgdl", F.col("x.term").alias("terms"), F.col("x.idf").alias("idf")), "weights")


def bm25(terms: DataFrame, queries: DataFrame, k: int = 10, config: Bm25 = Bm25(), digits: int = 6, by: str | None = None, weights: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best chunks of each query, scores over 0 only.

    With ``by``, a column of both tables, its values are corpora of their own:
    a query meets only chunks of its value, under their statistics.

    ``weights`` are those of ``weigh`` for the same queries, if at hand.

    Queries of the same terms are scored once.  They go to every task in
    blocks, the chunks stream past them, and k rows of each leave a task, of
    which there is one for each core: no pair of a query and a chunk that shares
    a term with it is ever shuffled, and k rows of each query are kept of a block.
    """
    spark = terms.sparkSession
    chunks = _grouped(terms, by, "chunk_id", "dl", "terms")
    asked, weights = weights or weigh(terms, queries, by)
    size = weights.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    schema = f"query_id string, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"
    found = None
    for block in blocks_of(weights, max(1, min(QUERY_BLOCK, _TERMS * size.n // max(1, size.terms or 0)))):
        if block.num_rows:
            part = streams(chunks).mapInArrow(_best_words(block, k, config, digits), schema)
            part = materialise(top_k(part.withColumn("score", F.round("score", digits)), k), "words")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"{schema}, rank int")
    best = found.withColumnRenamed("query_id", "same")
    return asked.join(best, "same").select("query_id", "chunk_id", "score", "rank")


#: Queries answered by one pass over the rows; a larger query set takes several.
QUERY_BLOCK = 4096
#: Terms of the queries of such a block, and how many of them, those of most queries, are weighed by a matrix product.
_TERMS, _DENSE = 1 << 19, 512
_CELLS = 1 << 21  # scores held at a time


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best_scores(asked: pa.Table, k: int, digits: int, exclude_self: bool):
    names = asked.column("query_id").to_numpy()
    q = _matrix(asked.column("q"))

    def best(at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k best of each query among the rows, larger scores and smaller ids first."""
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        return at[place < k], ids[place < k], score[place < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        floor = np.full(len(q), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("v"))
            for first in range(0, len(v), max(1, _CELLS // len(q))):
                part, here = v[first : first + max(1, _CELLS // len(q))], ids[first : first + max(1, _CELLS // len(q))]
                score = q @ part.T
                score = np.floor(score * 10.0**digits + 0.5) / 10.0**digits
                if exclude_self:
                    score[names[:, None] == here[None, :]] = -np.inf
                m = min(k, len(here))
                floor = np.maximum(floor, np.partition(score, len(here) - m, axis=1)[:, len(here) - m] if m == k else -np.inf)
                at, of = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
                held = best(*(np.concatenate(x) for x in zip(held, (at, here[of], score[at, of]))))
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(names[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "id", "score"])

    return run


def streams(rows: DataFrame) -> DataFrame:
    """``rows`` in at most one partition for each core, so that the rows a search gives out for each task don't grow with the table as well as with the queries."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def blocks_of(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[pa.Table]:
    """The query set (query_id, ...) in Arrow tables of about ``size`` rows, one at a time."""
    n = queries.count()
    blocks = -(-n // size)
    for b in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow() if blocks > 1 else queries.toArrow()


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 5, exclude_self: bool = False) -> DataFrame:
    """query_id, id, score, rank: exact search of a stated query set (query_id, q) against all rows (id, v) of unit vectors.

    The set is taken in blocks of QUERY_BLOCK; each block goes to every task,
    the rows stream past it as matrix products, and k rows of each query leave
    a task, of which there is one for each core; k rows of each are kept of a
    block.
    """
    spark = vectors.sparkSession
    ship(spark)
    ids = vectors.schema["id"].dataType.simpleString()
    name = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {name}, id {ids}, score double"
    found = None
    for block in blocks_of(queries.select("query_id", "q")):
        part = streams(vectors.select("id", "v")).mapInArrow(_best_scores(block, k, digits, exclude_self), schema)
        part = materialise(top_k(part.withColumn("score", F.round("score", digits)), k, tie="id"), "scores")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"{schema}, rank int")


def fuse(lists: list[DataFrame], k: int | None = None, rrf_k: int = RRF_K, digits: int = 8) -> DataFrame:
    """query_id, chunk_id, score, rank: reciprocal rank fusion of lists (query_id, chunk_id, rank); an id that stands twice in a list counts twice."""
    every = lists[0].select("query_id", "chunk_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "chunk_id", "rank"))
    fused = every.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), digits).alias("score"))
    return top_k(fused, k if k is not None else 2**31 - 1)


def _holds(ids: pa.ChunkedArray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.is_in(batch.column("chunk_id"), value_set=ids.combine_chunks()))

    return run


def among(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of chunks (chunk_id, ...) that ``hits`` can meet: up to HIT_IDS ids go to the tasks that read the chunks, with more all rows stay."""
    ship(chunks.sparkSession)
    ids = hits.select("chunk_id").distinct().limit(HIT_IDS + 1).toArrow().column("chunk_id")
    return chunks if len(ids) > HIT_IDS else chunks.mapInArrow(_holds(ids), chunks.schema)


#: Ids of hits that are sent to the tasks; with more of them all contents are shuffled to the hits.
HIT_IDS = 1 << 22


def factors(hits: DataFrame, chunks: DataFrame, queries: DataFrame, config: Signals = Signals()) -> DataFrame:
    """Hits (query_id, chunk_id, score, rank) with the four factors as columns; hits without a chunk are dropped.

    Hits are written first, so their size is known where they meet the
    contents; contents that none of them names are left where they are read.
    """
    hits = materialise(hits, "hits")
    text = queries.select("query_id", T.words(F.col("text")).alias("q_terms"), T.symbol_like(F.col("text")).alias("q_symbol"))
    known = among(chunks.select("chunk_id", "file_path", F.coalesce("content", F.lit("")).alias("content")), hits)
    rows = hits.join(known, "chunk_id").join(text, "query_id").withColumn("c_terms", F.array_distinct(T.words(F.col("content"))))
    one = F.lit(1.0)
    n = F.count("*").over(Window.partitionBy("query_id", "file_path"))
    stems = F.size(F.filter("q_terms", lambda t: F.array_contains("c_terms", t)))
    shared = F.arrays_overlap("c_terms", "q_terms")
    return rows.withColumns(
        {
            "f_definition": F.when(F.col("q_symbol") & T.has_definition(F.col("content")) & shared, DEFINITION_FACTOR).otherwise(1.0) if config.definition else one,
            "f_multi": F.when(n >= 2, F.least(F.lit(CHUNK_CAP), 1 + PER_CHUNK * (n - 1))).otherwise(1.0) if config.multi_chunk else one,
            "f_path": F.coalesce(T.path_factor(F.col("file_path")), one) if config.path else one,
            "f_stem": F.least(F.lit(STEM_CAP), 1 + PER_STEM * stems) if config.stems else one,
        }
    ).drop("q_terms", "c_terms", "content")


def apply_signals(hits: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 10, config: Signals = Signals(), digits: int = 6) -> DataFrame:
    """Re-scored and re-ranked hits; zero scores keep the order they had, other ties go by id."""
    scored = factors(hits, chunks, queries, config).withColumn("new", F.round(F.col("score") * F.col("f_definition") * F.col("f_multi") * F.col("f_path") * F.col("f_stem"), digits))
    tie = F.when(F.col("new") == 0, F.col("rank")).otherwise(F.col("chunk_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("new"), tie)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "chunk_id", F.col("new").alias("score"), F.col("place").alias("rank"))


def mock_relevance(query: Column, document: Column) -> Column:
    """A cheap stand-in for a cross-encoder: ten for each distinct query word in the document, and a little for brevity."""
    asked = F.filter(F.array_distinct(F.split(F.lower(query), "[^a-z0-9_]+")), lambda w: w != "")
    low = F.lower(document)
    return 10.0 * F.size(F.filter(asked, lambda w: F.contains(low, w))) + 1.0 / F.log2(F.greatest(F.lit(8), F.length(document)))


def rerank(hits: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 10, top_n: int = 50, relevance=mock_relevance, digits: int = 6) -> DataFrame:
    """The best ``top_n`` hits of each query re-sorted by ``relevance(query, content)``, cut to k; each pair is scored once."""
    hits = materialise(hits.where(F.col("rank") <= top_n), "hits")
    first = hits.join(among(chunks.select("chunk_id", "content"), hits), "chunk_id").join(queries.select("query_id", "text"), "query_id")
    scored = first.select("query_id", "chunk_id", F.round(relevance(F.col("text"), F.coalesce("content", F.lit(""))), digits).alias("score"))
    return top_k(scored, k)


def seeds(chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """query_id, chunk_id: for each region (query_id, repo, file_path, start_line, end_line) the first chunk of that file that overlaps it."""
    c = chunks.select("repo", "file_path", "chunk_id", F.col("start_line").alias("c0"), F.coalesce("end_line", "start_line").alias("c1"))
    both = regions.join(c, ["repo", "file_path"]).where("c0 <= end_line and c1 >= start_line")
    return both.groupBy("query_id").agg(F.min(F.struct("c0", "chunk_id")).alias("m")).select("query_id", F.col("m.chunk_id").alias("chunk_id"))


def related(chunks: DataFrame, terms: DataFrame, regions: DataFrame, k: int = 5, vectors: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: chunks like the seed of each region, the seed left out.

    By the seed's vector where ``vectors`` (id, v) are given, else by BM25 over its content.
    """
    found = materialise(seeds(chunks, regions), "seeds")
    if vectors is not None:
        asked = found.join(vectors.select(F.col("id").alias("chunk_id"), F.col("v").alias("q")), "chunk_id")
        hits = cosine(vectors, asked.select("query_id", "q"), k + 1).withColumnRenamed("id", "chunk_id")
    else:
        asked = found.join(chunks.select("chunk_id", F.col("content").alias("text")), "chunk_id").where("text is not null")
        hits = bm25(terms, asked.select("query_id", "text"), k + 1)
    return top_k(hits.drop("rank").join(found, ["query_id", "chunk_id"], "left_anti"), k)


def hybrid(terms: DataFrame, queries: DataFrame, vectors: DataFrame | None, query_vectors: DataFrame | None, k: int = 10, depth: int | None = None) -> DataFrame:
    """BM25 and cosine lists of ``depth`` (max(50, 5 k)) fused; without vectors the BM25 list alone."""
    depth = depth or max(50, 5 * k)
    words = bm25(terms, queries, depth)
    if vectors is None or query_vectors is None:
        return words.where(F.col("rank") <= k).withColumn("source", F.lit("bm25"))
    near = cosine(vectors, query_vectors, depth).withColumnRenamed("id", "chunk_id")
    return fuse([words, near], k).withColumn("source", F.lit("hybrid"))


# -- evaluation -------------------------------------------------------------------------------
def first_ranks(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, item, rank of each relevant item (query_id, item); null where ranked (query_id, item, rank) lacks it."""
    best = ranked.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    return relevant.select("query_id", "item").distinct().join(best, ["query_id", "item"], "left")


def _gains(k: int) -> list[Column]:
    hit = F.col("rank") <= k
    return [
        F.sum(F.when(hit, 1).otherwise(0)).alias("hits"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    ]


def _rated(sums: DataFrame, k: int, digits: int) -> DataFrame:
    """query_id, recall, mrr, ndcg of (query_id, n, hits, first, dcg)."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return sums.select(
        "query_id",
        F.round(F.col("hits") / F.col("n"), digits).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), digits).alias("mrr"),
        F.round(F.col("dcg") / ideal, digits).alias("ndcg"),
    )


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """query_id, recall, mrr, ndcg at k with binary gains."""
    ranks = first_ranks(ranked, relevant)
    return _rated(ranks.groupBy("query_id").agg(F.count("*").alias("n"), *_gains(k)), k, digits)


def label_metrics(ranked: DataFrame, queries: DataFrame, items: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """``metrics`` where the relevant items (chunk_id, label), each there once, are those whose label is the text of the query (query_id, text).

    How many these are is counted for each label, and only what is ranked up to
    k brings its label: no pair of a query and a relevant item is listed.
    """
    best = materialise(ranked.where(F.col("rank") <= k).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank")), "ranked")
    asked = queries.select("query_id", F.col("text").alias("label"))
    hits = best.join(among(items.select("chunk_id", "label"), best), "chunk_id").join(asked, ["query_id", "label"])
    sums = hits.groupBy("query_id").agg(*_gains(k))
    full = asked.join(items.where("label is not null").groupBy("label").agg(F.count("*").alias("n")), "label").join(sums, "query_id", "left")
    return _rated(full.fillna({"hits": 0, "dcg": 0.0}), k, digits)


def random_index(i: Column, n: Column | int, seed: int = 0xB7C8D9E1) -> Column:
    """The i-th draw (from 0) of the mulberry32 generator as an index below n; any draw without the ones before it."""
    mask = F.lit(0xFFFFFFFF)

    def times(a: Column, b: Column) -> Column:  # 32-bit product of unsigned values without overflow of 64 bits
        low = (a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(mask)
        high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
        return (low + high).bitwiseAND(mask)

    s = (F.lit(seed) + (i.cast("bigint") + 1).bitwiseAND(mask) * F.lit(0x6D2B79F5)).bitwiseAND(mask)
    t = times(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask))
    t = t.bitwiseXOR(F.shiftrightunsigned(t, 14))
    return F.floor(t / F.lit(float(2**32)) * n).cast("bigint")


Statistic = Callable[[Column], Column]


#: Statistics that are taken in the tasks that draw; any other one is taken of the drawn rows.
_DIRECT = {F.avg: np.mean, F.median: np.median}
_BOUNDS = (0.05, 0.5, 0.95)


def _drawn(first: int, last: int, n: int, seed: int = 0xB7C8D9E1) -> np.ndarray:
    """(last - first) x n: what ``random_index`` draws in the iterations first .. last - 1."""
    i = (np.arange(first * n, last * n, dtype=np.uint64) + np.uint64(1)).astype(np.uint32)
    s = np.uint32(seed) + i * np.uint32(0x6D2B79F5)
    t = (s ^ (s >> np.uint32(15))) * (s | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    t ^= t >> np.uint32(14)
    return np.floor(t / 2.0**32 * n).astype(np.int64).reshape(last - first, n)


def _resampled(statistic, iterations: int):
    def bounds(values: pa.Array) -> list[float | None]:
        known, v, n = values.is_valid().to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False).astype(np.float64), len(values)
        found: list = []
        for first in range(0, iterations, max(1, _CELLS // 2 // n)):
            at = _drawn(first, min(iterations, first + max(1, _CELLS // 2 // n)), n)
            if known.all():
                found.append(statistic(v[at], axis=1))
            else:
                found.append(np.array([statistic(v[x][known[x]]) for x in at if known[x].any()], np.float64))
        m = np.sort(np.concatenate(found))
        none = iterations - len(m)  # resamples without a value come first
        return [None if math.floor(iterations * p) < none else float(m[math.floor(iterations * p) - none]) for p in _BOUNDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [bounds(x.values) for x in batch.column("sample")]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(_BOUNDS))]
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("value"), *columns], names=["name", "value", "p05", "p50", "p95"])

    return run


def bootstrap(samples: DataFrame, statistic: Statistic = F.avg, iterations: int = 2000, digits: int = 6) -> DataFrame:
    """name, value, p05, p50, p95: a statistic of each group of samples (name, pos from 0, value), and of its resamples.

    ``statistic`` is any aggregate of a column: F.avg, F.median, a grouped
    Pandas function.  Draw j of iteration i is draw i * n + j of the generator,
    computed from its number alone.  F.avg and F.median are taken where a
    group's sample is drawn from, and only the bounds leave a task; any other
    statistic is taken of rows, one for each draw, the sample joined by position.
    """
    if statistic in _DIRECT:
        ship(samples.sparkSession)
        held = samples.groupBy("name").agg(statistic(F.col("value")).cast("double").alias("value"), F.sort_array(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("v")))).alias("x"))
        # few bytes, much work: dealt to all cores, which the number of bytes would not call for
        held = held.select("name", "value", F.col("x.v").alias("sample")).repartition(samples.sparkSession.sparkContext.defaultParallelism, "name")
        out = held.mapInArrow(_resampled(_DIRECT[statistic], iterations), "name string, value double, p05 double, p50 double, p95 double")
        return out.select("name", F.round("value", digits).alias("value"), *(F.round(F.round(c, 9), digits).alias(c) for c in ("p05", "p50", "p95")))
    sizes = samples.groupBy("name").agg(F.count("*").alias("n"))
    rounds = sizes.select("name", "n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("it"))
    # few bytes, much work: dealt to all cores, which the number of bytes would not call for
    rounds = rounds.repartition(samples.sparkSession.sparkContext.defaultParallelism, "name", "it")
    draws = rounds.select("name", "n", "it", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("j"))
    picked = draws.select("name", "n", "it", random_index(F.col("it") * F.col("n") + F.col("j"), F.col("n")).alias("pos")).join(samples, ["name", "pos"])
    stats = picked.groupBy("name", "it").agg(statistic(F.col("value")).alias("m")).withColumn("m", F.round("m", 9))
    place = F.row_number().over(Window.partitionBy("name").orderBy("m", "it"))
    at = lambda p: F.max(F.when(F.col("rn") == math.floor(iterations * p) + 1, F.col("m")))
    ci = stats.withColumn("rn", place).groupBy("name").agg(*(F.round(at(p), digits).alias(f"p{int(p * 100):02d}") for p in (0.05, 0.5, 0.95)))
    whole = samples.groupBy("name").agg(statistic(F.col("value")).alias("value"))
    return whole.withColumn("value", F.round("value", digits)).join(ci, "name")


def bootstrap_mean(samples: DataFrame, iterations: int = 2000, digits: int = 6) -> DataFrame:
    """name, mean, p05, p50, p95 of the resampled mean."""
    return bootstrap(samples, F.avg, iterations, digits).withColumnRenamed("value", "mean")


def summary(values: DataFrame, group: str, value: str, digits: int = 6) -> DataFrame:
    """n, mean, median and quartiles by linear interpolation."""
    p = lambda q: F.round(F.expr(f"percentile({value}, {q})"), digits)
    return values.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), p(0.5).alias("median"), p(0.25).alias("p25"), p(0.95).alias("p95"))


def regressions(baseline: DataFrame, current: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """name, metric, before, now, allowed of each metric that grew by more than its (share, floor) allows; names missing on a side are skipped."""
    both = baseline.alias("a").join(current.alias("b"), "name")
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"a.{m}").cast("double").alias("before"),
            F.col(f"b.{m}").cast("double").alias("now"),
            (F.col(f"a.{m}") + F.greatest(F.col(f"a.{m}") * share, F.lit(floor))).cast("double").alias("allowed"),
        )
        for m, (share, floor) in limits.items()
    ]
    return both.select("name", F.explode(F.array(*rows)).alias("r")).select("name", "r.*").where("now > allowed")


def round_robin(tasks: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` tasks taken in turn from the groups in order of their names."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return tasks.withColumn("turn", turn).orderBy("turn", group).limit(limit)


def _grep(asked: pa.Table, most: int):
    names, words, groups = (asked.column(c).to_pylist() for c in ("query_id", "k", "group"))
    of: dict[str, list[int]] = {}
    for i, ws in enumerate(words):
        for w in ws:
            of.setdefault(w, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for w, queries in of.items():
            automaton.add_word(w, queries)
        automaton.make_automaton()
        for batch in batches:
            taken = [0] * len(names)
            rows: list[tuple] = []
            paths, texts, homes = (batch.column(c).to_pylist() for c in ("path", "content", "group"))
            for i in sorted(range(len(paths)), key=paths.__getitem__):
                found = [(q, at) for at, queries in automaton.iter(texts[i]) for q in queries if taken[q] < most and groups[q] == homes[i]]
                if not found:
                    continue
                ends = [m.start() for m in _FEED.finditer(texts[i])] + [len(texts[i])]
                for q, no in sorted({(q, bisect_left(ends, at)) for q, at in found}):
                    if taken[q] < most:
                        taken[q] += 1
                        rows.append((names[q], paths[i], no + 1, ends[no] - (ends[no - 1] + 1 if no else 0)))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (asked.schema.field("query_id").type, pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "path", "line_no", "chars"])

    return run


_FEED = re.compile("\n")


def grep(files: DataFrame, queries: DataFrame, most: int = 100, by: str | None = None) -> DataFrame:
    """query_id, path, line_no, chars, rank of the first ``most`` lines, by path and line, that hold a keyword of the query (case counts).

    A stated query set in blocks against all files: each file is read once past
    one automaton of all keywords of the block, and at most ``most`` lines for
    each query and batch leave a task.  With ``by``, a column of both tables, a
    query reads only files of its value.
    """
    spark = files.sparkSession
    ship(spark)
    group = (F.col(by).cast("string") if by else F.lit("")).alias("group")
    asked = queries.select("query_id", T.keywords(F.col("text")).alias("k"), group).where(F.size("k") > 0)
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, path string, line_no int, chars int"
    found = None
    for block in blocks_of(asked):
        part = materialise(files.where("content is not null and path is not null").select("path", "content", group).mapInArrow(_grep(block, most), schema), "grep")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy("path", "line_no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

"""The search facade: build an index over a source tree or a table of chunks, query it in batches, keep it fresh."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselog.functions import text as T
from tesselog.functions import vectors as V
from tesselog.operators import code_chunks, index_store
from tesselog.operators import retrieval as R
from tesselog.session import materialise
from tesselog.sources import repo_files

#: A provider turns a text column into a column of unit vectors (array<float> or array<double>).
Provider = Callable[[Column], Column]
#: Told each phase of a build (walked, chunked, cached, embedded) with the number of its rows.
Progress = Callable[[str, int], None]


def hashed_provider(dim: int = 64) -> Provider:
    """Vectors made of the texts themselves, for tests and as a stand-in."""
    return lambda text: V.hashed_vector(text, dim)


class Models:
    """Providers by name; a name with a known prefix (``hf:owner/model``) is built by the factory of that prefix."""

    def __init__(self) -> None:
        self._entries: dict[str, tuple[Callable[[], Provider] | None, dict]] = {}
        self._prefixes: dict[str, Callable[[str], Provider]] = {}
        self.add("bm25", None, kind="bm25", cold_start_min=0.0)
        self.add("hashed", hashed_provider, kind="embed", cold_start_min=0.0)

    def add(self, name: str, factory: Callable[[], Provider] | None, **about) -> None:
        self._entries[name] = (factory, about)

    def add_prefix(self, prefix: str, factory: Callable[[str], Provider]) -> None:
        self._prefixes[prefix] = factory

    def provider(self, name: str) -> Provider | None:
        """The provider of a model, None for word search; an unknown name is an error."""
        if name in self._entries:
            factory = self._entries[name][0]
            return factory() if factory else None
        for prefix, build in self._prefixes.items():
            if name.startswith(prefix) and len(name) > len(prefix):
                return build(name[len(prefix) :])
        raise ValueError(f"no model is called {name!r}")

    def listed(self) -> list[str]:
        """Names in display order: word search first, then the fastest to start."""
        about = lambda n: self._entries[n][1]
        return sorted(self._entries, key=lambda n: (about(n).get("kind") != "bm25", about(n).get("cold_start_min", 0.0)))


class Config:
    """Settings as a JSON file, replaced whole; a missing or damaged one counts as empty."""

    KEYS = ("embedder",)

    def __init__(self, path: str):
        self.path = path

    def load(self) -> dict[str, str]:
        try:
            with open(self.path, encoding="utf-8") as f:
                got = json.load(f)
        except (OSError, ValueError):
            return {}
        return {k: v for k, v in got.items() if k in self.KEYS and isinstance(v, str)} if isinstance(got, dict) else {}

    def save(self, **values: str) -> None:
        wrong = set(values) - set(self.KEYS)
        if wrong:
            raise ValueError(f"unknown settings: {', '.join(sorted(wrong))}")
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        own = f"{self.path}.{os.getpid()}"
        with open(own, "w", encoding="utf-8") as f:
            json.dump(values, f, indent=2)
        os.replace(own, self.path)


def _whole(name: str, value: int, least: int, most: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least or most is not None and value > most:
        raise ValueError(f"{name} must be a whole number from {least}" + (f" to {most}" if most is not None else " on"))
    return value


@dataclass(frozen=True)
class Refresh:
    added: int
    modified: int
    removed: int
    embeds_recomputed: int


def _signed(chunks: DataFrame) -> DataFrame:
    """Chunks with an id made of what they are, so that unchanged ones keep theirs."""
    return chunks.withColumn("chunk_id", F.xxhash64("path", "start_line", "end_line", F.sha2("content", 256)))


class SearchIndex:
    """Tables files(path, mtime_ms), chunks(chunk_id, path, start_line, ...), terms and, with a provider, vectors.

    Queries come as a table (query_id, text); results are (query_id, chunk_id,
    score, rank, source).
    """

    def __init__(
        self, spark: SparkSession, root: str, files: DataFrame, chunks: DataFrame, vectors: DataFrame | None, provider: Provider | None, options: dict, terms: DataFrame | None = None, cache_hit: bool = False
    ):
        self.spark, self.root, self.files, self.provider, self.options = spark, root, files, provider, options
        self.chunks, self.vectors, self.cache_hit = chunks, vectors, cache_hit
        self.terms = terms if terms is not None else materialise(R.index_terms(chunks), "terms")

    @classmethod
    def build(
        cls, spark: SparkSession, root: str, provider: Provider | None = None, embed_filter: Column | None = None, store: index_store.IndexStore | None = None, model: str = "", progress: Progress | None = None, **walk
    ) -> SearchIndex:
        """Walk, read, chunk, tokenise and embed a tree; ``embed_filter`` says which chunks get vectors (code outside of tests).

        With a ``store`` the index of the same state of the tree, and of the
        same ``model`` where there is a provider, is loaded instead, and a new
        one is kept.  The state is the one git tells, else that of all files'
        times.
        """
        tell = progress or (lambda phase, n: None)
        options = {"embed_filter": embed_filter, "walk": walk}
        found = materialise(repo_files.walk(spark, root, **walk), "found")
        tell("walked", found.where("kind = 'file'").count())
        state = cls._state(root, found) + (f"+{model}" if provider else "") if store else ""
        kept = store.load(os.path.realpath(root), state) if store else None
        if kept is not None and {"files", "chunks", "terms", *(["vectors"] if provider else [])} <= set(kept):
            tell("cached", kept["chunks"].count())
            return cls(spark, root, kept["files"], kept["chunks"], kept.get("vectors") if provider else None, provider, options, kept["terms"], cache_hit=True)
        listed = materialise(repo_files.text_files(repo_files.read_files(found.where("kind = 'file'"), root)), "files")
        chunks = materialise(_signed(code_chunks.chunk_files(listed)), "chunks")
        tell("chunked", chunks.count())
        vectors = None
        if provider:
            vectors, n = cls._embed(chunks, provider, embed_filter, None)
            tell("embedded", n)
        index = cls(spark, root, listed.select("path", "mtime_ms"), chunks, vectors, provider, options)
        if store:
            tables = {"files": index.files, "chunks": chunks, "terms": index.terms} | ({"vectors": vectors} if provider else {})
            store.save(os.path.realpath(root), state, tables)
        return index

    @staticmethod
    def _state(root: str, found: DataFrame) -> str:
        known = index_store.git_state(root)
        if known:
            return known
        files = found.where("kind = 'file'").select(F.lit("").alias("repo"), "path", F.round("mtime_ms").cast("bigint").alias("mtime"))
        rows = index_store.state_ids(files, "repo", "path", "mtime").collect()
        return rows[0].state if rows else "empty"

    @staticmethod
    def _embed(chunks: DataFrame, provider: Provider, embed_filter: Column | None, old: DataFrame | None) -> tuple[DataFrame, int]:
        wanted = chunks.where(embed_filter if embed_filter is not None else F.col("language").isNotNull() & (T.path_factor(F.concat(F.lit("/"), F.col("path"))) >= 0.6))
        wanted = wanted.select("chunk_id", "content")
        if old is None:
            rows = wanted.withColumn("v", F.lit(None).cast("array<double>"))
        else:
            rows = index_store.reuse(wanted, old)
        rows = materialise(rows, "to_embed")
        fresh = rows.where("v is null").select(F.col("chunk_id").alias("id"), "content", provider(F.col("content")).cast("array<double>").alias("v"))
        kept = rows.where("v is not null").select(F.col("chunk_id").alias("id"), "content", "v")
        return materialise(kept.unionByName(fresh), "vectors"), rows.where("v is null").count()

    def size(self) -> int:
        return self.chunks.count()

    @property
    def has_embeddings(self) -> bool:
        return self.vectors is not None

    def _named(self) -> DataFrame:
        return self.chunks.select("chunk_id", F.concat(F.lit("/"), F.col("path")).alias("file_path"), "content")

    def _finish(self, hits: DataFrame, queries: DataFrame, k: int, signals: bool, rerank, top_n: int, source: str) -> DataFrame:
        if rerank is not None:
            hits = R.rerank(hits, self.chunks, queries, k, top_n, rerank)
        elif signals:
            hits = R.apply_signals(hits, self._named(), queries, k)
        return hits.where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank", F.lit(source).alias("source"))

    def search(self, queries: DataFrame, k: int = 10, signals: bool = True, rerank=None, top_n: int = 50) -> DataFrame:
        """BM25, by default with ranking signals; ``rerank`` (query, content -> score) sees the best ``top_n`` only."""
        _whole("k", k, 1), _whole("top_n", top_n, 1)
        return self._finish(R.bm25(self.terms, queries, max(top_n, 5 * k)), queries, k, signals, rerank, top_n, "bm25")

    def search_hybrid(self, queries: DataFrame, k: int = 10, signals: bool = False, rerank=None, top_n: int = 50) -> DataFrame:
        """BM25 and vectors fused; without a provider the same as ``search`` without its signals."""
        _whole("k", k, 1), _whole("top_n", top_n, 1)
        if not self.has_embeddings:
            return self.search(queries, k, signals, rerank, top_n)
        asked = queries.select("query_id", self.provider(F.col("text")).cast("array<double>").alias("q"))
        depth = max(top_n, 5 * k)
        hits = R.hybrid(self.terms, queries, self.vectors.select("id", "v"), asked, depth, depth).drop("source")
        return self._finish(hits, queries, k, signals, rerank, top_n, "hybrid")

    def find_related(self, regions: DataFrame, k: int = 5) -> DataFrame:
        """Chunks like the first one that overlaps each region (query_id, file_path, start_line, end_line)."""
        _whole("k", k, 1)
        wrong = regions.where("start_line < 1 or end_line < start_line or start_line is null or end_line is null").limit(1).collect()
        if wrong:
            raise ValueError(f"no region of lines: {wrong[0].start_line} to {wrong[0].end_line}")
        here = self.chunks.select(F.lit("").alias("repo"), F.col("path").alias("file_path"), "chunk_id", "start_line", "end_line", "content")
        vectors = self.vectors.select("id", "v") if self.has_embeddings else None
        return R.related(here, self.terms, regions.withColumn("repo", F.lit("")), k, vectors)

    def refresh(self) -> tuple[SearchIndex, Refresh]:
        """An index of the tree as it is now, and what changed; only changed files are read, only new content is embedded."""
        found = repo_files.walk(self.spark, self.root, **self.options["walk"])
        now = materialise(found.where("kind = 'file'").select("path", "mtime_ms"), "now")
        change = materialise(index_store.diff(self.files, now, ["path"], "mtime_ms"), "change")
        read = materialise(repo_files.text_files(repo_files.read_files(change.where("change <> 'removed'").join(now, "path").withColumn("size", F.lit(None).cast("bigint")), self.root)), "changed")
        # binaries among the changed files count as no file, as they did before
        known = change.join(read.select("path"), "path", "left_semi").unionByName(change.join(self.files.select("path"), "path", "left_semi").where("change = 'removed'"))
        counts = {r["change"]: r["count"] for r in known.groupBy("change").count().collect()}
        fresh = _signed(code_chunks.chunk_files(read))
        chunks = materialise(self.chunks.join(change.select("path"), "path", "left_anti").unionByName(fresh), "chunks")
        vectors, embeds = self.vectors, 0
        if self.provider:
            old = self.vectors.select("content", "v")
            vectors, embeds = self._embed(chunks, self.provider, self.options["embed_filter"], old)
        files = materialise(self.files.join(change.select("path"), "path", "left_anti").unionByName(read.select("path", "mtime_ms")), "files")
        index = SearchIndex(self.spark, self.root, files, chunks, vectors, self.provider, self.options)
        return index, Refresh(counts.get("added", 0), counts.get("modified", 0), counts.get("removed", 0), embeds)

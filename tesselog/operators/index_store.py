"""State of an index: what changed, what can be reused, where it is stored, and what a search without it costs."""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselog.functions import vectors as V
from tesselog.session import ship

FORMAT_VERSION = 3


def diff(old: DataFrame, new: DataFrame, keys: list[str], mtime: str) -> DataFrame:
    """keys, change: added, removed and modified files; unchanged ones are left out."""
    a = old.select(*keys, F.col(mtime).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*keys, F.col(mtime).alias("_new"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return a.join(b, keys, "full_outer").withColumn("change", change).where("change is not null").select(*keys, "change")


def reuse(chunks: DataFrame, old: DataFrame) -> DataFrame:
    """chunks (with content) and ``v``: the vector of equal content in old (content, v), null where one must be computed."""
    known = old.groupBy(F.sha2("content", 256).alias("sig")).agg(F.max("v").alias("v"))
    return chunks.where("content is not null").withColumn("sig", F.sha2("content", 256)).join(known, "sig", "left").drop("sig")


def state_ids(files: DataFrame, group: str, path: str, mtime: str) -> DataFrame:
    """group, state: a digest of all paths and times of a group.

    Files are dealt to 256 parts by a digest of their path; each part is
    digested in order of its paths, then the parts in order, so no task holds
    more than a part of a group.
    """
    row = F.concat(F.col(path), F.lit(":"), F.col(mtime).cast("string"), F.lit("\n"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), ""), 256)
    parts = files.groupBy(group, F.substring(F.sha2(path, 256), 1, 2).alias("part")).agg(joined(F.struct(F.col(path).alias("p"), row.alias("t"))).alias("t"))
    return parts.groupBy(group).agg(F.concat(F.lit("mtime:"), joined(F.struct("part", "t"))).alias("state"))


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def git_state(root: str) -> str | None:
    """The state of a working tree: its commit, with a digest of its changes if there are any; None where git has no answer.

    Files that git doesn't know make a tree changed, but their contents aren't part of the digest.
    """
    head = (_git(root, "rev-parse", "HEAD") or "").strip()
    status = _git(root, "status", "--porcelain") if head else None
    if status is None:
        return None
    return head if not status.strip() else f"{head}:{sha256((_git(root, 'diff') or '').encode()).hexdigest()}"


def git_info(folders: DataFrame, column: str = "cwd") -> DataFrame:
    """cwd, project_root, is_worktree, branch of each distinct folder that lies in a repository, asked where the folders are (all executors share them)."""
    ship(folders.sparkSession)

    def one(cwd: str) -> tuple | None:
        common = (_git(cwd, "rev-parse", "--git-common-dir") or "").strip() if os.path.isdir(cwd) else ""
        if not common:
            return None
        full = lambda p: os.path.realpath(os.path.join(cwd, p))
        own = (_git(cwd, "rev-parse", "--git-dir") or "").strip() or common
        branch = (_git(cwd, "branch", "--show-current") or "").strip() or None
        return cwd, os.path.dirname(full(common)), full(own) != full(common), branch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for r in map(one, batch.column(0).to_pylist()) if r]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.string()))], names=["cwd", "project_root", "is_worktree", "branch"])

    asked = folders.select(F.col(column).alias("cwd")).where("cwd is not null").distinct()
    return asked.mapInArrow(run, "cwd string, project_root string, is_worktree boolean, branch string")


Lookup = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def _mean_vectors(lookup: Lookup, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            coded = terms.flatten().dictionary_encode()
            v, known = lookup(coded.dictionary.to_pylist())
            codes = coded.indices.to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            keep = known[codes] if len(codes) else np.zeros(0, bool)
            # one product of the counts (row by term) with the vectors; equal (row, term) are folded first
            at, n = np.unique(row[keep] * len(known) + codes[keep], return_counts=True)
            sums = np.zeros((batch.num_rows, dim))
            r, t = at // max(1, len(known)), at % max(1, len(known))
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
            for first in range(0, len(starts), 512):  # some texts at a time
                part = starts[first : first + 512]
                end = starts[first + 512] if first + 512 < len(starts) else len(r)
                sums[r[part]] = np.add.reduceat(v[t[part[0] : end]] * n[part[0] : end, None], part - part[0], axis=0)
            total = np.sqrt((sums * sums).sum(1, keepdims=True))
            sums = np.divide(sums, total, out=np.zeros_like(sums), where=total > 0)
            some = np.zeros(batch.num_rows, bool)
            some[r] = True
            ends = np.arange(0, some.sum() * dim + 1, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").filter(pa.array(some)), pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[some].reshape(-1)))], names=["chunk_id", "v"])

    return run


#: A table of term vectors up to so many bytes goes to every task; a larger one is joined.
TABLE_BYTES = 64 << 20


def table_lookup(terms: list[str], matrix: np.ndarray) -> Lookup:
    """A lookup in a table of vectors; terms it lacks don't count."""
    place = {t: i for i, t in enumerate(terms)}

    def look(asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter((place.get(t, -1) for t in asked), np.int64, len(asked))
        return matrix[np.maximum(at, 0)] if len(matrix) else np.zeros((len(asked), 1)), at >= 0

    return look


def hashed_lookup(dim: int, seed: str = "mock") -> Lookup:
    """Vectors made of the terms themselves."""
    return lambda terms: (V.hashed_matrix(terms, dim, seed), np.ones(len(terms), bool))


def embed_terms(terms: DataFrame, lookup: Lookup, dim: int) -> DataFrame:
    """chunk_id, v: mean of the vectors of the terms (an array) of each chunk, of length 1; chunks without a known term have no row.

    Each batch looks up its distinct terms once and is averaged as a whole;
    nothing is shuffled.
    """
    ship(terms.sparkSession)
    return terms.select("chunk_id", "terms").mapInArrow(_mean_vectors(lookup, dim), "chunk_id bigint, v array<double>")


def static_embedding(terms: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``embed_terms`` with a table of vectors (term, v): in every task if it has at most TABLE_BYTES, else by a join.

    In the join terms are counted before they meet their vectors, and sums are
    partial per task.
    """
    n = vectors.count()
    if n * (dim * 8 + 64) <= TABLE_BYTES:
        got = vectors.select("term", "v").where("term is not null and v is not null").toArrow()
        flat = got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return embed_terms(terms, table_lookup(got.column("term").to_pylist(), flat.reshape(-1, dim)), dim)
    counted = terms.select("chunk_id", F.explode_outer("terms").alias("term")).where("term is not null").groupBy("chunk_id", "term").agg(F.count("*").alias("n"))
    sums = counted.join(vectors, "term").groupBy("chunk_id").agg(*(F.sum(F.col("v")[i] * F.col("n")).alias(f"s{i}") for i in range(dim)))
    return sums.select("chunk_id", V.scaled(F.array(*(f"s{i}" for i in range(dim)))).alias("v"))


def grep_cost(hits: DataFrame, files: DataFrame, most: int = 3, around: int = 15) -> DataFrame:
    """query_id, files, full_tokens, window_tokens: the cost of reading the first files that a grep found, whole or around the first hit."""
    first = hits.groupBy("query_id", "path").agg(F.min("rank").alias("r"), F.min_by("line_no", "rank").alias("line_no"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("r"))
    best = first.withColumn("place", place).where(F.col("place") <= most).join(files, "path")
    start = F.greatest(F.col("line_no") - around, F.lit(1)).cast("int")
    window = F.array_join(F.slice(F.split("content", "\n", -1), start, F.lit(2 * around)), "\n")
    cost = lambda c: F.sum(F.floor(F.octet_length(c) / 4 + 0.5)).cast("bigint")
    return best.groupBy("query_id").agg(F.count("*").alias("files"), cost(F.col("content")).alias("full_tokens"), cost(window).alias("window_tokens"))


class IndexStore:
    """Tables of an index under root/repo/state.

    A save writes to a folder of its own and then puts its manifest in place of
    the one before by a rename, so a state is always one save, whole; what an
    earlier save wrote is removed after that.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, repo: str, state: str | None = None) -> str:
        name = sha256(repo.encode()).hexdigest()[:16]
        return f"{self.root}/{name}" + (f"/{state.replace(':', '-')}" if state else "")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifest(self, base: str):
        fs, p = self._fs(f"{base}/manifest/_SUCCESS")
        if not fs.exists(p):
            return None
        rows = self.spark.read.schema(f"{_MANIFEST}, _corrupt_record string").json(f"{base}/manifest").collect()
        return rows[0] if len(rows) == 1 and rows[0].tables is not None else False

    def save(self, repo: str, state: str, tables: dict[str, DataFrame]) -> None:
        base, run = self._path(repo, state), uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{base}/{run}/{name}")
        before = self._manifest(base)
        manifest = self.spark.createDataFrame([(FORMAT_VERSION, repo, state, run, sorted(tables))], _MANIFEST)
        manifest.coalesce(1).write.json(f"{base}/manifest-{run}")
        fs, new = self._fs(f"{base}/manifest-{run}")
        _, place = self._fs(f"{base}/manifest")
        fs.delete(place, True)
        if not fs.rename(new, place):
            raise OSError(f"{base}: the manifest could not be put in place")
        if before:
            fs.delete(self._fs(f"{base}/{before.run}")[1], True)

    def load(self, repo: str, state: str) -> dict[str, DataFrame] | None:
        """The tables of a state; None on a miss or another format; a damaged manifest removes the state."""
        base = self._path(repo, state)
        found = self._manifest(base)
        if found is None:
            return None
        if found is False:
            fs, p = self._fs(base)
            fs.delete(p, True)
            return None
        if found.format_version != FORMAT_VERSION:
            return None
        return {name: self.spark.read.parquet(f"{base}/{found.run}/{name}") for name in found.tables}

    def evict(self, repo: str) -> None:
        fs, p = self._fs(self._path(repo))
        fs.delete(p, True)


_MANIFEST = "format_version int, repo string, state string, run string, tables array<string>"

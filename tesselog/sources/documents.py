"""Small JSON documents and binary stores: bench history, result envelopes, tensor files, remote embedders."""

from __future__ import annotations

import json
import math
import os
import struct
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_VERSION = 1
HISTORY_SCHEMA = (
    "formatVersion int, id string, startedAt string, repos array<struct<repo:string,queries:int,models:array<struct<model:string,recall:double,mrr:double,tokensSaved:double,ci:struct<p05:double,p50:double,p95:double>>>>>"
)


def save_history(df: DataFrame, path: str, started_at: str) -> str:
    """Write one run document; its name is the start time without colons."""
    out = f"{path.rstrip('/')}/{started_at.replace(':', '-')}"
    df.coalesce(1).write.mode("overwrite").json(out)
    return out


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs of the known version, latest first."""
    rows = spark.read.schema(HISTORY_SCHEMA).option("recursiveFileLookup", "true").json(path)
    return rows.where(F.col("formatVersion") == HISTORY_VERSION).orderBy(F.desc("startedAt"))


def result_envelope(results: DataFrame, queries: DataFrame, mode: str, top: int) -> DataFrame:
    """query_id, envelope: one JSON document for each query with its results in order."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score")))
    per = results.where(F.col("rank") <= top).groupBy("query_id").agg(listed.alias("results"))
    full = queries.select("query_id", "text").join(per, "query_id", "left")
    some = F.coalesce("results", F.array().cast("array<struct<rank:int,chunk_id:bigint,score:double>>"))
    return full.select("query_id", F.to_json(F.struct(F.col("text").alias("query"), F.lit(mode).alias("mode"), F.lit(top).alias("top"), F.size(some).alias("resultCount"), some.alias("results"))).alias("envelope"))


def tensors(data: bytes) -> dict[str, np.ndarray]:
    """The F32 tensors of a file with a 64-bit header length, a JSON header and raw values."""
    (size,) = struct.unpack_from("<Q", data)
    if 8 + size > len(data):
        raise ValueError("the header is longer than the file")
    header, base, out = json.loads(data[8 : 8 + size]), 8 + size, {}
    for name, about in header.items():
        if name == "__metadata__" or about.get("dtype") != "F32":
            continue
        a, b = about["data_offsets"]
        if b - a != 4 * math.prod(about["shape"]) or base + b > len(data):
            raise ValueError(f"{name}: offsets don't fit the shape")
        out[name] = np.frombuffer(data, "<f4", (b - a) // 4, base + a).reshape(about["shape"])
    return out


def embedding_tensor(found: dict[str, np.ndarray]) -> np.ndarray:
    """The one two-dimensional tensor, by its usual name if there are several."""
    flat = {k: v for k, v in found.items() if v.ndim == 2}
    if len(flat) != 1:
        flat = {k: v for k, v in flat.items() if "embed" in k.lower()}
    if len(flat) != 1:
        raise ValueError("no single embedding tensor")
    return next(iter(flat.values()))


def embed_remote(df: DataFrame, key: str, text: str, client: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """key, v: vectors from ``client``, called once per Arrow batch; counts and sizes are checked, lengths brought to 1."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = client(batch[text].fillna("").tolist())
            if len(got) != len(batch) or any(len(v) != dim for v in got):
                raise ValueError("the embedder returned another number or size of vectors")
            a = np.asarray(got, np.float64).reshape(len(batch), dim)
            n = np.sqrt((a * a).sum(1, keepdims=True))
            a = np.where((n <= 1e-6) | (np.abs(n - 1) <= 1e-3), a, a / np.where(n == 0, 1, n))
            yield pd.DataFrame({key: batch[key], "v": list(a.astype(np.float32))})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, v array<float>")


class WireError(RuntimeError):
    """An embedder that can't be reached, answers with an error, or says something else than vectors."""


def http_client(url: str, model: str = "", timeout: float = 30.0, key: str = "", batch: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A client for ``embed_remote``: texts go out as {"model", "input": [...]} in batches.

    Both usual answers are read: {"data": [{"embedding", "index"}, ...]} for
    many texts, and {"embedding": [...]} for one, for which texts are sent one
    by one (as "prompt") when a batch is refused as malformed.
    """

    def post(body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(url, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 400 and isinstance(body.get("input"), list):
                return {}
            raise WireError(f"{url} answered {e.code}") from e
        except (OSError, ValueError) as e:
            raise WireError(f"{url}: {e}") from e

    def vectors(got: dict) -> list[list[float]] | None:
        if isinstance(got.get("data"), list):
            rows = got["data"]
            if all(isinstance(r, dict) and isinstance(r.get("index"), int) for r in rows):
                rows = sorted(rows, key=lambda r: r["index"])
            return [r.get("embedding") for r in rows]
        return [got["embedding"]] if isinstance(got.get("embedding"), list) else None

    def run(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for first in range(0, len(texts), batch):
            part = texts[first : first + batch]
            found = vectors(post({"model": model, "input": part}))
            if found is None or len(found) != len(part):
                found = [(vectors(post({"model": model, "prompt": t})) or [None])[0] for t in part]
            if any(not isinstance(v, list) for v in found):
                raise WireError(f"{url} sent no vectors")
            out += found
        return out

    return run


def fetch_to_cache(name: str, folder: str, fetch: Callable[[str], bytes]) -> str:
    """The path of a file in a cache folder; ``fetch`` is asked for its bytes only if it isn't there, and it appears whole or not at all."""
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{os.getpid()}"
        with open(own, "wb") as f:
            f.write(fetch(name))
        os.replace(own, path)
    return path


def cross_encoder(score: Callable[[list[str], list[str]], list[float]]):
    """A scoring function over (query, document) batches as a column function for ``retrieval.rerank``."""

    @F.pandas_udf("double")
    def run(query: pd.Series, document: pd.Series) -> pd.Series:
        return pd.Series(score(query.tolist(), document.tolist()))

    return run

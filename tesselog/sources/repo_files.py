"""Source trees as DataFrames: listing with nested ignore rules, skip reasons, and text content."""

from __future__ import annotations

import os
import re
import subprocess
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselog.session import materialise, ship

MAX_BYTES = 1 << 20
PROBE_BYTES = 8192
IGNORE_FILE = ".gitignore"


@lru_cache(maxsize=1 << 16)
def compile_rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern on the path below the rule's folder, negated, folders only) of one ignore rule; None for blanks and comments."""
    text = line.rstrip("\r\n")
    text = re.sub(r"(?<!\\) +$", "", text)
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    text = text[1:] if text.startswith(("\\#", "\\!")) else text
    only_dirs = text.endswith("/")
    text = text.rstrip("/")
    if not text:
        return None
    anchored = "/" in text
    text = text.lstrip("/")
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            out, i = out + "/.+", i + 3
        elif text[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            body = text[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif text[i] == "\\" and i + 1 < len(text):
            out, i = out + re.escape(text[i + 1]), i + 2
        else:
            out, i = out + re.escape(text[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, only_dirs


class IgnoreRules:
    """Layers of rules by folder ('' is the root); the last match of the innermost layer that has one decides."""

    def __init__(self, files: dict[str, str]):
        self.layers = {d: [r for r in map(compile_rule, text.split("\n")) if r] for d, text in files.items()}

    def decides(self, path: str, is_dir: bool) -> bool:
        parts, verdict = path.split("/"), False
        for depth in range(len(parts)):
            rules = self.layers.get("/".join(parts[:depth]))
            if rules:
                below = "/".join(parts[depth:])
                for pattern, negated, only_dirs in rules:
                    if (is_dir or not only_dirs) and pattern.match(below):
                        verdict = not negated
        return verdict

    def ignored(self, path: str) -> bool:
        """Whether a file is ignored, itself or by a folder above it, which nothing inside can undo."""
        parts = path.split("/")
        if ".git" in parts[:-1] or parts[-1] == ".git":
            return True
        return any(self.decides("/".join(parts[:i]), True) for i in range(1, len(parts))) or self.decides(path, False)


_FOUND = "kind string, path string, mtime_ms double, size bigint, reason string, layers array<struct<folder:string,text:string>>, above array<string>"


def _scan(root: str, respect_ignore: bool, follow_links: bool, max_bytes: int):
    """Entries of the folders of a batch: files, folders to enter, and what is skipped for which reason."""

    def one(folder: str, layers: list, above: list):
        here = os.path.join(root, folder) if folder else root
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except FileNotFoundError:
            return
        except OSError:
            yield "skip", folder, None, None, "permission-denied", [], []
            return
        if respect_ignore and any(e.name == IGNORE_FILE for e in entries):
            try:
                with open(os.path.join(here, IGNORE_FILE), encoding="utf-8", errors="replace") as f:
                    layers = [*layers, (folder, f.read())]
            except OSError:
                pass
        rules = IgnoreRules(dict(layers))
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_symlink() and not follow_links:
                    yield "skip", path, None, None, "symlink-loop" if e.is_dir() else "not-a-regular-file", [], []
                    continue
                if e.is_dir():
                    about = e.stat()
                    me = f"{about.st_dev}:{about.st_ino}"
                    if respect_ignore and (e.name == ".git" or rules.decides(path, True)):
                        yield "skip", path, None, None, "gitignore", [], []
                    elif me in above:
                        yield "skip", path, None, None, "symlink-loop", [], []
                    else:
                        yield "dir", path, None, None, None, layers, [*above, me]
                elif respect_ignore and (e.name == ".git" or rules.decides(path, False)):
                    yield "skip", path, None, None, "gitignore", [], []
                elif not e.is_file():
                    yield "skip", path, None, None, "not-a-regular-file", [], []
                else:
                    about = e.stat()
                    large = about.st_size > max_bytes
                    yield "skip" if large else "file", path, about.st_mtime * 1000, about.st_size, "too-large" if large else None, [], []
            except FileNotFoundError:
                continue
            except OSError:
                yield "skip", path, None, None, "permission-denied", [], []

    def run(batches):
        for batch in batches:
            rows = [x for folder, layers, above in zip(batch["path"], batch["layers"], batch["above"]) for x in one(folder, [(r["folder"], r["text"]) for r in layers], list(above))]
            if not rows:
                continue
            out = pd.DataFrame(rows, columns=["kind", "path", "mtime_ms", "size", "reason", "layers", "above"])
            out["layers"] = [[{"folder": d, "text": t} for d, t in x] for x in out["layers"]]
            out["size"] = out["size"].astype("Int64")
            yield out

    return run


def walk(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, respect_ignore: bool = True, follow_links: bool = False) -> DataFrame:
    """kind (file or skip), path below root, mtime_ms, size, reason of everything under a folder that all executors see.

    Folders are read level by level on the executors; each carries the rules of
    the folders above it, so ignored folders are never entered and nothing is
    gathered on the driver.  ``.git`` is left out unless rules are switched off.
    """
    ship(spark)
    folders = spark.createDataFrame([("", [], [])], "path string, layers array<struct<folder:string,text:string>>, above array<string>")
    levels = None
    while True:
        found = materialise(folders.mapInPandas(_scan(root, respect_ignore, follow_links, max_bytes), _FOUND), "walk")
        here = found.where("kind <> 'dir'").drop("layers", "above")
        levels = here if levels is None else levels.unionByName(here)
        folders = found.where("kind = 'dir'").select("path", "layers", "above")
        if folders.isEmpty():
            return levels
        folders = folders.repartition("path")


def _read(root: str):
    def run(batches):
        for batch in batches:
            content, reason = [], []
            for path in batch["path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data = f.read()
                    binary = b"\0" in data[:PROBE_BYTES]
                    content.append(None if binary else data.decode("utf-8", "replace"))
                    reason.append("binary" if binary else None)
                except OSError:
                    content.append(None)
                    reason.append("permission-denied")
            yield batch.assign(content=content, reason=reason)

    return run


def read_files(files: DataFrame, root: str) -> DataFrame:
    """path, mtime_ms, size, content, reason of the files (path, mtime_ms, size) below root."""
    return files.select("path", "mtime_ms", "size").mapInPandas(_read(root), "path string, mtime_ms double, size bigint, content string, reason string")


def list_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, respect_ignore: bool = True, follow_links: bool = False) -> DataFrame:
    """path, mtime_ms, size, content, reason of everything under ``root``; reason is null for the files to be indexed.

    Reasons are gitignore, too-large, binary, permission-denied, symlink-loop
    and not-a-regular-file; what vanishes meanwhile is passed over.
    """
    found = walk(spark, root, max_bytes, respect_ignore, follow_links)
    files = read_files(found.where("kind = 'file'"), root)
    return files.unionByName(found.where("kind = 'skip'").select("path", "mtime_ms", "size", F.lit(None).cast("string").alias("content"), "reason"))


def text_files(listed: DataFrame) -> DataFrame:
    """path, mtime_ms, size, content of the files to be indexed, as text."""
    return listed.where("reason is null").select("path", "mtime_ms", "size", "content")


def skipped(listed: DataFrame) -> DataFrame:
    return listed.where("reason is not null").select("path", "reason")


#: Schemes that a repository may be fetched by.
SCHEMES = ("https", "http", "git", "ssh", "git+ssh", "git+https")


def url_problem(url: Column, allow_private: bool = False) -> Column:
    """Why a repository URL (or user@host:path) may not be fetched; null if it may."""
    short = F.regexp_extract(url, r"^[^\s@/]+@([^:/]+):.+$", 1)
    scheme = F.when(short != "", "ssh").otherwise(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))
    host = F.when(short != "", short).otherwise(F.regexp_extract(url, r"^[^/]+//(?:[^@/]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    host = F.lower(F.regexp_replace(host, r"^\[|\]$", ""))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.|0\.|::1?$|f[cd][0-9a-f]{2}:|fe80:)|\.(local|localhost|internal)$")
    out = F.when(~scheme.isin(*SCHEMES), "scheme").when(host == "", "host")
    return out if allow_private else out.when(private, "private host")


def clone(spark: SparkSession, url: str, target: str, commit: str | None = None, allow_private: bool = False, allow_local: bool = False, timeout: float = 600) -> str:
    """Fetch a repository into a folder, at a commit if one is named; the folder as it is if it already stands there.

    The URL is checked by ``url_problem`` first; nothing of it is ever run by a
    shell.  A folder on this machine counts only with ``allow_local``.
    """
    local = allow_local and os.path.isdir(url)
    problem = None if local else spark.createDataFrame([(url,)], "u string").select(url_problem(F.col("u"), allow_private)).first()[0]
    if problem or url.startswith("-"):
        raise ValueError(f"{url!r} may not be fetched: {problem}")

    def git(*args: str) -> str:
        done = subprocess.run(["git", *args], capture_output=True, timeout=timeout, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
        if done.returncode:
            raise RuntimeError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
        return done.stdout.decode().strip()

    if os.path.isdir(os.path.join(target, ".git")):
        if commit is None or git("-C", target, "rev-parse", "HEAD") == commit:
            return target
    else:
        git("clone", "--quiet", *([] if commit else ["--depth", "1"]), "--", url, target)
    if commit:
        git("-C", target, "checkout", "--quiet", "--detach", commit)
    return target

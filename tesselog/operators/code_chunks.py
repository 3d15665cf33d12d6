"""Files cut along their definitions: one chunk for each function or class member, the rest in line windows.

Python is parsed by its own grammar, TypeScript, JavaScript (with or without
markup), Go and Java by ``functions.syntax``; other languages, and files that
don't parse, are cut into line windows.  A class with members is entered
instead of emitted; comments on their own lines right above a definition belong
to it; a definition over ``MAX_LINES`` is windowed and keeps its name; every
other line that holds something is covered by windows.  How a file is cut is a
function that can be given.
"""

from __future__ import annotations

import ast
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselog.functions import syntax
from tesselog.functions import text as T
from tesselog.session import ship

MAX_LINES, WINDOW, OVERLAP = 200, 50, 5
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_KIND = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition"}


def windows(first: int, last: int, size: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Overlapping (first, last) windows of the lines first .. last."""
    out, at = [], first
    while at <= last:
        end = min(at + size - 1, last)
        out.append((at, end))
        if end == last:
            break
        at += size - overlap
    return out


def _definitions(body: list, found: list) -> None:
    for node in body:
        if not isinstance(node, _DEFS):
            continue
        members = [x for x in node.body if isinstance(x, _DEFS)] if isinstance(node, ast.ClassDef) else []
        if members:
            _definitions(node.body, found)
        else:
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            found.append((start, node.end_lineno, _KIND[type(node)], node.name))


def _braced(content: str, language: str, lines: list[str]) -> tuple[list[tuple], dict[int, int]]:
    """(first line, last line, node, name) of the definitions, and the first line of each own-line comment by its last one."""
    found, comments = syntax.definitions(content, language)
    starts = [0]
    for line in content.split("\n")[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    line_of = lambda at: bisect_right(starts, at)
    own = {}
    for a, b in comments:
        first = line_of(a)
        if not content[starts[first - 1] : a].strip():
            own[line_of(max(a, b - 1))] = first
    return [(line_of(d.start), min(line_of(max(d.start, d.end - 1)), len(lines)), d.node, d.name) for d in found], own


def chunks_of(content: str, language: str | None) -> list[tuple]:
    """(start_line, end_line, kind, node_type, symbol) of a file's chunks in order; none for blank files."""
    lines = content.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    if not any(x.strip() for x in lines):
        return []
    found: list[tuple] = []
    comments: dict[int, int] = {}
    if language == "python":
        try:
            _definitions(ast.parse(content).body, found)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            found = []
        comments = {i: i for i, x in enumerate(lines, 1) if x.lstrip().startswith("#")}
    elif language in syntax.RULES:
        found, comments = _braced(content, language, lines)
    out, covered = [], [False] * (len(lines) + 2)
    cursor = 1
    for start, end, kind, name in sorted(found, key=lambda x: x[:2]):
        while start - 1 in comments:
            start = comments[start - 1]
        start = max(start, cursor)
        if end < start:
            continue
        cursor = end + 1
        for a, b in windows(start, end) if end - start + 1 > MAX_LINES else [(start, end)]:
            out.append((a, b, "tree-sitter", kind, name))
        covered[start : end + 1] = [True] * (end - start + 1)
    at = 1
    while at <= len(lines):
        if covered[at]:
            at += 1
            continue
        end = at
        while end < len(lines) and not covered[end + 1]:
            end += 1
        if any(x.strip() for x in lines[at - 1 : end]):
            out += [(a, b, "line", None, None) for a, b in windows(at, end)]
        at = end + 1
    return sorted(out, key=lambda c: (c[0], c[1]))


_SCHEMA = "path string, language string, start_line bigint, end_line bigint, kind string, node_type string, symbol_name string, content string"


#: (content, language) -> rows like those of ``chunks_of``.
Chunker = Callable[[str, str | None], list[tuple]]


def _run(chunker: Chunker):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.int64() if "bigint" in x else pa.string() for x in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content"))):
                if content:
                    lines = content.split("\n")
                    rows += [(path, language, a, b, kind, node, name, "\n".join(lines[a - 1 : b])) for a, b, kind, node, name in chunker(content, language)]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def chunk_files(files: DataFrame, chunker: Chunker = chunks_of) -> DataFrame:
    """path, language, start_line, end_line, kind, node_type, symbol_name, content of files (path, content), cut by ``chunker``."""
    ship(files.sparkSession)
    return files.select("path", T.language(F.col("path")).alias("language"), "content").mapInArrow(_run(chunker), _SCHEMA)


class ChunkFile:
    """The chunker as a table function: ``spark.udtf.register("chunk_file", udtf(ChunkFile, returnType=ChunkFile.SCHEMA))``, then ``SELECT * FROM t, LATERAL chunk_file(content, language)``."""

    SCHEMA = "start_line bigint, end_line bigint, kind string, node_type string, symbol_name string"

    def eval(self, content: str | None, language: str | None):
        yield from chunks_of(content or "", language)


def coverage(chunks: DataFrame, by: str = "language") -> DataFrame:
    """Files, chunks, and the shares of chunks that come from syntax and that are named, of each language."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return chunks.groupBy(by).agg(
        F.count_distinct("path").alias("files"), F.count("*").alias("chunks"), share(F.coalesce(F.col("kind") == "tree-sitter", F.lit(False))).alias("by_syntax"), share(F.col("symbol_name").isNotNull()).alias("named")
    )

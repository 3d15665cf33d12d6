"""A streaming source of the complete lines appended to log files.

The offset of a file is the byte behind its last line feed, a mark of which
file it is (its first line and its place on the disk) and a generation that
grows when the file shrinks or gives way to another one; after that it is read
from its start again.  A reader that starts anew finds the mark in the file
itself and the generation in the offset it starts from, so nothing is read
twice.  Only whole lines are emitted; a carriage return before the line feed
goes.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, generation int, start bigint, value string"


class _Piece(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int):
        self.path, self.generation, self.start, self.end = path, generation, start, end


def _whole_lines(path: str, start: int) -> int:
    """The position behind the last line feed from ``start`` on, or ``start``."""
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        at = f.tell()
        while at > start:
            size = min(1 << 16, at - start)
            f.seek(at - size)
            k = f.read(size).rfind(b"\n")
            if k >= 0:
                return at - size + k + 1
            at -= size
    return start


_HEAD = 1 << 16  # bytes of the first line that count for a file's mark


def _mark(path: str) -> int:
    """What tells a file from another one at the same path; 0 as long as it has no whole line."""
    with open(path, "rb") as f:
        head = f.read(_HEAD)
        at = head.find(b"\n")
        if at < 0 and len(head) < _HEAD:
            return 0
        return (zlib.crc32(head[:at] if at >= 0 else head) ^ (os.fstat(f.fileno()).st_ino << 20)) & (2**52 - 1) or 1


class TailReader(DataSourceStreamReader):
    """Offsets are {path: [generation, position, mark]}; the generation is null until the start of this run tells it."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.seen: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        for path in sorted(glob.glob(self.pattern)):
            generation, end, mark = self.seen.get(path, [None, 0, 0])
            try:
                now = _mark(path)
                if os.path.getsize(path) < end or mark and now != mark:
                    generation, end = None if generation is None else generation + 1, 0
                self.seen[path] = [generation, _whole_lines(path, end), now]
            except OSError:
                continue
        return {"files": {p: list(v) for p, v in self.seen.items()}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, out = start["files"], []
        for path, (generation, stop, mark) in end["files"].items():
            was, begin, old = before.get(path, [None, 0, 0])
            same = stop >= begin and old in (0, mark) and (generation is None or was is None or generation == was)
            if generation is None:
                generation = 0 if path not in before else (was or 0) + (0 if same else 1)
            known = self.seen.setdefault(path, [generation, stop, mark])
            if known[0] is None:
                known[0] = generation
            begin = begin if same else 0
            if stop > begin:
                out.append(_Piece(path, generation, begin, stop))
        return out

    def read(self, partition: _Piece) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                yield partition.path, partition.generation, at, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """spark.dataSource.register(TailSource); spark.readStream.format("log_tail").load("/logs/*/*.jsonl")"""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])

"""Oversized items cut into pieces under a limit, at the deepest boundary within reach, with overlap.

A text is walked piece by piece: of all boundaries in the size window of the
piece the deepest wins, the last of equally deep ones.  How deep a boundary is
comes from a depth function over the whole text:

* ``natural_depths``: behind a blank line, a line feed, a space or tab;
* ``cohesion_depths``: lexical-cohesion valleys - at each end of a line or
  sentence the words of the units before and after are compared as hashed count
  vectors (blocks are differences of prefix sums), and the depth is how far the
  similarity falls below the nearest peaks on both sides; natural depths break
  ties and serve where there is no valley.

Only texts over the limit leave the JVM.  A text is cut in O(length).

Defined cases: null, empty and short texts give no row; rows of one id count
once (a row with start_line wins over one without, then the largest content);
a null id gives no row; a null start_line counts as line 1; texts without any
boundary are cut at the limit; ``end_line`` and other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselog.session import ship

LIMIT, FLOOR, OVERLAP = 1600, 800, 160
_BLANK = re.compile(r"^[ \t\r]*\n", re.M)
_WORD = re.compile(r"\w+")
_UNIT = re.compile(r"\n|[.!?](?=[ \t])[ \t]+|[。！？]")
_BLOCK_UNITS, _DIMS, _STRIDE = 6, 512, 2048

Depths = Callable[[str], tuple[np.ndarray, np.ndarray]]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def natural_depths(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions just behind a space or tab (depth 1), a line feed (2) and a blank line (3)."""
    codes = _codes(text)
    depth = np.zeros(len(codes) + 1, np.float64)
    depth[np.flatnonzero((codes == 32) | (codes == 9)) + 1] = 1
    depth[np.flatnonzero(codes == 10) + 1] = 2
    depth[[m.end() for m in _BLANK.finditer(text)]] = 3
    at = np.flatnonzero(depth)
    return at, depth[at]


def similarities(units: np.ndarray, bins: np.ndarray, n: int, block: int = _BLOCK_UNITS) -> np.ndarray:
    """Cosine of the word counts of the ``block`` units before and after each of the gaps 1 .. n - 1 between n units.

    units and bins tell, word by word in order, the unit a word stands in and
    the bin its hash falls into.  Counts are made for _STRIDE gaps at a time.
    """
    out = np.zeros(max(n - 1, 0))
    for first in range(1, n, _STRIDE):
        last = min(n, first + _STRIDE)
        low, high = max(0, first - block), min(n, last - 1 + block)
        a, b = np.searchsorted(units, (low, high))
        sums = np.zeros((high - low + 1, _DIMS), np.float32)
        np.add.at(sums, (units[a:b] - low + 1, bins[a:b]), 1)
        np.cumsum(sums, axis=0, out=sums)
        gap = np.arange(first, last)
        at = sums[gap - low]
        before = at - sums[np.maximum(gap - block, low) - low]
        after = sums[np.minimum(gap + block, high) - low] - at
        norms = np.sqrt((before * before).sum(1, dtype=np.float64) * (after * after).sum(1, dtype=np.float64))
        out[first - 1 : last - 1] = np.where(norms > 0, (before * after).sum(1, dtype=np.float64) / np.where(norms > 0, norms, 1), 0.0)
    return out


def valleys(alike: np.ndarray) -> np.ndarray:
    """How far each value lies below the nearest peak to its left and to its right, together: from each place one climbs as long as it doesn't go down."""

    def climb(x: list[float]) -> list[float]:
        peak = x[:1]
        for i in range(1, len(x)):
            peak.append(peak[-1] if x[i - 1] >= x[i] else x[i])
        return peak

    rounded = np.round(alike, 6)
    left, right = climb(rounded.tolist()), climb(rounded[::-1].tolist())[::-1]
    return np.asarray(left) + np.asarray(right) - 2 * rounded


def cohesion_depths(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Natural boundaries and sentence ends; the deeper the valley of lexical cohesion there, the deeper the boundary."""
    at, depth = natural_depths(text)
    ends = np.array([m.end() for m in _UNIT.finditer(text)], np.int64)
    ends = ends[ends < len(text)]
    if not len(ends):
        return at, depth
    words = [(m.start(), zlib.crc32(m[0].encode("utf-8", "surrogatepass")) % _DIMS) for m in _WORD.finditer(text.lower())] if len(text.lower()) == len(text) else [
        (m.start(), zlib.crc32(m[0].lower().encode("utf-8", "surrogatepass")) % _DIMS) for m in _WORD.finditer(text)
    ]
    place, bins = (np.array(x, np.int64) for x in zip(*words)) if words else (np.zeros(0, np.int64),) * 2
    valley = valleys(similarities(np.searchsorted(ends, place, "right"), bins, len(ends) + 1))
    every = np.union1d(at, ends)
    out = np.zeros(len(every))
    out[np.searchsorted(every, at)] = depth
    spot = np.searchsorted(every, ends)
    out[spot] = np.maximum(out[spot], 1) + 1000 * np.round(valley, 6)
    return every, out


def cut(text: str, depths: Depths = natural_depths, limit: int = LIMIT, floor: int = FLOOR, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text over ``limit`` characters; the next start is a line start within the overlap if there is one."""
    n = len(text)
    if n <= limit:
        return []
    at, depth = depths(text)
    line_starts = np.flatnonzero(_codes(text) == 10) + 1
    pieces, start = [], 0
    while n - start > limit:
        lo, hi = np.searchsorted(at, (start + floor, start + limit), "right")
        if hi > lo:
            window = depth[lo:hi]
            end = int(at[hi - 1 - int(window[::-1].argmax())])
        else:
            end = start + limit
        pieces.append((start, end))
        k = int(np.searchsorted(line_starts, end - overlap))
        start = int(line_starts[k]) if k < len(line_starts) and line_starts[k] < end else end - overlap
    pieces.append((start, n))
    return pieces


def _split(depths: Depths, limit: int, floor: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, path, first, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                feeds = np.flatnonzero(_codes(text) == 10)
                for no, (a, b) in enumerate(cut(text, depths, limit, floor, overlap)):
                    rows.append((key, path, no, a, b, first + int(np.searchsorted(feeds, a)), first + int(np.searchsorted(feeds, b - 1)), text[a:b]))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.string()]
            names = ["chunk_id", "file_path", "piece_no", "start_char", "end_char", "start_line", "end_line", "content"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def split_oversized(chunks: DataFrame, depths: Depths = natural_depths, limit: int = LIMIT, floor: int = FLOOR, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, file_path, piece_no, start_char, end_char, start_line, end_line, content of each piece of an oversized chunk."""
    if not 0 <= overlap < floor < limit:
        raise ValueError("0 <= overlap < floor < limit is needed, else a piece wouldn't move on")
    large = chunks.where(F.col("chunk_id").isNotNull() & (F.length("content") > limit))
    best = F.max(F.struct(F.col("start_line").isNotNull().alias("known"), "content", "start_line", "file_path")).alias("b")
    once = large.groupBy("chunk_id").agg(best).select("chunk_id", "b.file_path", F.coalesce("b.start_line", F.lit(1)).cast("bigint").alias("start_line"), "b.content")
    ship(chunks.sparkSession)
    schema = "chunk_id bigint, file_path string, piece_no bigint, start_char bigint, end_char bigint, start_line bigint, end_line bigint, content string"
    return once.mapInArrow(_split(depths, limit, floor, overlap), schema)

"""Long passages that stand word for word in more than one document.

Sliding sentence spans, made exact to the character:

1. Cuts.  In every window of ``WINDOW`` positions one position is a cut: the
   start of a sentence if there is one, else the place whose next characters
   hash smallest (so texts without sentences are cut too).  Which one it is
   depends on the characters there alone, hence equal passages are cut alike.
2. Spans.  From each cut the run of sentences over the next ``SPAN`` characters
   is hashed.  As WINDOW + SPAN - 1 + the look-around of a cut is the least
   length, every passage of that length holds a whole span.
3. Join.  Spans whose hash occurs in more than one document are found globally
   by a partial aggregation (smallest and largest document of a hash) and
   joined back on the hash.
4. Edges.  A passage of exactly the least length has one lowest position, the
   same wherever it stands; only passages whose lowest position starts a shared
   span can be shared.  Those of one cut follow one another, so its first and
   last passage settle all of them if both stand in other documents; only for
   the cuts where one does not, at the edges of what is shared, is every passage
   hashed and joined.

A hash that a third of all documents hold is aggregated before the shuffle; on
the way back it is the probe side of a join with unique keys, which adaptive
execution splits.  No pair of documents is ever formed.

Defined cases: null, empty and shorter texts hold no passage; white space and
rare characters count like others, by code points; a passage repeated within
one document only doesn't count; texts under one doc_id count as one document,
whose stretches are those of all its texts together; a null doc_id takes no
part; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselog.session import materialise, release

LEAST = 200
SPAN = 96
_LOOK = 8  # characters behind a position whose hash decides about it
_BACK = 2  # characters before it that tell a sentence start
_BLOCK_CHARS = 250_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: What ends a sentence.
_STOPS = np.array([ord(c) for c in ".!?;:。！？；…\n"], np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_powers = np.ones(1, _U)
_inverse = np.ones(1, _U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 2 * _BLOCK_CHARS)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for name, by in (("_powers", _BASE), ("_inverse", inverse)):
            got = np.full(n, by, _U)
            got[0] = 1
            globals()[name] = np.multiply.accumulate(got)
    return _powers, _inverse


class Block:
    """Some texts as one array of code points, with O(1) hashes of any stretch."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        n = len(self.codes)
        powers, self._inverse = _tables(n + 1)
        self._sums = np.zeros(n + 1, _U)
        np.cumsum(_mix(self.codes.astype(_U) + _BASE) * powers[:n], out=self._sums[1:])

    def hashes(self, at: np.ndarray | None, length: int) -> np.ndarray:
        """The hash of ``length`` characters from each position ``at`` (all positions where it fits if None)."""
        if at is None:
            n = len(self.codes) - length + 1
            return _mix((self._sums[length:] - self._sums[:n]) * self._inverse[:n])
        return _mix((self._sums[at + length] - self._sums[at]) * self._inverse[at])


def _slide(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over each window x[i:i+size], by doubling."""
    got, have = x, 1
    while have * 2 <= size:
        got = op(got[:-have], got[have:])
        have *= 2
    return op(got[: len(x) - size + 1], got[size - have : size - have + len(x) - size + 1]) if have < size else got


class Cuts:
    """The cuts of all texts of a block.

    ``at`` has their positions, ``rank`` the rank of every position, and
    ``low[i]`` the lowest rank of the positions i .. i + window - 1, 0 where
    these don't belong to a passage of ``least`` characters of one text.
    """

    def __init__(self, block: Block, least: int = LEAST, span: int = SPAN):
        codes, n = block.codes, len(block.codes)
        self.window = window = least - span + 1 - _BACK
        # rank of each position: sentence starts first, then by the hash of what follows
        m = n - _LOOK + 1
        self.rank = rank = (block.hashes(None, _LOOK) >> _U(2)) | _U(1)
        stop = np.isin(codes, _STOPS)
        space = (codes == 32) | (codes == 10) | (codes == 9)
        begins = np.zeros(n, bool)
        begins[2:] = stop[:-2] & space[1:-1] & ~space[2:]
        begins[1:] |= stop[:-1] & (codes[:-1] >= 0x2000) | (codes[:-1] == 10) & ~space[1:]
        rank += np.where(begins[:m], _U(0), _U(1) << _U(62))
        low = _slide(rank[: n - span + 1], window, np.minimum)
        for a, b in zip(block.bounds[:-1], block.bounds[1:]):  # what reaches into another text or looks back out of its own
            low[a : a + _BACK] = 0
            low[max(a, b - span - window + 2) : b] = 0
        self.low = low
        # a position is a cut if it is the lowest of some window that holds it
        pad = np.zeros(window - 1, _U)
        best = _slide(np.concatenate((pad, low, pad)), window, np.maximum)
        self.at = np.flatnonzero(best == rank[: len(best)])

    def ranges(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the passages of the least length whose lowest position is the cut; they follow one another."""
        first = at[:, None] - np.arange(self.window)[::-1]
        ok = (first >= 0) & (first < len(self.low))
        ok &= self.low[np.where(ok, first, 0)] == self.rank[at][:, None]
        lo = ok.argmax(1)
        hi = self.window - 1 - ok[:, ::-1].argmax(1)
        steps = np.arange(len(at))
        return first[steps, lo] - _BACK, first[steps, hi] - _BACK


def _blocks(batch: pa.RecordBatch, least: int):
    """(rows, Block) of runs of texts of at least ``least`` characters, about _BLOCK_CHARS together."""
    texts = batch.column("text").to_pylist()
    rows, size = [], 0
    for i, t in enumerate(texts):
        if t is None or len(t) < least:
            continue
        if rows and size + len(t) > _BLOCK_CHARS:
            yield np.array(rows), Block([texts[r] for r in rows])
            rows, size = [], 0
        rows.append(i)
        size += len(t)
    if rows:
        yield np.array(rows), Block([texts[r] for r in rows])


def _owners(block: Block, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(block.bounds, at, "right") - 1


def _spans(least: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for rows, block in _blocks(batch, least):
                at = Cuts(block, least, span).at
                own = _owners(block, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.hashes(at, span).view(np.int64)), pa.array(ids[rows[own]]), pa.array((at - block.bounds[own]).astype(np.int32))], names=["hash", "doc_id", "at"]
                )

    return run


def _struct(marks, field: str) -> np.ndarray:
    return marks.values.field(field).to_numpy(zero_copy_only=False)


def _ranges(least: int, span: int):
    """The range of each shared cut, with the hashes of its first and last passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            marks = batch.column("marks")
            for rows, block in _blocks(batch, least):
                found = Cuts(block, least, span)
                at = np.concatenate([_struct(marks[int(r)], "at").astype(np.int64) + block.bounds[k] for k, r in enumerate(rows)])
                cut = np.concatenate([_struct(marks[int(r)], "hash") for r in rows])
                # of texts under one id, each answers for its own cuts only
                own = np.repeat(np.arange(len(rows)), [len(marks[int(r)]) for r in rows])
                ok = at + span <= block.bounds[own + 1]
                ok[ok] = block.hashes(at[ok], span).view(np.int64) == cut[ok]
                ok &= np.isin(at, found.at)
                at, cut, own = at[ok], cut[ok], own[ok]
                lo, hi = found.ranges(at)
                base = block.bounds[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cut),
                        pa.array(ids[rows[own]]),
                        pa.array((lo - base).astype(np.int32)),
                        pa.array((hi - base).astype(np.int32)),
                        pa.array(block.hashes(lo, least).view(np.int64)),
                        pa.array(block.hashes(hi, least).view(np.int64)),
                    ],
                    names=["cut", "doc_id", "lo", "hi", "h_lo", "h_hi"],
                )

    return run


def _windows(least: int):
    """All passages of the ranges that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            marks = batch.column("marks")
            for rows, block in _blocks(batch, least):
                lo = np.concatenate([_struct(marks[int(r)], "lo").astype(np.int64) + block.bounds[k] for k, r in enumerate(rows)])
                hi = np.concatenate([_struct(marks[int(r)], "hi").astype(np.int64) + block.bounds[k] for k, r in enumerate(rows)])
                own = np.repeat(np.arange(len(rows)), [len(marks[int(r)]) for r in rows])
                hi = np.minimum(hi, block.bounds[own + 1] - least)
                size = np.maximum(hi - lo + 1, 0)
                w = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                w = np.unique(w)
                own = _owners(block, w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.hashes(w, least).view(np.int64)), pa.array(ids[rows[own]]), pa.array((w - block.bounds[own]).astype(np.int32))], names=["hash", "doc_id", "at"]
                )

    return run


def _shared_hashes(rows: DataFrame) -> DataFrame:
    """The hashes of rows (hash, doc_id) that more than one document holds."""
    return rows.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("hash")


def _stretches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, a, b = [], [], []
            for doc, starts in zip(batch.column("doc_id").to_pylist(), batch.column("starts")):
                at = np.sort(np.asarray(starts.values))
                new = np.flatnonzero(np.diff(at) > least) + 1
                docs += [doc] * (len(new) + 1)
                a += at[np.concatenate(([0], new))].tolist()
                b += (at[np.concatenate((new - 1, [len(at) - 1]))] + least).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "start_char", "end_char"])

    return run


def _documents(docs: DataFrame, least: int) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).select("doc_id", "text")


def shared_spans(docs: DataFrame, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """doc_id, start_char, end_char: the longest stretches covered by runs of ``least`` characters that another document holds."""
    if least < span + _LOOK + _BACK:
        raise ValueError("a passage must have room for a span and a window")
    texts = _documents(docs, least)
    row = "hash bigint, doc_id bigint, at int"
    spans = materialise(texts.mapInArrow(_spans(least, span), row), "spans")
    marks = materialise(spans.join(_shared_hashes(spans), "hash", "left_semi"), "marks")
    release(spans)
    # the two ends of each range settle it, unless one of them stands nowhere else
    of = marks.groupBy("doc_id").agg(F.collect_list(F.struct("at", "hash")).alias("marks"))
    ranges = materialise(texts.join(of, "doc_id").mapInArrow(_ranges(least, span), "cut bigint, doc_id bigint, lo int, hi int, h_lo bigint, h_hi bigint"), "ranges")
    ends = _shared_hashes(ranges.select(F.explode(F.array("h_lo", "h_hi")).alias("hash"), "doc_id"))
    ends = materialise(ends, "ends")
    closed = ranges.join(ends.withColumnRenamed("hash", "h_lo"), "h_lo", "left_semi").join(ends.withColumnRenamed("hash", "h_hi"), "h_hi", "left_semi")
    open_cuts = materialise(ranges.join(closed.select("cut", "doc_id", "lo"), ["cut", "doc_id", "lo"], "left_anti").select("cut").distinct(), "open")
    settled = ranges.join(open_cuts, "cut", "left_anti").select("doc_id", F.explode(F.array("lo", "hi")).alias("at"))
    # a cut that is open anywhere is looked at everywhere: its passages elsewhere may lie inside a range
    todo = ranges.join(open_cuts, "cut", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    windows = materialise(texts.join(todo, "doc_id").mapInArrow(_windows(least), row), "windows")
    both = materialise(_shared_hashes(windows), "both")
    edges = windows.join(both, "hash", "left_semi").select("doc_id", "at")
    starts = settled.unionByName(edges).groupBy("doc_id").agg(F.collect_set("at").alias("starts"))
    return starts.mapInArrow(_stretches(least), "doc_id bigint, start_char bigint, end_char bigint")


def shared_share(docs: DataFrame, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """doc_id, n_chars, n_spans, shared_chars, share: how much of each document stands elsewhere, 0 for the others."""
    spans = shared_spans(docs, least, span).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("n_chars"))
    out = sizes.join(spans, "doc_id", "left")
    n, shared = F.coalesce("n_spans", F.lit(0)).cast("bigint"), F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    return out.select("doc_id", "n_chars", n.alias("n_spans"), shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("share"))

"""Deeply nested log lines as flat tables of lines, messages and blocks.

``flatten(lines)`` makes one pass over the lines in Arrow batches.  Each batch
is indexed structurally (see ``functions.structural``); whether a value is a
message, a block or neither then follows level by level from its parent.  JSON
text that stands for a message or a content is unescaped and indexed in the
next round, all such texts of the batch together.  Results are linked to calls
by an equi join on (file, call id).

Defined cases: a null or empty value, a value that is no JSON object and a
damaged line give a line row with ``is_object`` false and no other rows; lines
with a null ``line_id`` are left out, as nothing could refer to them; a null
file or line number is kept, and calls are linked within null files as within
any other; rows of one ``line_id`` count once, the one received last; of equal
keys in one object the last counts; lines may be nested at any depth; other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselog.functions import structural as S
from tesselog.session import materialise, ship

#: The types that make an object a block.
BLOCK_TYPES = ("text", "thinking", "tool_use", "tool_result", "image")
USE_KEYS = ("tool_use_id", "toolUseId")

SCHEMA = (
    "record string, line_id bigint, file string, line_no int, is_object boolean, place int, path string,"
    " parent_path string, message_path string, type string, role string, call_id string, depth int"
)
_FIELDS = [
    ("record", pa.string()),
    ("line_id", pa.int64()),
    ("file", pa.string()),
    ("line_no", pa.int32()),
    ("is_object", pa.bool_()),
    ("place", pa.int32()),
    ("path", pa.string()),
    ("parent_path", pa.string()),
    ("message_path", pa.string()),
    ("type", pa.string()),
    ("role", pa.string()),
    ("call_id", pa.string()),
    ("depth", pa.int32()),
]
_MAX_BYTES = 8 << 20  # bytes indexed at a time; a longer line is indexed alone

_PLAIN, _DEAD, _CONTENT_OUT, _CONTENT_IN = 0, 1, 2, 3


def _text_of(raw: bytes) -> str | None:
    """The decoded JSON string, or None if it isn't one."""
    try:
        return json.loads(raw)
    except (ValueError, RecursionError):
        return None


def _scalar(raw: bytes) -> str | None:
    """A call id as comparable text: strings and numbers don't equal each other; null gives None."""
    if raw[:1] == b'"':
        got = _text_of(raw)
        return None if got is None else "s" + got
    return None if raw in (b"null", b"") or raw[:1] in b"{[" else "v" + raw.decode("utf-8", "replace")


class _Seed:
    """A text to be indexed, and what it stands for."""

    __slots__ = ("line", "state", "is_message", "path", "offset", "block", "message")

    def __init__(self, line, state, is_message, path, offset, block, message):
        self.line, self.state, self.is_message, self.path, self.offset, self.block, self.message = line, state, is_message, path, offset, block, message


def _round(texts: list[bytes], seeds: list[_Seed], messages: list, blocks: list, objects: set) -> tuple[list[bytes], list[_Seed]]:
    """Index ``texts`` together, append their messages and blocks, return the texts of the next round."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    nodes = S.index(data, offsets)
    n = len(nodes.text)
    roots = np.flatnonzero(nodes.parent < 0)
    live = nodes.valid
    if not n:
        return [], []
    key_message, key_content, key_type = nodes.key_is("message"), nodes.key_is("content"), nodes.key_is("type")
    key_id, key_role = nodes.key_is("id"), nodes.key_is("role")
    key_uses = [nodes.key_is(k) for k in USE_KEYS]
    # the type of each object, as an index into BLOCK_TYPES
    type_of = np.full(n, -1, np.int64)
    for i in np.flatnonzero(key_type & (nodes.kind == S.STRING)):
        raw = nodes.raw(i)
        got = _text_of(raw) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")
        if got in BLOCK_TYPES:
            type_of[nodes.parent[i]] = BLOCK_TYPES.index(got)
    state = np.full(n, _DEAD, np.int64)
    is_message = np.zeros(n, bool)
    is_block = np.zeros(n, bool)
    by_depth = np.argsort(nodes.depth, kind="stable")
    bounds = np.searchsorted(nodes.depth[by_depth], np.arange(int(nodes.depth.max(initial=0)) + 2))
    for level in range(len(bounds) - 1):
        at = by_depth[bounds[level] : bounds[level + 1]]
        at = at[live[nodes.text[at]]]
        if level == 0:
            for i in at:
                seed = seeds[nodes.text[i]]
                state[i], is_message[i] = seed.state, seed.is_message and nodes.kind[i] == S.OBJECT
        else:
            p = nodes.parent[at]
            ps, in_object = state[p], nodes.kind[p] == S.OBJECT
            out = np.where(ps == _PLAIN, _PLAIN, _DEAD)
            # elements of a content are candidates like a lone content object
            element = ~in_object & ((ps == _CONTENT_OUT) | (ps == _CONTENT_IN))
            is_array = nodes.kind[at] == S.ARRAY
            out = np.where(element & (ps == _CONTENT_OUT), np.where(is_array, _PLAIN, _CONTENT_OUT), out)
            out = np.where(element & (ps == _CONTENT_IN), np.where(is_array, _DEAD, _CONTENT_IN), out)
            # objects met as candidates were settled below: blocks keep only their content alive
            block_parent, message_parent = is_block[p], is_message[p] & ~is_block[p]
            out = np.where(block_parent, np.where(key_content[at], _CONTENT_IN, _DEAD), out)
            out = np.where(message_parent & key_content[at], _CONTENT_OUT, out)
            becomes = in_object & (ps == _PLAIN) & ~block_parent & key_message[at] & ~(message_parent & key_content[at])
            is_message[at] = becomes & (nodes.kind[at] == S.OBJECT)
            state[at] = out
        # a candidate object is a block by its type; another one is plain outside of blocks, dead inside
        cand = at[(nodes.kind[at] == S.OBJECT) & (state[at] >= _CONTENT_OUT)]
        is_block[cand] = type_of[cand] >= 0
        rest = cand[~is_block[cand]]
        state[rest] = np.where(state[rest] == _CONTENT_OUT, _PLAIN, _DEAD)
    # paths only where something is emitted
    memo: dict[int, tuple[str, tuple, str, str]] = {}

    def where(i: int) -> tuple[str, tuple, str, str]:
        """(path, offsets, enclosing block, enclosing message) of node i, itself not counted as enclosing."""
        got = memo.get(i)
        if got is None:
            chain, up = [i], int(nodes.parent[i])
            while up >= 0 and up not in memo:
                chain.append(up)
                up = int(nodes.parent[up])
            seed = seeds[nodes.text[i]]
            if up < 0:
                up = chain.pop()
                path, block, message = seed.path, seed.block, seed.message
            else:
                path, _, block, message = memo[up]
            for node in reversed(chain):
                if is_block[up]:
                    block = path
                if is_message[up]:
                    message = path
                step = str(nodes.index[node]) if nodes.key0[node] < 0 else _text_of(b'"' + nodes.data[nodes.key0[node] : nodes.key1[node]].tobytes() + b'"')
                path, up = f"{path}.{step}" if path else str(step), node
                if nodes.depth[node] % 64 == 0:  # deep paths are long: only some are kept on the way
                    memo[node] = (path, seed.offset + (int(nodes.start[node] - offsets[nodes.text[node]]),), block, message)
            got = memo[i] = (path, seed.offset + ((int(nodes.start[i] - offsets[nodes.text[i]]),) if nodes.parent[i] >= 0 else ()), block, message)
        return got

    def child(mask: np.ndarray) -> dict[int, int]:
        at = np.flatnonzero(mask)
        return {int(nodes.parent[i]): int(i) for i in at}

    ids, roles, uses = child(key_id), child(key_role), [child(k) for k in key_uses]
    for i in roots:
        if live[nodes.text[i]] and nodes.kind[i] == S.OBJECT and not seeds[nodes.text[i]].path:
            objects.add(seeds[nodes.text[i]].line)
    for i in np.flatnonzero(is_message):
        path, offset, _, message = where(int(i))
        role = roles.get(int(i))
        messages.append((seeds[nodes.text[i]].line, offset, path, message, _text_of(nodes.raw(role)) if role is not None and nodes.kind[role] == S.STRING else None))
    for i in np.flatnonzero(is_block):
        i = int(i)
        path, offset, block, message = where(i)
        kind, call = BLOCK_TYPES[type_of[i]], None
        if kind == "tool_use" and i in ids:
            call = _scalar(nodes.raw(ids[i]))
        elif kind == "tool_result":
            for use in uses:
                if call is None and i in use:
                    call = _scalar(nodes.raw(use[i]))
        blocks.append((seeds[nodes.text[i]].line, offset, path, block, message, kind, call))
    # JSON text standing for a message or a content
    par = np.maximum(nodes.parent, 0)
    plain_object = (nodes.parent >= 0) & (nodes.kind[par] == S.OBJECT) & (state[par] == _PLAIN) & ~is_block[par]
    for_content = (nodes.kind == S.STRING) & (nodes.parent >= 0) & key_content & (is_block[par] | is_message[par])
    for_message = (nodes.kind == S.STRING) & key_message & plain_object & ~for_content
    next_texts, next_seeds = [], []
    for i in np.flatnonzero((for_content | for_message) & live[nodes.text]):
        raw = nodes.raw(i)
        if raw[1:].lstrip()[:1] not in (b"{", b"[", b"\\"):
            continue
        text = _text_of(raw)
        if text is None or text.lstrip(" \t\r\n")[:1] not in ("{", "["):
            continue
        path, offset, block, message = where(int(i))
        state_in = (_CONTENT_IN if is_block[par[i]] else _CONTENT_OUT) if for_content[i] else _PLAIN
        if for_message[i] and text.lstrip(" \t\r\n")[:1] != "{":
            continue
        next_texts.append(text.encode("utf-8", "surrogatepass"))
        next_seeds.append(_Seed(seeds[nodes.text[i]].line, state_in, bool(for_message[i]), path, offset, block, message))
    return next_texts, next_seeds


def _flatten(values: list[bytes | None]) -> tuple[list, list, set]:
    """The messages and blocks of the texts, and the places of those that are JSON objects."""
    messages: list = []
    blocks: list = []
    objects: set[int] = set()
    texts, seeds, size = [], [], 0

    def run():
        t, s = texts, seeds
        while t:
            t, s = _round(t, s, messages, blocks, objects)

    for line, value in enumerate(values):
        if value is None or value.lstrip(b" \t\r\n")[:1] != b"{":
            continue
        if texts and size + len(value) > _MAX_BYTES:
            run()
            texts, seeds, size = [], [], 0
        texts.append(value)
        seeds.append(_Seed(line, _PLAIN, False, "", (), "", ""))
        size += len(value)
    run()
    return messages, blocks, objects


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, files, nos = (batch.column(k).to_pylist() for k in ("line_id", "file", "line_no"))
        values = batch.column("value").cast(pa.binary()).to_pylist()
        messages, blocks, objects = _flatten(values)
        rows = [("line", ids[i], files[i], nos[i], i in objects, None, "", "", "", None, None, None, 0) for i in range(len(ids))]
        spot: dict[tuple, int] = {}
        for kind, found in (("message", messages), ("block", blocks)):
            found.sort(key=lambda x: (x[0], x[1]))
            spot.clear()
            for x in found:
                k = spot[x[0]] = spot.get(x[0], -1) + 1
                i = x[0]
                if kind == "message":
                    rows.append((kind, ids[i], files[i], nos[i], True, k, x[2], x[3], x[3], None, x[4], None, x[2].count(".")))
                else:
                    rows.append((kind, ids[i], files[i], nos[i], True, k, x[2], x[3], x[4], x[5], None, x[6], x[2].count(".")))
        columns = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], names=[k for k, _ in _FIELDS])


def latest_lines(lines: DataFrame) -> DataFrame:
    """One row for each line_id: of rows delivered again the one received last."""
    best = F.max(F.struct("received_at", "value", "file", "line_no")).alias("b")
    return lines.where("line_id is not null").groupBy("line_id").agg(best).select("line_id", "b.file", "b.line_no", "b.value")


def flatten(lines: DataFrame) -> DataFrame:
    """Line, message and block rows of ``lines`` (line_id, file, line_no, value, received_at) in one relation."""
    ship(lines.sparkSession)
    return latest_lines(lines).mapInArrow(_batches, SCHEMA)


def link_calls(blocks: DataFrame) -> DataFrame:
    """Each block row with the place of its call: ``use_line_id`` and ``use_path``, (-1, '') where there is none.

    The first call of a (file, id) is found by a partial aggregation before the
    shuffle, so that many calls under one id reach the join as one row.
    """
    first = F.min(F.struct(F.coalesce("line_no", F.lit(2**31 - 1)).alias("no"), "place", "line_id", "path")).alias("u")
    uses = (
        blocks.where("type = 'tool_use' and call_id is not null")
        .groupBy(F.coalesce("file", F.lit("")).alias("u_file"), F.col("call_id").alias("u_id"))
        .agg(first)
        .select("u_file", "u_id", F.col("u.line_id").alias("u_line"), F.col("u.path").alias("u_path"))
    )
    key = F.when(F.col("type") == "tool_result", F.col("call_id"))
    return (
        blocks.withColumn("_key", key)
        .join(uses, (F.coalesce(F.col("file"), F.lit("")) == F.col("u_file")) & (F.col("_key") == F.col("u_id")), "left")
        .withColumn("use_line_id", F.coalesce("u_line", F.lit(-1).cast("bigint")))
        .withColumn("use_path", F.coalesce("u_path", F.lit("")))
        .drop("_key", "u_file", "u_id", "u_line", "u_path")
    )


def found_blocks(lines: DataFrame) -> DataFrame:
    """line_id, block_path, parent_path, use_line_id, use_path: one row for each block."""
    flat = materialise(flatten(lines).where("record = 'block'").select("line_id", "file", "line_no", "place", "path", "parent_path", "type", "call_id"), "blocks")
    return link_calls(flat).select("line_id", F.col("path").alias("block_path"), "parent_path", "use_line_id", "use_path")

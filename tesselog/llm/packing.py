"""Filling containers of a fixed capacity with texts, measured in tokens.

Sum-of-squares packing: with N[g] open containers whose free room is g, each
item goes where the sum of the squares of N grows least.  The items are dealt
to shards by a hash of their place in the table of sizes, so that no shard holds
more than about ``SHARD_ITEMS`` items, pieces of long texts counted, whatever their keys; each shard packs its
items, larger ones first, in one task with O(capacity) state plus its open
containers.  Only (key, piece, size) is shuffled, never a text.

Defined cases: a text longer than a container is split into full containers
and a rest that is packed like any other; null and empty texts have no tokens,
take no room and stand in the first container of their shard; equal ids are
placed one by one; other columns are ignored; no container stays empty unless
a shard has only texts without tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselog.llm.encoding import count_tokens
from tesselog.session import materialise

CAPACITY = 2048
SHARD_ITEMS = 50_000


class SumOfSquares:
    """Open containers by free room; ``place`` puts one item where the sum of squares grows least."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # open containers by free room; 0 and capacity don't count
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.containers = 0
        self._far = np.int64(1) << 60

    def place(self, size: int) -> tuple[int, int]:
        """(container, tokens in it before) for an item of 1 .. capacity tokens."""
        cap, n = self.capacity, self.count
        room = cap
        if size < cap:
            # moving a container from room g to g - size changes the sum by 2 (N[g-size] - N[g] + 1); filling it up by 1 - 2 N[g]
            grow = n[: cap - size] - n[size:cap]
            grow *= 2
            grow += 2
            grow[0] -= 1
            grow[n[size:cap] == 0] = self._far
            at = int(grow.argmin())
            if grow[at] <= 2 * n[cap - size] + 1:
                room = at + size
        if room == cap:
            box = self.containers
            self.containers += 1
        else:
            box = self.open[room].pop()
            n[room] -= 1
        left = room - size
        if left:
            self.open[left].append(box)
            n[left] += 1
        return box, cap - room


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and offset of each item of 0 .. capacity tokens; larger items are placed first, equal ones in order."""
    boxes, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    shop = SumOfSquares(capacity)
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        if sizes[i] > 0:
            boxes[i], offsets[i] = shop.place(int(sizes[i]))
    return boxes, offsets


def _pack(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("piece_no", "ascending")])
        boxes, places = pack_sizes(rows.column("n_tokens").to_numpy(), capacity)
        container = rows.column("shard").to_numpy().astype(np.int64) * (1 << 32) + boxes
        return rows.drop_columns(["shard"]).append_column("container_id", pa.array(container)).append_column("place", pa.array(places))

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece_no, first_token, n_tokens, container_id, place: where each text, or piece of a long one, lies."""
    sizes = materialise(count_tokens(docs, vocabulary=vocabulary), "sizes")
    return pack_counts(sizes, capacity, shard_items)


def pack_counts(sizes: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``pack`` for (doc_id, n_tokens)."""
    n = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)), F.lit(capacity).cast("bigint"))
    pieces = sizes.select("doc_id", n.alias("n"), F.posexplode(starts).alias("piece_no", "first_token")).select(
        "doc_id", F.col("piece_no").cast("bigint").alias("piece_no"), "first_token", F.least(F.lit(capacity), F.col("n") - F.col("first_token")).cast("bigint").alias("n_tokens")
    )
    boxes = sizes.agg(F.sum(F.greatest(F.lit(1), F.ceil(n / capacity)))).first()[0] or 0
    shards = max(1, -(-int(boxes) // shard_items))
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    schema = "doc_id bigint, piece_no bigint, first_token bigint, n_tokens bigint, container_id bigint, place bigint"
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(_pack(capacity), schema)

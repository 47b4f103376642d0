"""Items of varying length into containers of fixed capacity, by best-two-fit.

Items are spread by a hash of their id over shards of a bounded number of containers; each shard is packed by itself, so a
task holds no more than a shard whatever the input's size, and each shard leaves at most one container half empty. A shard
is packed by counts of lengths: a container is filled greedily with the longest length that fits; then its shortest item
gives way to two unpacked items if they fill the widened gap more tightly.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import staged


class _Pool:
    """Unpacked items as counts by length."""

    def __init__(self, sizes: np.ndarray) -> None:
        values, counts = np.unique(sizes, return_counts=True)
        self.lengths: list[int] = values.tolist()
        self.count: dict[int, int] = dict(zip(self.lengths, counts.tolist(), strict=True))

    def take(self, length: int) -> None:
        self.count[length] -= 1
        if not self.count[length]:
            del self.lengths[bisect_left(self.lengths, length)]

    def give(self, length: int) -> None:
        if not self.count.get(length):
            self.lengths.insert(bisect_left(self.lengths, length), length)
            self.count[length] = 0
        self.count[length] += 1

    def longest_within(self, room: int) -> int | None:
        at = bisect_right(self.lengths, room)
        return self.lengths[at - 1] if at else None

    def best_two(self, room: int) -> tuple[int, int] | None:
        """The two items that fill ``room`` most tightly."""
        low, high = 0, bisect_right(self.lengths, room) - 1
        best, pair = -1, None
        while low <= high:
            a, b = self.lengths[low], self.lengths[high]
            if a + b > room:
                high -= 1
                continue
            if (low < high or self.count[a] > 1) and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            low += 1
        return pair


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """The lengths in each container. All sizes are between 1 and the capacity."""
    pool = _Pool(sizes)
    bins = []
    while pool.lengths:
        held: list[int] = []
        room = capacity
        while room and (length := pool.longest_within(room)) is not None:
            pool.take(length)
            held.append(length)
            room -= length
        # the last taken is the shortest
        while room and len(held) > 1 and pool.lengths:
            shortest = held[-1]
            pair = pool.best_two(room + shortest)
            if pair is None or sum(pair) <= shortest:
                break
            held.pop()
            pool.give(shortest)
            for length in pair:
                pool.take(length)
            room += shortest - sum(pair)
            held += sorted(pair, reverse=True)
            held.sort(reverse=True)
        bins.append(held)
    return bins


def _pack(capacity: int):  # noqa: ANN202
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["size", "item", "piece"], kind="stable").reset_index(drop=True)
        sizes = shard["size"].to_numpy()
        container = np.zeros(len(shard), np.int64)
        full = sizes == capacity
        container[full] = np.arange(full.sum())
        loose = np.flatnonzero((sizes > 0) & ~full)
        bins = best_two_fit(sizes[loose], capacity)
        lengths = np.array([x for b in bins for x in b], np.int64)
        owner = np.repeat(np.arange(len(bins)) + full.sum(), [len(b) for b in bins])
        container[loose] = owner[np.argsort(lengths, kind="stable")]  # both by length: items of one length are interchangeable
        return pd.DataFrame({"shard": shard["shard"], "bin": container, "item": shard["item"], "piece": shard["piece"], "start": shard["start"], "size": sizes})

    return run


def packed(items: DataFrame, capacity: int, containers_per_shard: int = 4096, items_per_shard: int = 500_000) -> DataFrame:
    """Each item's container: container, item, piece, start, size.

    ``items``: a unique integer ``item`` and its ``size``. An item above the capacity is split into pieces that fill a
    container each and a rest; ``start`` is where the piece begins. No other item is split. Items without size or with
    size 0 or below take no room and go to the first container of their shard; a shard has no more than about
    ``items_per_shard`` items, whatever their size. Equal items are interchangeable; ties go by
    id, so the result is the same each time. Null items are left out. Empty input gives no rows; other columns are ignored.
    """
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long")
    sized = staged(items.where("item is not null").select(F.col("item").cast("long").alias("item"), size.alias("size")))
    whole = sized.agg(F.sum("size").alias("size"), F.count("*").alias("items")).first()
    shards = max(1, -(-(whole.size or 0) // (capacity * containers_per_shard)), -(-whole.items // items_per_shard))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1).cast("int")), lambda p: F.struct(p.alias("piece"), (p.cast("long") * capacity).alias("start")))
    cut = sized.select("item", "size", F.inline(pieces)).select(
        F.pmod(F.xxhash64("item", "piece"), F.lit(shards)).cast("int").alias("shard"), "item", "piece", "start", F.least(F.col("size") - F.col("start"), F.lit(capacity)).alias("size")
    )
    out = cut.groupBy("shard").applyInPandas(_pack(capacity), "shard int, bin long, item long, piece int, start long, size long")
    return out.select((F.shiftleft(F.col("shard").cast("long"), 32) + F.col("bin")).alias("container"), "item", "piece", "start", "size")


def containers(placed: DataFrame, capacity: int) -> DataFrame:
    """container, items, used, unused of each container."""
    return placed.groupBy("container").agg(F.count("*").alias("items"), F.sum("size").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))

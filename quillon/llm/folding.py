"""Duplicates hidden by formatting: equal but for whitespace, letter case, punctuation or the order of a list.

Text is never rewritten. Its characters stream through a lookup table that skips (0) or folds (lower case) into rolling
polynomial hashes over two bases modulo 2^31 - 1; list entries are hashed alone and added up, so their order does not
matter. Rows whose hashes collide are compared with the smallest row of their group by two pointers that step over what
the table skips. A row that differs from it in spite of equal hashes goes through the same again under another seed, so the
result is exact.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import staged

PRIME = np.uint64(2**31 - 1)


def _fold(code: int) -> int:
    """0 for what is skipped, else the character in lower case: letters, digits and marks stay. A character whose lower case
    takes more than one stays as it is."""
    c = chr(code)
    if unicodedata.category(c)[0] not in "LNM":
        return 0
    low = c.lower()
    return ord(low) if len(low) == 1 else code


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return np.fromiter((_fold(c) for c in range(0x10000)), np.uint32, 0x10000)


class Folded:
    """The characters of a column of texts through the table: where the kept ones are and what they fold to."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_string()).fill_null("")
        rows = len(column)
        first = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[first[0] : first[-1]] if rows else np.zeros(0, np.uint8)
        at = first - first[0]
        if len(raw) and raw.max() >= 128:
            codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            at = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][at]
            folded = _table()[np.minimum(codes, 0xFFFF)]
            for c in np.unique(codes[codes > 0xFFFF]):
                folded[codes == c] = _fold(int(c))
        else:
            folded = _table()[raw]
        keep = folded != 0
        before = np.r_[0, np.cumsum(keep)]
        self.rows = rows
        self.place = np.flatnonzero(keep)
        self.value = folded  # read at ``place`` only
        self.start, self.stop = before[at[:-1]], before[at[1:]]  # of each row, among the kept
        self.size = self.stop - self.start

    def hashes(self, base: int, modulus: np.uint64 = PRIME) -> np.ndarray:
        """The polynomial hash of each row's kept characters."""
        longest = int(self.size.max()) if self.rows else 0
        power = _powers(base, max(longest, 1))
        rank = np.arange(len(self.place)) - np.repeat(self.start, self.size)
        terms = (self.value[self.place].astype(np.uint64) * power[rank]) % PRIME
        total = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
        return (total[self.stop] - total[self.start]) % modulus


@lru_cache(maxsize=8)
def _power_block(base: int, size: int) -> np.ndarray:
    out = np.empty(size, np.uint64)
    out[0] = 1
    done = 1
    while done < size:  # doubling
        step = min(done, size - done)
        factor = np.uint64(pow(base, done, int(PRIME)))
        out[done : done + step] = out[:step] * factor % PRIME
        done += step
    return out


def _powers(base: int, longest: int) -> np.ndarray:
    return _power_block(base, 1 << max(10, (longest - 1).bit_length()))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _bases(seed: int) -> tuple[int, int]:
    rng = np.random.default_rng(seed + 1)
    return tuple(int(b) for b in rng.integers(2**21, 2**31 - 2, 2))


def _entries(column: pa.Array) -> tuple[Folded, np.ndarray]:
    """The entries of a list column and the row of each."""
    column = column.cast(pa.large_list(pa.large_string()))
    sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    return Folded(column.flatten()), np.repeat(np.arange(len(column)), sizes)


def row_hashes(batch: pa.RecordBatch, texts: list[str], lists: list[str], seed: int, modulus: int) -> list[np.ndarray]:
    """Two 64-bit hashes of each row."""
    out = []
    folded = [Folded(batch.column(c)) for c in texts]
    entries = [_entries(batch.column(c)) for c in lists]
    small = np.uint64(modulus)
    for base in _bases(seed):
        h = np.zeros(batch.num_rows, np.uint64)
        for f in folded:
            h = _mix(h + f.hashes(base, small) + (f.size.astype(np.uint64) << np.uint64(32)) * np.uint64(small == PRIME) + np.uint64(1))
        for e, row in entries:
            own = np.where(e.size > 0, _mix(e.hashes(base, small) + np.uint64(7)), np.uint64(0))
            total = np.zeros(batch.num_rows, np.uint64)
            np.add.at(total, row, own)
            h = _mix(h + total)
        if small != PRIME:
            h = h % small
        out.append(h.view(np.int64))
    return out


def _same_text(a: Folded, b: Folded) -> np.ndarray:
    """Two pointers over the kept characters of either side, all rows at once."""
    same = a.size == b.size
    pick = lambda f: f.value[f.place[np.repeat(same, f.size)]]
    differ = np.r_[0, np.cumsum(pick(a) != pick(b))]
    stop = np.cumsum(np.where(same, a.size, 0))
    start = stop - np.where(same, a.size, 0)
    return same & (differ[stop] == differ[start])


def _same_list(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the lists hold the same entries in any order; entries of which nothing is kept don't count."""
    sides = []
    for column in (a, b):
        f, row = _entries(column)
        h = [f.hashes(base) for base in _bases(0)]
        order = np.lexsort((h[1], h[0], f.size, row))
        order = order[f.size[order] > 0]
        sides.append((column.cast(pa.large_list(pa.large_string())).flatten().take(pa.array(order)), row[order]))
    rows = len(a)
    counts = [np.bincount(row, minlength=rows) for _, row in sides]
    same = counts[0] == counts[1]
    left, right = (values.filter(pa.array(same[row])) for values, row in sides)
    alike = _same_text(Folded(left), Folded(right))
    row = sides[0][1][same[sides[0][1]]]
    wrong = np.bincount(row, weights=~alike, minlength=rows)
    return same & (wrong == 0)


def _hashing(texts: list[str], lists: list[str], seed: int, modulus: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = row_hashes(batch, texts, lists, seed, modulus)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h1), pa.array(h2)], names=[*batch.schema.names, "h1", "h2"])

    return run


def _verifying(texts: list[str], lists: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.ones(batch.num_rows, bool)
            for c in texts:
                same &= _same_text(Folded(batch.column(c)), Folded(batch.column(f"first_{c}")))
            for c in lists:
                same &= _same_list(batch.column(c), batch.column(f"first_{c}"))
            keep = ["id", "first_id", *texts, *lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(same)], names=[*keep, "same"])

    return run


def _pass(rows: DataFrame, texts: list[str], lists: list[str], seed: int, modulus: int, hot_share: float, salts: int) -> DataFrame:
    """All rows but the first of each hash group, against that first: id, first_id, the texts, same."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    hashed = staged(rows.mapInArrow(_hashing(texts, lists, seed, modulus), f"{ddl}, h1 long, h2 long"))
    groups = staged(hashed.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    first = hashed.join(groups.select(F.col("first_id").alias("id"), "n"), "id").select("h1", "h2", "n", F.col("id").alias("first_id"), *(F.col(c).alias(f"first_{c}") for c in (*texts, *lists)))
    # groups with more than hot_share of the rows in groups: fewer than 1 / hot_share of them, so they can be broadcast
    total = groups.agg(F.sum("n").alias("total"))
    hot = groups.where(F.col("n") > total.scalar() * hot_share).select("h1", "h2", F.lit(1).alias("hot"))
    salt = F.when(F.col("hot") == 1, F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    spread = F.when(F.col("hot") == 1, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = hashed.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", salt).drop("hot")
    right = first.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", F.explode(spread)).drop("hot", "n")
    paired = left.join(right, ["h1", "h2", "salt"]).where("id <> first_id").drop("h1", "h2", "salt")
    kinds = dict(rows.dtypes)
    out = ", ".join(f"`{c}` {kinds[c.removeprefix('first_')]}" for c in ("id", "first_id", *texts, *lists))
    return staged(paired.mapInArrow(_verifying(texts, lists), f"{out}, same boolean"))


def copies(rows: DataFrame, texts: list[str], lists: list[str], modulus: int = int(PRIME), hot_share: float = 0.001, salts: int = 64) -> DataFrame:
    """Every row that is a copy of another but for formatting: first_id (the smallest id of its group), id.

    ``rows``: a unique ``id``, the ``texts`` columns and the ``lists`` columns (arrays of strings). Skipped are all
    characters but letters, digits and marks. Null and empty texts are equal; null lists, empty lists and list entries
    without kept characters are equal to none; repeated entries count. Records of which nothing is kept are copies of each
    other. Empty input gives no rows. Other columns are ignored. ``modulus`` below the prime makes hashes collide, for tests.
    """
    left = rows.select("id", *texts, *lists)
    found: DataFrame | None = None
    seed = 0
    while True:
        checked = _pass(left, texts, lists, seed, modulus, hot_share, salts)
        good = checked.where("same").select("first_id", "id")
        found = good if found is None else found.unionByName(good)
        left = checked.where("not same").select("id", *texts, *lists)
        if left.isEmpty():
            return found
        seed += 1

"""Mix sources to target shares of the total size.

Whole repeats of a source cost no choice. For what is left of its budget, documents are counted by exact length. The same
fraction of the documents of every length is taken, rounded over neighbouring lengths, so that the choice has the lengths
of its source; that leaves less than one document. A bounded knapsack over the counts of the others (subset sums, longest first) comes as
close to the rest as possible. Then that many are drawn of each length, by a seeded hash. The
driver sees counts by source and length only, for the few sources that have a target.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import staged

#: Documents of one source and length that one task ranks, about.
SLICE = 100_000


def source_key(source: Column) -> Column:
    """One spelling for a source: trimmed, in lower case, words joined by hyphens; null for empty ones."""
    key = F.regexp_replace(F.trim(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", " ")), " ", "-")
    return F.when(key != "", key)


def subset_sum(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length sum up as closely as possible to ``budget`` without passing it.

    Sums that can be reached are bits of one number; for each sum the step that reached it first is kept, in 4 bytes.
    Long ones come first, so few documents make the sum.
    """
    mask = (1 << (budget + 1)) - 1
    first = np.zeros(budget + 1, np.int32)
    lengths = sorted((n for n, k in counts.items() if 0 < n <= budget and k > 0), reverse=True)
    reach = 1
    steps: list[tuple[int, int]] = []  # length, number taken together
    for length in lengths:
        left, part = min(counts[length], budget // length), 1
        while left > 0 and not reach >> budget:
            part = min(part, left)
            new = (reach << (length * part)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(steps)
                steps.append((length, part))
                reach |= new
            left -= part
            part *= 2
    at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    while at:
        length, part = steps[first[at]]  # what it was reached from was reached by an earlier step
        taken[length] = taken.get(length, 0) + part
        at -= length * part
    return taken


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length fill ``budget``: the same fraction of every length, then the subset sum of what is left.

    Rounded down from the longest on, the first part never passes the budget and stays below it by less than the longest
    document, so the knapsack is no larger than that, at any budget.
    """
    available = sum(n * k for n, k in counts.items())
    budget = max(0, min(budget, available))
    taken, seen, rest = {n: 0 for n in counts}, 0, budget
    for n in sorted(counts, reverse=True) if available else ():
        before = seen * budget // available
        seen += counts[n]
        taken[n] = seen * budget // available - before
        rest -= n * taken[n]
    for n, k in subset_sum({n: k - taken[n] for n, k in counts.items()}, rest).items():
        taken[n] += k
    return {n: k for n, k in taken.items() if k}


@dataclass
class Plan:
    """For each source: whole repeats, documents drawn once more by length, and the sizes."""

    source: str
    target: float
    wanted: float
    repeats: int
    drawn: dict[int, int]
    available: int
    budget: int

    @property
    def size(self) -> int:
        return self.repeats * self.available + sum(n * k for n, k in self.drawn.items())


def plan(counts: dict[str, dict[int, int]], targets: list[tuple[str, float, int]], total: int | None = None) -> list[Plan]:
    """Budgets and choices for all sources with a target.

    A target without texts can't be met; its share goes to the others in proportion. Without ``total``, the mix is the
    largest in which every source reaches its share within its repeats.
    """
    size = {s: sum(n * k for n, k in counts.get(s, {}).items()) for s, _, _ in targets}
    usable = [(s, share, most) for s, share, most in targets if size[s] > 0 and share > 0 and most > 0]
    scale = sum(share for _, share, _ in usable)
    if total is None:
        total = min((int(size[s] * most / (share / scale)) for s, share, most in usable), default=0)
    out = []
    for s, share, most in targets:
        mine = (s, share, most) in usable
        wanted = share / scale if mine else 0.0
        budget = min(round(total * wanted), size[s] * most) if mine else 0
        repeats = budget // size[s] if mine else 0
        drawn = fit(counts[s], budget - repeats * size[s]) if mine and repeats < most else {}
        out.append(Plan(s, share, wanted, repeats, drawn, size[s], budget))
    return out


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    ``documents``: a unique ``doc_id``, ``source``, ``tokens``; ``targets``: source, target_share, max_repeats, one row per
    source. The mix has doc_id, source, tokens, repeats (above 0); the report source, target_share, wanted_share (targets
    without texts left out), actual_share, tokens, available, max_repeats for every target. Sources are compared by
    ``source_key``; several targets of one source add up, with the lowest cap. Sources without target are not used.
    Documents of no tokens come along in whole repeats. Missing shares and caps count as 0. Empty inputs give an empty mix.
    """
    spark = documents.sparkSession
    docs = staged(documents.select("doc_id", source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("tokens")).where("doc_id is not null"))
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("most")).where("source is not null")
    goals = [(r.source, r.share, r.most) for r in wanted.groupBy("source").agg(F.sum("share").alias("share"), F.min("most").alias("most")).orderBy("source").collect()]
    named = docs.where(F.col("source").isin([g[0] for g in goals])) if goals else docs.limit(0)
    counts: dict[str, dict[int, int]] = {}
    for r in named.groupBy("source", "tokens").agg(F.count("*").alias("n")).toLocalIterator():
        counts.setdefault(r.source, {})[r.tokens] = r.n
    plans = plan(counts, goals, total)

    whole = spark.createDataFrame([(p.source, p.repeats) for p in plans], "source string, repeats int")
    # plain frames over rows of the driver: Spark broadcasts them as far as its own limit allows
    drawn = spark.createDataFrame([(p.source, n, k, counts[p.source][n]) for p in plans for n, k in p.drawn.items()], "source string, tokens long, k long, n long")
    placed = named.join(whole, "source").join(drawn, ["source", "tokens"], "left")
    plain = placed.where("k is null or k >= n").select("doc_id", "source", "tokens", (F.col("repeats") + F.when(F.col("k") > 0, 1).otherwise(0)).alias("repeats"))
    # the first k by hash among the documents of one source and length; a rank within a slice of them plus the number of
    # documents in the slices before it, so that no task has to rank all documents of one length
    h = F.xxhash64(F.lit(seed), "doc_id")
    hashed = placed.where("k < n").withColumn("h", h).withColumn("slice", F.pmod("h", F.ceil(F.col("n") / SLICE)).cast("long"))
    inside = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("source", "tokens", "slice").orderBy("h", "doc_id")))
    slices = hashed.groupBy("source", "tokens", "slice").agg(F.count("*").alias("m"))
    before = slices.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("source", "tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    once_more = F.when(F.col("rank") + F.col("before") <= F.col("k"), 1).otherwise(0)
    ranked = inside.join(before.drop("m"), ["source", "tokens", "slice"]).select("doc_id", "source", "tokens", (F.col("repeats") + once_more).alias("repeats"))
    mix = plain.unionByName(ranked).where("repeats > 0").withColumn("repeats", F.col("repeats").cast("int"))
    everything = sum(p.size for p in plans)
    caps = {g[0]: g[2] for g in goals}
    report = spark.createDataFrame(
        [(p.source, p.target, p.wanted, p.size / everything if everything else 0.0, p.size, p.available, caps[p.source]) for p in plans],
        "source string, target_share double, wanted_share double, actual_share double, tokens long, available long, max_repeats int",
    )
    return mix, report

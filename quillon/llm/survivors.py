"""The best representative of each duplicate group, by skylines.

A member is dominated if another of its group is at least as good in every dimension and better in one. What is left is
the skyline; the policy, which ranks the dimensions, picks one of it. Members left over form the next layer, and so on;
nulls of the chosen member are filled from the layers in turn.

Groups are never gathered. What lies in the first layers of a group lies in the first layers of any part of it, so every
task first reduces the parts of groups that it holds to their first layers, and only these are brought together by group.
Rows stream through in the order of the policy, so that dominators come first and only a staircase per layer is kept in
memory. How many layers are needed isn't known before: where fields are still empty that some member could fill, more
layers are computed, for these groups only.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import staged

#: Severities from the best known to the least; anything else is unknown.
SEVERITIES = ("critical", "high", "medium", "low", "info")

#: Remediations that give no advice, as letters and digits in lower case.
NO_ADVICE = (
    "na", "nil", "no", "none", "notapplicable", "notavailable", "notprovided", "notspecified", "notset", "null", "nan", "nodata", "noremediation",
    "pending", "placeholder", "seeabove", "seebelow", "tba", "tbc", "tbd", "todo", "undefined", "unknown", "unspecified", "missing", "empty",
    "x", "xx", "xxx", "xxxx", "fixme", "tobedone", "tobedefined", "tobeconfirmed", "tobedetermined",
)


def severity_rank(severity: Column) -> Column:
    """5 for critical to 1 for info, whatever the letter case; 0 for anything else and null."""
    rank = F.lit(0)
    for i, name in enumerate(SEVERITIES):
        rank = F.when(F.lower(severity) == name, F.lit(5 - i)).otherwise(rank)
    return rank


def unit_confidence(confidence: Column) -> Column:
    """The confidence on a scale of 0 to 1: values above 1 are percentages. Null, NaN and values outside are -1, the lowest."""
    usable = confidence.isNotNull() & ~F.isnan(confidence) & (confidence >= 0) & (confidence <= 100)
    return F.when(usable, F.when(confidence > 1, confidence / 100).otherwise(confidence)).otherwise(F.lit(-1.0))


def gives_advice(remediation: Column) -> Column:
    """Whether a remediation says anything. Never null."""
    plain = F.regexp_replace(F.lower(remediation), r"[^\p{L}\p{N}]+", "")
    return F.coalesce((plain != "") & ~plain.isin(*NO_ADVICE), F.lit(False))


class Staircase:
    """Points of two dimensions of which none is dominated; says whether a new one is at or below the stairs."""

    def __init__(self) -> None:
        self.steps: list[tuple] = []  # by the first dimension ascending, hence by the second descending

    def covers(self, a: object, b: object) -> bool:
        """Whether some point is at least as good in both."""
        at = bisect_left(self.steps, (a,))
        return at < len(self.steps) and self.steps[at][1] >= b

    def add(self, a: object, b: object) -> None:
        at = bisect_left(self.steps, (a,))
        stop = at + (at < len(self.steps) and self.steps[at][0] == a and self.steps[at][1] <= b)
        start = at
        while start and self.steps[start - 1][1] <= b:
            start -= 1
        self.steps[start:stop] = []
        insort(self.steps, (a, b))


def _layering(group: str, dims: list[list[str]], depth: int):  # noqa: ANN202
    """Add the layer (from 1) of each row, of rows up to layer ``depth``. They come group by group, best by policy first, so
    a row's first dimension is no better than that of the rows before it, and two dimensions are left to compare."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = object()
        layers: list[Staircase] = []
        for b in batches:
            out = np.zeros(len(b), np.int32)
            keys = b[group].to_numpy()
            left, right = (b[names[0]].to_list() if len(names) == 1 else list(zip(*(b[n] for n in names), strict=True)) for names in dims[1:])
            for i, point in enumerate(zip(left, right, strict=True)):
                if keys[i] != now:
                    now, layers = keys[i], []
                # dominated by a layer means dominated by all before it, so the first that doesn't is found by halving
                low, high = 0, len(layers)
                while low < high:
                    middle = (low + high) // 2
                    if layers[middle].covers(*point):
                        low = middle + 1
                    else:
                        high = middle
                if low == depth:
                    continue
                if low == len(layers):
                    layers.append(Staircase())
                layers[low].add(*point)
                out[i] = low + 1
            yield b.assign(layer=out)[out > 0]

    return run


def layered(rows: DataFrame, group: str, dims: list[list[str]], depth: int) -> DataFrame:
    """``rows`` with their dominance layer in their group, up to layer ``depth``.

    ``dims`` are three dimensions in the order of the policy, each of one column or of several that are compared in turn;
    columns are without nulls, higher is better. A column ``member`` breaks ties, smallest first. Of equal rows the first is
    in a layer and the others behind it; collapse them before where they should share one. Rows of a null group are left out.
    """
    order = [group, *(F.desc(n) for names in dims for n in names), "member"]
    schema = T.StructType([*rows.schema.fields, T.StructField("layer", T.IntegerType())])
    run = _layering(group, dims, depth)
    parts = rows.where(F.col(group).isNotNull()).sortWithinPartitions(*order).mapInPandas(run, schema).drop("layer")
    return parts.repartition(group).sortWithinPartitions(*order).mapInPandas(run, schema)


def chosen(layers: DataFrame, group: str, dims: list[list[str]]) -> DataFrame:
    """The member of each group that the policy prefers among its skyline: group, member."""
    order = F.struct(*(F.col(n) for names in dims for n in names), (-F.col("member")).alias("m"))
    return layers.where("layer = 1").groupBy(group).agg((-F.max(order)["m"]).alias("member"))


def _judged(members: DataFrame) -> DataFrame:
    """Members once each, with what is compared: severity rank and confidence, completeness, time."""
    once = members.select("member_id", "fingerprint", "severity", "confidence", "remediation", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at")).dropDuplicates(["member_id"])
    return once.where("fingerprint is not null and member_id is not null").select(
        "fingerprint", F.col("member_id").cast("long").alias("member"), "severity", severity_rank(F.col("severity")).alias("rank"), unit_confidence(F.col("confidence")).alias("sure"),
        F.when(gives_advice(F.col("remediation")), F.col("remediation")).alias("advice"), "at",
    )


def best_fields(members: DataFrame) -> DataFrame:
    """fingerprint, field, member_id: for each group of two or more, its primary and the member with the latest advice.

    ``members``: member_id (integer), fingerprint, severity, confidence, remediation, observed_at. Rows delivered twice
    under one member_id count once. Either is chosen from a skyline over trust (severity, then confidence), recency and
    completeness (whether it gives advice). For 'primary' trust comes first, then the earliest time, then completeness; for
    'remediation' completeness, then the latest time, then trust, and nobody is chosen where none gives advice. Missing
    times count as the latest for the first and the earliest for the second; remaining ties go to the smallest member_id.
    Groups without fingerprint are left out, as is everything but these columns. Empty input gives no rows.
    """
    judged = staged(
        _judged(members).select("fingerprint", "member", "rank", "sure", F.col("advice").isNotNull().cast("int").alias("complete"), F.coalesce(-F.col("at"), F.lit(-(2**62))).alias("early"), F.coalesce("at", F.lit(-(2**62))).alias("late"))
    )
    policies = {"primary": [["rank", "sure"], ["early"], ["complete"]], "remediation": [["complete"], ["late"], ["rank", "sure"]]}
    several = judged.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max("complete").alias("advised")).where("n > 1")
    out: DataFrame | None = None
    for field, dims in policies.items():
        picked = chosen(layered(judged, "fingerprint", dims, 1), "fingerprint", dims)
        allowed = several if field == "primary" else several.where("advised = 1")
        rows = picked.join(allowed, "fingerprint", "left_semi").select("fingerprint", F.lit(field).alias("field"), F.col("member").alias("member_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def survivors(members: DataFrame, depth: int = 4) -> DataFrame:
    """One record for each fingerprint, built from the layers: fingerprint, member_id, severity, confidence, remediation.

    Dimensions in the order of the policy: trust (severity, then confidence), completeness (fields that say something),
    recency (the day of observation). The chosen member's unknown severity, missing confidence or empty advice is filled
    from the best member of the earliest layer that has one, by policy within the layer. ``depth`` is the number of layers
    computed at first. Same input rules as ``best_fields``.
    """
    fields = {"severity": F.when(F.col("rank") > 0, F.lower("severity")), "confidence": F.when(F.col("sure") >= 0, F.col("sure")), "remediation": F.col("advice")}
    judged = _judged(members).select(
        "fingerprint", "member", "rank", "sure", sum(f.isNotNull().cast("int") for f in fields.values()).alias("complete"),
        F.coalesce(F.floor(F.col("at") / 86_400_000_000), F.lit(-1_000_000)).cast("long").alias("day"), *(f.alias(k) for k, f in fields.items()),
    )
    dims = [["rank", "sure"], ["complete"], ["day"]]
    names = [n for dim in dims for n in dim]
    held = lambda k: F.min(F.when(F.col(k).isNotNull(), F.struct("member", F.col(k).alias("value")))).alias(k)
    cells = staged(judged.groupBy("fingerprint", *names).agg(F.min("member").alias("id"), *(held(k) for k in fields)).withColumnRenamed("id", "member"))
    there = staged(cells.groupBy("fingerprint").agg(*(F.bool_or(F.col(k).isNotNull()).alias(f"has_{k}") for k in fields)))
    order = F.struct("layer", *((-F.col(n)).alias(f"o_{n}") for n in names), F.col("member").alias("m"))
    first = lambda k: F.min_by(F.when(F.col(k).isNotNull(), F.col(f"{k}.value")), F.when(F.col(k).isNotNull(), order)).alias(k)
    built: DataFrame | None = None
    while True:
        made = layered(cells, "fingerprint", dims, depth).groupBy("fingerprint").agg(F.min(order)["m"].alias("member_id"), *(first(k) for k in fields))
        whole = F.lit(True)
        for k in fields:
            whole = whole & (F.col(k).isNotNull() | ~F.col(f"has_{k}"))
        made = staged(made.join(there, "fingerprint").withColumn("whole", whole))
        good = made.where("whole").select("fingerprint", "member_id", F.coalesce("severity", F.lit("unknown")).alias("severity"), "confidence", "remediation")
        built = good if built is None else built.unionByName(good)
        left = made.where("not whole").select("fingerprint")
        if left.isEmpty():
            return built
        cells, depth = staged(cells.join(left, "fingerprint", "left_semi")), depth * 4

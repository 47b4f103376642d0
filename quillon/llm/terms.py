"""How often every distinct term or n-gram occurs, and in how many records.

A suffix array with common-prefix intervals, cut at the longest n-gram asked for:

1. In each record its own suffixes are sorted; a suffix notes how many tokens it shares with the one before it. Where it
   shares n or more, the n-gram at its start has been counted for this record already: these adjacencies are what turns
   occurrences into records.
2. Equal suffixes with equal notes are counted, map-side first, so a token that fills a third of the data is one row.
3. The distinct suffixes are range-partitioned and sorted: the suffix array. A pass over it cuts, for every n, the
   intervals in which neighbours share n tokens. Each interval is one n-gram: its occurrences are the interval's sum, its
   records that sum less the noted adjacencies.
4. An interval may cross the end of a batch or partition; the parts of one n-gram are added up at the end.

No record, term or interval has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.variant import let

#: Joins the tokens of a suffix; sorts before every other character, so joined suffixes sort as lists of tokens do.
SEPARATOR = "\x01"


def _own_suffixes(tokens: Column, max_n: int) -> Column:
    """The suffixes of one record, cut at max_n tokens and sorted, each with the tokens it shares with the one before."""

    def shared(a: Column, b: Column) -> Column:
        first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")

    def noted(ordered: Column) -> Column:
        def note(suffix: Column, i: Column) -> Column:
            before = F.get(ordered, i - 1)
            if max_n == 1:  # one token: it is shared or not
                return F.struct(suffix.alias("suffix"), F.coalesce((before == suffix).cast("int"), F.lit(0)).alias("shared"))
            return F.struct(F.array_join(suffix, SEPARATOR).alias("suffix"), F.when(before.isNull(), F.lit(0)).otherwise(shared(before, suffix)).alias("shared"))

        return F.transform(ordered, note)

    # bound once each, as a lambda evaluates what it names for every element
    cut = tokens if max_n == 1 else let(tokens, lambda all_: F.transform(all_, lambda _, i: F.slice(all_, i + 1, F.lit(max_n))))
    return let(F.array_sort(cut), noted)


def _intervals(max_n: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            parts = b["suffix"].str.split(SEPARATOR, regex=False)
            size = parts.str.len().to_numpy()
            field, count, shared = b["field"].to_numpy(), b["n"].to_numpy(), b["shared"].to_numpy()
            alike = np.zeros(len(b), bool)  # with the row before: same field and same first n tokens
            alike[1:] = field[1:] == field[:-1]
            for n in range(1, max_n + 1):
                token = np.array([p[n - 1] if len(p) >= n else None for p in parts], dtype=object)
                alike = alike & np.r_[False, token[1:] == token[:-1]]
                has = size >= n
                starts = np.flatnonzero(~alike)
                occurs = np.add.reduceat(np.where(has, count, 0), starts)
                repeats = np.add.reduceat(np.where(has & (shared >= n), count, 0), starts)
                keep = occurs > 0
                at = starts[keep]
                if len(at):
                    grams = [SEPARATOR.join(parts.iat[i][:n]) for i in at] if n > 1 else token[at]
                    yield pd.DataFrame({"field": field[at], "size": np.int32(n), "gram": grams, "occurrences": occurs[keep], "records": (occurs - repeats)[keep]})

    return run


def ngrams(records: DataFrame, max_n: int = 1) -> DataFrame:
    """Occurrences and records of all n-grams of up to ``max_n`` tokens.

    ``records``: id, field, tokens (array of strings); one row per record and field. Returns field, size, gram (tokens
    joined by a blank), occurrences, records. Null tokens and lists count as absent, empty tokens are dropped. Rows under
    one (id, field) have to be unique. Empty input gives no rows.
    """
    clean = F.filter("tokens", lambda t: t != "")
    if max_n > 1:
        clean = F.transform(clean, lambda t: F.translate(t, SEPARATOR, " "))
    suffixes = records.select("field", clean.alias("tokens")).select("field", F.inline(_own_suffixes(F.col("tokens"), max_n)))
    counted = suffixes.groupBy("field", "suffix", "shared").agg(F.count("*").alias("n"))
    array = counted.repartitionByRange("field", "suffix").sortWithinPartitions("field", "suffix")
    parts = array.mapInPandas(_intervals(max_n), "field string, size int, gram string, occurrences long, records long")
    return (
        parts.groupBy("field", "size", "gram")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .withColumn("gram", F.translate("gram", SEPARATOR, " "))
    )


def marked(counts: DataFrame, total: DataFrame, rarer_than: int = 3, share: float = 0.05) -> DataFrame:
    """Add mark: 'rare' below ``rarer_than`` records, 'common' above ``share`` of all records, else null.

    ``total`` is one row with the column ``total``. A term that is both (tiny collections) is rare.
    """
    mark = F.when(F.col("records") < rarer_than, F.lit("rare")).when(F.col("records") > F.col("total") * share, F.lit("common"))
    return counts.withColumn("total", total.groupBy().agg(F.sum("total").alias("total")).scalar()).withColumn("mark", mark).drop("total")

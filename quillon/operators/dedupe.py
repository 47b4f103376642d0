"""Rows that were delivered more than once."""

from pyspark.sql import DataFrame


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Keep one row for each key. Rows under one key are redeliveries of the same content, so any of them will do.

    Rows with a null key count as one key. Select the columns you need before, as whole rows are shuffled.
    """
    return df.dropDuplicates(list(keys))

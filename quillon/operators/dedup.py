"""Keep-first dedup layers and split-leakage eviction.

"First" is always the least ``ord``: a DataFrame has no order of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def keep_first(df: DataFrame, keys: list[str], ord: str) -> DataFrame:
    """The row with the least ord of each key, by a grouped minimum over narrow rows.

    A semi-join with the winners follows, so a hot key is pre-aggregated before any shuffle
    and its rows need no common task. Null keys form one group; ord must be unique.
    """
    least = df.groupBy(*keys).agg(F.min(ord).alias(ord)).select(ord)
    return df.join(least, ord, "left_semi")


def rank_in_group(df: DataFrame, keys: list[str], ord: str) -> DataFrame:
    """Adds rn, the place of each row in its key group; for reports on small groups."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(ord)))


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram (group_size, n_groups)."""
    return df.groupBy(*keys).agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("n_groups"))

"""Deterministic sampling, exclusion and slicing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillon.operators.prefix import numbered
from quillon.session import store


def draw_key(key: str, seed: int) -> Column:
    """A uniform order that depends on the key and the seed alone."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def exclude(pool: DataFrame, key: str, *used: DataFrame) -> DataFrame:
    """pool without the keys of any of the used tables (their first column)."""
    every = reduce(DataFrame.union, [u.select(F.col(u.columns[0]).alias(key)) for u in used]).distinct()
    return pool.join(every, key, "left_anti")


def sample(pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in draw order; a top-k, not a full sort. Fewer rows in the pool are an error."""
    out = pool.withColumn("draw", draw_key(key, seed)).orderBy("draw", key).limit(n)
    have = out.count()
    if have < n:
        raise ValueError(f"asked for {n} rows of a pool of {have}")
    return out


def shard_slice(drawn: DataFrame, i: int, k: int, order: str = "draw") -> DataFrame:
    """Slice i of k of an already drawn sample, rn being a row's place in the order, from 0."""
    rows = numbered(drawn, [order], "rn").withColumn("rn", F.col("rn") - 1)
    chunk = -(-drawn.count() // k)
    return rows.where((F.col("rn") >= i * chunk) & (F.col("rn") < (i + 1) * chunk))


def group_split(rows: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """Adds is_train: whole groups go to one side, the share of them with the least draws."""
    groups = store(rows.select(group).distinct().withColumn("draw", draw_key(group, seed))).df
    n = groups.count()
    ranked = numbered(groups, ["draw", group], "at").select(group, ((F.col("at") - 1) / F.lit(max(1, n - 1)) < share).alias("is_train"))
    return rows.join(ranked, group)


def last_n_as_validation(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Adds part: the last n by key (at most all but one) are `val`, the others `train`."""
    n = min(n, max(0, rows.count() - 1))
    last = rows.orderBy(F.desc(key)).limit(n).select(key).withColumn("_val", F.lit(True))
    return rows.join(last, key, "left").withColumn("part", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")

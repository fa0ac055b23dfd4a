"""Running sums, ranks and quantiles without a window over all rows.

Rows are dealt by ranges of the order, summed within each range in parallel, and shifted by
the sums of the ranges before. Only a row for each range and group is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.session import store

#: Offsets (one row for each range and each group that it holds) that are broadcast at most.
SMALL_TABLE = 100_000


def running(rows: DataFrame, order: list, sums: list[str], groups: list[str] | None = None) -> DataFrame:
    """rows with `<c>_upto` for each of sums: the sum of c over the group's rows up to this one.

    rows are computed twice, to sample the ranges and to deal them: store them if that is dear.
    order: columns, perhaps descending; it should be total, for rows that tie are summed in any
    order. groups: names of columns, null being a group; without them all rows are one group.
    """
    groups = groups or []
    held = store(rows.repartitionByRange(*[F.col(g).asc_nulls_first() for g in groups], *order).withColumn("_p", F.spark_partition_id())).df
    within = Window.partitionBy("_p", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranges = held.groupBy("_p", *groups).agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store(ranges.select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g_{g}") for g in groups], *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])).df
    if offsets.count() <= SMALL_TABLE:
        offsets = F.broadcast(offsets)
    same = F.col("_p") == F.col("_q")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = held.withColumns({f"_w_{c}": F.sum(c).over(within) for c in sums}).join(offsets, same)
    return out.select(*rows.columns, *[(F.col(f"_w_{c}") + F.col(f"_o_{c}")).alias(f"{c}_upto") for c in sums])


def numbered(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows with their place in the order, from 1."""
    out = running(rows.withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    return out.drop("_one").withColumnRenamed("_one_upto", name)


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """(groups, one column for each of shares): exact quantiles, linear between neighbours; null values don't count.

    Equal values are counted first, so a task holds counts and not the values of a group.
    """
    groups = groups or []
    counts = store(rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))).df
    at = running(counts, ["_v"], ["_n"], groups)
    totals = store(counts.groupBy(*groups).agg(F.sum("_n").alias("_total"))).df
    if groups:
        named = totals.select(*[F.col(g).alias(f"_t_{g}") for g in groups], "_total")
        same = F.lit(True)
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"_t_{g}"))
        at = at.join(F.broadcast(named) if totals.count() <= SMALL_TABLE else named, same)
    else:
        at = at.crossJoin(F.broadcast(totals))  # one row
    out, cols = at, {}
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_total") - 1)
        for end, k in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            cols[f"_{name}_{end}"] = F.max(F.when((F.col("_n_upto") > k) & (F.col("_n_upto") - F.col("_n") <= k), F.col("_v")))
        cols[f"_{name}_x"] = F.max(place - F.floor(place))
    out = out.groupBy(*groups).agg(*[v.alias(k) for k, v in cols.items()])
    return out.select(*groups, *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_x")).alias(n) for n in shares])

"""Lookups, restrictions and exclusions by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_wins(table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): of rows that share a key the first in the order counts."""
    return table.groupBy(key).agg(F.min_by(value, order).alias(value))


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """rows with value from the row of table that has their key, else the default; table has a key once."""
    known = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    found = F.col("_v") if default is None else F.coalesce("_v", default)
    return rows.join(known, F.col(key) == F.col("_k"), "left").withColumn(value, found).drop("_k", "_v")


def only(rows: DataFrame, wanted: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """The rows whose key is among the wanted ones (column other, or of the same name)."""
    return rows.join(wanted.select(F.col(other or key).alias("_w")), F.col(key) == F.col("_w"), "left_semi")


def without(rows: DataFrame, unwanted: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """The rows whose key isn't among the unwanted ones; a null key is never unwanted."""
    return rows.join(unwanted.select(F.col(other or key).alias("_u")), F.col(key) == F.col("_u"), "left_anti")


def unfinished(events: DataFrame, run: list[str], finished: Column) -> DataFrame:
    """The runs none of whose events says that they finished, once each."""
    return events.groupBy(*run).agg(F.max(F.coalesce(finished, F.lit(False))).alias("_f")).where("not _f").drop("_f")


def existing_variants(items: DataFrame, files: DataFrame, key: str, n: int, variant: str = "v") -> DataFrame:
    """(key, variant) for each item and each of its variants 0 to n - 1 that has a file in files(key, variant)."""
    wanted = items.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(variant))
    return wanted.join(files.select(key, variant).distinct(), [key, variant], "left_semi")


def with_defaults(rows: DataFrame, defaults: DataFrame, builtin: dict[str, object]) -> DataFrame:
    """rows whose null settings come from defaults (one row), else from the built-in values."""
    one = defaults.limit(1).select(*[F.col(c).alias(f"_d_{c}") for c in builtin])
    both = rows.crossJoin(F.broadcast(one))  # one row
    return both.withColumns({c: F.coalesce(F.col(c), F.col(f"_d_{c}"), F.lit(v)) for c, v in builtin.items()}).drop(*[f"_d_{c}" for c in builtin])


def state_of(rules: dict[str, Column], otherwise: str) -> Column:
    """The name of the first rule that holds, in their order."""
    out = F
    for name, rule in rules.items():
        out = out.when(rule, F.lit(name))
    return out.otherwise(F.lit(otherwise))

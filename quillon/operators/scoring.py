"""Feature scaling, logistic scores, AUC and threshold choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillon.operators.prefix import running
from quillon.session import store


def standardize(rows: DataFrame, cols: list[str]) -> DataFrame:
    """z_<col> with the population deviation; a deviation under 1e-9 counts as 1."""
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])  # one row
    scaled = rows.crossJoin(F.broadcast(stats))
    sd = lambda c: F.when(F.col(f"_s_{c}") < 1e-9, 1.0).otherwise(F.col(f"_s_{c}"))
    return scaled.select(*rows.columns, *[((F.col(c) - F.col(f"_m_{c}")) / sd(c)).alias(f"z_{c}") for c in cols])


def logistic(cols: list[str], weights: list[float], bias: float) -> Column:
    z = F.lit(bias)
    for c, w in zip(cols, weights):
        z = z + F.col(c) * w
    return 1 / (1 + F.exp(-z))


def fit_logistic(rows: DataFrame, cols: list[str], label: str = "y", l2: float = 1e-3):
    """A pyspark.ml model; the intercept isn't regularised and features are taken as they are."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=cols, outputCol="features").transform(rows)
    return LogisticRegression(labelCol=label, regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(data)


def cumulative(rows: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """(p, a, b, tp, fp, pos, neg): of each distinct score the rows with it and those at or above it, by label."""
    by = store(rows.groupBy(F.col(score).alias("p")).agg(F.sum(label).alias("a"), F.sum(1 - F.col(label)).alias("b"))).df
    upto = running(by, [F.desc("p")], ["a", "b"])
    every = store(by.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("pos"), F.coalesce(F.sum("b"), F.lit(0)).alias("neg"))).df  # one row
    return upto.withColumnsRenamed({"a_upto": "tp", "b_upto": "fp"}).crossJoin(F.broadcast(every))


def roc_auc(rows: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """One row, auc: trapezoids over distinct scores, so ties count half; null with one class."""
    c = cumulative(rows, score, label)
    area = F.sum(F.col("b") * (2 * F.col("tp") - F.col("a")) / 2)
    return c.agg(F.when(F.max("pos") * F.max("neg") > 0, area / (F.max("pos") * F.max("neg"))).alias("auc"))


def cohens_d(rows: DataFrame, cols: list[str], label: str = "y") -> DataFrame:
    """(feature, d): |difference of means| over the pooled population deviation (0 counts as 1e-9)."""
    stacked = rows.select(label, F.explode(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "v"))
    g = stacked.groupBy("feature").agg(*[f(F.when(F.col(label) == k, F.col("v"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("s", F.var_pop))])
    pooled = F.sqrt((F.col("s0") + F.col("s1")) / 2)
    return g.select("feature", (F.abs(F.col("m0") - F.col("m1")) / F.when(pooled == 0, 1e-9).otherwise(pooled)).alias("d"))


def poison_threshold(rows: DataFrame, score: str = "p", label: str = "y", most: float = 0.01) -> DataFrame:
    """One row: the cutoff t that keeps (p < t) most clean rows (y = 0) with at most this share of
    the poisoned ones; the lowest of equals, and the least score where none qualifies."""
    c = cumulative(rows, score, label).select("p", (F.col("neg") - F.col("fp")).alias("kept"), ((F.col("pos") - F.col("tp")) / F.greatest(F.col("pos"), F.lit(1))).alias("admitted"))
    best = F.max(F.when(F.col("admitted") <= most, F.struct(F.col("kept"), (-F.col("p")).alias("np"))))
    return c.agg(F.coalesce(-best["np"], F.min("p")).alias("threshold"), F.coalesce(best["kept"], F.lit(0)).alias("kept"))

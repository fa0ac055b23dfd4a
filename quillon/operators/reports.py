"""Report rollups: counts, summaries, rankings, pixel statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.operators.prefix import quantiles


def gate_rates(fates: DataFrame) -> DataFrame:
    """Shares of the pool (at least 1) that each layer removed, that all of them did, and that leaked."""
    pool = F.greatest(F.lit(1), F.count_if(F.col("fate") != "reference"))
    rate = lambda *names: F.round(F.count_if(F.col("fate").isin(*names)) / pool, 5)
    return fates.agg(rate("exact").alias("exact_rate"), rate("norm").alias("norm_rate"), rate("phash").alias("phash_rate"), rate("exact", "norm", "phash").alias("dedup_rate"), rate("bench", "held-out").alias("leak_rate"))


def throughput(pool: DataFrame, hash_s: float, gate_s: float, target: int = 5_000_000) -> DataFrame:
    """Rows a second (of the pool) and the hours that the target would take."""
    rate = F.count("*") / F.lit(hash_s + gate_s)
    return pool.agg(F.count("*").alias("pool"), F.round(rate, 2).alias("per_second"), F.round(target / rate / 3600, 2).alias("hours_for_5m"))


def distance_blocks(rows: DataFrame, kind: str = "kind", d: str = "d") -> DataFrame:
    """Least, mean, greatest and percentiles (cut to whole numbers) of the distances of each kind."""
    q = quantiles(rows, d, {f"p{p}": p / 100 for p in (50, 90, 95, 99)}, [kind])
    sums = rows.groupBy(F.col(kind).alias("_k")).agg(F.min(d).alias("min_d"), F.round(F.avg(d), 2).alias("mean_d"), F.max(d).alias("max_d"))
    return sums.join(q, F.col("_k").eqNullSafe(F.col(kind))).select(kind, "min_d", "mean_d", "max_d", *[F.floor(c).cast("int").alias(c) for c in ("p50", "p90", "p95", "p99")])


def flag_counts(rows: DataFrame, reject: str = "reject", warn: str = "warn") -> DataFrame:
    every = F.concat(F.transform(reject, lambda x: F.concat(F.lit("R:"), x)), F.transform(warn, lambda x: F.concat(F.lit("W:"), x)))
    return rows.select(F.explode(every).alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag")


def by_tier(rows: DataFrame, shard: str, tier: str, tiers: list[str]) -> DataFrame:
    """Counts by shard and tier, tiers as columns in lower case, with totals."""
    return rows.groupBy(F.col(shard).alias("shard")).agg(*[F.count_if(F.col(tier) == t).alias(t.lower()) for t in tiers], F.count("*").alias("total"))


def audit_summary(rows: DataFrame, metric: str, rules: dict[str, str]) -> DataFrame:
    hits = {k: F.coalesce(F.expr(v), F.lit(False)) for k, v in rules.items()}
    any_hit = F.lit(False)
    for h in hits.values():
        any_hit = any_hit | h
    return rows.agg(F.count("*").alias("total"), F.count(metric).alias("scored"), F.count_if(any_hit).alias("flagged"), *[F.count_if(h).alias(f"n_{k}") for k, h in hits.items()])


def worst(rows: DataFrame, metric: str, ties: list[str], k: int) -> DataFrame:
    """The k rows with the greatest metric (missing counts as 0), ties by name."""
    return rows.orderBy(F.desc(F.coalesce(F.col(metric), F.lit(0))), *ties).limit(k)


def calibration(rows: DataFrame, family: str = "family", feature: str = "feature", v: str = "v") -> DataFrame:
    """n, mean, deviation and exact tenths of each family and feature; null values don't count."""
    rows = rows.where(F.col(v).isNotNull())
    q = quantiles(rows, v, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, [family, feature])
    sums = rows.groupBy(F.col(family).alias("_f"), F.col(feature).alias("_g")).agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("sd"))
    both = sums.join(q, F.col("_f").eqNullSafe(F.col(family)) & F.col("_g").eqNullSafe(F.col(feature)))
    return both.select(family, feature, "n", "mean", "sd", *[F.round(p, 4).alias(p) for p in ("p10", "p50", "p90")])


def eval_means(rows: DataFrame, variant: str, metric: str, error: str = "error") -> DataFrame:
    ok = F.when(F.col(error).isNull(), F.col(metric))
    return rows.groupBy(variant).agg(F.count(ok).alias("n"), F.round(F.avg(ok), 6).alias("mean"))


def speedups(rows: DataFrame, baseline: str, config: str = "config", value: str = "value") -> DataFrame:
    best = rows.groupBy(config).agg(F.max(value).alias("best"))
    base = best.where(F.col(config) == baseline).select(F.col("best").alias("_b"))  # at most one row
    return best.join(F.broadcast(base), how="left").select(config, F.round("best", 6).alias("best"), F.round(F.col("best") / F.col("_b"), 6).alias("speedup"))


def mode(rows: DataFrame, group: str, label: str) -> DataFrame:
    """The most frequent label of each group, the lowest of equals."""
    counts = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.max(F.struct("n", (-F.col(label)).alias("l"))).alias("m")).select(group, (-F.col("m.l")).alias(label))


def colour_histogram(pixels: DataFrame, step: int) -> DataFrame:
    return pixels.groupBy(*[F.floor(F.col(k) / step).cast("int").alias(f"{k}{step}") for k in "rgb"]).agg(F.count("*").alias("n"))


def boundary_parts(cells: DataFrame, width: int, image: str = "vec_id") -> DataFrame:
    """Sums for a boundary F1: a cell is on an edge if it differs from the one right of or below it."""
    both = cells.select(image, F.explode(F.array(F.when(F.col("i") % width > 0, F.col("i") - 1), F.col("i") - width)).alias("i"), F.col("t").alias("t2"), F.col("p").alias("p2"))
    e = cells.join(both, [image, "i"]).groupBy(image, "i").agg(F.max((F.col("t") != F.col("t2")).cast("long")).alias("tb"), F.max((F.col("p") != F.col("p2")).cast("long")).alias("pb"))
    return e.groupBy(image).agg(F.sum(F.col("tb") * F.col("pb")).alias("hit"), F.sum("tb").alias("true_edges"), F.sum("pb").alias("found_edges"))


def boundary_f1(parts: DataFrame, group: str) -> DataFrame:
    """(group, precision, recall, f1) from boundary_parts' sums; null without edges on either side."""
    sums = parts.groupBy(group).agg(*[F.sum(c).alias(c) for c in ("hit", "true_edges", "found_edges")])
    both = (F.col("true_edges") > 0) & (F.col("found_edges") > 0)
    p, r = F.when(both, F.col("hit") / F.col("found_edges")), F.when(both, F.col("hit") / F.col("true_edges"))
    return sums.select(group, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).when(both, 0.0).alias("f1"))


def pixel_accuracy(cells: DataFrame, group: str, truth: str = "t", found: str = "p") -> DataFrame:
    """(group, accuracy): share of cells whose labels agree."""
    return cells.groupBy(group).agg(F.avg((F.col(truth) == F.col(found)).cast("double")).alias("accuracy"))


def epoch_means(rows: DataFrame, epoch: str = "epoch", loss: str = "loss", items: str = "items") -> DataFrame:
    """(epoch, mean): losses of batches weighted by their items; without items 0."""
    return rows.groupBy(epoch).agg((F.coalesce(F.sum(F.col(loss) * F.col(items)), F.lit(0.0)) / F.greatest(F.sum(items), F.lit(1))).alias("mean"))


def leaderboard(rows: DataFrame, run: str = "user_id", epoch: str = "epoch", value: str = "value") -> DataFrame:
    """The least value of each run and the first epoch that had it."""
    best = F.min(F.struct(value, epoch))
    return rows.groupBy(run).agg(best.alias("b")).select(run, F.col(f"b.{epoch}").alias("epoch"), F.round(f"b.{value}", 6).alias("best"))


def region_ids(pixels: DataFrame, image: str, key: str) -> DataFrame:
    """region: dense numbers by ascending key within an image, key 0 being region 0."""
    keys = pixels.select(image, key).where(F.col(key) != 0).distinct()
    keys = keys.withColumn("region", F.row_number().over(Window.partitionBy(image).orderBy(key)).cast("long"))
    return pixels.join(keys, [image, key], "left").fillna(0, ["region"])


def audit_flags(pixels: DataFrame, image: str, declared: int | None, limits: dict[str, float]) -> DataFrame:
    """QC metrics and flags of each image from its pixel table (r, g, b, label, error).

    A blank image raises neither coverage nor empty-label flags; without a declared palette
    size the palette isn't checked.
    """
    from quillon.functions.columns import is_ink

    m = pixels.groupBy(image).agg(F.avg(is_ink("r", "g", "b").cast("double")).alias("ink"), F.avg((F.col("label") > 0).cast("double")).alias("lab"), F.avg("error").alias("mae"), F.count_distinct("label").alias("used"))
    blank, delta = F.col("ink") < limits["blank"], F.abs(F.col("ink") - F.col("lab"))
    flags = [F.when(blank, "blank"), F.when(~blank & (F.col("lab") == 0), "labels-empty"), F.when(~blank & (delta > limits["coverage"]), "coverage-mismatch"), F.when(F.col("mae") > limits["reconstruction"], "high-reconstruction")]
    if declared is not None:
        flags.append(F.when(F.col("used") < declared, "palette-mismatch"))
    return m.select(image, F.round("ink", 5).alias("ink_frac"), F.round("lab", 5).alias("label_nonzero_frac"), F.round(delta, 5).alias("coverage_delta"), F.round("mae", 4).alias("reconstruction_mae"), F.concat_ws(",", *flags).alias("flags"))

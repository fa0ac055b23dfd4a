"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources get shares of the word budget by weight, none above a limit of epochs. A source's
target is taken as complete epochs of all its documents, then a fraction: documents get
exponential keys, -ln(u) / w with u from a hash of the key column and w a quality weight,
and the least keys are taken until the rest of the budget is used up.

The prefix sum over a source's keys is not a sort of the source: sizes are summed by
(source, key bucket), a running sum over the buckets finds the one in which the budget ends,
and only that bucket's documents (at most about one in a thousand, fewer of a large table)
are ordered. Buckets are even up to a key of 16 and grow with the key beyond, so sources of
nothing but poor documents, whose keys are large, are spread as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.session import store

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
BUDGET, EPOCHS = 1.5, 2
#: Columns that mix adds.
ADDED = ["size", "source_size", "target", "es_key", "taken", "copies"]
#: Key buckets: for a unit of the key at least KEY_SCALE, and one for every KEY_ROWS rows.
KEY_SCALE, KEY_ROWS = 1024, 50_000


def with_keys(docs: DataFrame, key: str, text: str, source: str, seed: int, scale: int = KEY_SCALE) -> DataFrame:
    """Adds size (words), source (cast to string), es_key and its bucket; null text has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"size": F.regexp_count(t, F.lit(WORD)).cast("long"), "_sym": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"), "_src": F.col(source).cast("string")})
    weight = F.when(F.col("size") > 0, F.col("size").cast("double") / (F.col("size") + 10 * F.col("_sym"))).otherwise(F.lit(1.0))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    out = out.withColumn("es_key", -F.log(u) / weight).drop("_sym")
    x = F.col("es_key")
    return out.withColumn("_b", F.floor(F.when(x < 16, x * scale).otherwise(16 * scale * (1 + F.log(x / 16)))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(_src, source_size, target) from (_src, source_size), one row a source, null last.

    The sources themselves, a row each however many documents they have, are ordered in one task.

    Shares go by weight; a source whose share exceeds epochs times its size stops there, and
    the excess goes to the others by weight, until none is above.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    order = Window.orderBy(F.col("_src").asc_nulls_last())
    out = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("cap", F.col("source_size") * epochs)
    by_ratio = Window.orderBy(F.col("cap").cast("double") / F.col("w"), F.col("_src").asc_nulls_last())
    before, on = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    out = out.withColumns({"_c": F.coalesce(F.sum("cap").over(before), F.lit(0)), "_w": F.sum("w").over(on), "_t": F.sum("source_size").over(whole)})
    out = out.withColumn("_l", (F.col("_t").cast("double") * budget - F.col("_c")) / F.col("_w"))
    level = F.min(F.when(F.col("cap").cast("double") / F.col("w") >= F.col("_l"), F.struct(F.col("cap").cast("double") / F.col("w"), F.col("_l").alias("l")))).over(whole)
    out = out.withColumn("_level", F.coalesce(level["l"], F.lit(float("inf"))))
    return out.select("_src", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("_level")).alias("target"))


def _keyed(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """docs with keys, buckets that suit its number of rows, and a tie-breaker from the text."""
    scale = max(KEY_SCALE, docs.count() // KEY_ROWS)
    return with_keys(docs, key, text, source, seed, scale).withColumn("_tie", F.md5(F.col(text)))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = 1, boundary: str = "split", narrow: bool = False) -> DataFrame:
    """docs with size, source_size, target, es_key, taken and copies added (such columns are replaced).

    taken counts words, repeats included; copies is the number of times that the document is
    taken, its last one perhaps in part. boundary says what becomes of the document at which
    the budget ends: `split` takes the words that are left, so a source's words reach its
    target (rounded down); `nearest` takes it whole if at least half fits. The null source is
    a source, the last one. A null or wordless text has the size 0 and takes 0. Ties of keys
    go by key column, then by text; repeated rows are separate documents with equal keys.
    Draws depend on the key column and the seed alone, so reruns agree. narrow keeps the key
    column alone beside those added. Texts are read once for their keys, and rows with their
    keys are stored, so the later steps read a few numbers a row and the columns they return.
    """
    names = [key] if narrow else [c for c in docs.columns if c not in ADDED]
    out = _taken(_packed(docs, names, key, text, source, seed), "_key", weights, budget, epochs, boundary)
    return out.select("_row.*", *ADDED)


def _packed(docs: DataFrame, names: list[str], key: str, text: str, source: str, seed: int) -> DataFrame:
    """Rows packed into one column, so that no name of theirs meets a name used here, and their keys."""
    one = lambda c, name: F.col(f"`{c}`").alias(name)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), one(key, "_key"), one(text, "_text"), one(source, "_source"))
    return _keyed(packed, "_key", "_text", "_source", seed).drop("_text", "_source")


def _taken(rows: DataFrame, key: str, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, boundary: str = "split") -> DataFrame:
    """mix of rows that have their keys."""
    if boundary not in ("split", "nearest"):
        raise ValueError("boundary is split or nearest")
    rows = store(rows).df
    buckets = store(rows.groupBy("_src", "_b").agg(F.sum("size").alias("n"))).df
    goal = targets(buckets.groupBy("_src").agg(F.sum("n").alias("source_size")), weights, budget, epochs)
    goal = goal.withColumn("_e", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = store(goal.withColumn("_rest", F.floor(F.col("target") - F.col("_e") * F.col("source_size")).cast("long"))).df
    upto = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ends = buckets.withColumn("_cum", F.sum("n").over(upto)).withColumnRenamed("_src", "_s").join(goal, F.col("_s").eqNullSafe(F.col("_src")))
    ends = ends.where(F.col("_cum") > F.col("_rest")).groupBy("_s").agg(F.min(F.struct("_b", (F.col("_cum") - F.col("n")).alias("before"))).alias("m")).select("_s", F.col("m._b").alias("_at"), F.col("m.before").alias("_before"))
    plan = store(goal.join(ends, goal["_src"].eqNullSafe(ends["_s"]), "left").select(F.col("_src").alias("_p"), "source_size", "target", "_e", "_rest", F.coalesce("_at", F.lit((1 << 63) - 1)).alias("_at"), F.coalesce("_before", F.lit(0)).alias("_before"))).df
    plan = F.broadcast(plan) if plan.count() <= 10_000 else plan
    rows = rows.join(plan, rows["_src"].eqNullSafe(plan["_p"]))
    clear = rows.where("_b <> _at").withColumns({"_extra": F.when(F.col("_b") < F.col("_at"), F.col("size")).otherwise(F.lit(0)), "_one": (F.col("_b") < F.col("_at")).cast("int")})
    run = Window.partitionBy("_src").orderBy("es_key", F.col(key).asc_nulls_last(), F.col("_tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where("_b = _at").withColumn("_left", F.col("_rest") - F.col("_before") - (F.sum("size").over(run) - F.col("size")))
    if boundary == "split":
        edge = edge.withColumn("_extra", F.greatest(F.lit(0), F.least("size", "_left"))).withColumn("_one", (F.col("_extra") > 0).cast("int"))
    else:
        edge = edge.withColumn("_one", ((F.col("_left") > 0) & (F.col("_left") * 2 >= F.col("size"))).cast("int")).withColumn("_extra", F.col("_one") * F.col("size"))
    out = clear.unionByName(edge.drop("_left"))
    out = out.withColumns({"taken": (F.col("_e") * F.col("size") + F.col("_extra")).cast("long"), "copies": (F.col("_e") + F.col("_one")).cast("int")})
    return out.drop("_src", "_b", "_tie", "_p", "_e", "_rest", "_at", "_before", "_extra", "_one")


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = 1, boundary: str = "nearest") -> DataFrame:
    """The mix itself: each document once for every time that it is taken, columns as in docs.

    Null, empty and wordless texts are in no mix; repeated rows are taken one by one; an empty
    table gives no rows; a text of any length counts whole.
    """
    out = _taken(_packed(docs, docs.columns, key, text, source, seed), "_key", weights, budget, epochs, boundary)
    return out.where("copies > 0").withColumn("_i", F.explode(F.expr("sequence(1, copies)"))).select("_row.*")

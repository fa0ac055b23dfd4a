"""Hamming similarity: fingerprints, band join, leakage matching, clusters, the gate, census."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quillon.operators.graph import connected_components
from quillon.operators.prefix import numbered, quantiles
from quillon.operators.sampling import draw_key
from quillon.session import store

#: References whose hashes (8 bytes each) go to the tasks in one pass, and bytes of text that are hashed at once.
HEADS, WINDOW_BYTES = 4_000_000, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def coefficient_bits(block: Column) -> Column:
    """64 bits as an array: each coefficient above the median of the 63 behind the first."""
    middle = F.sort_array(F.slice(block, 2, 63))[31]
    return F.transform(block, lambda x: F.when(x > middle, F.lit(1)).otherwise(F.lit(0)))


def pack_bits(bits: Column) -> Column:
    """64 bits, first one highest, as a long in two's complement."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def dct_matrix(n: int) -> np.ndarray:
    """Rows of the orthonormal cosine transform (type II) of n samples."""
    k = np.arange(n)
    return np.sqrt(np.where(k == 0, 1.0, 2.0) / n)[:, None] * np.cos(np.pi * np.outer(k, 2 * k + 1) / (2 * n))


def coefficients(rows: DataFrame, gray: str = "gray", out: str = "block") -> DataFrame:
    """rows with the 64 lowest coefficients, row by row, of a square grey image of 8x8 pixels or more.

    Null for a null image, one that isn't square, or one that is smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis: dict[int, np.ndarray] = {}
        for b in batches:
            blocks = []
            for v in b.column(gray):
                side = round(len(v) ** 0.5) if v.is_valid else 0
                if side < 8 or side * side != len(v):
                    blocks.append(None)
                    continue
                m = basis.setdefault(side, dct_matrix(side)[:8])
                blocks.append((m @ v.values.to_numpy(zero_copy_only=False).reshape(side, side) @ m.T).ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.list_(pa.float64()))], names=[*b.schema.names, out])

    rows = rows.withColumn(gray, F.col(gray).cast("array<double>"))
    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("array<double>").alias(out)).schema)


def degenerate(gray: Column) -> Column:
    """Too flat to be told apart: deviation below 8, or ink (below 250) on under 2 % or over 98 % of the pixels."""
    n = F.size(gray)
    total = lambda f: F.aggregate(gray, F.lit(0.0), lambda a, x: a + f(x)) / n
    mean = total(lambda x: x)
    ink = total(lambda x: F.when(x < 250, 1.0).otherwise(0.0))
    return (F.sqrt(F.aggregate(gray, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n) < 8) | (ink < 0.02) | (ink > 0.98)


def fingerprints(rows: DataFrame, gray: str = "gray") -> DataFrame:
    """rows with render_ok, degenerate and phash, from a grey image as an array of doubles.

    Without an image (null, not square or under 8x8) render_ok is false; a degenerate image
    has no phash; neither is an error.
    """
    out = coefficients(rows, gray, "_block")
    ok = F.col("_block").isNotNull()
    out = out.withColumns({"render_ok": ok, "degenerate": ok & F.coalesce(degenerate(F.col(gray)), F.lit(False))})
    return out.withColumn("phash", F.when(ok & ~F.col("degenerate"), pack_bits(coefficient_bits(F.col("_block"))))).drop("_block")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Bands and bits flipped within each, for the choice of the cheapest.
_BANDS = range(1, 65)
#: A value's key in a join costs about as much as so many candidates that are only compared; keys that a value may have at most.
KEY_COST, MOST_KEYS = 4, 4096
#: Heads of references that are broadcast at most (12 bytes each).
SMALL_TABLE = 1_000_000


def _cuts(bands: int) -> list[tuple[int, int]]:
    at = [64 * i // bands for i in range(bands + 1)]
    return list(zip(at, at[1:]))


def _ball(width: int, flips: int) -> list[int]:
    """Masks of a band of this width with at most so many bits set."""
    out = [0]
    for k in range(1, min(flips, width) + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(width), k)]
    return out


def band_plan(n: int, m: int, radius: int) -> tuple[int, int]:
    """(bands, flips) by which n values find those of m within the radius at the least cost.

    Values within the radius differ by at most radius // bands bits in one of the bands, so
    with that many flips tried in each band none is missed. Few wide bands mean many tries,
    many narrow ones many candidates; what is cheapest depends on how many values there are.
    """

    def cost(bands: int) -> float:
        flips, total = radius // bands, 0.0
        for a, b in _cuts(bands):
            tries = sum(comb(b - a, k) for k in range(min(flips, b - a) + 1))
            if tries * bands > MOST_KEYS:
                return float("inf")
            total += KEY_COST * (n * tries + m) + n * m * tries / 2.0 ** (b - a)
        return total

    best = min((x for x in _BANDS if x <= radius + 1), key=cost)
    return best, radius // best


def near_values(left: DataFrame, right: DataFrame, radius: int, plan: tuple[int, int] | None = None) -> DataFrame:
    """(va, vb, d): all pairs of a value of left and one of right that differ in at most radius bits.

    left and right have one column, v, of distinct longs. An equi-join on (band, bits, with
    some of them flipped) finds every pair; it is kept where its first such band says, so no
    pair comes twice and no distinct follows. The plan is chosen for the numbers of values.
    """
    if not 0 <= radius <= 64:
        raise ValueError("radius is a number of bits, 0 to 64")
    if plan is None:
        n = left.count()
        plan = band_plan(n, n if right is left else right.count(), radius)
    bands, flips = plan
    cuts = _cuts(bands)
    bits = lambda v, a, b: F.shiftrightunsigned(F.shiftleft(v, 64 - b), 64 - (b - a))
    v = F.col("v")
    exact = F.array(*[F.struct(F.lit(i).alias("band"), bits(v, a, b).alias("bits")) for i, (a, b) in enumerate(cuts)])
    tried = exact
    if flips:
        masks = lambda n: F.array(*[F.lit(x if x < 1 << 63 else x - (1 << 64)).cast("long") for x in _ball(n, flips)])
        around = lambda i, a, b: F.transform(masks(b - a), lambda x: F.struct(F.lit(i).alias("band"), bits(v, a, b).bitwiseXOR(x).alias("bits")))
        tried = F.concat(*[around(i, a, b) for i, (a, b) in enumerate(cuts)])
    pairs = left.select(v.alias("va"), F.explode(tried).alias("k")).join(right.select(v.alias("vb"), F.explode(exact).alias("k")), "k")
    gap = F.col("va").bitwiseXOR(F.col("vb"))
    first = F.coalesce(*[F.when(F.bit_count(bits(gap, a, b)) <= flips, F.lit(i)) for i, (a, b) in enumerate(cuts)])
    return pairs.withColumn("d", F.bit_count(gap)).where((F.col("d") <= radius) & (first == F.col("k.band"))).select("va", "vb", "d")


def band_pairs(hashes: DataFrame, radius: int, id: str = "id", value: str = "h") -> DataFrame:
    """(a, b, d), a < b, of all rows whose hashes differ in at most radius bits.

    Distinct values meet first, so a value that very many rows have takes part once; its
    rows are then paired, as many pairs as there are. Null values match nothing.
    """
    rows = store(hashes.where(F.col(value).isNotNull()).select(F.col(id).alias("i"), F.col(value).alias("v"))).df
    values = rows.select("v").distinct()
    near = near_values(values, values, radius)
    left, right = rows.toDF("a", "va"), rows.toDF("b", "vb")
    return left.join(near, "va").join(right, "vb").where("a < b").select("a", "b", "d")


def hamming_clusters(hashes: DataFrame, radius: int, id: str = "id", value: str = "h", plan: tuple[int, int] | None = None) -> DataFrame:
    """(id, cluster): single-linkage clusters, named by their least id; null hashes are left out."""
    rows = store(hashes.where(F.col(value).isNotNull()).select(F.col(id).alias("id"), F.col(value).alias("v"))).df
    lead = store(rows.groupBy("v").agg(F.min("id").alias("lead"))).df
    values = lead.select("v")
    edges = near_values(values, values, radius, plan).where("va < vb")
    ends = edges.join(lead.toDF("va", "a"), "va").join(lead.toDF("vb", "b"), "vb")
    comps = connected_components(ends.select("a", "b")).toDF("lead", "c")
    named = lead.join(comps, "lead", "left").select("v", F.coalesce("c", "lead").alias("c"))
    return rows.join(named, "v").select("id", F.col("c").alias("cluster"))


def leaked(records: DataFrame, references: DataFrame, keys: list[str], ord: str = "ord", fingerprint: str | None = None, radius: int = 0, plan: tuple[int, int] | None = None) -> DataFrame:
    """ord of the records that share any one of the keys with a reference, or have a fingerprint
    within the radius of one; null keys and fingerprints match nothing.

    One semi-join for each key, united: a join on "this or that" would be a nested loop.
    """
    parts = [records.where(F.col(k).isNotNull()).join(references.select(k).distinct(), k, "left_semi").select(ord) for k in keys]
    if fingerprint is not None:
        values = lambda t: t.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias("v")).distinct()
        found = near_values(values(references), values(records), radius, plan).select(F.col("vb").alias(fingerprint)).distinct()
        parts.append(records.join(found, fingerprint, "left_semi").select(ord))
    return reduce(DataFrame.union, parts).distinct()


def _windows(col: pa.Array, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, row, place of the window in the row, hash) of all windows of n words, for texts of words joined by single spaces."""
    col = pc.binary_join_element_wise(col.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    first = 0
    while first < len(col):  # as many texts as fit, or one
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + WINDOW_BYTES, "right")) - 1)
        b = np.frombuffer(col.buffers()[2], np.uint8)[offs[first] : offs[last]]
        power, back, total = np.full(len(b), _BASE), np.full(len(b), _BACK), np.zeros(len(b) + 1, np.uint64)
        power[0] = back[0] = 1
        power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64, out=total[1:])
        end = np.flatnonzero(b == 32) + 1
        start = np.concatenate(([0], end[:-1]))
        row = np.searchsorted(offs[first + 1 : last + 1] - offs[first], start, "right")
        place = np.arange(len(row)) - np.searchsorted(row, row)
        for n in lengths:
            if len(end) >= n:
                whole = row[: len(row) - n + 1] == row[n - 1 :]
                s, e = start[: len(row) - n + 1][whole], end[n - 1 :][whole]
                h = (total[e] - total[s]) * back[s] + np.uint64(n)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                yield n, row[: len(whole)][whole] + first, place[: len(whole)][whole], (h ^ (h >> np.uint64(29))).view(np.int64)
        first = last


def containing(records: DataFrame, references: DataFrame, ord: str = "ord", text: str = "norm_text", words: int = 8) -> DataFrame:
    """(ord, ref): records whose text contains a reference's whole text, word by word.

    Texts are normal forms, words joined by single spaces; both tables have ord and text, the
    references' ord being ref. The hash of a reference's first words (so many, or all of a
    shorter one) is looked for among the records' windows of the same length, in one pass for
    so many references (``HEADS``); records that have one are then compared in full. Null and
    empty texts contain nothing and are contained nowhere.
    """
    known = references.where(F.length(text) > 0).select(F.col(ord).alias("ref"), F.col(text).alias("_t"), F.least(F.size(F.split(text, " ")), F.lit(words)).alias("_n"))
    rows = records.where(F.length(text) > 0).select(F.col(ord).alias("_o"), F.col(text).alias("_r"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = b.column("_n").to_numpy(), np.zeros(b.num_rows, np.int64)
            for k, row, place, h in _windows(b.column("_t"), sorted(set(n.tolist()))):
                own = (place == 0) & (n[row] == k)
                out[row[own]] = h[own]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "_h"])

    known = store(known.mapInArrow(heads, StructType([*known.schema.fields, StructField("_h", LongType())]))).df
    lengths = sorted(r["_n"] for r in known.select("_n").distinct().collect())  # at most `words` numbers
    parts = max(1, -(-known.count() // HEADS))

    def found(part: int) -> DataFrame:
        mine = known.where(F.pmod("_h", F.lit(parts)) == part)
        wanted = np.unique(mine.select("_h").distinct().toPandas()["_h"].to_numpy(np.int64))

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits: dict[int, set[int]] = {}
                for _, row, _, h in _windows(b.column("_r"), lengths) if len(wanted) else ():
                    hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                    for r, x in zip(row[hit].tolist(), h[hit].tolist()):
                        hits.setdefault(r, set()).add(x)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(list(hits), pa.int64())) for c in b.columns], pa.array([list(x) for x in hits.values()], pa.list_(pa.int64()))], [*b.schema.names, "_hits"])

        have = rows.mapInArrow(met, StructType([*rows.schema.fields, StructField("_hits", ArrayType(LongType()))]))
        return have.withColumn("_h", F.explode("_hits")).join(mine.select("ref", "_t", "_h"), "_h")

    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    pairs = reduce(DataFrame.union, [found(i) for i in range(parts)])
    return pairs.where(spaced("_r").contains(spaced("_t"))).select(F.col("_o").alias(ord), "ref").distinct()


POOL, BENCH, HELD_OUT = ("train", "corpus"), ("bench",), ("val", "test")


def layered_gate(records: DataFrame, layers: list[str], ord: str = "ord", split: str = "split", fingerprint: str | None = None, radius: int = 4) -> DataFrame:
    """Every record with its fate: reference, bench, held-out, a layer's name, or kept.

    The pool (train, corpus) loses what matches bench, then what matches val or test, then
    repeats by each layer in turn among what is left; first means the least ord. With a
    fingerprint (a 64-bit column, null where there is none) a last layer of that name
    follows: of the clusters within the radius among what is left, the first record stays,
    and matches within the radius of a reference are leaks as well.
    """
    records = store(records).df
    plan = None if fingerprint is None else band_plan(*[records.where(F.col(fingerprint).isNotNull()).count()] * 2, radius)
    pool = records.where(F.col(split).isin(*POOL))
    of = lambda names: records.where(F.col(split).isin(*names))
    bench = leaked(pool, of(BENCH), layers, ord, fingerprint, radius, plan).withColumn("_bench", F.lit(True))
    held = leaked(pool, of(HELD_OUT), layers, ord, fingerprint, radius, plan).withColumn("_held", F.lit(True))
    marked = records.join(bench, ord, "left").join(held, ord, "left")
    fate = F.when(~F.col(split).isin(*POOL), "reference").when(F.col("_bench"), "bench").when(F.col("_held"), "held-out")
    marked = store(marked.withColumn("fate", fate).drop("_bench", "_held")).df
    for layer in layers:
        least = marked.where(F.col("fate").isNull() & F.col(layer).isNotNull()).groupBy(layer).agg(F.min(ord).alias("_least"))
        marked = marked.join(least, layer, "left")
        marked = marked.withColumn("fate", F.when(F.col("fate").isNull() & (F.col(ord) > F.col("_least")), F.lit(layer)).otherwise(F.col("fate"))).drop("_least")
    if fingerprint is not None:
        marked = store(marked).df
        clusters = hamming_clusters(marked.where("fate is null"), radius, ord, fingerprint, plan).toDF(ord, "_cluster")
        marked = marked.join(clusters, ord, "left")
        marked = marked.withColumn("fate", F.when(F.col(ord) > F.col("_cluster"), F.lit(fingerprint)).otherwise(F.col("fate"))).drop("_cluster")
    return marked.fillna("kept", ["fate"])


def cluster_sizes(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Histogram (cluster_size, n_clusters)."""
    return members.groupBy(cluster).agg(F.count("*").alias("cluster_size")).groupBy("cluster_size").agg(F.count("*").alias("n_clusters"))


def calibration_distances(base: DataFrame, variants: DataFrame, seed: int = 7, id: str = "id", value: str = "h", kind: str = "kind") -> DataFrame:
    """(kind, d): distances of variants to their originals, and of random pairs of originals as `distinct`.

    base: id, value; variants: id of the original, kind, value. There are as many random pairs
    as variants of the most frequent kind: neighbours in orders drawn by seed, seed + 1 and so
    on. Null values take no part.
    """
    base, variants = store(base.where(F.col(value).isNotNull())).df, store(variants.where(F.col(value).isNotNull())).df
    near = variants.select(F.col(id).alias("_i"), F.col(kind).alias("kind"), F.col(value).alias("_v")).join(base, F.col("_i") == F.col(id)).select("kind", hamming(F.col("_v"), F.col(value)).alias("d"))
    sizes = near.groupBy("kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n, at, out = base.count(), 0, near
    while n > 1 and sizes > 0:
        drawn = numbered(base.withColumn("_draw", draw_key(id, seed + at)), ["_draw", id], "_r").select("_r", F.col(value).alias("_v"))
        pairs = drawn.join(drawn.select((F.col("_r") - 1).alias("_r"), F.col("_v").alias("_u")), "_r").where(F.col("_r") <= sizes)
        out = out.union(pairs.select(F.lit("distinct").alias("kind"), hamming(F.col("_v"), F.col("_u")).alias("d")))
        at, sizes = at + 1, sizes - (n - 1)
    return out


def suggested_threshold(rows: DataFrame, near: str, distinct: str = "distinct") -> DataFrame:
    """One row, threshold: halfway between the near kind's 99th and the distinct pairs' first hundredth, half to even."""
    q = quantiles(rows, "d", {"p99": 0.99, "p1": 0.01}, ["kind"])
    at = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    return q.agg(F.bround((at(near, "p99") + at(distinct, "p1")) / 2).cast("int").alias("threshold"))


def split_census(members: DataFrame, cluster: str = "cluster", split: str = "split") -> DataFrame:
    """(a, b, n): clusters that hold both splits, for each sorted pair of splits."""
    sets = members.groupBy(cluster).agg(F.sort_array(F.collect_set(split)).alias("s")).where("size(s) > 1")
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))

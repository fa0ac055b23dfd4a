"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has virtual nodes on a ring; a row goes to the first one clockwise from the hash
of its key. Rows are counted by arc (the stretch before a virtual node); the counts, as many
as there are virtual nodes, reach the driver, which walks the ring: a shard accepts its arcs'
rows up to its capacity, and what overflows continues clockwise to the next shard with room.
The result is a short table of (arc, range of ranks, shard), which each row meets by its arc.

A row's rank within its arc is not found by sorting the arc: the ring is cut into slices whose
number grows with the table, rows are counted by (arc, slice), and only a slice is sorted.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window, functions as F

from quillon.session import store

RING = 1 << 40
CELLS = 1024
#: Rows that are numbered by one sort, about, and cell counts that are broadcast at most.
SLICE_ROWS, SMALL_TABLE = 50_000, 100_000


def virtual_nodes(shards: int, each: int) -> list[tuple[int, int]]:
    """Sorted (position, shard)."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:5], "big")
    return sorted((at(s, v), s) for s in range(shards) for v in range(each))


def place(counts: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the rows of each arc go.

    capacity must hold all rows in sum. An arc's own rows come before any overflow; overflow
    of the arcs in ring order goes clockwise to the next owner with room.
    """
    room, out, over, used = list(capacity), [], [], [0] * len(capacity)

    def put(arc: int, lo: int, hi: int, s: int) -> None:
        out.append((arc, lo, hi, s, used[s]))
        used[s] += hi - lo
        room[s] -= hi - lo

    for arc in sorted(counts):
        s = owners[arc]
        n = min(counts[arc], room[s])
        if n:
            put(arc, 0, n, s)
        if n < counts[arc]:
            over.append((arc, n, counts[arc]))
    for arc, lo, hi in over:
        at = arc
        while lo < hi:
            at = (at + 1) % len(owners)
            n = min(hi - lo, room[owners[at]])
            if n:
                put(arc, lo, lo + n, owners[at])
                lo += n
    return out


def _arc(df: DataFrame, nodes: list[tuple[int, int]], name: str) -> DataFrame:
    """Adds the number of the first virtual node at or after _pos."""
    at = [p for p, _ in nodes]
    width = RING // CELLS
    cells = [(c, bisect_left(at, c * width), [p for p in at if c * width <= p < (c + 1) * width]) for c in range(CELLS)]
    table = df.sparkSession.createDataFrame(cells, "_cell int, _first int, _in array<long>")  # CELLS rows
    out = df.withColumn("_cell", (F.col("_pos") / width).cast("int")).join(F.broadcast(table), "_cell")
    arc = (F.col("_first") + F.size(F.filter("_in", lambda p: p < F.col("_pos")))) % len(nodes)
    return out.withColumn(name, arc).drop("_cell", "_first", "_in")


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", each: int = 64, law: str = "rows", load: float = 1.0) -> DataFrame:
    """docs with shard, slot and grown_shard added (such columns are replaced).

    law `rows`: loads are bounded by load times the mean count; at load 1.0 counts are at most
    one apart, the first shards having the larger ones. law `key`: no bound, the key and the
    number of shards decide, and grown_shard is the shard with one more shard on the ring.
    slot numbers a shard's rows from 0 without gaps, by ring position, key and text. A null
    key counts as a key of its own; repeated rows are placed one by one; an empty table gives
    no rows.
    """
    if law not in ("rows", "key") or load < 1:
        raise ValueError("law is rows or key, load at least 1")
    spark = docs.sparkSession
    nodes = virtual_nodes(shards, each)
    width = max(1, RING // (docs.count() // SLICE_ROWS + 1))
    names = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rows = _arc(rows.withColumn("_pos", F.pmod(F.xxhash64(F.col(f"_row.{key}"), F.lit(29)), F.lit(RING))), nodes, "_arc")
    rows = rows.withColumn("_slice", F.floor(F.col("_pos") / width))
    slices = store(rows.groupBy("_arc", "_slice").agg(F.count("*").alias("_n"))).df
    counts = {r["_arc"]: r["n"] for r in slices.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}  # at most one row for each virtual node
    n = sum(counts.values())
    if law == "key":
        capacity = [n] * shards
    elif load == 1:
        capacity = [n // shards + (s < n % shards) for s in range(shards)]
    else:
        capacity = [-int(-load * n // shards)] * shards
    plan = spark.createDataFrame(place(counts, [s for _, s in nodes], capacity), "_a int, _lo long, _hi long, shard int, _slot long")
    before = Window.partitionBy("_arc").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(F.col("_arc").alias("_sa"), F.col("_slice").alias("_ss"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if slices.count() <= SMALL_TABLE:
        starts = F.broadcast(starts)
    order = Window.partitionBy("_arc", "_slice").orderBy("_pos", F.col(f"_row.{key}").asc_nulls_last(), F.xxhash64(f"_row.{text}"))
    rows = rows.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    rows = rows.join(starts, (F.col("_arc") == F.col("_sa")) & (F.col("_slice") == F.col("_ss"))).withColumn("_rank", F.col("_rank") + F.col("_start"))
    out = rows.join(F.broadcast(plan), (F.col("_arc") == F.col("_a")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    out = out.withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_lo"))
    if law == "key":
        more = virtual_nodes(shards + 1, each)
        owner = F.array(*[F.lit(s) for _, s in more])
        out = _arc(out, more, "_new").withColumn("grown_shard", F.get(owner, F.col("_new"))).drop("_new")
    else:
        out = out.withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select("_row.*", "shard", "slot", "grown_shard")

"""Run events: retention, throttling, event log, live latest-by-run state.

Batch forms take any table; streaming forms take a streaming DataFrame and use state or
foreachBatch, with checkpoints in the folder given.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.prefix import running

EVENT = "_run string, _seq long, type string, step long, epoch int, loss double, elapsed_s double"
#: Events kept for replay: the newest of each class of a run.
STEP_CAP, OTHER_CAP, SAMPLE_CAP = 50_000, 5_000, 1


def retained(events: DataFrame, run: str, seq: str, kind: str, caps: dict[str, int], other: int) -> DataFrame:
    """The newest events of each run and kind, as many as its cap (other for kinds not named).

    Each class is ranked under a cap of its own, a literal, so every task drops what is beyond it
    before the shuffle and a run with very many events brings a few rows from each.
    """
    w = Window.partitionBy(run, kind).orderBy(F.desc(seq))
    known = F.col(kind).isin(*caps) if caps else F.lit(False)
    classes = [(F.col(kind) == k, n) for k, n in caps.items()] + [(~F.coalesce(known, F.lit(False)), other)]
    parts = [events.where(c).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n) for c, n in classes]
    return reduce(DataFrame.union, parts).drop("_rn")


def stamped(events: DataFrame, stream: str, seq: str, starts: Column) -> DataFrame:
    """Adds run, `<stream>#<n>` with n the number of starts up to the event; those before the first start have n = 0."""
    rows = running(events.withColumn("_start", F.coalesce(starts, F.lit(False)).cast("long")), [seq], ["_start"], [stream])
    return rows.withColumn("run", F.concat_ws("#", F.col(stream).cast("string"), F.col("_start_upto").cast("string"))).drop("_start").withColumnRenamed("_start_upto", "run_number")


def cleared(events: DataFrame, stream: str, number: str = "run_number") -> DataFrame:
    """What replay holds after a start has cleared the history: the events of each stream's last run."""
    last = events.groupBy(F.col(stream).alias("_s")).agg(F.max(number).alias("_n"))
    return events.join(last, F.col(stream).eqNullSafe(F.col("_s")) & (F.col(number) == F.col("_n"))).drop("_s", "_n")


JOB_END = "job exited rc="


def tailed(lines: DataFrame, log: str, n: str, line: str, seen: int = 0, end: str = JOB_END) -> DataFrame:
    """Lines of each log beyond the first `seen` numbers, up to its first line that says that the job ended."""
    stop = lines.where(F.col(line).contains(end)).groupBy(F.col(log).alias("_l")).agg(F.min(n).alias("_n"))
    out = lines.join(stop, F.col(log).eqNullSafe(F.col("_l")), "left")
    return out.where((F.col(n) > seen) & (F.col("_n").isNull() | (F.col(n) <= F.col("_n")))).drop("_l", "_n")


def throttled(events: DataFrame, run: str, ts: str, seq: str, every: str) -> DataFrame:
    """The last event of each run and time window."""
    return events.groupBy(run, F.window(ts, every).alias("_w")).agg(F.max(seq).alias(seq)).select(run, F.col("_w.start").alias("w"), seq)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over JSON lines that are appended as files (the console tail's seen-offset is the checkpoint)."""
    return spark.readStream.schema(EVENT).json(folder)


def write_log(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends all but sample events to a JSON log, exactly once."""
    return events.where("type <> 'sample'").writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "seqs array<long>, kinds array<string>"


def _keep_newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seqs, kinds = map(list, state.get) if state.exists else ([], [])
    for f in frames:
        seqs += f["_seq"].tolist()
        kinds += f["kind"].tolist()
    keep = []
    for kind, cap in (("sample", SAMPLE_CAP), ("step", STEP_CAP), ("other", OTHER_CAP)):
        keep += sorted((s for s, k in zip(seqs, kinds) if k == kind), reverse=True)[:cap]
    chosen = sorted(s for s in keep)
    by = dict(zip(seqs, kinds))
    state.update((chosen, [by[s] for s in chosen]))
    yield pd.DataFrame({"_run": [key[0]], "n": [len(chosen)], "first_seq": [chosen[0] if chosen else None], "last_seq": [chosen[-1] if chosen else None]})


def live_retention(events: DataFrame) -> DataFrame:
    """Per run, after each batch: how many events replay would hold and their range of numbers."""
    kind = F.when(F.col("type") == "sample", "sample").when((F.col("type") == "metric") & F.col("step").isNotNull(), "step").otherwise("other")
    rows = events.select("_run", "_seq", kind.alias("kind"))
    return rows.groupBy("_run").applyInPandasWithState(_keep_newest, "_run string, n long, first_seq long, last_seq long", STATE, "update", GroupStateTimeout.NoTimeout)


def live_throttle(events: DataFrame, every: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Streaming form of throttled(): event time from elapsed_s, late events within the watermark."""
    timed = events.withColumn("at", F.timestamp_seconds("elapsed_s")).withWatermark("at", late)
    return timed.groupBy("_run", F.window("at", every)).agg(F.max("_seq").alias("_seq"))

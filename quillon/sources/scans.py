"""Scans and sinks of the curation pipeline."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.operators.sampling import draw_key

SHARD = r"(train|val|test)-\d+-of-\d+\.parquet$"


def discover_shards(spark: SparkSession, root: str, expected: int = 14) -> list[str]:
    """Paths of the shards under root, sorted; of equal file names the first path wins.

    A count other than expected is an error (0 turns that off). Only file names are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").rlike(SHARD))
    paths = sorted(r["path"] for r in named.groupBy("name").agg(F.min("path").alias("path")).collect())
    if expected and len(paths) != expected:
        raise ValueError(f"{len(paths)} shards under {root}; {expected} expected")
    return paths


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """filename, svg and split, which is the start of the shard's name."""
    rows = spark.read.parquet(*paths)
    return rows.select(F.col("Filename").alias("filename"), F.col("Svg").alias("svg"), F.regexp_extract(F.col("_metadata.file_name"), SHARD, 1).alias("split"))


def read_drawings(spark: SparkSession, root: str) -> DataFrame:
    """path and svg of every .svg file under root, one row a file."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.svg").text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("svg"))


def sample_drawings(spark: SparkSession, root: str, n: int, seed: int) -> DataFrame:
    """path and svg of n of the .svg files under root (all, if there are fewer), drawn by path and seed.

    Only names are listed for the draw; only the drawn files are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.svg").load(root).select("path")
    drawn = [r["path"] for r in files.orderBy(draw_key("path", seed), "path").limit(n).collect()]  # n names
    if not drawn:
        return spark.createDataFrame([], "path string, svg string")
    return spark.read.option("wholetext", True).text(drawn).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("svg"))


def last_wins(lines: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, value): of the lines of a key the last one in the order counts."""
    return lines.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def read_manifest(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """sha and split of JSON-lines manifests; the last line of a sha wins, files going by their paths.

    wanted: only its shas (column sha). Lines of one file are in order within the pieces it is
    read in, and the pieces by their place in it.
    """
    rows = spark.read.schema("sha string, split string").json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_line")).where("sha is not null")
    if wanted is not None:
        rows = rows.join(wanted.select("sha").distinct(), "sha", "left_semi")
    return last_wins(rows, "sha", "split", "_file", "_at", "_line")


def off_split(rows: DataFrame, split: str, wanted: str, key: str) -> DataFrame:
    """Keys of the rows whose split isn't the wanted one (a null split isn't)."""
    return rows.where(~F.col(split).eqNullSafe(F.lit(wanted))).select(key)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("sha")).where("sha <> ''").distinct()


def append_ledger(rows: DataFrame, path: str, sha: str = "sha") -> None:
    rows.select(sha).write.mode("append").text(path)


def sample_dirs(spark: SparkSession, root: str, flagged: DataFrame | None = None) -> DataFrame:
    """Names of complete samples: clean.png and at least one wrecked_*.png, no leading _, not flagged."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.slice(F.split("path", "/"), -2, 2).alias("p"))
    dirs = files.select(F.col("p")[0].alias("name"), F.col("p")[1].alias("file")).groupBy("name").agg(F.max((F.col("file") == "clean.png").cast("int")).alias("c"), F.count_if(F.col("file").rlike(r"^wrecked_.*\.png$")).alias("n"))
    out = dirs.where("c = 1 and n > 0 and not startswith(name, '_')").select("name")
    if flagged is not None:
        out = out.join(flagged.select("name"), "name", "left_anti")
    return out.orderBy("name")


def read_metas(spark: SparkSession, root: str) -> DataFrame:
    """meta.json of every sample, with a common `ops` view: recipes of either version."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").json(root)
    return rows.withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_palettes(spark: SparkSession, root: str) -> DataFrame:
    """(name, entry, r, g, b, background) of every palette.json; entry 0 is background unless it says otherwise."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "palette.json").text(root)
    told = rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("name"), F.from_json("value", "palette array<array<int>>, background_index int").alias("p"))
    each = told.select("name", F.coalesce("p.background_index", F.lit(0)).alias("of"), F.posexplode("p.palette").alias("entry", "c"))
    return each.select("name", "entry", *[F.get("c", i).alias(k) for i, k in enumerate("rgb")], (F.col("entry") == F.col("of")).alias("background"))


#: Settings of a run that the readers know; others stay in `settings`, as JSON.
RUN = "name string, data_root string, n int, batch_size int, num_workers int, lr double, max_epochs int, ckpt_dir string"


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """(run, the columns of RUN, settings) of a plan: its runs in order, from 1; null where a run says nothing."""
    rows = spark.read.option("wholetext", True).text(path)
    runs = rows.select(F.posexplode(F.from_json("value", "runs array<string>")["runs"]).alias("i", "settings"))
    return runs.select((F.col("i") + 1).alias("run"), F.from_json("settings", RUN).alias("s"), "settings").select("run", "s.*", "settings")


def write_tiers(rows: DataFrame, out: str) -> None:
    """Drawings by tier and first two digits of their sha, the manifest as JSON lines, a summary."""
    rows.withColumn("prefix", F.substring("sha", 1, 2)).write.mode("overwrite").partitionBy("tier", "prefix").parquet(f"{out}/drawings")
    rows.drop("svg").write.mode("overwrite").partitionBy("tier").json(f"{out}/manifest")
    rows.groupBy("tier").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{out}/summary")


def write_drawings(rows: DataFrame, out: str) -> int:
    """Writes each drawing to `<out>/<tier>/<first two digits>/<sha>.svg`; the number of rows.

    out is a path or URI that the executors share. A repeated task writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, base = fs.FileSystem.from_uri(out) if "://" in out else (fs.LocalFileSystem(), out)
        made: set[str] = set()
        for b in batches:
            for sha, tier, svg in zip(*(b.column(c).to_pylist() for c in ("sha", "tier", "svg"))):
                folder = f"{base}/{tier}/{sha[:2]}"
                if folder not in made:
                    store_.create_dir(folder)
                    made.add(folder)
                with store_.open_output_stream(f"{folder}/{sha}.svg") as f:
                    f.write((svg or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select("sha", "tier", "svg").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def with_ord(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ord, the row's place by the keys, in two steps: ranges are sorted in parallel, then offset."""
    parts = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    counts = parts.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("_m"))
    offsets = counts.select("_p", "_m", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_o"))
    return parts.join(F.broadcast(offsets), "_p").withColumn("ord", F.col("_i") - F.col("_m") + F.col("_o")).drop("_p", "_i", "_m", "_o")

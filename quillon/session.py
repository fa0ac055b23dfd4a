"""Session helpers: tuning defaults, and tables written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillon")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` or the context's own checkpoint folder. Where
    neither is set, a local master gets a temporary folder; a cluster gets an error,
    for a machine-local folder would lose rows there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and the executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return sc._jsc.sc().getCheckpointDir().get()


_TABLES: list[Stored] = []


class Stored:
    """A table in the shared folder: ``df`` reads it, ``drop()`` deletes it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        if self in _TABLES:
            _TABLES.remove(self)


def store(df: DataFrame) -> Stored:
    """Writes df once to the shared folder; later reads survive lost executors and have no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = Stored(spark, path)
    _TABLES.append(out)
    return out


class Scratch:
    """Drops the tables stored within a ``with`` block at its end, but for those kept.

    For blocks whose results are written before they end; a DataFrame that is returned from one
    and read later must not depend on a table that is dropped.
    """

    def __enter__(self) -> Scratch:
        self.before, self.kept = list(_TABLES), []
        return self

    def keep(self, table: Stored) -> Stored:
        self.kept.append(table)
        return table

    def __exit__(self, *error) -> None:
        for t in [t for t in _TABLES if t not in self.before and t not in self.kept]:
            t.drop()

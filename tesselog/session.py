"""Session helpers: building a session, reading tables and keeping intermediate tables.

Intermediate tables are written as Parquet into the shared folder named by
``spark.checkpoint.dir``; reading them back cuts the lineage and survives the
loss of any executor.  The JVM removes them when it ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").config(map=base).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each context, however the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_has_tesselog", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder_ = tempfile.mkdtemp(prefix="tesselog-ship-")  # the driver serves it until it ends
    atexit.register(shutil.rmtree, folder_, ignore_errors=True)
    out = os.path.join(folder_, "tesselog.zip")
    with zipfile.ZipFile(out, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(out)
    context._has_tesselog = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, as a lazy scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """``df`` with at least one partition for each core; one whose ``scan`` (itself, if not given) has them already, as any large table, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if (df if scan is None else scan).rdd.getNumPartitions() >= cores else df.repartition(cores)


def once(rows: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """One row for each value of ``key`` (not null): the last by ``latest``, then by the other columns in order of their names.

    Which keys occur again is counted on the key alone and written first: where
    these keys are few enough to be broadcast, only their rows are shuffled, the
    others pass through where they were read.
    """
    rows = rows.where(F.col(key).isNotNull())
    again = materialise(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "again")
    order = [F.desc(c) for c in ([latest] if latest else []) + sorted(c for c, t in rows.dtypes if c not in (key, latest) and not t.startswith(("map", "variant")))]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    several = rows.join(again, key, "left_semi").withColumn("_place", place).where("_place = 1").drop("_place")
    return rows.join(again, key, "left_anti").unionByName(several)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master that names none."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    own = getattr(spark, "_tesselog_dir", None)
    if own is None:
        own = spark._tesselog_dir = "file://" + tempfile.mkdtemp(prefix="tesselog-")
    return own


@contextmanager
def _drops_shuffles(spark: SparkSession):
    """Shuffle files of the enclosed writes are removed when each write ends."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/tesselog/{name}-{uuid.uuid4().hex}"
    with _drops_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tesselog_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_tesselog_path", None)
        if not path:
            continue
        context = df.sparkSession.sparkContext
        hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop_path, True)

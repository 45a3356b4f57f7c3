"""Session settings and the shared stage folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(
    master: str | None = None, app: str = "tidemark", **conf: str
) -> SparkSession:
    """Session with the settings the library expects; a cluster's own values win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A local session without the setting gets a temporary folder. On a cluster a
    machine-local folder would lose data with its executor, so that is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage(df: DataFrame, name: str, spread_by: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where one result feeds several jobs: the plan behind it runs once, the
    columns stay prunable, and a lost executor only costs a re-read. ``spread_by``
    deals the rows into as many files as there are shuffle partitions, for tables
    that are small in bytes but feed heavy work per row.
    """
    if spread_by:
        # A hash of the key: on the key itself a join's coalesced layout would be kept.
        df = df.repartition(shuffle_width(df.sparkSession), F.xxhash64(spread_by))
    path = f"{stage_root(df.sparkSession)}/stage/{name}-{uuid.uuid4().hex}"
    for made in _passing:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession):
    """Tables staged inside are removed at the end, and shuffle files with the step they serve.

    For a part of a job whose result is a few figures that the driver holds.
    """
    key, made = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    _passing.append(made)
    try:
        yield
    finally:
        _passing.remove(made)
        spark.conf.set(key, before)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where the package is on the driver's path only. Spark's own file
    distribution carries the archive to the executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / package.name
    archive = shutil.make_archive(str(base), "zip", root_dir=package.parent, base_dir=package.name)
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)

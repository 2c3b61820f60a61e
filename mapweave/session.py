"""Session settings and lineage cutting for iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app_name: str = "mapweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow).

    Shuffle parallelism is left to the caller: set ``spark.sql.shuffle.partitions``
    (or AQE's ``coalescePartitions.initialPartitionNum``) for the cluster at hand.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut-off tables: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_ROOTS:
        folder = tempfile.mkdtemp(prefix="spark-mapweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_ROOTS[context.applicationId] = folder
    return _LOCAL_ROOTS[context.applicationId]


_RUNS: dict[str, str] = {}
_OPEN: list[list[str]] = []


def run_folder(spark: SparkSession) -> str:
    """This application's folder under the shared one. It is removed when the driver's process ends."""
    name = spark.sparkContext.applicationId
    if name not in _RUNS:
        _RUNS[name] = f"{checkpoint_root(spark)}/mapweave/{name}"
        atexit.register(_remove_at_exit, spark, _RUNS[name])
    return _RUNS[name]


#: Names of the bucketed tables, by their paths.
_TABLES: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    if path in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the JVM may be gone by then
        for name in _TABLES.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        _remove(spark, path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are materialised inside, for a caller that removes them later."""
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        _OPEN.pop()


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _remove(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are removed at the end: for callers that have written their result by then."""
    with recorded() as paths:
        try:
            yield
        finally:
            remove_tables(spark, paths)


def materialize_bucketed(df: DataFrame, column: str) -> DataFrame:
    """``materialize`` as a table that is bucketed and sorted by ``column``: joins on it don't move its rows again."""
    spark = df.sparkSession
    name = f"mapweave_{uuid.uuid4().hex}"
    path = f"{run_folder(spark)}/{name}"
    if _OPEN:
        _OPEN[-1].append(path)
    _TABLES[path] = name
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(name)
    saved = spark.table(name)
    saved._mapweave_path = path
    return saved


def write_folders(df: DataFrame, column: str) -> str:
    """``df`` written with a folder for each value of ``column``; its path in the run's folder."""
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.partitionBy(column).parquet(path)
    return path


def materialize(df: DataFrame, replaces: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    A written table cuts the lineage, survives the loss of executors, is computed
    once and keeps column pruning for its readers. ``replaces`` names the table of
    an earlier round that nothing reads any more; its files are removed. ``keep``: until the application ends, also
    inside ``scratch`` or ``recorded``.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved._mapweave_path = path
    old = getattr(replaces, "_mapweave_path", None)
    if old:
        _remove(spark, old)
    return saved

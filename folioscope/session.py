"""Session helpers: builder defaults and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC times. On a cluster leave ``master`` unset."""
    builder = (
        SparkSession.builder.appName("folioscope")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset and the master is
    local (tests) a folder of our own, which is then remembered in the session and removed at exit."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="folioscope-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = "file://" + own
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    """Deletes what :func:`materialize` wrote, as far as the sessions still answer."""
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:
            return


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below :func:`shared_dir` and read it again.

    Cuts the lineage like ``checkpoint()``, but columnar and compressed, so later passes read only
    the columns they need. The files outlive executors; they are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioscope-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, limit_bytes: int = 8 << 20) -> bool:
    """Whether the optimiser's size estimate of a *materialized* ``df`` proves it below the limit.
    Used before a broadcast hint; the estimate of a Parquet scan is its size in bytes on disk."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= limit_bytes


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy per row.

    A table read from many files or splits passes unchanged; a single small file is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

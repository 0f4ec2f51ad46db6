"""Session helpers: table loading and lineage cuts that survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, as parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (as in tests) gets a temporary folder, once; on a cluster
    an executor couldn't read what another one wrote there, so it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named or sc.getCheckpointDir()


def _cuts(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cuts-{spark.sparkContext.applicationId}"


#: Spark's setting to remove shuffle files when their query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    Unlike a local checkpoint the files outlive any executor. The shuffle files of the write are of
    no more use when it is done, and are removed then.
    """
    spark = df.sparkSession
    path = f"{_cuts(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(*cuts: DataFrame) -> None:
    """Deletes what these results of :func:`cut` stand on. Only for tables that nothing lazy reads any more."""
    for df in cuts:
        if getattr(df, "_cut_path", None):
            _delete(df.sparkSession, df._cut_path)


def clear_cuts(spark: SparkSession) -> None:
    """Deletes what the session's :func:`cut` wrote so far. To be called when the results that stand on it have been written."""
    _delete(spark, _cuts(spark))


def sized_broadcast(small: DataFrame, rows: int, bound: int = 100_000) -> DataFrame:
    """``small`` with a broadcast hint if its counted ``rows`` are within ``bound``; else as it is."""
    return small.hint("broadcast") if rows <= bound else small


#: Rows beyond which a table is not broadcast however small its files are.
MANY = 100_000


def no_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a hint that keeps Spark from broadcasting it if its counted ``rows`` are more than ``MANY``; else as it is.

    Spark goes by the bytes of files, and packed ids take few: some copies of a table just below its
    limit, built at once for one plan, fill the driver.
    """
    return df if rows <= MANY else df.hint("merge")

"""Session helpers shared by tests, bench and queries."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they wouldn't find it by themselves.

    They do if the driver runs in the repository or has it in PYTHONPATH. Otherwise the package is
    zipped once per application; Spark serves the file to its executors.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = {os.path.abspath(p or ".") for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    app = spark.sparkContext.applicationId
    if root in known or app in _shipped:
        return
    _shipped.add(app)
    staged = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "quarrylake"), "zip", root, "quarrylake")
    spark.sparkContext.addPyFile(staged)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table NAME of a folder of Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a shared folder")
    return os.path.join(os.path.abspath(spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").removeprefix("file:")), "checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_written: list[tuple[str, str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for what several parts of a plan read, each with its own columns.

    Tables are deleted when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_delete_written, spark)
    _written.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete_written(spark: SparkSession) -> None:
    try:
        sc = spark.sparkContext
        for app, path in _written:
            if app == sc.applicationId:
                p = sc._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before: what it left lies in its checkpoint folder
        pass

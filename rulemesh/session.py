"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rulemesh")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# The folders of local sessions without a shared one, by application.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one.

    That is ``spark.checkpoint.dir``, else the folder of ``SparkContext.setCheckpointDir``. Only
    a session whose executors run in the driver's process (a test) may go without and gets a
    folder of its own; elsewhere the executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own_folders.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="rulemesh-")
        _own_folders[spark.sparkContext.applicationId] = named
    return f"{named.rstrip('/')}/rulemesh-{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame, split_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read on from it.

    With ``split_by`` rows of different values of that column lie in different files, so a
    filter on it reads only its own.

    Unlike an RDD checkpoint the table is columnar, so later steps read only
    their columns, and its size is known to the planner. It outlives executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write if split_by is None else df.write.partitionBy(split_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*(F.col(f"`{c}`") for c in df.columns))


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results read from them must be stored before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed by the page-structure functions, the only ones that run in Python,
    when the job was not submitted with the package in ``--py-files``.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="rulemesh-"), "rulemesh"),
        "zip",
        root_dir=os.path.dirname(package),
        base_dir=os.path.basename(package),
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)

"""Session helpers: tests' and benchmarks' sessions, and shipping this package to executors that lack it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g", app: str = "vecloom") -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they start; done once per application.

    The driver serves the archive to the executors, so only the driver's own disk is used for it.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="vecloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def shared_folder(spark: SparkSession, what: str) -> str:
    """The folder of ``spark.checkpoint.dir``, shared by the cluster. Without one a temporary folder serves a local
    session; a cluster is refused, as its executors would not find the files again."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the cluster shares: {what} are kept there")
    return tempfile.mkdtemp(prefix="vecloom-")


def _checkpoints(spark: SparkSession) -> str:
    """The folder of checkpoints, set on first use (see :func:`shared_folder`)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df):
    """Checkpoint in the folder of ``spark.checkpoint.dir``."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df):
    """``df`` written as a compressed table in the shared folder, and read back: a lineage cut for tables that are large
    beside their input, of which a checkpoint would keep plain rows. The tables are deleted when the program ends."""
    spark = df.sparkSession
    path = f"{_checkpoints(spark)}/vecloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session ended before
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)

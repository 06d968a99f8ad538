"""Sessions, table access, staging and size checks shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch between the JVM and Python; Spark's own 10,000 are too many for long texts.
ARROW_ROWS = 1000


def get_spark(app: str = "ferrule", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster pass your own session instead."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    return builder.config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context, so that they need no installed copy.

    Also makes Arrow batches of whole documents ARROW_ROWS long, unless the session has a number of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if getattr(context, "_ferrule_shipped", False):
        return
    root, d = Path(__file__).resolve().parent, tempfile.mkdtemp()
    atexit.register(shutil.rmtree, d, ignore_errors=True)  # the context serves the archive as long as it lives
    shutil.copytree(root, Path(d, "src", root.name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{d}/{root.name}", "zip", f"{d}/src"))
    context._ferrule_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test directory; the path may live in any store that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staging_root(spark: SparkSession) -> str:
    """This application's folder in the shared folder of the cluster (spark.checkpoint.dir). Where that is unset, as in
    tests, a folder of our own, which goes with the process.

    A session that is not local and has no shared folder is refused: a machine-local folder would not be seen by
    other executors.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/ferrule-{context.applicationId}"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = os.path.join(tempfile.gettempdir(), f"ferrule-stage-{os.getpid()}")
    if not getattr(context, "_ferrule_staged", False):
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        context._ferrule_staged = True
    return f"file://{root}/ferrule-{context.applicationId}"


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stage(df: DataFrame, name: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ferrule_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a frame that stage() made, once nothing that is still to run reads it."""
    fs, at = _folder(df.sparkSession, df._ferrule_path)
    fs.delete(at, True)


#: Bytes of Parquet files that may be broadcast; in memory they take up to some 25 times as much.
MAX_BROADCAST_BYTES = 4 << 20


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df staged, with a broadcast hint if it has at most so many rows and MAX_BROADCAST_BYTES; else Spark joins it by
    shuffle."""
    df = stage(df, "side")
    fs, at = _folder(df.sparkSession, df._ferrule_path)
    small = fs.getContentSummary(at).getLength() <= MAX_BROADCAST_BYTES and df.count() <= rows
    return F.broadcast(df) if small else df


def drop_staged(spark: SparkSession) -> None:
    """Delete what stage() left in this application; for when no staged frame is used any more."""
    fs, at = _folder(spark, staging_root(spark))
    fs.delete(at, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df, from file sizes; an upper guide for partition counts, never for results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

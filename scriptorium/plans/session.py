"""Session helpers: sessions for tests and benches, code shipping, shared-folder tables."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "scriptorium.shipped"


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library assumes (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("scriptorium")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session.

    Python workers unpickle functions by module name, so they must be able to import the package
    even where the repository folder is not on their path.
    """
    context = spark.sparkContext
    if getattr(context, "_scriptorium_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="scriptorium-"), "scriptorium.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(target)
    context._scriptorium_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in one process (tests) a temporary folder is used and
    removed at exit; on a cluster that is an error, since executors could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(context, "_scriptorium_dir", None):
        folder = tempfile.mkdtemp(prefix="scriptorium-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context._scriptorium_dir = f"file://{folder}"
    return context._scriptorium_dir


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/scriptorium-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage (a lost executor costs a re-read, not a re-computation) and gives Catalyst
    real sizes for what follows.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scriptorium_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that nothing reads any more; others stay."""
    for rows in tables:
        path = rows.__dict__.get("scriptorium_path")
        if path:
            delete(rows.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished plans removed, which else stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where their source has too few parts for that (one small file, say).

    Sources with at least half as many parts as there are cores are left as they are, so on large
    inputs no shuffle is added.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

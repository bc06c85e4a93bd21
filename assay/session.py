"""Session settings that every job of the library expects."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "assay", cores: int | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ASSAY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset (tests, local runs) a folder of our own is made; the context keeps it, as the setting is
    static and cannot be set in a running session.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="assay-checkpoint-"))
    return named or context.getCheckpointDir()


#: Cuts between two collections of what earlier ones have left.
CUTS = 4


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files (and checkpoints, if so set) of tables that nobody holds: it does so only after the
    driver's JVM has collected them, which a loop of many small jobs may not cause for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and drop its lineage; survives lost executors. Every CUTS-th one releases what is left over."""
    context = df.sparkSession.sparkContext
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    context._assay_cuts = getattr(context, "_assay_cuts", 0) + 1
    if context._assay_cuts % CUTS == 0:
        release(df.sparkSession)
    return kept


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context; a cluster may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_assay_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="assay-package-"), "assay.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    context._assay_shipped = True

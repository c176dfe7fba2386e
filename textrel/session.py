"""Session helpers: a local session for tests, shared-folder checkpoints, table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session with the settings the library expects (ANSI, AQE, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textrel")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    importable(spark)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared checkpoint folder.

    The folder is the one the session names in ``spark.checkpoint.dir``. A temporary folder is used only where that
    setting is absent and the master is local, since executors elsewhere could not read it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="textrel-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they share that folder."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (home, known) if x)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder with one Parquet file or directory per table."""
    importable(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))

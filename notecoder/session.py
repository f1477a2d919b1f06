"""Session helpers: local sessions for tests and benchmarks, checkpoint folder."""
from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the engine expects of any session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("notecoder")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder named in ``spark.checkpoint.dir``.

    A folder of our own is set only where none is configured and the master is local.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="notecoder-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once."""
    sc = spark.sparkContext
    if not getattr(sc, "_notecoder_shipped", False):
        root = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="notecoder-package-")) / "notecoder"
        sc.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
        sc._notecoder_shipped = True

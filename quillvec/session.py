"""Session set-up for local runs, and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app_name: str = "quillvec", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local-mode session, where driver and executors are one machine, may
    go without the setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="quillvec-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there.

    Needed where row placement becomes data (dense ids): a lost executor must
    not lead to a second, differently ordered evaluation. The shuffles that led
    here go at once; else they fill the disks until the driver collects its garbage.
    """
    shared_dir(df.sparkSession)
    # A plan of its own: ``df`` itself may have been run, and may run again.
    own = df.select("*")
    pinned = own.checkpoint(eager=True)
    own._jdf.queryExecution().toRdd().cleanShuffleDependencies(True)
    return pinned

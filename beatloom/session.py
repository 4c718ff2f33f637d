"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "beatloom") -> SparkSession:
    """Session for tests and local runs. On a cluster, submit with these settings and its own sizes."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", os.environ.get("BEATLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in spark.checkpoint.dir.

    A local session, whose executors are the driver itself, may do without and gets a scratch folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("BEATLOOM_TEST_DIR")
    if not root and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        root = os.environ["BEATLOOM_TEST_DIR"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables below the shared root."""
    return f"{shared_root(spark)}/beatloom/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut a long lineage: write the frame to the checkpoint folder and go on from there.

    Ordered operators read their input twice, so a chain of them grows its plan with every step;
    composite jobs call this between their stages.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()

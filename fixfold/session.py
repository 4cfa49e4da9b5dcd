"""Session helpers: one place for the configuration every job relies on.

Nothing here starts a server: the UI stays off and only the ports a local
Spark session opens by itself are used.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings a job needs to behave the same on a laptop and on a cluster.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "fixfold") -> SparkSession:
    """Build (or reuse) a session.

    A master, a shuffle width or a driver memory that the environment sets stays
    as it is; without any master a local session of ``$BENCH_CPUS`` cores is made."""
    conf = SparkConf()
    builder = SparkSession.builder.appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master or not conf.contains("spark.master"):
        builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        if not conf.contains("spark.driver.memory"):
            builder = builder.config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` wins.  Only a local session, whose tasks all run on
    this machine, may go without it: it gets a fresh scratch folder.  On a
    cluster the setting is needed, for a folder of one machine would not do."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="fixfold-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
